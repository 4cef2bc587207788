"""The registry of deal pages as tables: due set, lists, state from check events, cadence, upserts, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions.price import js_round, to_fixed

HOUR = 3_600_000
DAY = 24 * HOUR
NEVER = 9_007_199_254_740_991  # nextCheckAt of an excluded record
ALPHA = 0.3
LEAST_HOURS, MOST_HOURS = 1.0, 168.0
CHANGE_WEIGHT, DENSITY_WEIGHT = 166.0, 1.0
PARK_AFTER = 2
STRATEGY_DAYS, STRATEGY_FAILURES, MOST_STRATEGIES = 7, 3, 500
MEMO_HOURS = 12


def due(registry: DataFrame, now: Column | int, cap: int | None = 5) -> DataFrame:
    """G1: what to check next, one page for each domain: pinned, active, stale, parked, the longest due first."""
    now = F.lit(now) if isinstance(now, int) else now
    order = F.when(F.col("status") == "pinned", 0).when(F.col("status") == "active", 1).when(F.col("status") == "stale", 2).otherwise(3)
    at = F.when(F.col("status") == "parked", F.coalesce("revisitAfter", F.lit(0))).otherwise(F.col("nextCheckAt"))
    rows = registry.where(~F.col("status").isin("excluded", "candidate") & (at <= now)).withColumn("prio_", order)
    first = F.row_number().over(Window.partitionBy("domain").orderBy("prio_", "nextCheckAt", "id"))
    rows = rows.withColumn("n_", first).where("n_ = 1").drop("n_")
    rows = rows.orderBy("prio_", "nextCheckAt", "id")
    return (rows if cap is None else rows.limit(cap)).drop("prio_")


def listing(registry: DataFrame, domain: str | None = None, status: list[str] | None = None, sort: str = "nextCheckAt", limit: int = 100) -> DataFrame:
    """H1: filtered records in ascending order of one key, null as 0."""
    if sort not in ("nextCheckAt", "lastVerifiedAt", "finalScore", "lastSeenAt"):
        raise ValueError(f"unknown sort key {sort!r}")
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1..500")
    rows = registry
    if domain:
        rows = rows.where(F.col("domain") == domain)
    if status:
        rows = rows.where(F.col("status").isin(status))
    return rows.orderBy(F.coalesce(F.col(sort), F.lit(0)), "id").limit(limit)


def mark_stale(registry: DataFrame, now: Column | int, after_ms: int = DAY) -> DataFrame:
    """Active records not verified for a day become stale."""
    now = F.lit(now) if isinstance(now, int) else now
    old = (F.col("status") == "active") & (now - F.coalesce("lastVerifiedAt", F.lit(0)) > after_ms)
    return registry.withColumn("status", F.when(old, "stale").otherwise(F.col("status")))


def evict(registry: DataFrame, now: int, cap: int = 5000) -> DataFrame:
    """down to the cap: long overdue parked records go first, then the longest unseen; pinned and active stay."""
    safe = F.col("status").isin("pinned", "active")
    overdue = (F.col("status") == "parked") & (F.col("revisitAfter") < now - 365 * DAY)
    excess = registry.agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("excess"))
    # so many of the order are to go: a sort and a bounded index, not a window over one partition
    order = [F.when(overdue, 0).otherwise(1), F.coalesce("lastSeenAt", F.lit(0)), F.col("id")]
    n = excess.first()["excess"]
    if not n:
        return registry
    gone = registry.where(~safe).orderBy(*order).limit(n).select("id")
    return registry.join(gone, "id", "left_anti").select(*registry.columns)


def interval_hours(change_rate: Column, density: Column) -> Column:
    """Hours between checks by a page's own changes and deals."""
    return F.least(F.greatest(F.lit(MOST_HOURS) / (F.lit(1.0) + F.lit(CHANGE_WEIGHT) * change_rate + F.lit(DENSITY_WEIGHT) * density), F.lit(LEAST_HOURS)), F.lit(MOST_HOURS))


def next_check(status: Column, revisit: Column, change_rate: Column, density: Column, now: Column, jitter: Column | float = 1.0) -> Column:
    """When to check next, epoch milliseconds; jitter is a factor of 0.85..1.15 that the caller injects."""
    j = F.lit(float(jitter)) if isinstance(jitter, (int, float)) else jitter
    return F.when(status == "parked", F.coalesce(revisit, now + 30 * DAY)).otherwise(now + js_round(interval_hours(change_rate, density) * j * HOUR)).cast("long")


def seasonal_wake(months: Column, now: Column) -> Column:
    """The first of the next month in which a page was ever live, in UTC; 30 days without any."""
    at = F.timestamp_millis(now)
    month, year = F.month(at), F.year(at)
    later = F.array_min(F.filter(months, lambda m: m > month))
    first = lambda y, m: F.unix_millis(F.make_date(y, m, F.lit(1)).cast("timestamp"))
    target = F.coalesce(later, F.array_min(months))
    this = first(year, target)
    return F.when(F.size(months) == 0, now + 30 * DAY).otherwise(F.when(this <= now, first(year + 1, target)).otherwise(this)).cast("long")


def fold_checks(checks: DataFrame) -> DataFrame:
    """The state of each record after its checks (record_id, ts, event_id, kind, density, changed).

    kind is ok, miss or blocked; a blocked check changes nothing. The moving averages follow their closed form
    over the numbered checks, so a record is a window and an aggregate, not a loop. A record is one page.
    With a column productCount its average is told too; with firstScore (the score a record was found with, at
    most 1) the final score, which every success draws towards 1 and nothing lowers.
    """
    w = Window.partitionBy("record_id").orderBy("ts", "event_id")
    back = Window.partitionBy("record_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = checks.where("kind <> 'blocked'").withColumn("n", F.row_number().over(w))
    ok = F.col("kind") == "ok"
    rows = rows.withColumn("oks", F.sum(F.when(ok, 1).otherwise(0)).over(w)).withColumn("later", F.sum(F.when(ok, 1).otherwise(0)).over(back) - F.when(ok, 1).otherwise(0))
    rows = rows.withColumn("last_miss", F.sum(F.when(ok, 1).otherwise(0)).over(back))  # 0: in the closing run of misses
    decay = F.pow(F.lit(1 - ALPHA), F.col("later"))
    # the very first check takes its sample whole; after a first miss the average starts from 0
    own = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.lit(ALPHA))
    more = []
    if "productCount" in checks.columns:
        more.append(F.coalesce(F.sum(F.when(ok, own * F.col("productCount") * decay)), F.lit(0.0)).alias("avgProductCount"))
    if "firstScore" in checks.columns:
        first = F.min_by("firstScore", "n")
        more.append((F.lit(1.0) - (F.lit(1.0) - first) * F.pow(F.lit(1 - ALPHA), F.count_if(ok))).alias("finalScore"))
    return rows.groupBy("record_id").agg(
        F.count("*").alias("checkCount"),
        F.count_if(ok).alias("successCount"),
        F.count_if(F.col("last_miss") == 0).alias("consecutiveMisses"),
        F.coalesce(F.sum(F.when(ok, own * F.col("density") * decay)), F.lit(0.0)).alias("dealDensity"),
        F.coalesce(F.sum(F.when(ok, F.lit(ALPHA) * F.col("changed").cast("double") * decay)), F.lit(0.0)).alias("changeRate"),
        F.max("ts").alias("lastCheckAt"),
        F.max(F.when(ok, F.col("ts"))).alias("lastVerifiedAt"),
        F.array_sort(F.collect_set(F.when(ok, F.month("ts")))).alias("seasonHint"),
        *more,
    ).withColumn("status", F.when(F.col("consecutiveMisses") >= PARK_AFTER, "parked").when(F.col("consecutiveMisses") == 0, "active").when(F.col("successCount") > 0, "stale").otherwise("candidate"))


def upsert(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """insert new pages, refresh known ones (last seen, label, the last 20 of the joined evidence)."""
    s = seen.select("id", F.col("url").alias("s_url"), F.col("domain").alias("s_domain"), F.col("label").alias("s_label"), F.col("evidence").alias("s_evidence"), F.col("seenAt").alias("s_seen"), F.col("accepted").alias("s_accepted"))
    evidence = F.array_union(F.coalesce("evidence", F.array().cast("array<string>")), F.coalesce("s_evidence", F.array().cast("array<string>")))
    return registry.join(s, "id", "full_outer").select(
        "id",
        F.coalesce("url", "s_url").alias("url"),
        F.coalesce("domain", "s_domain").alias("domain"),
        F.coalesce("s_label", "label").alias("label"),
        F.coalesce("status", F.when(F.col("s_accepted"), "active").otherwise("candidate")).alias("status"),
        F.coalesce("s_seen", "lastSeenAt").alias("lastSeenAt"),
        F.slice(evidence, F.greatest(F.size(evidence) - 19, F.lit(1)), 20).alias("evidence"),
    )


def import_records(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming records replace or join the registry's; pinned and excluded ones survive. Last of an id wins."""
    w = Window.partitionBy("id").orderBy(F.desc("ord"))
    last = incoming.withColumn("n_", F.row_number().over(w)).where("n_ = 1").select(*registry.columns)
    kept = registry.where(F.col("status").isin("pinned", "excluded"))
    fresh = last.join(kept.select("id"), "id", "left_anti").select(*registry.columns)
    others = registry.where(~F.col("status").isin("pinned", "excluded")).join(last.select("id"), "id", "left_anti").select(*registry.columns)
    return kept.unionByName(others).unionByName(fresh)


def import_counts(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """of the ids of an import, how many the registry takes and how many its pinned and excluded records keep out."""
    kept = registry.where(F.col("status").isin("pinned", "excluded")).select("id", F.lit(True).alias("kept_"))
    ids = incoming.select("id").distinct().join(kept, "id", "left")
    return ids.agg(F.count_if(F.col("kept_").isNull()).alias("added"), F.count("kept_").alias("skipped"))


def patch(registry: DataFrame, updates: DataFrame, now: Column | int, jitter: Column | float = 1.0) -> DataFrame:
    """A user's changes (id, ord, status, label, notes, nextCheckAt; null leaves a field as it is).

    An excluded record is never due, a re-activated one is due by its own cadence, and a time given by the user
    goes before both but the first. Of several changes of an id the last counts; ids without a record and
    statuses other than pinned, excluded and active do nothing.
    """
    now = F.lit(now) if isinstance(now, int) else now
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ord")))
    fields = ("status", "label", "notes", "nextCheckAt")
    u = updates.withColumn("n_", last).where("n_ = 1").select("id", *(F.col(c).alias(f"u_{c}") for c in fields))
    u = u.withColumn("u_status", F.when(F.col("u_status").isin("pinned", "excluded", "active"), F.col("u_status")))
    cadence = next_check(F.lit("active"), F.col("revisitAfter"), F.col("changeRate"), F.col("dealDensity"), now, jitter)
    at = F.when(F.col("u_status") == "excluded", F.lit(NEVER)).otherwise(F.coalesce("u_nextCheckAt", F.when(F.col("u_status") == "active", cadence), "nextCheckAt"))
    new = {
        "status": F.coalesce("u_status", "status"),
        "userPinned": F.when(F.col("u_status").isNotNull(), F.col("u_status") == "pinned").otherwise(F.col("userPinned")),
        "label": F.coalesce("u_label", "label"),
        "notes": F.coalesce("u_notes", "notes"),
        "nextCheckAt": at,
    }
    return registry.join(u, "id", "left").select(*(new[c].alias(c) if c in new else c for c in registry.columns))


def remove(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """Without these records; unlike an exclusion this is not remembered."""
    return registry.join(ids.select("id"), "id", "left_anti").select(*registry.columns)


def backoff(registry: DataFrame, blocked: DataFrame, pause_ms: int = HOUR) -> DataFrame:
    """Records blocked at some time (id, at) are not due before a pause has gone by; nothing else changes."""
    until = blocked.groupBy("id").agg((F.max("at") + pause_ms).alias("until_"))
    at = F.greatest("nextCheckAt", "until_")  # greatest passes over null
    return registry.join(until, "id", "left").select(*(at.alias(c) if c == "nextCheckAt" else c for c in registry.columns))


def strategies(outcomes: DataFrame, cap: int = MOST_STRATEGIES) -> DataFrame:
    """The strategy that each host is left with after its outcomes (host, ts, event_id, outcome, quality).

    A success keeps or creates it, blocks do not count, three failures in a row end it, and one does if the last
    success is more than a week old. Count and best quality begin anew after an end. The cap keeps the hosts of
    the latest successes, looked at once, at the end.
    """
    w = Window.partitionBy("host").orderBy("ts", "event_id")
    ok = F.col("outcome") == "success"
    rows = outcomes.where(F.col("outcome").isin("success", "failure")).withColumn("island", F.sum(F.when(ok, 1).otherwise(0)).over(w)).where("island > 0")
    age = F.unix_micros(F.max(F.when(~ok, F.col("ts"))).cast("timestamp")) - F.unix_micros(F.max(F.when(ok, F.col("ts"))).cast("timestamp"))
    g = rows.groupBy("host", "island").agg(
        F.count_if(~ok).alias("failures"), F.max(F.when(ok, F.col("ts"))).alias("success"), F.max(F.when(ok, F.col("quality"))).alias("quality"), F.coalesce(age > STRATEGY_DAYS * DAY * 1000, F.lit(False)).alias("old")
    )
    ended = F.col("old") | (F.col("failures") >= STRATEGY_FAILURES)
    by = Window.partitionBy("host").orderBy("island")
    g = g.withColumn("ended", ended).withColumn("era", F.sum(F.coalesce(F.lag(ended.cast("int")).over(by), F.lit(0))).over(by))
    last = g.groupBy("host", "era").agg(F.count("*").alias("successCount"), F.max("quality").alias("bestQuality"), F.max_by(F.struct("failures", "success", "ended"), "island").alias("l"))
    last = last.groupBy("host").agg(F.max_by(F.struct("successCount", "bestQuality", "l"), "era").alias("e")).where("not e.l.ended")
    rows = last.select("host", "e.successCount", "e.bestQuality", F.col("e.l.failures").alias("failures"), F.col("e.l.success").alias("lastSuccess"))
    return rows.orderBy(F.desc("lastSuccess"), "host").limit(cap)


def fold_memos(runs: DataFrame) -> DataFrame:
    """What the discovery runs (domain, at, ord, platform, negativePaths) of a domain leave known: the last
    platform told, the time of the last run, and all paths that ever answered with nothing."""
    told = runs.where("platform is not null").groupBy("domain").agg(F.max_by("platform", F.struct("at", "ord")).alias("platform"))
    paths = runs.select("domain", F.explode("negativePaths").alias("p")).groupBy("domain").agg(F.array_sort(F.collect_set("p")).alias("negativePaths"))
    rows = runs.groupBy("domain").agg(F.max("at").alias("lastDiscoveryAt")).join(told, "domain", "left").join(paths, "domain", "left")
    return rows.select("domain", "platform", F.coalesce("negativePaths", F.array().cast("array<string>")).alias("negativePaths"), "lastDiscoveryAt")


def fresh_memos(memos: DataFrame, now: Column | int, hours: int = MEMO_HOURS) -> DataFrame:
    """The memos that a run may still use."""
    now = F.lit(now) if isinstance(now, int) else now
    return memos.where(now - F.col("lastDiscoveryAt") <= hours * HOUR)


def csv_lines(registry: DataFrame) -> DataFrame:
    """The export's lines: only the label is quoted, density has three decimals, null is empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    label = F.concat(F.lit('"'), F.replace(text("label"), F.lit('"'), F.lit('""')), F.lit('"'))
    return registry.select("id", F.concat_ws(",", text("url"), text("domain"), label, text("status"), F.coalesce(to_fixed(F.col("dealDensity")), F.lit("")), text("lastVerifiedAt")).alias("line"))


def runs_in_last_hour(runs: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """How many runs the hour before each one had, itself included."""
    sec = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(by).orderBy(sec).rangeBetween(-3_600_000_000, 0)
    return runs.withColumn("runs", F.count("*").over(w))


def failure_runs(outcomes: DataFrame, by: list[str], order: list[str], failed: Column, least: int = 3) -> DataFrame:
    """Maximal runs of failures of at least `least`."""
    w = Window.partitionBy(by).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    return outcomes.withColumn("island", island).where(failed).groupBy(*by, "island").agg(F.count("*").alias("failures"), F.min(order[0]).alias("since")).where(F.col("failures") >= least).drop("island")
