"""Queries over the registry and the check events behind it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.operators import registry as R
from offerlens.sources.tables import CHECKS_SQL, checks, table
from offerlens.streaming import refresh

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = 1_790_000_000_000  # the fixed clock of these queries, epoch milliseconds


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _registry(spark, sf_dir):
    """A registry record for each user: status and times from counts of the user's events."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("ok"), F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("seen"))
    status = F.element_at(F.array(*map(F.lit, ("active", "pinned", "stale", "parked", "candidate", "excluded"))), (F.col("user_id") % 6 + 1).cast("int"))
    return e.select(
        F.concat(F.lit("r"), "user_id").alias("id"), F.concat(F.lit("https://d"), F.col("user_id") % 20, F.lit(".test/deals/"), "user_id").alias("url"), F.concat(F.lit("d"), F.col("user_id") % 20, F.lit(".test")).alias("domain"),
        F.concat(F.lit('Page "'), "user_id", F.lit('"')).alias("label"), status.alias("status"), (F.lit(NOW) + (F.col("n") - 60) * 3_600_000).alias("nextCheckAt"),
        F.when(status == "parked", F.lit(NOW) + (F.col("ok") - 14) * 86_400_000).alias("revisitAfter"), F.when(F.col("user_id") % 7 != 0, F.lit(NOW) - F.col("n") * 1_500_000).alias("lastVerifiedAt"), F.col("seen").alias("lastSeenAt"),
        (F.col("ok") / F.col("n")).alias("dealDensity"), (F.col("ok") / F.col("n")).alias("finalScore"), F.array(F.concat(F.lit("e"), "ok")).alias("evidence"),
    )


_REG = f"""e AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS ok, max(epoch_us(ts) // 1000) AS seen FROM events GROUP BY user_id),
 reg AS (SELECT 'r' || user_id AS id, 'https://d' || (user_id % 20) || '.test/deals/' || user_id AS url, 'd' || (user_id % 20) || '.test' AS domain, 'Page "' || user_id || '"' AS label,
   ['active', 'pinned', 'stale', 'parked', 'candidate', 'excluded'][user_id % 6 + 1] AS status, CAST({NOW} AS BIGINT) + (n - 60) * 3600000 AS nextCheckAt, CASE WHEN user_id % 6 = 3 THEN CAST({NOW} AS BIGINT) + (ok - 14) * 86400000 END AS revisitAfter,
   CASE WHEN user_id % 7 <> 0 THEN CAST({NOW} AS BIGINT) - n * 1500000 END AS lastVerifiedAt, seen AS lastSeenAt, CAST(ok AS DOUBLE) / n AS dealDensity, CAST(ok AS DOUBLE) / n AS finalScore, ['e' || ok] AS evidence FROM e)"""


@query(
    f"""WITH {_REG}, d AS (SELECT *, CASE status WHEN 'pinned' THEN 0 WHEN 'active' THEN 1 WHEN 'stale' THEN 2 ELSE 3 END AS prio FROM reg WHERE status NOT IN ('excluded', 'candidate') AND CASE WHEN status = 'parked' THEN coalesce(revisitAfter, 0) ELSE nextCheckAt END <= {NOW}),
  f AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY prio, nextCheckAt, id) AS k FROM d) SELECT id, domain, status, nextCheckAt FROM f WHERE k = 1 ORDER BY prio, nextCheckAt, id LIMIT 5"""
)
def registry_due(spark, sf_dir):
    """G1."""
    return R.due(_registry(spark, sf_dir), NOW).select("id", "domain", "status", "nextCheckAt")


@query(f"""WITH {_REG} SELECT id, status, lastVerifiedAt FROM reg WHERE status IN ('active', 'stale', 'pinned') ORDER BY coalesce(lastVerifiedAt, 0), id LIMIT 25""")
def registry_list(spark, sf_dir):
    """H1."""
    return R.listing(_registry(spark, sf_dir), status=["active", "stale", "pinned"], sort="lastVerifiedAt", limit=25).select("id", "status", "lastVerifiedAt")


@query(f"""WITH {_REG}, s AS (SELECT CASE WHEN status = 'active' AND {NOW} - coalesce(lastVerifiedAt, 0) > 86400000 THEN 'stale' ELSE status END AS status FROM reg) SELECT status, count(*) AS records FROM s GROUP BY status""")
def registry_stale(spark, sf_dir):
    """J24, F29."""
    return R.mark_stale(_registry(spark, sf_dir), NOW).groupBy("status").agg(F.count("*").alias("records"))


@query(
    f"""WITH {_REG}, o AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN status = 'parked' AND revisitAfter < {NOW} - 31536000000 THEN 0 ELSE 1 END, coalesce(lastSeenAt, 0), id) AS k FROM reg WHERE status NOT IN ('pinned', 'active'))
  SELECT id, status FROM reg WHERE id NOT IN (SELECT id FROM o WHERE k <= (SELECT greatest(count(*) - 100, 0) FROM reg))"""
)
def registry_evict(spark, sf_dir):
    """F20, down to 100."""
    return R.evict(_registry(spark, sf_dir), NOW, 100).select("id", "status")


@query(f"""WITH {_REG} SELECT id, concat_ws(',', url, domain, '"' || replace(label, '"', '""') || '"', status, printf('%.3f', dealDensity), coalesce(CAST(lastVerifiedAt AS VARCHAR), '')) AS line FROM reg""")
def registry_export_csv(spark, sf_dir):
    """A19."""
    return R.csv_lines(_registry(spark, sf_dir))


@query(
    f"""WITH {_REG}, s AS (SELECT 'r' || user_id AS id, 'https://new.test/' || user_id AS u, 'new.test' AS d, CASE WHEN user_id % 2 = 0 THEN 'seen' END AS l, ['e' || (user_id % 3), 'x'] AS ev, CAST({NOW} AS BIGINT) AS at, user_id % 4 = 0 AS acc FROM e WHERE user_id % 5 = 0
   UNION ALL SELECT 'n' || (user_id % 10), 'https://new.test/n', 'new.test', 'fresh', ['y'], CAST({NOW} AS BIGINT), user_id % 20 < 10 FROM e WHERE user_id < 10)
  SELECT coalesce(r.id, s.id) AS id, coalesce(r.url, s.u) AS url, coalesce(s.l, r.label) AS label, coalesce(r.status, CASE WHEN s.acc THEN 'active' ELSE 'candidate' END) AS status, coalesce(s.at, r.lastSeenAt) AS lastSeenAt,
    CAST(len(list_distinct(list_concat(coalesce(r.evidence, []), coalesce(s.ev, [])))) AS BIGINT) AS evidence FROM reg r FULL JOIN s ON r.id = s.id"""
)
def registry_upsert(spark, sf_dir):
    """F21, F22."""
    r = _registry(spark, sf_dir)
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    known = u.where("user_id % 5 = 0").select(F.concat(F.lit("r"), "user_id").alias("id"), F.concat(F.lit("https://new.test/"), "user_id").alias("url"), F.lit("new.test").alias("domain"), F.when(F.col("user_id") % 2 == 0, "seen").alias("label"), F.array(F.concat(F.lit("e"), F.col("user_id") % 3), F.lit("x")).alias("evidence"), F.lit(NOW).alias("seenAt"), (F.col("user_id") % 4 == 0).alias("accepted"))
    new = u.where("user_id < 10").select(F.concat(F.lit("n"), F.col("user_id") % 10).alias("id"), F.lit("https://new.test/n").alias("url"), F.lit("new.test").alias("domain"), F.lit("fresh").alias("label"), F.array(F.lit("y")).alias("evidence"), F.lit(NOW).alias("seenAt"), (F.col("user_id") % 20 < 10).alias("accepted"))
    return R.upsert(r, known.unionByName(new)).select("id", "url", "label", "status", "lastSeenAt", F.size("evidence").cast("long").alias("evidence"))


@query(
    f"""WITH {_REG}, i AS (SELECT id, 'imported' AS label FROM reg WHERE dealDensity > 0.2) SELECT r.id, CASE WHEN i.id IS NOT NULL AND r.status NOT IN ('pinned', 'excluded') THEN 'imported' ELSE r.label END AS label FROM reg r LEFT JOIN i USING (id)
  UNION ALL SELECT 'z1', 'last'"""
)
def registry_import(spark, sf_dir):
    """F23."""
    r = _registry(spark, sf_dir)
    i = r.where("dealDensity > 0.2").withColumn("label", F.lit("imported")).withColumn("ord", F.lit(1))
    one = r.limit(1).withColumn("id", F.lit("z1"))
    more = one.withColumn("label", F.lit("first")).withColumn("ord", F.lit(2)).unionByName(one.withColumn("label", F.lit("last")).withColumn("ord", F.lit(3)))
    return R.import_records(r, i.unionByName(more.withColumn("status", F.lit("active")))).select("id", "label")


_FOLD = f"""{CHECKS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ts, event_id) AS n FROM checks WHERE kind <> 'blocked'),
  m AS (SELECT *, sum(CASE WHEN kind = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY n DESC) AS back FROM k),
  s AS (SELECT record_id, count(*) AS checkCount, count(*) FILTER (kind = 'ok') AS successCount, count(*) FILTER (back = 0) AS consecutiveMisses,
    coalesce(sum(CASE WHEN kind = 'ok' THEN (CASE WHEN n = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END) * density * pow(CAST(0.7 AS DOUBLE), back - 1) END), 0) AS dealDensity,
    coalesce(sum(CASE WHEN kind = 'ok' AND changed THEN CAST(0.3 AS DOUBLE) * pow(CAST(0.7 AS DOUBLE), back - 1) END), 0) AS changeRate, max(ts) FILTER (kind = 'ok') AS verified, list_sort(list(DISTINCT month(ts)) FILTER (kind = 'ok')) AS months FROM m GROUP BY record_id)"""
_NINE = "floor({} * 1e9 + CAST(0.5 AS DOUBLE)) / 1e9"


def _nine(c):
    return F.floor(F.col(c) * 1e9 + 0.5) / 1e9


_STATE = """CASE WHEN consecutiveMisses >= 2 THEN 'parked' WHEN consecutiveMisses = 0 THEN 'active' WHEN successCount > 0 THEN 'stale' ELSE 'candidate' END"""


@query(f"""WITH {_FOLD} SELECT record_id, checkCount, successCount, consecutiveMisses, {_NINE.format("dealDensity")} AS dealDensity, {_NINE.format("changeRate")} AS changeRate, epoch_us(verified) // 1000 AS lastVerifiedAt, list_aggregate([CAST(x AS VARCHAR) FOR x IN months], 'string_agg', ',') AS season, {_STATE} AS status FROM s""")
def registry_state(spark, sf_dir):
    """The batch form of the refresh."""
    s = R.fold_checks(checks(spark, sf_dir))
    return s.select("record_id", "checkCount", "successCount", "consecutiveMisses", _nine("dealDensity").alias("dealDensity"), _nine("changeRate").alias("changeRate"), F.unix_millis(F.col("lastVerifiedAt").cast("timestamp")).alias("lastVerifiedAt"), F.nullif(F.array_join("seasonHint", ","), F.lit("")).alias("season"), "status")


@query(
    f"""WITH {_FOLD}, t AS (SELECT record_id, {_STATE} AS status, changeRate, dealDensity, months FROM s), h AS (SELECT *, least(greatest(CAST(168 AS DOUBLE) / (1 + CAST(166 AS DOUBLE) * changeRate + dealDensity), CAST(1 AS DOUBLE)), CAST(168 AS DOUBLE)) AS hours FROM t)
  SELECT record_id, CASE WHEN status = 'parked' THEN NULL ELSE CAST(floor(CAST({NOW} AS BIGINT) / 1000.0 / 60) + round(floor(hours * 60)) AS BIGINT) END AS minute,
    CASE WHEN status = 'parked' THEN epoch_ms(CASE WHEN make_timestamp(year(epoch_ms({NOW})), coalesce(list_min(list_filter(months, lambda m: m > month(epoch_ms({NOW})))), list_min(months)), 1, 0, 0, 0.0) <= epoch_ms({NOW})
      THEN make_timestamp(year(epoch_ms({NOW})) + 1, coalesce(list_min(list_filter(months, lambda m: m > month(epoch_ms({NOW})))), list_min(months)), 1, 0, 0, 0.0) ELSE make_timestamp(year(epoch_ms({NOW})), coalesce(list_min(list_filter(months, lambda m: m > month(epoch_ms({NOW})))), list_min(months)), 1, 0, 0, 0.0) END) END AS wake FROM h"""
)
def next_checks(spark, sf_dir):
    """J22, J23, with jitter 1: the minute of the next check, or when a parked page wakes."""
    s = R.fold_checks(checks(spark, sf_dir))
    parked = F.col("status") == "parked"
    minute = (F.floor(F.lit(NOW) / 1000.0 / 60) + F.floor(R.interval_hours(F.col("changeRate"), F.col("dealDensity")) * 60)).cast("long")
    return s.select("record_id", F.when(~parked, minute).alias("minute"), F.when(parked, R.seasonal_wake(F.col("seasonHint"), F.lit(NOW))).alias("wake"))


@query(f"""WITH {CHECKS_SQL}, i AS (SELECT *, sum(CASE WHEN kind = 'blocked' THEN 0 ELSE 1 END) OVER (PARTITION BY record_id ORDER BY ts, event_id) AS island FROM checks) SELECT record_id, count(*) AS failures, min(ts) AS since FROM i WHERE kind = 'blocked' GROUP BY record_id, island HAVING count(*) >= 3""")
def failure_bursts(spark, sf_dir):
    """Runs of three failures or more."""
    return R.failure_runs(checks(spark, sf_dir), ["record_id"], ["ts", "event_id"], F.col("kind") == "blocked")


@query("""SELECT user_id, max(runs) AS most, CAST(sum(runs) AS BIGINT) AS total FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS runs FROM events) GROUP BY user_id""")
def browser_hour_window(spark, sf_dir):
    """G7, by user."""
    r = R.runs_in_last_hour(table(spark, sf_dir, "events"), ["user_id"])
    return r.groupBy("user_id").agg(F.max("runs").alias("most"), F.sum("runs").alias("total"))


@query("""SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS status, count(*) AS events FROM events GROUP BY user_id""")
def latest_status(spark, sf_dir):
    """the last value of a key."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events"))


@query(f"""WITH {CHECKS_SQL}, o AS (SELECT kind, CASE WHEN kind = 'ok' AND changed THEN 1 ELSE 0 END AS c FROM checks) SELECT kind, count(*) AS checks, CAST(sum(c) AS BIGINT) AS changed FROM o GROUP BY kind""")
def refresh_summary(spark, sf_dir):
    """F25."""
    c = checks(spark, sf_dir)
    return c.groupBy("kind").agg(F.count("*").alias("checks"), F.count_if((F.col("kind") == "ok") & F.col("changed")).alias("changed"))


@query(
    f"""WITH {_FOLD} SELECT record_id, checkCount, successCount, consecutiveMisses, {_NINE.format("dealDensity")} AS dealDensity, {_NINE.format("changeRate")} AS changeRate, {_STATE} AS status FROM s"""
)
def stream_refresh_state(spark, sf_dir):
    """The refresh as a stream of the events file, its last state of each record (the oracle is the batch form)."""
    s = refresh.run_once(spark, sf_dir)
    return s.select("record_id", "checkCount", "successCount", "consecutiveMisses", _nine("dealDensity").alias("dealDensity"), _nine("changeRate").alias("changeRate"), "status")


@query("""SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS status FROM events GROUP BY user_id""")
def stream_latest_status(spark, sf_dir):
    """The last status of each key, kept by a stream."""
    return refresh.latest_once(spark, sf_dir)


_ATT = """s AS (SELECT user_id AS host, event_id, ts, CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'signup' THEN 'blocked' ELSE 'success' END AS outcome, CAST(json_extract_string(props, '$.k') AS DOUBLE) / CAST(100 AS DOUBLE) AS quality FROM events)"""


@query(
    f"""WITH {_ATT}, i AS (SELECT *, sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ts, event_id) AS island FROM s WHERE outcome <> 'blocked'),
  g AS (SELECT host, island, count(*) FILTER (outcome = 'failure') AS failures, max(ts) FILTER (outcome = 'success') AS success, max(quality) FILTER (outcome = 'success') AS quality, coalesce(bool_or(outcome = 'failure' AND ts - start > INTERVAL 7 DAY), false) AS late
    FROM (SELECT *, max(CASE WHEN outcome = 'success' THEN ts END) OVER (PARTITION BY host, island) AS start FROM i WHERE island > 0) GROUP BY ALL),
  b AS (SELECT host, max(island) FILTER (failures >= 3 OR late) AS ended, max(island) AS last FROM g GROUP BY host)
  SELECT host, count(*) AS successCount, max(quality) AS bestQuality, arg_max(failures, island) AS failures, max(success) AS lastSuccess FROM g JOIN b USING (host) WHERE island > coalesce(ended, 0) AND coalesce(ended, 0) < last GROUP BY host ORDER BY lastSuccess DESC, host LIMIT 500"""
)
def strategy_cache(spark, sf_dir):
    """A host's strategy lives from a success until three failures, or one after a week; blocks do not count."""
    outcome = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "signup", "blocked").otherwise("success")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), "event_id", "ts", outcome.alias("outcome"), (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("quality"))
    return R.strategies(e)


_HOURS = "least(greatest(CAST(168 AS DOUBLE) / (CAST(1 AS DOUBLE) + CAST(166 AS DOUBLE) * (CAST(ok AS DOUBLE) / n / CAST(7 AS DOUBLE)) + CAST(ok AS DOUBLE) / n), CAST(1 AS DOUBLE)), CAST(168 AS DOUBLE))"


@query(
    f"""WITH {_REG}, r AS (SELECT reg.*, e.user_id AS u, n, ok FROM reg JOIN e ON reg.id = 'r' || e.user_id), p AS (SELECT *, CASE WHEN u % 4 = 1 THEN 'pinned' WHEN u % 4 = 2 THEN 'excluded' WHEN u % 4 = 3 THEN 'active' END AS us,
    CASE WHEN u % 5 = 0 THEN 'renamed' END AS ul, CASE WHEN u % 9 = 0 THEN CAST({NOW} AS BIGINT) + u END AS un FROM r)
  SELECT id, coalesce(us, status) AS status, CASE WHEN us IS NULL THEN status = 'pinned' ELSE us = 'pinned' END AS userPinned, coalesce(ul, label) AS label, CASE WHEN u % 6 = 0 THEN 'note' END AS notes,
    CASE WHEN us = 'excluded' THEN CAST(9007199254740991 AS BIGINT) WHEN un IS NOT NULL THEN un WHEN us = 'active' THEN CAST({NOW} AS BIGINT) + CAST(floor({_HOURS} * CAST(1 AS DOUBLE) * 3600000 + CAST(0.5 AS DOUBLE)) AS BIGINT) ELSE nextCheckAt END AS nextCheckAt FROM p"""
)
def registry_patch(spark, sf_dir):
    """A user's change of every record, an overruled change of every eighth, and one of no record."""
    r = _registry(spark, sf_dir).withColumn("changeRate", F.col("dealDensity") / 7.0).withColumn("userPinned", F.col("status") == "pinned").withColumn("notes", F.lit(None).cast("string"))
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    k = F.col("user_id")
    id_ = F.concat(F.lit("r"), k).alias("id")
    told = u.select(id_, F.lit(2).alias("ord"), F.when(k % 4 == 1, "pinned").when(k % 4 == 2, "excluded").when(k % 4 == 3, "active").when(k % 8 == 0, "candidate").alias("status"), F.when(k % 5 == 0, "renamed").alias("label"), F.when(k % 6 == 0, "note").alias("notes"), F.when(k % 9 == 0, F.lit(NOW) + k).alias("nextCheckAt"))
    old = u.where("user_id % 8 = 1").select(id_, F.lit(1).alias("ord"), F.lit("excluded").alias("status"), F.lit("overruled").alias("label"), F.lit("overruled").alias("notes"), F.lit(1).cast("long").alias("nextCheckAt"))
    none = told.limit(1).withColumn("id", F.lit("absent"))
    return R.patch(r, told.unionByName(old).unionByName(none), NOW).select("id", "status", "userPinned", "label", "notes", "nextCheckAt")


@query(
    f"""WITH {_REG}, {CHECKS_SQL}, b AS (SELECT 'r' || record_id AS id, max(epoch_us(ts) // 1000) + {NOW} - 1704067200000 + 3600000 AS until FROM checks WHERE kind = 'blocked' GROUP BY record_id)
  SELECT reg.id, greatest(nextCheckAt, coalesce(until, 0)) AS nextCheckAt FROM reg LEFT JOIN b USING (id) WHERE status <> 'excluded'"""
)
def registry_backoff(spark, sf_dir):
    """Blocked checks, moved to the registry's clock, put records off; excluded records are removed."""
    r = _registry(spark, sf_dir)
    at = F.unix_millis(F.col("ts").cast("timestamp")) + NOW - 1_704_067_200_000
    b = checks(spark, sf_dir).where("kind = 'blocked'").select(F.concat(F.lit("r"), "record_id").alias("id"), at.alias("at"))
    return R.remove(R.backoff(r, b), r.where("status = 'excluded'")).select("id", "nextCheckAt")


@query(
    f"""WITH {_FOLD}, a AS (SELECT record_id, arg_min(event_id % 100 / CAST(100 AS DOUBLE), n) AS first, count(*) FILTER (kind = 'ok') AS oks,
    coalesce(sum(CASE WHEN kind = 'ok' THEN (CASE WHEN n = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END) * (event_id % 40) * pow(CAST(0.7 AS DOUBLE), back - 1) END), 0) AS products FROM m GROUP BY record_id)
  SELECT record_id, {_NINE.format("products")} AS avgProductCount, {_NINE.format("(1 - (1 - first) * pow(CAST(0.7 AS DOUBLE), oks))")} AS finalScore FROM a"""
)
def registry_averages(spark, sf_dir):
    """average product count and final score; both are made from the event's number."""
    c = checks(spark, sf_dir).withColumn("productCount", F.col("event_id") % 40).withColumn("firstScore", F.col("event_id") % 100 / 100.0)
    return R.fold_checks(c).select("record_id", _nine("avgProductCount").alias("avgProductCount"), _nine("finalScore").alias("finalScore"))


@query(f"""WITH {_REG} SELECT count(*) FILTER (status NOT IN ('pinned', 'excluded')) + 1 AS added, count(*) FILTER (status IN ('pinned', 'excluded')) AS skipped FROM reg""")
def registry_import_counts(spark, sf_dir):
    """the registry imported into itself twice over, with one new record."""
    r = _registry(spark, sf_dir)
    return R.import_counts(r, r.unionByName(r).unionByName(r.limit(1).withColumn("id", F.lit("new"))))


@query(
    """WITH r AS (SELECT user_id % 50 AS domain, epoch_us(ts) // 1000 AS t, event_id, CASE event_type WHEN 'view' THEN 'shopify' WHEN 'click' THEN 'woocommerce' END AS platform, CASE WHEN event_type = 'error' THEN '/p' || (event_id % 8) END AS path FROM events),
  m AS (SELECT domain, max(t) AS lastDiscoveryAt, arg_max(platform, struct_pack(a := t, b := event_id)) FILTER (platform IS NOT NULL) AS platform, coalesce(list_aggregate(list_sort(list(DISTINCT path) FILTER (path IS NOT NULL)), 'string_agg', ','), '') AS negativePaths FROM r GROUP BY domain)
  SELECT domain, platform, negativePaths, lastDiscoveryAt FROM m WHERE (SELECT max(t) FROM r) - lastDiscoveryAt <= 43200000"""
)
def discovery_memos(spark, sf_dir):
    """Events as discovery runs; the memos that are fresh at the time of the last run."""
    e = table(spark, sf_dir, "events")
    platform = F.when(F.col("event_type") == "view", "shopify").when(F.col("event_type") == "click", "woocommerce")
    path = F.when(F.col("event_type") == "error", F.array(F.concat(F.lit("/p"), F.col("event_id") % 8))).otherwise(F.array().cast("array<string>"))
    runs = e.select((F.col("user_id") % 50).alias("domain"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("ord"), platform.alias("platform"), path.alias("negativePaths"))
    now = runs.agg(F.max("at").alias("now_"))
    m = R.fresh_memos(R.fold_memos(runs).join(F.broadcast(now)), F.col("now_"))
    return m.select("domain", "platform", F.array_join("negativePaths", ",").alias("negativePaths"), "lastDiscoveryAt")
