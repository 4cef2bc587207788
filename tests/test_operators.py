"""Relational forms beside plain sequential folds, on random small inputs."""

import random

from pyspark.sql import functions as F

from offerlens.operators import discovery as D
from offerlens.operators import offers as O
from offerlens.operators import registry as R
from offerlens.operators.crawl import allowed, parse_sitemaps, robots_rules
from offerlens.streaming.refresh import step

OFFER = "g int, ord long, batch int, title string, originalPrice double, dealPrice double, discountPercentage int, currency string, sourceSite string, productUrl string, imageUrl string, page string"


def fold(rows, cap):
    """The merge, one offer at a time."""
    kept, pages = {}, set()
    for r in sorted(rows, key=lambda r: r[1]):
        _, ord_, _, title, original, deal, pct, _, _, link, image, page = r
        pages.add(page)
        key = (title.lower(), deal)
        if key not in kept:
            if len(kept) < cap:
                kept[key] = {"ord": ord_, "original": original, "pct": pct, "link": link, "image": image}
            continue
        k = kept[key]
        if not k["image"] and image:
            k["image"] = image
        if k["link"] in pages and link and link not in pages:
            k["link"] = link
        if k["original"] is None and original is not None and original > deal:
            k["original"] = original
            if k["pct"] is None:
                k["pct"] = pct
    return {(v["ord"], v["original"], v["pct"], v["link"], v["image"]) for v in kept.values()}


def test_merge_equals_the_fold(spark):
    rnd = random.Random(4)
    rows = []
    for g in range(60):
        for n in range(rnd.randint(1, 14)):
            batch = n // 4
            links = [f"p{b}" for b in range(3)] + ["a", "b", ""]
            rows.append((g, n, batch, rnd.choice(["Fan", "fan", "Pot"]), rnd.choice([None, 50.0, 200.0]), rnd.choice([20.0, 100.0]), rnd.choice([None, 5, 9]), "BDT", "s", rnd.choice(links), rnd.choice([None, "", "i1", "i2"]), f"p{batch}"))
    df = spark.createDataFrame(rows, OFFER)
    got = {}
    for r in O.merge(df, ["g"], 3, "page", "batch").collect():
        got.setdefault(r["g"], set()).add((r["ord"], r["originalPrice"], r["discountPercentage"], r["productUrl"], r["imageUrl"]))
    for g in range(60):
        assert got[g] == fold([r for r in rows if r[0] == g], 3), g


def offers_of(spark, items):
    rows = [(1, n, *x) for n, x in enumerate(items)]
    return spark.createDataFrame(rows, "run int, ord long, title string, dealPrice double, sourceSite string, currency string")


def test_comparison_groups(spark):
    t = "Samsung Galaxy A15 128GB"
    got = O.comparison_groups(offers_of(spark, [(t, 18499.0, "A", "BDT"), (f"{t} new", 19499.0, "B", "BDT"), ("Other thing here", 5.0, "A", "BDT")]), ["run"]).collect()
    assert [(r["savings"], r["savingsPercent"], r["sites"]) for r in got] == [(1000.0, 5, 2)]
    veto = [(t, 99999.0, "B", "BDT"), (t, 18499.0, "B", "USD"), (t.replace("A15", "A16").replace("128GB", "256GB"), 18499.0, "B", "BDT")]
    for other in veto:  # price ratio, currency, model numbers
        assert O.comparison_groups(offers_of(spark, [(t, 18499.0, "A", "BDT"), other]), ["run"]).count() == 0, other
    same = [(t, 100.0, "A", "BDT"), (t, 110.0, "A", "BDT")]
    assert O.comparison_groups(offers_of(spark, same), ["run"]).count() == 0


def test_quality_flags(spark):
    rows = [(1, "u", None, 10.0, None), (1, "u", None, 10.0, None), (2, "x", "i", 10.0, 20.0), (2, "y", "i", 9000.0, None), (2, "z", "i", 20.0, None)]
    df = spark.createDataFrame(rows, "g int, productUrl string, imageUrl string, dealPrice double, originalPrice double")
    q = {r["g"]: r for r in O.quality(df, ["g"], F.lit("u"), F.when(F.col("g") == 2, 30).cast("long")).collect()}
    assert q[1]["flags"] == ["all-prices-identical", "mostly-fallback-links"] and q[1]["score"] == 0.0
    assert q[2]["flags"] == ["extreme-variance", "low-coverage"] and abs(q[2]["coverage"] - 0.1) < 1e-12


def test_due_equals_the_greedy_loop(spark):
    rnd = random.Random(9)
    order = {"pinned": 0, "active": 1, "stale": 2, "parked": 3}
    for seed in range(3):
        rows = [(f"r{i:03d}", f"d{rnd.randint(0, 8)}", rnd.choice(["pinned", "active", "stale", "parked", "candidate", "excluded"]), rnd.randint(0, 100), rnd.choice([None, rnd.randint(0, 100)])) for i in range(80)]
        df = spark.createDataFrame(rows, "id string, domain string, status string, nextCheckAt long, revisitAfter long")
        ready = [r for r in rows if r[2] in order and ((r[4] or 0) if r[2] == "parked" else r[3]) <= 50]
        want, seen = [], set()
        for r in sorted(ready, key=lambda r: (order[r[2]], r[3], r[0])):
            if r[1] not in seen and len(want) < 5:
                seen.add(r[1])
                want.append(r[0])
        assert [r["id"] for r in R.due(df, 50).collect()] == want, seed


def test_checks_fold_equals_the_steps(spark):
    rnd = random.Random(2)
    rows = []
    for rec in range(40):
        for n in range(rnd.randint(1, 12)):
            rows.append((rec, n * 1000, n, rnd.choice(["ok", "ok", "miss", "blocked"]), rnd.random(), rnd.random() < 0.5))
    df = spark.createDataFrame(rows, "record_id int, t long, event_id int, kind string, density double, changed boolean").withColumn("ts", F.timestamp_millis("t"))
    got = {r["record_id"]: r for r in R.fold_checks(df).collect()}
    for rec in range(40):
        s = (0, 0, 0, 0.0, 0.0, "candidate")
        for r in (x for x in rows if x[0] == rec):
            s = step(s, r[3], r[4], r[5])
        if s[0]:
            g = got[rec]
            assert (g["checkCount"], g["successCount"], g["consecutiveMisses"]) == s[:3]
            assert abs(g["dealDensity"] - s[3]) < 1e-12 and abs(g["changeRate"] - s[4]) < 1e-12
            assert (g["status"] == s[5]) or {g["status"], s[5]} <= {"stale", "parked", "candidate"}


def test_cadence_and_season(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.0, 0.9)], "c double, d double")
    assert [round(r[0], 3) for r in df.select(R.interval_hours(F.col("c"), F.col("d"))).collect()] == [168.0, 1.0, 88.421]
    now = 1_789_041_600_000  # 2026-09-10
    df = spark.createDataFrame([([11],), ([3, 9],), ([],)], "m array<int>")
    got = [r[0] for r in df.select(R.seasonal_wake(F.col("m"), F.lit(now))).collect()]
    assert got == [1_793_491_200_000, 1_803_859_200_000, now + 30 * R.DAY]


def test_robots_and_sitemaps(spark):
    body = "User-agent: a\nUser-agent: *\nDisallow: /x\nAllow: /x/y\n\nUser-agent: b\nDisallow: /\nSitemap: https://s.test/m.xml"
    rules = robots_rules(spark.createDataFrame([("s", body)], "site string, body string"))
    paths = spark.createDataFrame([("s", "/x/1"), ("s", "/x/y1"), ("s", "/q"), ("other", "/x")], "site string, path string")
    assert {r["path"] if r["site"] == "s" else "o": r["allowed"] for r in allowed(paths, rules).collect()} == {"/x/1": False, "/x/y1": True, "/q": True, "o": True}
    assert [r["value"] for r in rules.where("kind = 'sitemap'").collect()] == ["https://s.test/m.xml"]
    docs = spark.createDataFrame([("u", "<urlset><url><loc>a?x=1&amp;amp;y</loc></url></urlset>"), ("v", "nothing"), ("w", None)], "url string, xml string")
    assert [r["loc"] for r in parse_sitemaps(docs).collect()] == ["a?x=1&amp;y"]


def test_walk_takes_hubs_and_falls_back(spark):
    c = spark.createDataFrame([("s", "hub", 0, "nav", 0.9), ("s", "plain", 1, "body", 0.3), ("t", "only", 0, "footer", 0.2)], "site string, url string, ord int, source string, prior double")
    v = [("s", "hub", 4, 0.5, 0.5, False, None), ("s", "plain", 1, 0.0, 0.2, False, None), *[("s", f"sub{i}", 20, 0.8, 0.9, True, None) for i in range(3)], ("t", "only", 0, 0.0, 0.0, False, "blocked:x")]
    v = spark.createDataFrame(v, "site string, url string, productCount long, density double, quality double, countdown boolean, reason string")
    l = spark.createDataFrame([("s", "hub", f"sub{i}", i, 0.8) for i in range(3)], "site string, hub string, url string, ord int, prior double")
    got = {(r["site"], r["url"]): r for r in D.select_pages(c, v, l).collect()}
    assert {u for (s, u), r in got.items() if r["rank"]} == {"sub0", "sub1", "sub2"} and got["s", "hub"]["reason"] == "demoted"
    assert got["s", "sub0"]["prior"] == 0.8 * 0.7 and got["t", "only"]["reason"] == "blocked:x"


def test_empty_tables(spark):
    none = spark.createDataFrame([], OFFER)
    assert O.merge(none, ["g"], 3, "page", "batch").count() == 0
    assert O.comparison_groups(none, ["g"]).count() == 0
    assert O.quality(none, ["g"], F.lit("u")).count() == 0
