"""Discovery and registry operators against sequential folds over random tables."""

import random

from pyspark.sql import functions as F

from offerlens.operators import crawl
from offerlens.operators import discovery as D
from offerlens.operators import offers as O
from offerlens.operators import registry as R


def test_strategies_equal_the_sequential_cache(spark):
    rnd = random.Random(4)
    rows, day = [], R.DAY
    for host in range(60):
        t = 0
        for n in range(rnd.randint(0, 15)):
            t += rnd.choice([1000, day, 5 * day, 9 * day])
            rows.append((f"h{host:02d}", t, n, rnd.choice(["success", "failure", "failure", "blocked"]), rnd.random()))
    want: dict = {}
    for host, t, _, outcome, q in rows:
        s = want.get(host)
        if outcome == "success":
            want[host] = (s[0] + 1 if s else 1, max(s[1], q) if s else q, 0, t)
        elif outcome == "failure" and s:
            s = (s[0], s[1], s[2] + 1, s[3])
            if s[2] >= (1 if t - s[3] > 7 * day else 3):
                del want[host]
            else:
                want[host] = s
    df = spark.createDataFrame(rows, "host string, t long, event_id int, outcome string, quality double").withColumn("ts", F.timestamp_millis("t"))
    got = {r["host"]: (r["successCount"], r["bestQuality"], r["failures"], r["at"]) for r in R.strategies(df).withColumn("at", F.unix_millis("lastSuccess")).collect()}
    assert got == want and len(want) > 10
    newest = sorted(want, key=lambda h: (-want[h][3], h))[:5]
    assert [r["host"] for r in R.strategies(df, 5).collect()] == newest


def test_same_listings_equal_the_greedy_loop(spark):
    rnd = random.Random(8)
    rows = [(f"s{k % 5}", f"u{k:03d}", [f"t{x}" for x in range(rnd.randint(0, 3), rnd.randint(3, 12))] if k % 9 else [], rnd.choice([0.1, 0.5, 0.7])) for k in range(120)]
    df = spark.createDataFrame(rows, "site string, url string, tokens array<string>, score double")
    want = {}
    for site in {r[0] for r in rows}:
        kept = []
        for _, u, t, _ in sorted((r for r in rows if r[0] == site), key=lambda r: (-r[3], r[1])):
            t = set(t)
            want[u] = next((k for k, s in kept if t and s and len(s & t) / len(s | t) >= 0.8), None)
            if want[u] is None:
                kept.append((u, t))
    assert {r["url"]: r["duplicate_of"] for r in O.same_listings(df, ["site"]).collect()} == want
    assert any(want.values())


CHECK = "site string, url string, productCount long, density double, quality double, countdown boolean, reason string, titles array<string>"


def test_selection_collapses_equal_listings_and_keeps_its_budget(spark):
    c = spark.createDataFrame([("s", f"p{i}", i, "nav", 0.9 - i / 10) for i in range(5)] + [("t", f"p{i}", i, "nav", 0.9) for i in range(5)], "site string, url string, ord int, source string, prior double")
    c = c.withColumn("spent", F.when(F.col("site") == "t", 18).otherwise(0))
    same, other = [f"a{i}" for i in range(10)], ["b"]
    rows = [(s, f"p{i}", 20, 0.8, 0.9, False, None, {0: same, 1: same[:9], 2: other}.get(i)) for s in "st" for i in range(5)]
    got = {(r["site"], r["url"]): r for r in D.select_pages(c, spark.createDataFrame(rows, CHECK), spark.createDataFrame([], "site string, hub string, url string, ord int, prior double")).collect()}
    assert got["s", "p1"]["reason"] == "duplicate-of:p0" and got["s", "p1"]["rank"] is None
    assert [got["s", u]["rank"] for u in ("p0", "p2", "p3", "p4")] == [1, 2, 3, None]
    assert {u for s, u in got if s == "t"} == {"p0", "p1"}  # two of twenty fetches were left


def test_tiers_stop_at_four_strong_candidates(spark):
    rows = [("a", f"u{i}", 0, 0.6, None) for i in range(4)] + [("a", "late", 2, 0.9, None), ("b", "u", 0, 0.9, "neg-token:x"), ("b", "m", 2, 0.9, None), ("b", "p", 3, 0.1, None)]
    got = D.by_tier(spark.createDataFrame(rows, "site string, url string, tier int, prior double, reject string")).collect()
    assert {(r["site"], r["url"]) for r in got} == {("a", "u0"), ("a", "u1"), ("a", "u2"), ("a", "u3"), ("b", "u"), ("b", "m"), ("b", "p")}


def test_sitemap_pages_are_gated(spark):
    rows = [("a", 1, i, 0.5, None) for i in range(250)] + [("b", 1, 0, 0.4, None), ("b", 1, 1, 0.9, "stop-segment:x"), ("b", 2, 0, 0.41, None)]
    got = D.sitemap_pages(spark.createDataFrame(rows, "site string, place int, ord int, prior double, reject string")).collect()
    assert sum(r["site"] == "a" for r in got) == 200 and max(r["ord"] for r in got) == 199
    assert [(r["place"], r["ord"]) for r in got if r["site"] == "b"] == [(2, 0)]


def test_sitemaps_are_read_breadth_first_four_at_most(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    page = lambda u: f"<urlset><url><loc>{u}</loc></url></urlset>"
    docs = [("https://a/r", index("https://a/m", "https://a/Items", "https://a/x", "https://a/y", "https://a/z")), ("https://a/m", index("https://a/deep")), ("https://a/deep", page("deep")), ("https://a/Items", page("item"))]
    docs += [(f"https://a/{u}", page(u)) for u in "yz"] + [("https://b/only", page("b"))]  # https://a/x gives no answer and takes a place
    roots = spark.createDataFrame([("a", "https://a/r", 0), ("b", "https://b/none", 0), ("b", "https://b/only", 1)], "site string, url string, ord int")
    got = crawl.walk_sitemaps(roots, spark.createDataFrame(docs, "url string, xml string")).collect()
    assert {(r["site"], r["place"], r["loc"]) for r in got} == {("a", 4, "y"), ("b", 2, "b")}


def test_probe_titles(spark):
    probed = spark.createDataFrame([("s", u, u) for u in ("same", "own", "bare", "gone")], "site string, url string, path string")
    answers = spark.createDataFrame([("same", "<TITLE> Home\n</title>"), ("own", "<title>Deals</title>"), ("bare", "x"), ("gone", None)], "url string, html string")
    homes = spark.createDataFrame([("s", "<title lang='en'>Home</title>")], "site string, html string")
    assert {r["url"]: r["hit"] for r in crawl.judge_probes(probed, answers, homes).collect()} == {"same": False, "own": True, "bare": True, "gone": False}


def test_warm_start_takes_half_of_the_first_six(spark):
    saved = spark.createDataFrame([("a", f"u{i}", "active", i, "f") for i in range(8)] + [("b", "v", "pinned", 0, "f"), ("c", "w", "stale", 99, "f")], "site string, url string, status string, nextCheckAt long, fingerprint string")
    checks = spark.createDataFrame([("u0", None, "f"), ("u1", None, "g"), ("u2", None, "f"), ("u7", None, "f"), ("v", "blocked:x", "f")], "url string, reason string, fingerprint string")
    got = {r["site"]: tuple(r)[1:] for r in D.warm_start(saved, checks, 50).collect()}
    assert got == {"a": (8, 6, 3, 1, True), "b": (1, 1, 0, 0, False)}
    pins = spark.createDataFrame([("a", "other")], "site string, url string")
    assert not {r["site"]: r["warm"] for r in D.warm_start(saved, checks, 50, pins).collect()}["a"]


def test_score_averages_equal_the_steps(spark):
    rnd = random.Random(5)
    rows = [(rec, n * 1000, n, rnd.choice(["ok", "ok", "miss", "blocked"]), 0.5, True, rnd.randint(0, 60), 0.4) for rec in range(30) for n in range(rnd.randint(1, 10))]
    df = spark.createDataFrame(rows, "record_id int, t long, event_id int, kind string, density double, changed boolean, productCount int, firstScore double").withColumn("ts", F.timestamp_millis("t"))
    got = {r["record_id"]: r for r in R.fold_checks(df).collect()}
    for rec, g in got.items():
        n, products, score = 0, 0.0, 0.4
        for r in (x for x in rows if x[0] == rec and x[3] != "blocked"):
            n += 1
            if r[3] == "ok":
                products = float(r[6]) if n == 1 else 0.3 * r[6] + 0.7 * products
                score = max(score, 0.3 + 0.7 * score)
        assert abs(g["avgProductCount"] - products) < 1e-9 and abs(g["finalScore"] - score) < 1e-12


def test_memos_and_empty_registry(spark):
    runs = spark.createDataFrame([("d", 1, 0, "shopify", ["/b", "/a"]), ("d", 2, 0, None, ["/a"]), ("e", 0, 0, None, None)], "domain string, at long, ord int, platform string, negativePaths array<string>")
    memos = R.fold_memos(runs)
    assert {tuple(r["negativePaths"]) for r in memos.collect()} == {("/a", "/b"), ()}
    assert [(r["domain"], r["platform"]) for r in R.fresh_memos(memos, 12 * R.HOUR + 1).collect()] == [("d", "shopify")]
    none = spark.createDataFrame([], "id string, status string, label string, notes string, nextCheckAt long, revisitAfter long, userPinned boolean, changeRate double, dealDensity double")
    told = spark.createDataFrame([], "id string, ord int, status string, label string, notes string, nextCheckAt long")
    assert R.patch(none, told, 0).count() == 0 and R.backoff(none, spark.createDataFrame([], "id string, at long")).count() == 0
    assert R.import_counts(none, none).collect()[0].asDict() == {"added": 0, "skipped": 0}
