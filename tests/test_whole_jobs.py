"""Queries that cover their whole table, beside brute force on small tables."""

import random
from collections import Counter
from itertools import combinations

from offerlens.functions import text as X
from offerlens.operators import offers as O
from offerlens.plans import catalogue


def test_similar_titles_equal_all_pairs(spark):
    rnd = random.Random(4)
    rows = [(i, f"b{i % 2}", rnd.choices("abcdefghij", k=rnd.randint(0, 6))) for i in range(120)]
    t = spark.createDataFrame(rows, "id long, brand string, tokens array<string>")
    for least in (0.4, 0.5, 0.75, 1.0):
        got = {(r["a"], r["b"]): r["jaccard"] for r in O.similar_titles(t, ["brand"], least).collect()}
        want = {}
        for (a, x, s), (b, y, u) in combinations(rows, 2):
            s, u = set(s), set(u)
            if x == y and s and u and len(s & u) / len(s | u) >= least:
                want[a, b] = len(s & u) / len(s | u)
        assert got == want



def test_similar_titles_tell_members_of_large_kinds_from_bounded_lists(spark):
    words = [["red", "lamp", "desk"], ["red", "lamp", "wool"], ["blue", "lamp", "desk", "wool"], ["kettle"]]
    rows = [(i, f"b{i % 2}", [*words[i % 7 % 4], f"pk{i}"]) for i in range(140)]
    t = spark.createDataFrame(rows, "id long, brand string, tokens array<string>")
    got = sorted(tuple(r) for r in O.similar_titles(t, ["brand"], 0.6, block=3).collect())
    want = []
    for (a, x, s), (b, y, u) in combinations(rows, 2):
        j = len(set(s) & set(u)) / len(set(s) | set(u))
        if x == y and j >= 0.6:
            want.append((a, b, j))
    assert got == want and len(want) > 500


def naive_groups(offers, threshold=0.5, same_site=0.15, ratio=5.0):
    """The sequential rule on plain lists: each offer, by price, joins the best group or begins one."""
    groups = []
    for o in sorted(offers, key=lambda o: (o["dealPrice"], o["ord"])):
        if len(o["norm"]) < 4:
            continue
        best, score = None, 0.0
        for g in groups:
            low, high = min(g[0]["dealPrice"], o["dealPrice"]), max(*(x["dealPrice"] for x in g), o["dealPrice"])
            if low <= 0 or high / low > ratio or (o["models"] and g[0]["models"] and not o["models"] & g[0]["models"]):
                continue
            pairs = [Counter(t[i : i + 2] for t in [x["norm"].replace(" ", "")] for i in range(len(t) - 1)) for x in (o, g[0])]
            dice = 2 * (pairs[0] & pairs[1]).total() / (pairs[0].total() + pairs[1].total())
            s = 0.5 * dice + 0.5 * len(o["tokens"] & g[0]["tokens"]) / len(o["tokens"] | g[0]["tokens"]) - (same_site if o["sourceSite"] in {x["sourceSite"] for x in g} else 0)
            if s > score:
                best, score = g, s
        if best is not None and score >= threshold:
            best.append(o)
        else:
            groups.append([o])
    return sorted([x["ord"] for x in g] for g in groups if len({x["sourceSite"] for x in g}) > 1)


def test_comparison_groups_equal_the_sequential_rule(spark):
    rnd = random.Random(11)
    word = ["steel", "kettle", "lamp", "desk", "wool", "blanket", "phone", "case"]
    rows = [(r, i, f"{' '.join(rnd.sample(word, 3))} {rnd.choice(['a100', 'b200', ''])}", round(rnd.uniform(1, 60), 2), f"s{rnd.randint(0, 3)}", "USD", f"https://s/{i}") for r in (1, 2) for i in range(45)]
    df = spark.createDataFrame(rows, "run int, ord long, title string, dealPrice double, sourceSite string, currency string, productUrl string")
    told = df.withColumn("norm", X.normalize_title("title")).withColumn("tokens", X.content_tokens("norm")).withColumn("models", X.model_tokens("tokens")).collect()
    got = O.comparison_groups(df, ["run"]).collect()
    for run in (1, 2):
        offers = [{**r.asDict(), "tokens": set(r["tokens"]), "models": set(r["models"])} for r in told if r["run"] == run]
        mine = sorted((g for g in got if g["run"] == run), key=lambda g: g["place"])
        assert sorted([m["ord"] for m in g["members"]] for g in mine) == naive_groups(offers)
        assert [g["savings"] for g in mine] == sorted((g["savings"] for g in mine), reverse=True)
        for g in mine:
            prices = [m["dealPrice"] for m in g["members"]]
            assert prices == sorted(prices) and (g["bestPrice"], g["worstPrice"], g["items"]) == (prices[0], prices[-1], len(prices))
            assert all(m["productUrl"] == f"https://s/{m['ord']}" for m in g["members"])


def test_distinct_words_of_every_row(spark, tmp_path):
    rows = [(1, "one two ONE", "en"), (2, "für grün", "de"), (3, "দাম কত", None), (4, None, "en"), (5, "", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["words"]: r["documents"] for r in catalogue.QUERIES["distinct_words"](spark, str(tmp_path)).collect()}
    assert got == {2: 3, 0: 2}
