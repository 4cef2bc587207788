"""Decontamination beside brute-force alignment of every window with every document."""

import random
import resource

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from offerlens.llm import decontaminate as DC

DOCS = "doc_id long, text string"
ITEM = "The quick brown fox jumps over the lazy dog while seven wizards quietly boxed up fizzy jugs of quartz and vexing numbers."


def edits(p, t):
    """(least edit distance of p to a part of t, ends of such parts)."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row), [j for j, x in enumerate(row) if x == min(row)]


def plain(text):
    return DC.normal(pa.array([text], pa.large_string()))[0].as_py().encode()


def brute(items, docs):
    """(document's place, item) pairs, with the ends of the best alignments of the windows within budget."""
    out = {}
    for n, text in enumerate(docs):
        raw = plain(text or "")
        for item, t in items:
            t = plain(t or "")
            if len(t) < DC.LEAST:
                if t and b" " + t + b" " in b" " + raw + b" ":
                    out[n, item] = []
                continue
            for s in DC.window_starts(len(t)).tolist():
                w = t[s : s + DC.WINDOW]
                k, ends = edits(w, raw) if raw else (len(w), [])
                if k <= int(len(w) * DC.RATE):
                    out.setdefault((n, item), []).append(ends)
    return out


def noisy(rnd, p):
    p = list(p)
    for _ in range(rnd.randint(0, 9)):
        k = rnd.randrange(len(p) + 1)
        p[k : k + rnd.randint(0, 1)] = rnd.choice(["", "z", "q"])
    return "".join(p)


def made(rnd, n_items, n_docs):
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7)))
    stem = " ".join(word() for _ in range(9))
    items = [(i, (stem + " " if i % 2 else "") + " ".join(word() for _ in range(rnd.randint(2, 40)))) for i in range(n_items)] + [(90, "one two"), (91, None), (92, " .")]
    docs = []
    for _ in range(n_docs):
        t = plain(rnd.choice(items)[1] or "x").decode()
        a = rnd.randrange(max(len(t) - 90, 1))
        docs.append(" ".join([word()] * rnd.randint(0, 4) + [noisy(rnd, t[a : a + rnd.randint(60, 240)])] + [word() for _ in range(rnd.randint(0, 5))] + [rnd.choice(["one two", "one twos", stem])]))
    return items, docs + [None, ""]


def test_regions_equal_brute_alignment():
    rnd = random.Random(8)
    items, docs = made(rnd, 6, 40)
    index = DC.Index(items)
    data, off = DC.utf8(DC.normal(pa.array([d or "" for d in docs], pa.large_string())))
    want = brute(items, docs)
    for most in (DC.MOST_SHARED, 400, 0):  # whole; in parts; with contexts, shorter q-grams and the least parts
        got = index.regions(data, off, most)
        assert {(n, i) for n, i, *_ in got} == set(want)
        for (n, i), windows in want.items():
            spans = [(s, e) for m, j, s, e, _ in got if (m, j) == (n, i)]
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
            assert all(any(s < x <= e for s, e in spans for x in ends) for ends in windows)
        if most == DC.MOST_SHARED:
            first = got
        assert got == first


def test_whole_query_equals_brute_force(spark):
    rnd = random.Random(9)
    items, docs = made(rnd, 5, 30)
    rows = [(i if i % 7 else None, t) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, DOCS).withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame([*items, (None, "lost"), items[0]], "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute(items, docs)
    for block in (4 << 20, 400):  # one block; several
        got = [(r["doc_id"], r["item_id"]) for r in DC.contaminated(df, bench, block_bytes=block).select("doc_id", "item_id").distinct().collect()]
        assert sorted(got, key=str) == sorted({(rows[n][0], i) for n, i in want}, key=str)
        kept = DC.drop_contaminated(df, bench, block_bytes=block)
        assert kept.columns == df.columns
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted((str(a), str(t)) for n, (a, t) in enumerate(rows) if n not in {m for m, _ in want})


def test_every_place_and_any_passage_of_a_window(spark):
    rows = [(9007199254740993, f"{ITEM} and on {'filler words ' * 30} {ITEM}"), (9007199254740992, "clean"), (2, ITEM.upper().replace(" ", "\n")), (None, ITEM), (3, ITEM), (3, "clean too"), (4, ITEM[:60])]
    rows += [(100 + s, "w " * 9 + ITEM[s : s + 99] + " x" * 9) for s in range(len(ITEM) - 99)]
    bench = spark.createDataFrame([(10, ITEM), (11, None), (12, ""), (13, "one two")], "item_id long, text string")
    df = spark.createDataFrame(rows, DOCS)
    got = DC.contaminated(df, bench).collect()
    assert {r["doc_id"] for r in got} == {9007199254740993, 2, None, 3} | {100 + s for s in range(len(ITEM) - 99)}
    assert [(r["region_start"], r["region_end"], r["edits"]) for r in got if r["doc_id"] == 9007199254740993] == [(0, 120, 0), (518, 638, 0)]
    assert sorted((r["doc_id"], r["text"]) for r in DC.drop_contaminated(df, bench).collect()) == [(3, "clean too"), (4, ITEM[:60]), (9007199254740992, "clean")]
    assert DC.contaminated(df.where("doc_id < 0"), bench).count() == 0
    assert DC.contaminated(df, bench.where("item_id < 0")).count() == 0 and DC.drop_contaminated(df, bench.where("item_id < 0")).count() == len(rows)


def test_a_shared_stem_stays_within_memory():
    """Items with one question stem against 200 KB that repeat it, alike or with other words after it: under 1 GB."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 8)))
    stem = " ".join(word() for _ in range(18))[:100]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for n, text in ((2000, (stem + " ") * (200_000 // 101)), (100, " ".join(f"{stem[:55]} {word()} {word()}" for _ in range(3000)))):
        index = DC.Index([(i, f"{stem} {' '.join(word() for _ in range(12))}") for i in range(n)])
        data = np.frombuffer(plain(text), np.uint8)
        got = index.regions(data, np.array([0, len(data)]))
        assert len({i for _, i, *_ in got}) == (n if text.startswith(stem) else 0)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1e6 < 1
