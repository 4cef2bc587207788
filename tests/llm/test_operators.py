"""The training-data operators beside brute force, round trips and held-out labels, with the odd cases."""

import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerlens.llm import decontaminate as DC
from offerlens.llm import langid as LI
from offerlens.llm import license_scan as LS
from offerlens.llm import neardup as ND
from offerlens.llm import packing as PK
from offerlens.llm import pieces as SP
from offerlens.llm import preference as PF
from offerlens.llm import queries as Q
from offerlens.llm import secrets as SE
from offerlens.llm import toxicity as TX
from offerlens.llm.components import components
from tests.compare import check

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "a"), (4, "x " * 60_000), (5, "same text of some six words"), (6, "same text of some six words"), (7, "ßüé 日本 🙂\n\t"), (8, "== ++ --")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


# 1 near duplicates


def family(rnd, n, base=None):
    base = base or [f"w{rnd.randint(0, 9999)}" for _ in range(120)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(1, 4)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 99999)}"
        out.append(" ".join(w))
    return out


def brute_classes(texts, weights):
    d, key, count = ND.weighted_sets(pa.array([t or "" for t in texts], pa.large_string()))
    sets = [dict() for _ in texts]
    for i, k, c, w in zip(d, key, count, weights(key), strict=True):
        sets[i][int(k)] = float(c * w)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        low = sum(min(v, b[k]) for k, v in a.items() if k in b)
        high = sum(a.values()) + sum(b.values()) - low
        if (texts[i] or "") == (texts[j] or "") or (high and low / high >= 0.8):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(5)
    texts = [t for _ in range(8) for t in family(rnd, rnd.randint(0, 6))] + ["", None, "", "two words", "two words", "two other"]
    df = docs(spark, list(enumerate(texts)))
    idf = ND.document_frequencies(df)
    want = brute_classes(texts, idf.weights)
    got = {r["doc_id"]: r for r in ND.near_duplicates(df.withColumn("rep", F.lit(1)).withColumn("class_id", F.lit(2))).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert all(got[i]["class_size"] == want.count(want[i]) for i in got)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ND, "SMALL", 3)
    monkeypatch.setattr(ND.across, "__defaults__", (8,))
    rnd = random.Random(6)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(60)]
    texts = list(dict.fromkeys(family(rnd, 70, base)))
    df = docs(spark, list(enumerate(texts)))
    want = brute_classes(texts, ND.document_frequencies(df).weights)
    got = {r["doc_id"]: r["class_id"] for r in ND.near_duplicates(df).collect()}
    missed = sum(got[i] != got[want[i]] for i in range(len(texts)))
    assert len(set(want)) > 1 and missed <= 1  # samples, not blocks, may miss a pair


def test_joining_spans_every_link():
    rnd = random.Random(1)
    texts = family(rnd, 40)
    d, key, count = ND.weighted_sets(pa.array(texts, pa.large_string()))
    w = np.ones(len(key))
    pairs = ND.joining(d, key, count, w, np.arange(len(texts)), 0.8)
    want = brute_classes(texts, lambda k: np.ones(len(k)))
    assert len(pairs) == len(texts) - len(set(want))


def test_samples_agree_as_often_as_texts_do():
    rnd = random.Random(3)
    a, b = family(rnd, 1)[0], None
    w = a.split()
    w[10:20] = [f"n{i}" for i in range(10)]
    b = " ".join(w)
    d, key, count = ND.weighted_sets(pa.array([a, b], pa.large_string()))
    s = ND.samples(d, key, count.astype(float), 2)
    same = ND.paired_jaccard(d, key, count.astype(float), 1)[0]
    assert abs((s[0] == s[1]).mean() - same) < 0.25
    heavy = ND.samples(d, key, count * 2.5, 2)
    assert abs((heavy[0] == heavy[1]).mean() - same) < 0.25


def test_a_boilerplate_shingle_weighs_less(spark):
    rnd = random.Random(12)
    own = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    notice = "this notice stands at the foot of every second page of the site"
    df = docs(spark, [(i, f"{own(40)} {notice}" if i % 2 else own(45)) for i in range(400)])
    idf = ND.document_frequencies(df)
    d, key, count = ND.weighted_sets(pa.array([notice, own(20)], pa.large_string()))
    w = idf.weights(key)
    assert np.allclose(w[d == 0], np.log1p(400 / 200) / np.log1p(64)) and (w[d == 1] == 1).all()
    # two texts of mostly the notice: alike by counts, not by TF-IDF
    pair = [f"{notice} {notice.upper()} {own(2)}", f"{notice} {notice.upper()} {own(2)}"]
    d, key, count = ND.weighted_sets(pa.array(pair, pa.large_string()))
    plain, weighed = (ND.paired_jaccard(d, key, w, 1)[0] for w in (count.astype(float), count * idf.weights(key)))
    assert weighed < plain - 0.1


def test_recall_on_documents_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    rows = df.select("doc_id", "text").collect()
    want = brute_classes([r["text"] for r in rows], ND.document_frequencies(df).weights)
    got = {r["doc_id"]: r for r in ND.near_duplicates(df).collect()}
    ids = [r["doc_id"] for r in rows]
    assert [got[i]["class_id"] for i in ids] == [ids[k] for k in want]
    assert sum(r["links"] for r in got.values()) > 0


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    text, other, third = ("one two three four five six seven eight nine ten", "some wholly other words stand in this text here", "and a third text that is like neither of them")
    rows = [(3, text), (4, other), (5, text), (5, other), (None, text), (None, third), (None, third), (4, other)]
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["class_size"]) for r in ND.near_duplicates(docs(spark, rows)).collect())
    assert got == [(0, 0, 2), (0, 0, 2), (0, 3, 3), (3, 3, 3), (4, 4, 3), (4, 4, 3), (5, 3, 3), (5, 4, 3)]
    kept = ND.keep_one(docs(spark, rows).withColumn("row", F.lit(7)))
    assert sorted((r["doc_id"] or 0, r["text"], r["row"]) for r in kept.collect()) == sorted([(0, third, 7), (3, text, 7), (4, other, 7)])


def test_near_duplicates_of_odd_and_no_rows(spark):
    got = {r["doc_id"]: r["class_id"] for r in ND.near_duplicates(docs(spark, ODD)).collect()}
    assert got[1] == got[2] == 1 and got[5] == got[6] == 5 and len(got) == 8
    assert ND.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (3, 1), *[(100, 100 + i) for i in range(1, 50)], *[(i, i + 1) for i in range(200, 230)]], "a long, b long")
    got = dict(components(edges).collect())
    assert got[3] == 1 and got[5] == 4 and 9 not in got and got[149] == 100 and got[230] == 200
    assert components(edges.where("a < 0")).count() == 0


# 2 packing


def test_best_fit_equals_brute_force():
    for seed in range(20):
        sizes = np.random.default_rng(seed).integers(1, 33, 150)
        rows, room = [], []
        for i in np.argsort(-sizes, kind="stable").tolist():
            fit = [r for r in range(len(rows)) if room[r] >= sizes[i]]
            r = min(fit, key=room.__getitem__) if fit else len(rows)
            if not fit:
                rows.append([])
                room.append(32)
            rows[r].append(i)
            room[r] -= sizes[i]
        got = PK.best_fit(sizes, 32)
        assert sorted(32 - sum(sizes[i] for i in r) for r in got) == sorted(room)
        assert sorted(i for r in got for i in r) == list(range(150))


def test_packing_round_trip(spark):
    df = docs(spark, ODD)
    packed = PK.pack(df, length=64, window=5_000)
    enc = PK.encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    back = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in PK.unpack(packed).collect()}
    assert {i: enc.decode(x[:-1]) for i, x in back.items()} == {i: t or "" for i, t in ODD}
    for r in packed.collect():
        pos, cu = np.frombuffer(r["positions"], "<u2"), r["cu_seqlens"]
        assert len(np.frombuffer(r["ids"], "<u2")) == 64 and cu[-1] == r["n_ids"] <= 64
        assert all(pos[a:b].tolist() == list(range(b - a)) for a, b in itertools.pairwise(cu))
    assert PK.pack(docs(spark, [])).count() == 0


def test_rows_of_one_id_and_written_matrices(spark, tmp_path):
    enc = PK.encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    rows = [(1, "a first long text " * 30), (1, "another one " * 40), (None, "no id " * 20), (None, None), (1, "a first long text " * 30)]
    packed = PK.pack(docs(spark, rows).withColumn("shard", F.lit("x")), length=32, window=300)
    PK.write_packed(packed, f"{tmp_path}/packed")
    again = spark.read.parquet(f"{tmp_path}/packed")
    assert sorted(map(str, again.select(*packed.columns).collect())) == sorted(map(str, packed.collect()))
    back = sorted((r["doc_id"] or 0, enc.decode(np.frombuffer(r["ids"], "<u4").tolist()[:-1])) for r in PK.unpack(again).collect())
    assert back == sorted((i or 0, t or "") for i, t in rows)
    for shard in {r["shard"] for r in again.collect()}:
        at = [r["row"] for r in again.where(F.col("shard") == shard).orderBy("row").collect()]
        assert at == list(range(len(at)))


def test_long_texts_are_cut_between_tokens():
    enc = PK.encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    text = "word  two\n three's 12 " * 400
    assert np.concatenate([enc.encode_to_numpy(x, disallowed_special=()) for x in PK.chunks(text, 100)]).tolist() == enc.encode_ordinary(text)


# 4 preference


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert check(spark, SF, Q.QUERIES[name], Q.ORACLE_SQL[name]) > 0


def test_common_prefix_masks_and_odd_turns(spark):
    conv = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi <|im_end|>"), (2, 1, "assistant", "no"), (3, 1, None, None), (3, None, "assistant", "x"), (None, 0, "user", "lost")]
    t = spark.createDataFrame(conv, "conv_id long, turn long, role string, text string")
    turns = PF.turns_of(t)
    pairs = turns.where("conv_id = 1").select(F.lit(1).alias("pair_id"), F.col("turns").alias("chosen")).crossJoin(turns.where("conv_id = 2").select(F.col("turns").alias("rejected")))
    r = PF.format_pairs(pairs).first()
    assert r["prompt_turns"] == 1 and "hi < |im_end|>" in r["prompt"]
    assert [r["chosen"][s["start"] : s["end"]] for s in r["chosen_loss"]] == ["yes<|im_end|>"]
    assert [r["rejected"][s["start"] : s["end"]] for s in r["rejected_loss"]] == ["no<|im_end|>"]
    assert r["usable"]
    forged = PF.turns_of(spark.createDataFrame([(1, 0, "user<|im_end|>\nassistant", "x")], "conv_id long, turn long, role string, text string")).first()["turns"][0]
    assert forged["role"] == "user< |im_end|> assistant"
    same = PF.format_pairs(turns.where("conv_id = 1").select(F.lit(1).alias("pair_id"), F.col("turns").alias("chosen"), F.col("turns").alias("rejected"))).first()
    assert (same["prompt_turns"], same["chosen"], same["rejected"], same["usable"]) == (2, "", "", False)
    odd = turns.where("conv_id = 3").select("conv_id", "turns").first()["turns"]
    assert [(x["role"], x["text"]) for x in odd] == [("assistant", "x"), ("unknown", "")]
    one = spark.createDataFrame([(1, None, None)], "pair_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    assert PF.format_pairs(one).first()["chosen"] == ""
    assert PF.sampled_rejections(t.where("conv_id < 0")).count() == 0


# 5 toxicity


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.2
    votes = np.stack([np.where(y, rng.random(6000) < a, rng.random(6000) < b) for a, b in ((0.7, 0.02), (0.5, 0.01), (0.4, 0.02), (0.6, 0.05))], 1)
    # two more that mostly repeat the first one's vote
    votes = np.concatenate([votes, *(np.where(rng.random(6000) < 0.95, votes[:, 0], rng.random(6000) < 0.1)[:, None] for _ in range(2))], 1)
    m = TX.LabelModel(votes, np.array([0.05, 0.5, 0.9])[np.minimum(votes.sum(1), 2)])
    assert (m.accuracy[1] > 5 * m.accuracy[0]).all()
    joined = {frozenset((j, p)) for j, p in enumerate(m.parent) if p >= 0}
    assert len(joined & {frozenset(x) for x in ((0, 4), (0, 5), (4, 5))}) == 2
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.9


def test_label_model_posterior_equals_enumeration():
    rng = np.random.default_rng(2)
    y = rng.random(500) < 0.4
    votes = np.stack([np.where(y, rng.random(500) < 0.6, rng.random(500) < 0.1) for _ in range(4)], 1)
    votes = np.concatenate([votes, votes[:, :1]], 1)
    m = TX.LabelModel(votes, np.where(votes.any(1), 0.9, 0.1))
    joint = {}
    for c in (0, 1):
        for v in itertools.product((False, True), repeat=5):
            p = m.share if c else 1 - m.share
            for j, fires in enumerate(v):
                r = m.rate[c, int(m.parent[j] >= 0 and v[m.parent[j]]), j]
                p *= r if fires else 1 - r
            joint[c, v] = p
    assert abs(sum(joint.values()) - 1) < 1e-9 and (m.parent >= 0).any()
    for row, q in zip(votes, m.posterior(votes), strict=True):
        told = [sum(p for (c, v), p in joint.items() if c == y and all(v[j] for j in np.flatnonzero(row))) for y in (0, 1)]
        told = [x * (r if row.any() else 1 - r) for x, r in zip(told, m.spoken, strict=True)]
        assert abs(told[1] / sum(told) - q) < 1e-9


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{rnd.randint(0, 300)}" for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            w[rnd.randrange(40)] = rnd.choice(["scumbag", "rotten", "vile"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + i, t) for i, t in ODD]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in TX.toxicity(docs(spark, rows), lab).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and not got[next(i for i in range(600) if i not in held)]["held_out"]
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.95
    assert {r["score"] for r in TX.toxicity(docs(spark, ODD), lab.where("doc_id < 0")).collect()} == {1 / (1 + np.exp(30.0))}
    assert TX.toxicity(docs(spark, []), lab).count() == 0


# 6 language


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = LI.language_id(d).join(d.select("doc_id", "lang", "text"), "doc_id").where(F.length("text") > 20).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.9


def test_language_of_odd_rows(spark):
    d = docs(spark, [(100 + i, "le chat et la souris dans la maison") for i in range(8)] + ODD)
    got = {r["doc_id"]: r for r in LI.language_id(d).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {1, 2, 8} and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in LI.language_id(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert LI.language_id(docs(spark, [])).count() == 0
    kept = LI.keep_spoken(d, None)
    assert kept.count() == 0 and kept.columns == d.columns


def test_pair_tables_equal_the_network():
    rng = np.random.default_rng(3)
    net = LI.ByteNet(["a", "b", "c"], np.arange(256).astype(np.uint8))
    x = rng.integers(0, LI.CLASSES, (70, LI.WINDOW + 3)).astype(np.uint8)
    x[5, 40:] = 0
    assert np.allclose(net.ready().probabilities(x), net.softmax(net.pooled(x)[0]), atol=1e-5)


def test_windows_cover_whole_texts():
    text = bytes(range(97, 123)) * 50
    data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    x, doc, letters = LI.windows(data, off, np.arange(256).astype(np.uint8))
    assert bytes(np.concatenate([r[: LI.WINDOW] for r in x])).rstrip(b"\0") == text and letters.sum() == len(text)


# 7 secrets


def brute_spans(text):
    rules = [
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    found = [(m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(rules) for m in re.finditer(p, text, re.ASCII) if ok(m)]
    return ",".join(f"{k}:{s}:{e}" for s, n, k, e in sorted(found))


def test_base_spans_equal_brute_force(spark):
    rnd = random.Random(1)
    parts = ["password = ", "PASSWD:'", "ſecret=", "api_key=", "apikey: ", "toKen=", "AKIA", "abc123", "0123456789abcdef", "é🙂", " ", "ABCDEFGH", "=", '"', "xyz.-/+"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(150)] + [(900 + i, t) for i, t in ODD]
    import hashlib

    got = {r["doc_id"]: r for r in SE.scan_secrets(docs(spark, rows)).collect()}
    for i, t in rows:
        want = brute_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
        assert got[i]["n_hex"] == want.count("hex:")
    assert SE.scan_secrets(docs(spark, [])).count() == 0


def test_random_tokens_are_found_and_words_left(spark):
    rnd = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    plain = " ".join("".join(rnd.choice(["the", "ing", "tion", "er", "and", "ou"]) for _ in range(rnd.randint(1, 5))) for _ in range(20_000))
    word = "theingtionandertheingtionandouer2"
    rows = [(i, f"{plain[i * 400 : i * 400 + 900]} {''.join(rnd.choices(alphabet, k=40)) if i % 4 == 0 else word}") for i in range(80)]
    got = {r["doc_id"]: r["n_random"] for r in SE.scan_secrets(docs(spark, rows)).collect()}
    assert sum(got[i] for i in range(0, 80, 4)) >= 17 and sum(n for i, n in got.items() if i % 4) == 0
    masked = {r["doc_id"]: r["text"] for r in SE.mask_secrets(docs(spark, [*rows, (900, None), (901, "token = abcdefgh1 end")])).collect()}
    assert masked[900] is None and masked[901] == "[secret] end" and sum("[secret]" in (t or "") for t in masked.values()) >= 18


def test_thresholds_follow_benjamini_hochberg():
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.random(500), rng.random(50) * 1e-6])
    bins = (-np.log10(p) / 0.1).astype(int)
    least = SE.thresholds([("a", int(b), 1) for b in bins], 0.05)["a"]
    k = max(i for i, x in enumerate(np.sort(p), 1) if x <= 0.05 * i / len(p))
    assert abs((bins >= least).sum() - k) <= 5


# 8 pieces


@pytest.fixture(scope="module")
def model():
    return SP.Model("/opt/tokenizers/piece_bpe_32k.model")


def every_segmentation(m, s):
    ends, _ = m.lattice(s)
    upto = {0: [(0.0, [])]}
    for j in range(1, len(s) + 1):
        upto[j] = [(a + c, ids + (list(p) if isinstance(p, tuple) else [p])) for i, p, c in ends[j] for a, ids in upto[i]]
    return sorted(upto[len(s)], key=lambda x: -x[0])


def test_nbest_equals_every_segmentation(model):
    for s in ("▁hello", "▁erhaé", "ñüß", "▁▁a", "\n", "日", "▁thblea"):
        assert [round(x, 6) for x, _ in model.nbest(s, 5)] == [round(x, 6) for x, _ in every_segmentation(model, s)[:5]]
    e = SP.Encoder(model, 4)
    ids, off, best, more = e.batch(["hi wor\nlé", ""])
    every = every_segmentation(model, "▁hi▁wor\nlé")
    assert [round(x, 6) for x, _ in every[:4]] == [round(x, 6) for x in (best[0], *(s for s, _ in more[0]))]
    for score, changes in more[0]:
        own = ids[off[0] : off[1]].tolist()
        for at, drop, new in reversed(changes):
            own[at : at + drop] = new
        assert (round(score, 6), own) in [(round(x, 6), y) for x, y in every] and model.decode(np.array(own)) == "hi wor\nlé"
    assert best[1] == 0.0 and more[1] == [] and off[2] == off[1]


def test_long_runs_of_equal_letters(model):
    for c in "a", "=", "語", "q":
        for s in (c * 9, f"{c * 5}b{c * 4}"):
            want = every_segmentation(model, s)
            got = model.nbest(s, 6)
            assert [round(x, 6) for x, _ in got] == [round(x, 6) for x, _ in want[:6]]
            assert len({tuple(x) for _, x in got}) == len(got) and all((x, y) in want for x, y in got)
    began = time.perf_counter()
    e = SP.Encoder(model, 4)
    ids, off, best, more = e.batch(["a" * 100_000, "a" * 1600, "=" * 20_000])
    assert time.perf_counter() - began < 60
    assert [model.decode(ids[a:b]) for a, b in itertools.pairwise(off.tolist())] == ["a" * 100_000, "a" * 1600, "=" * 20_000]
    assert all(len(m) == 3 and m[0][0] <= b for m, b in zip(more, best, strict=True))


def test_vector_and_single_search_agree(model):
    rnd = random.Random(0)
    segs = list({"".join(rnd.choices("▁theonéñ日ab.", k=rnd.randint(1, 30))) for _ in range(300)})
    ids, off, score, gap = SP.viterbi(model, segs)
    for i, s in enumerate(segs):
        a = model.nbest(s, 2)
        assert abs(a[0][0] - score[i]) < 1e-6 and (len(a) < 2 or abs(a[0][0] - a[1][0] - gap[i]) < 1e-6)
        assert gap[i] < 1e-6 or a[0][1] == ids[off[i] : off[i + 1]].tolist()


def test_pieces_round_trip(spark):
    got = {r["doc_id"]: r for r in SP.encode_pieces(docs(spark, [*ODD, (9, "▁")])).collect()}
    assert all(got[i]["lossless"] for i, _ in ODD) and not got[9]["lossless"]
    assert got[1]["n_pieces"] == got[2]["n_pieces"] == 0 and got[5]["ids"] == got[6]["ids"]
    assert SP.encode_pieces(docs(spark, [])).count() == 0


# 9 licences


def test_licences_equal_brute_force(spark):
    rnd = random.Random(3)
    parts = ["CC BY", "cc-by", "General\nPublic License", "ALL RIGHTS RESERVED", "general public", "all", "rights", "ccby", "é", "x", "K", "1"]
    rows = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(120)] + [(900 + i, t) for i, t in ODD]
    got = {r["doc_id"]: r for r in LS.scan_licenses(docs(spark, rows)).collect()}
    for i, t in rows:
        w = words(t or "")
        places = {p: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p in LS.PHRASES}
        every = sorted(k for x in places.values() for k in x)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(every), every[0] if every else None, every[-1] if every else None), t
        assert r["base_labels"] == ",".join(sorted({LS.PHRASES[p] for p, x in places.items() if x}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert LS.scan_licenses(docs(spark, [])).count() == 0


def test_templates_and_their_keys(spark):
    for _, text, keys in LS.TEMPLATES:
        assert all(f" {k} " in f" {text} " for k in keys) and any(s in k for k in keys for s in LS.SIGNS)
    rows = [(i, f"some words\n{text.upper()}. And more") for i, (_, text, _) in enumerate(LS.TEMPLATES)] + [(99, "a mit of a license and the apache of a version 2")]
    got = {r["doc_id"]: r["labels"].split(",") for r in LS.scan_licenses(docs(spark, rows)).collect()}
    assert all(label in got[i] for i, (label, _, _) in enumerate(LS.TEMPLATES)) and got[99] == [""]


# the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    more = [(10_000 + i, t) for i, t in ODD] + [(None, "a row without any id has a text of its own"), (20_000, "one id and one text of two that are unlike"), (20_000, "while the second row of this id says something else"), (20_001, "password = hunter2hunter2 and so on")]
    d = spark.read.parquet(f"{SF}/documents.parquet").unionByName(docs(spark, more)).withColumn("extra", F.lit(1))
    held = []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == P.COLUMNS, name
        before, rows = {(r["doc_id"], r["text"]) for r in d.collect()}, out.collect()
        held.append({(r["doc_id"], r["text"]) for r in rows})
        assert name == "secrets" or held[-1] <= before
        d = spark.createDataFrame(rows, out.schema)
    # language: every text with a letter, and no other; dedup: one of each class; decontamination: those without a benchmark passage
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert {10_001, 10_002, 10_008}.isdisjoint({i for i, _ in held[0]}) and all(letters(t) for _, t in held[0])
    kept = [i for i, _ in held[1]]
    assert None in kept and kept.count(20_000) == 2 and 10_006 not in kept and 10_005 in kept
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = sorted(held[1], key=str)
    flat, off = DC.utf8(DC.normal(pa.array([t for _, t in rows], pa.large_string())))
    bad = {n for n, *_ in DC.Index(bench).regions(flat, off)}
    assert held[2] == {r for n, r in enumerate(rows) if n not in bad}
    assert ("[secret] and so on") in {t for _, t in held[3]} and len(held[3]) == len(held[2])
    out = P.STAGES[-1][1](spark, d, SF).collect()
    assert len(out) == d.count() and all(r["lossless"] for r in out)
    assert P.run(spark, SF).count() > 0
