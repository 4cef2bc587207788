"""Toxicity by weak supervision: mined voters, a generative label model, a linear classifier.

Voters are mined from labelled training rows: lexicon voters are words, pattern voters are byte n-grams of
words, each kept if it is far commoner in toxic texts. A generative label model then explains the votes of the
training sample, without the labels, by a latent class: it estimates each voter's rate in either class and, for
the voter it most depends on within the classes, its rate given that one's vote, so that voters which fire
together count as the one piece of evidence they are. The posterior labels, and no others, train a logistic
regression over the presence of many hashed words and n-grams, and that classifier scores every whole text.

Null or empty text has no features: its score is the classifier's intercept. Repeated texts score alike. With
no labelled toxic row nothing is learned and every score is 0. Extra columns are ignored; labels, lang,
source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import WORD_CLASS, distinct, mix, powers, saved, slices, spans_of, utf8

GRAMS = (5, 6, 8)
BITS = 22


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of the words and of the byte n-grams within words, with repeats.

    A feature is a hash of BITS + 2 bits: words and each n-gram length have ranges of their own.
    """
    data, off = utf8(pc.utf8_lower(col))
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_word = WORD_CLASS[data]
    starts, ends = spans_of(is_word, off)
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
    shift = np.uint64(64 - BITS)
    out_d = [np.searchsorted(off, starts, side="right") - 1]
    out_f = [(mix((total[ends] - total[starts]) * q[starts]) >> shift).astype(np.int64)]
    word = np.cumsum(np.bincount(starts, minlength=len(data)))
    at = np.flatnonzero(is_word)
    room = ends[word[at] - 1] - at
    head = np.zeros(len(data), bool)
    head[starts] = True
    for k, n in enumerate(GRAMS, 1):
        a = at[room >= n]
        # an n-gram at the head of a word is another feature than the same within
        h = mix((total[a + n] - total[a]) * q[a] + head[a].astype(np.uint64) * np.uint64(0x51ED270B))
        out_f.append((h >> shift).astype(np.int64) + (k << BITS))
        out_d.append(np.searchsorted(off, a, side="right") - 1)
    return np.concatenate(out_d), np.concatenate(out_f)


def presence(col: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, place in sorted `wanted`) pairs, each once."""
    d, f = features(col)
    if not len(d) or not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = _table(wanted)
    k = table[f]
    on = k >= 0
    key = distinct(d[on] * len(wanted) + k[on])
    return key // len(wanted), key % len(wanted)


_tables: dict[bytes, np.ndarray] = {}


def _table(wanted: np.ndarray) -> np.ndarray:
    key = wanted.tobytes()
    if key not in _tables:
        _tables.clear()
        t = np.full((len(GRAMS) + 1) << BITS, -1, np.int32)
        t[wanted] = np.arange(len(wanted))
        _tables[key] = t
    return _tables[key]


def counts(col: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, toxic texts, other texts that have it)."""
    size = (len(GRAMS) + 1) << BITS
    d, f = features(col)
    key = distinct(d * size + f)
    d, f = key // size, key % size
    order = np.argsort(f, kind="stable")
    f, bad = f[order], toxic[d[order]].astype(np.int64)
    at = np.flatnonzero(np.append(True, f[1:] != f[:-1])) if len(f) else np.zeros(0, np.int64)
    n, pos = np.diff(np.append(at, len(f))), np.add.reduceat(bad, at) if len(at) else at
    return f[at], pos, n - pos


def _count(batches):
    for b, col in slices(batches):
        f, pos, neg = counts(col, b.column(b.schema.get_field_index("toxic")).to_numpy() == 1)
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(pos), pa.array(neg)], ["feature", "pos", "neg"])


def mine(labelled: DataFrame, most: int = 4096, least_docs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(features, log-odds): those far commoner in toxic texts than in others, the best by chi-squared.

    labelled: (text, toxic), of bounded rows. Counts are made where the texts are; `most` of them reach the driver.
    """
    n1, n0 = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    n = n1 + n0
    per = labelled.select("text", "toxic").mapInArrow(_count, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").cast("double").alias("a"), F.sum("neg").cast("double").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    a, b = F.col("a"), F.col("b")
    cross = a * (n0 - b) - b * (n1 - a)
    chi = n * cross * cross / F.greatest((a + b) * (n - a - b) * float(n1 * n0), F.lit(1.0))
    kept = per.where(a >= least_docs).select("feature", odds.alias("odds"), chi.alias("chi")).where("odds > 2.5 AND chi > 20").orderBy(F.desc("chi"), "feature").limit(most).collect()
    kept = sorted((r["feature"], r["odds"]) for r in kept)
    return np.array([f for f, _ in kept], np.int64), np.array([o for _, o in kept])


def _design(wanted: np.ndarray):
    """Each text's places in `wanted`, as int32 bytes."""

    def run(batches):
        for b, col in slices(batches):
            d, k = presence(col, wanted)
            cut = np.searchsorted(d, np.arange(b.num_rows + 1))
            rows = [k[i:j].astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(rows, pa.binary())], ["doc_id", "has"])

    return run


class LabelModel:
    """A latent class and voters that fire or abstain, each given the class and at most one other voter's vote.

    `parent` (-1: none) is the voter that a voter most depends on within the classes: the maximum spanning forest
    of the conditional mutual information of all pairs, less what chance alone would give. `rate[y, v, j]` is the
    chance that voter j fires in class y if its parent's vote is v; `accuracy[y, j]` whatever its parent does;
    `share` is the chance of class 1. All of them are estimated by expectation-maximisation without any label:
    the start, which tells which class is which, is a guess of each row's class. A voter that does not fire
    abstains, which is no evidence of its own: it knows one word of one language, and its vote is summed over;
    that no voter fires at all is one piece of evidence, with the chance `spoken` of any firing in either class.
    """

    def __init__(self, votes: np.ndarray, guess: np.ndarray, rounds: int = 20):
        x = votes.astype(np.float64)
        q = np.clip(guess.astype(np.float64), 0.02, 0.98)
        for k in range(rounds):
            if k in (0, 5, 10):
                self.parent, self.order = self._forest(x, q)
            self._fit(x, q)
            new = self.posterior(votes)
            done = np.abs(new - q).max() < 1e-4 and k > 10
            q = new
            if done:
                break

    def _fit(self, x: np.ndarray, q: np.ndarray) -> None:
        m = x.shape[1]
        self.share = float(np.clip(q.mean(), 1e-4, 1 - 1e-4))
        some = x.any(1)
        self.spoken = [float(np.clip((w @ some + 0.5) / (w.sum() + 1), 1e-4, 1 - 1e-4)) for w in (1 - q, q)]
        self.rate, self.accuracy = np.zeros((2, 2, m)), np.zeros((2, m))
        up = np.where(self.parent >= 0, self.parent, 0)
        for y, w in ((0, 1 - q), (1, q)):
            own = (w @ x + 0.05) / (w.sum() + 1)
            self.accuracy[y] = own
            with_parent = x[:, up] * (self.parent >= 0)
            for v, p in ((0, 1 - with_parent), (1, with_parent)):  # shrunk to the rate without the parent
                n, hit = w @ p, np.einsum("i,ij,ij->j", w, p, x)
                self.rate[y, v] = (hit + 2 * own) / (n + 2)
            self.rate[y][:, self.parent < 0] = own[self.parent < 0]
        self.rate = np.clip(self.rate, 1e-6, 1 - 1e-6)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of class 1 given the votes that fired; those that did not are summed over.

        Sums go up the forest, from the voters without children to the roots.
        """
        some = votes.any(1)
        z = np.full(len(votes), np.log(self.share) - np.log1p(-self.share))
        for y, sign in ((1, 1), (0, -1)):
            z += sign * np.where(some, np.log(self.spoken[y]), np.log1p(-self.spoken[y]))
            below = np.zeros((2, *votes.shape))  # log chance of the fired votes below a voter, given its own
            for j in self.order[::-1]:
                p, r = self.parent[j], self.rate[y, :, j]
                for v in (0, 1) if p >= 0 else (0,):
                    fires = np.log(r[v]) + below[1][:, j]
                    both = np.where(votes[:, j], fires, np.logaddexp(fires, np.log1p(-r[v]) + below[0][:, j]))
                    if p >= 0:
                        below[v][:, p] += both
                    else:
                        z += sign * both
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @staticmethod
    def _forest(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = x.shape
        info = np.zeros((m, m))
        for w in (1 - q, q):
            total = w.sum() + 1e-9
            both = (x * w[:, None]).T @ x / total
            p = np.diag(both)
            for joint, a, b in ((both, p[:, None], p[None]), (p[:, None] - both, p[:, None], 1 - p[None]), (p[None] - both, 1 - p[:, None], p[None]), (1 - p[:, None] - p[None] + both, 1 - p[:, None], 1 - p[None])):
                joint = np.maximum(joint, 1e-12)
                info += total / n * joint * np.log(joint / np.maximum(a * b, 1e-12))
        info -= 10 / n  # a pair without dependence reaches this hardly ever
        np.fill_diagonal(info, 0)
        parent, best, seen, order = np.full(m, -1), np.zeros(m), np.zeros(m, bool), np.zeros(m, np.int64)
        for k in range(m):  # Prim's algorithm, a new tree where no positive edge is left
            at = int(np.argmax(np.where(seen, -1, best)))
            seen[at], order[k] = True, at
            better = ~seen & (info[at] > best)
            best[better], parent[better] = info[at][better], at
        return parent, order


def logistic(d: np.ndarray, k: np.ndarray, n: int, m: int, target: np.ndarray, start: np.ndarray, steps: int = 300, l2: float = 10.0) -> tuple[np.ndarray, float]:
    """Gradient descent for a sparse binary design given as (row, feature) pairs and soft targets.

    Each step drops a fifth of the features at random, so that one of several that usually come together suffices.
    """
    rng = np.random.default_rng(1)
    w, b = start * 0.3, -2.0
    every_d, every_k = d, k
    vw, vb, g2, gb2 = np.zeros(m), 0.0, np.zeros(m), 0.0
    weight = np.where(target > 0.5, 0.5 / max((target > 0.5).mean(), 1e-3) ** 0.5, 0.5 / max((target <= 0.5).mean(), 1e-3))
    for step in range(1, steps + 1):
        kept = rng.random(len(every_d)) < 0.8
        d, k = every_d[kept], every_k[kept]
        z = np.bincount(d, w[k], n) + b
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        gw, gb = np.bincount(k, e[d], m) + l2 * w / n, e.sum()
        vw, vb = 0.9 * vw + 0.1 * gw, 0.9 * vb + 0.1 * gb
        g2, gb2 = 0.99 * g2 + 0.01 * gw * gw, 0.99 * gb2 + 0.01 * gb * gb
        w = w - 0.05 * (vw / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.99**step)) + 1e-8)
        b = b - 0.05 * (vb / (1 - 0.9**step)) / (np.sqrt(gb2 / (1 - 0.99**step)) + 1e-8)
    return w, float(b)


def learn(wanted: np.ndarray, odds: np.ndarray, has: list[np.ndarray], voters: int = 256) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, intercept) of the classifier, trained on the label model's posteriors alone.

    has: each sampled text's places in `wanted`.
    """
    n, m = len(has), len(wanted)
    d, k = np.repeat(np.arange(n), [len(h) for h in has]), np.concatenate(has).astype(np.int64)
    # the voters: the features of the highest odds, lexicon (words) and patterns (n-grams) alike
    words, grams = np.flatnonzero(wanted < 1 << BITS), np.flatnonzero(wanted >= 1 << BITS)
    best = np.concatenate([x[np.argsort(-odds[x], kind="stable")][: voters // 2] for x in (words, grams)])
    place = np.full(m, -1)
    place[best] = np.arange(len(best))
    votes = np.zeros((n, len(best)), bool)
    on = place[k] >= 0
    votes[d[on], place[k[on]]] = True
    # a guess from the votes alone: several, one, none
    model = LabelModel(votes, np.array([0.05, 0.5, 0.9])[np.minimum(votes.sum(1), 2)])
    w, b = logistic(d, k, n, m, model.posterior(votes), odds)
    return wanted, w, b


def _score(model):
    def run(batches):
        for b, col in slices(batches):
            n = b.num_rows
            z = np.full(n, -30.0)
            if model is not None:
                wanted, w, bias = model
                d, k = presence(col, wanted)
                z = np.bincount(d, w[k], n) + bias if len(d) else np.full(n, bias)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = 6_000) -> DataFrame:
    """Score every row of docs; learn from rows whose crc32(doc_id) mod 5 is not 0.

    bound: the most rows of the training sample, of which toxic labelled, other labelled and rows taken without
    their label have a third each; they are chosen by a hash of doc_id over the whole table, by sorted top-k of
    bounded size. Labels choose the sample's thirds and mine the voters; no row's label is a training target. A
    repeated doc_id is one row of the sample (its least text by hash). A null doc_id is not held out, and no such
    row is learned from.
    """
    spark, held_out = docs.sparkSession, F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    own = labels.where(~held_out & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(17), "doc_id")
    third = bound // 3
    picked = own.where("toxic = 1").orderBy(order).limit(third).unionByName(own.where("toxic = 0").orderBy(order).limit(third)).collect()
    model = None
    if {r["toxic"] for r in picked} == {0, 1}:
        named = spark.createDataFrame(picked, "doc_id long, toxic int")  # 2/3 of the bound
        more = docs.select("doc_id").where(~held_out).join(F.broadcast(named), "doc_id", "left_anti").distinct().orderBy(order).limit(third).collect()
        named = named.unionByName(spark.createDataFrame([(r["doc_id"], None) for r in more], "doc_id long, toxic int"))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(named), "doc_id")
        sample = saved(rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "toxic-sample")  # bound rows
        wanted, odds = mine(sample.where("toxic is not null"))
        if len(wanted):
            has = sample.select("doc_id", "text").mapInArrow(_design(wanted), "doc_id long, has binary").collect()
            model = learn(wanted, odds, [np.frombuffer(r["has"], np.int32) for r in sorted(has)])
    scored = docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
