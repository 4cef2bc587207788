"""Language identification by a byte convolutional network, trained here in numpy.

Filters of several widths run over one-hot byte classes (so a filter is a table lookup per offset), each is
max-pooled over a fixed-length window, and a softmax layer follows. A text is cut into consecutive windows
that overlap by the widest filter less one, so every byte n-gram of the whole text is seen; the windows'
probabilities are averaged by their letters.

Null text or text without a letter: `und`, score 0. Where no labelled text exists every row is `und`.
Repeated rows get the same prediction. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import slices, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
CLASSES = 96  # the commonest bytes of the sample; 0 pads, 1 is any other
UNKNOWN = "und"

_letter = np.zeros(256, bool)
_letter[128:] = True
_letter[[*range(65, 91), *range(97, 123)]] = True


class ByteNet:
    """Tables of the network; `probabilities` takes windows of byte classes."""

    def __init__(self, langs: list[str], classes: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs, self.classes = langs, classes
        self.params = {f"t{w}": rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}
        for w in WIDTHS:
            self.params[f"t{w}"][:, 0] = 0
        self.params["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.params["bias"] = np.zeros(len(langs), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """x: (windows, positions) of byte classes -> pooled features, and where each filter peaks."""
        feats, where = [], []
        for w in WIDTHS:
            t = self.params[f"t{w}"]
            n = x.shape[1] - w + 1
            acc = t[0][x[:, :n]]
            for j in range(1, w):
                acc += t[j][x[:, j : j + n]]
            at = acc.argmax(1)
            where.append(at)
            feats.append(np.take_along_axis(acc, at[:, None], 1)[:, 0])
        return np.concatenate(feats, 1), where

    def softmax(self, feats: np.ndarray) -> np.ndarray:
        z = np.maximum(feats, 0) @ self.params["out"] + self.params["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the cross-entropy; the gradient of a max-pooled filter goes to the place where it peaks."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(p) for k, p in self.params.items()}
        by = [np.flatnonzero(y == c) for c in range(len(self.langs))]
        for step in range(1, steps + 1):
            pick = np.array([by[c][rng.integers(len(by[c]))] for c in rng.integers(0, len(by), batch)])
            xb, yb = x[pick], y[pick]
            feats, where = self.pooled(xb)
            p = self.softmax(feats)
            p[np.arange(batch), yb] -= 1
            p /= batch
            grad = {"out": np.maximum(feats, 0).T @ p, "bias": p.sum(0)}
            back = (p @ self.params["out"].T) * (feats > 0)
            for k, w in enumerate(WIDTHS):
                g = np.zeros_like(self.params[f"t{w}"])
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(xb, where[k] + j, 1), np.arange(FILTERS)[None]), part)
                g[:, 0] = 0
                grad[f"t{w}"] = g
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in self.params:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
                self.params[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)

    def ready(self) -> "ByteNet":
        """Pair tables: two offsets of a filter in one lookup."""
        t2, t3, t4 = (self.params[f"t{w}"] for w in WIDTHS)
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
        self.pairs = (pair(t2[0], t2[1]), pair(t3[0], t3[1]), t3[2], pair(t4[0], t4[1]), pair(t4[2], t4[3]))
        return self

    def probabilities(self, x: np.ndarray, most: int = 64) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)), np.float32)
        p2, p3, s3, a4, b4 = self.pairs
        for i in range(0, len(x), most):
            c = x[i : i + most]
            code = c[:, :-1].astype(np.int32) * CLASSES + c[:, 1:]
            f2 = p2.take(code[:, :], axis=0).max(1)
            acc = p3.take(code[:, :-1], axis=0)
            acc += s3.take(c[:, 2:], axis=0)
            f3 = acc.max(1)
            acc = a4.take(code[:, :-2], axis=0)
            acc += b4.take(code[:, 2:], axis=0)
            out[i : i + most] = self.softmax(np.concatenate([f2, f3, acc.max(1)], 1))
        return out


def windows(data: np.ndarray, off: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte classes of each window, its document, its letters); windows cover whole texts."""
    lap = max(WIDTHS) - 1
    size = np.diff(off)
    n = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), n)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = off[doc] + start * WINDOW
    left = np.minimum(off[doc + 1] - at, WINDOW + lap)
    width = np.arange(WINDOW + lap)
    idx = at[:, None] + width
    inside = width[None] < left[:, None]
    raw = np.where(inside, data[np.minimum(idx, max(len(data) - 1, 0))], 0) if len(data) else np.zeros(idx.shape, np.uint8)
    letters = (_letter[raw] & inside)[:, :WINDOW].sum(1)
    x = classes[raw]
    x[~inside] = 0
    return x, doc, letters


def held(remainder: int, divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor == remainder


def train(labelled: DataFrame, bound: int = 3000, seed: int = 3) -> ByteNet | None:
    """Fit on labelled (doc_id, text, lang): at most `bound` texts of each language, one window each.

    The sample is chosen by a hash of doc_id and text at a rate that the languages' counts give, so it is spread
    over the whole table and no group is gathered; repeated rows are one.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    u = (F.xxhash64(F.lit(seed), "doc_id", "text") % 1_000_000 + 1_000_000) % 1_000_000 / 1e6
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, 0.9 * bound / n))).otherwise(rate)
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.greatest(F.lit(1), F.length("text") - WINDOW)).cast("int") + 1
    got = rows.where(u < rate).select("doc_id", "lang", F.substring("text", start, F.lit(WINDOW)).alias("piece")).distinct().toPandas()
    got = got.sort_values(["doc_id", "piece", "lang"]).groupby("lang").head(bound)
    if not len(got):
        return None
    langs = sorted(got["lang"].unique())
    raw = [p.encode() for p in got["piece"]]
    seen = np.bincount(np.frombuffer(b"".join(raw), np.uint8), minlength=256)
    top = np.argsort(-seen, kind="stable")[: CLASSES - 2]
    classes = np.ones(256, np.uint8)
    classes[top] = np.arange(2, 2 + len(top))
    rng = np.random.default_rng(seed)
    length = WINDOW + max(WIDTHS) - 1
    x = np.zeros((len(raw), length), np.uint8)
    for i, r in enumerate(raw):
        n = len(r) if rng.random() < 0.6 else max(4, int(len(r) * rng.random()))  # short texts and last windows too
        r = r[:n][:length]
        x[i, : len(r)] = classes[np.frombuffer(r, np.uint8)]
    net = ByteNet(langs, classes)
    net.fit(x, np.array([langs.index(v) for v in got["lang"]]))
    return net


def _judge(net: ByteNet | None, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores of whole texts."""
    n = len(col)
    pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
    has = pc.match_substring_regex(col, r"\p{L}").to_numpy(zero_copy_only=False)
    if net is not None and has.any():
        data, off = utf8(col)
        x, doc, letters = windows(data, off, net.classes)
        keep = letters > 0
        x, doc, letters = x[keep], doc[keep], letters[keep]
        p = net.probabilities(x) * letters[:, None]
        total = np.stack([np.bincount(doc, p[:, c], n) for c in range(len(net.langs))], 1)
        total /= np.maximum(np.bincount(doc, letters, n), 1)[:, None]
        best = total.argmax(1)
        pred[has] = np.array(net.langs, object)[best[has]]
        score[has] = np.clip(total[np.arange(n), best][has], 0, 1)
    return pred, score


def _predict(net: ByteNet | None):
    def run(batches):
        if net is not None:
            net.ready()
        for b, col in slices(batches):
            pred, score = _judge(net, col)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def keep_spoken(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """docs without those of no language; lang becomes the prediction, the other columns stay."""

    def run(batches):
        if net is not None:
            net.ready()
        for b, col in slices(batches):
            pred, _ = _judge(net, col)
            lang = pa.array(pred, pa.string())
            cols = [lang if f.name == "lang" else c for f, c in zip(b.schema, b.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names).filter(pa.array(pred != UNKNOWN, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    return docs.select("doc_id", "text").mapInArrow(_predict(net), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, bound: int = 3000) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 4 is not 2; predict every row.

    A null doc_id is not held out, and no such row is learned from.
    """
    net = train(docs.where(~held(2, 4)).select("doc_id", "text", "lang"), bound)
    return identify(docs, net).select("doc_id", F.coalesce(held(2, 4), F.lit(False)).alias("held_out"), "lang_pred", "score")
