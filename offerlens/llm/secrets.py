"""Secret scan: fixed patterns plus a randomness test battery with length-aware false-discovery control.

Pass 1 counts byte pairs over every text: the order-1 model of ordinary text. Pass 2 finds, in every whole
text, the fixed patterns' spans and the long tokens; a token is also cut at its inner `=` and at `/`, `+`, `-`
and `_`, and every part that is long enough is tested: its encoding is inferred and its characters
are tested for uniformity (chi-squared over the alphabet), runs about the middle of the alphabet and lag-1
serial correlation. The departure from randomness is compared with what ordinary text of the same encoding
and length class would show; Benjamini-Hochberg per (encoding, length class), over the histogram of all
tokens of the corpus, sets the threshold. Only histograms of fixed size reach the driver.

Null or empty text: no spans. Repeated rows are scanned each on their own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import reduce
from operator import or_
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import saved, slices, utf8

# The patterns of the base kinds, in their listed order.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
SHORTEST = {"assign": 8, "access": 16, "hex": 32}

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile(ACCESS)
_hex = re.compile(r"[0-9a-f]{32,}")
_token = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_value = re.compile(r"[A-Za-z0-9+/_-]+")
#: Whole values, and their parts where one alphabet's separators, or all, are cut out.
_cuts = [re.compile(x) for x in (r"[A-Za-z0-9+/_-]+", r"[A-Za-z0-9+/]+", r"[A-Za-z0-9_-]+", r"[A-Za-z0-9]+")]
_has_assign = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
_has_token = r"[A-Za-z0-9+/_=-]{20}"

_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
#: Encodings, the narrowest first; a token has the first whose alphabet holds it.
ALPHABETS = {
    "digits": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "hexup": _DIGITS + "ABCDEF",
    "upper": _UPPER,
    "lower": _LOWER,
    "base32": _UPPER + "234567",
    "lower36": _DIGITS + _LOWER,
    "alpha": _UPPER + _LOWER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_TOKENS = "array<struct<start:int,end:int,cls:string,score:int>>"
LENGTHS = (20, 24, 32, 40, 48, 64, 96, 128, 256)
BINS = 400
_BIN_WIDTH = 0.1  # of -log10 p


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns, in order; positions are code points."""
    found = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
    found += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= SHORTEST["access"]]
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(found)


def encoding_of(token: str) -> str | None:
    body = set(token.rstrip("="))
    if token[0] in _UPPER and token[1:] and set(token[1:]) <= set(_LOWER):
        return "lower"  # a capitalised word, tested in lower case
    return next((k for k, a in ALPHABETS.items() if body <= set(a)), None)


def parts_of(token: str, start: int) -> list[tuple[int, int, str]]:
    """(start, end, encoding) of the token's parts to test: between its inner `=`, and within these between separators."""
    out = {}
    for m in _value.finditer(token):
        for cut in _cuts:
            for x in cut.finditer(m[0]):
                at, end = start + m.start() + x.start(), start + m.start() + x.end()
                if not token[m.start() + x.end() :].strip("="):
                    end = start + len(token)  # with its padding
                kind = encoding_of(x[0])
                if kind and len(x[0]) >= LENGTHS[0]:
                    out[at, end] = kind
    return [(s, e, k) for (s, e), k in out.items()]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def departure(codes: np.ndarray, m: int) -> float:
    """Log of the summed squared z-scores of the three tests; low for a random string over m letters."""
    n = len(codes)
    chi = float(((np.bincount(codes, minlength=m) - n / m) ** 2).sum() * m / n)
    df = m - 1
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = codes >= m // 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 0.25)
        zr = (runs - mean) / math.sqrt(var)
    else:
        zr = math.sqrt(n)
    x = codes - codes.mean()
    s = float((x * x).sum())
    zs = float((x[1:] * x[:-1]).sum()) / s * math.sqrt(n) if s else math.sqrt(n)
    return math.log(1e-3 + max(z, 0.0) ** 2 + zr * zr + zs * zs)


def length_class(n: int) -> int:
    return max(i for i, x in enumerate(LENGTHS) if x <= n)


def null_model(pairs: np.ndarray, draws: int = 300, seed: int = 7) -> dict[tuple[str, int], tuple[float, float]]:
    """(mean, deviation) of `departure` for strings of ordinary text, by encoding and length class.

    pairs: 256 x 256 counts of neighbouring bytes. Where the text has none of an alphabet's letters, its
    letters follow a steep fixed law.
    """
    rng = np.random.default_rng(seed)
    out = {}
    for kind, letters in ALPHABETS.items():
        at = np.frombuffer(letters.encode(), np.uint8)
        w = pairs[np.ix_(at, at)].astype(float)
        if w.sum() < 100:
            w = np.outer(np.ones(len(at)), 1.0 / np.arange(1, len(at) + 1) ** 1.5)
        first = (w.sum(0) + w.sum(0).sum() * 1e-4 / len(at)) / (w.sum() * (1 + 1e-4))
        step = (w + 1e-3 * first) / (w + 1e-3 * first).sum(1, keepdims=True)
        cum = step.cumsum(1)
        for c, n in enumerate(LENGTHS):
            x = np.empty((draws, n), np.int64)
            x[:, 0] = rng.choice(len(at), draws, p=first / first.sum())
            for j in range(1, n):
                x[:, j] = np.minimum((rng.random(draws)[:, None] > cum[x[:, j - 1]]).sum(1), len(at) - 1)
            d = np.array([departure(r, len(at)) for r in x])
            out[kind, c] = (float(d.mean()), max(float(d.std()), 0.05))
    return out


def _count_pairs(batches):
    total = np.zeros(65536, np.int64)
    for _, col in slices(batches):
        data, _ = utf8(col)
        if len(data) > 1:
            total += np.bincount(data[:-1].astype(np.int64) << 8 | data[1:], minlength=65536)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


_SCANNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("base", pa.string()),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("tokens", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cls", pa.string()), ("score", pa.int32())]))),
    ]
)


def _scan(null: dict, least_p: float):
    codes = {k: {c: i for i, c in enumerate(a)} for k, a in ALPHABETS.items()}
    normal = NormalDist()

    def run(batches):
        for b, col in slices(batches):
            look = pc.or_(pc.or_(pc.match_substring_regex(col, _has_assign), pc.match_substring(col, "AKIA")), pc.match_substring_regex(col, _has_token))
            n = b.num_rows
            base, counts, tokens = [""] * n, np.zeros((3, n), np.int64), [[] for _ in range(n)]
            for i in np.flatnonzero(look.to_numpy(zero_copy_only=False)):
                text = col[int(i)].as_py()
                found = base_spans(text)
                base[i] = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
                for _, k, _ in found:
                    counts[k, i] += 1
                for m in _token.finditer(text):
                    for start, end, kind in parts_of(m[0], m.start()):
                        if any(s <= start and end <= e for s, _, e in found):
                            continue
                        body = text[start:end].rstrip("=")
                        body = body.lower() if kind == "lower" else body
                        c = length_class(len(body))
                        d = departure(np.fromiter(map(codes[kind].__getitem__, body), np.int64, len(body)), len(codes[kind]))
                        mean, dev = null[kind, c]
                        p = max(normal.cdf((d - mean) / dev), 10.0 ** (-BINS * _BIN_WIDTH + 1))
                        # itself not to be told from a random string: the three squared z-scores stay below their joint tail
                        score = int(-math.log10(p) / _BIN_WIDTH) if math.exp(d) < least_p else 0
                        tokens[i].append({"start": start, "end": end, "cls": f"{kind}:{c}", "score": score})
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(base), *map(pa.array, counts), pa.array(tokens, _SCANNED.field("tokens").type)], schema=_SCANNED)

    return run


def thresholds(histogram: list[tuple[str, int, int]], q: float) -> dict[str, int]:
    """Benjamini-Hochberg from (class, -log10 p bin, count): the lowest bin that is a discovery."""
    by: dict[str, np.ndarray] = {}
    for c, s, n in histogram:
        by.setdefault(c, np.zeros(BINS + 1, np.int64))[min(s, BINS)] += n
    out = {}
    for c, n in by.items():
        above = n[::-1].cumsum()[::-1]
        p = 10.0 ** (-np.arange(BINS + 1) * _BIN_WIDTH)
        ok = np.flatnonzero((above > 0) & (p * n.sum() <= q * above) & (np.arange(BINS + 1) > 0))
        if len(ok):
            out[c] = int(ok[0])
    return out


def _scanned(docs: DataFrame, q: float, tail: float) -> tuple[DataFrame, dict, dict[str, int]]:
    """(each document's spans and tested tokens, written; the null model; the least score by class)."""
    pairs = np.zeros(65536, np.int64)
    for r in docs.select("text").mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        pairs[r["pair"]] = r["n"]
    null = null_model(pairs.reshape(256, 256))
    schema = f"doc_id long, base string, n_assign long, n_access long, n_hex long, tokens {_TOKENS}"
    scanned = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(null, tail), schema), "secrets")
    # at most encodings x length classes x bins rows
    histogram = scanned.select(F.explode("tokens").alias("t")).groupBy("t.cls", "t.score").count().collect()
    return scanned, null, thresholds([tuple(r) for r in histogram], q)


def scan_secrets(docs: DataFrame, q: float = 0.01, tail: float = 27.0) -> DataFrame:
    """One row per document: counts of the base kinds, base spans, all spans.

    q: the false-discovery rate within each encoding and length class. tail: the most that the three squared
    z-scores of a random string may sum to. Method spans have the kind `random`; one that lies within a base
    span is not repeated.
    """
    scanned, _, least = _scanned(docs, q, tail)
    found = F.array().cast(_TOKENS)
    if least:
        found = F.filter("tokens", lambda t: reduce(or_, ((t["cls"] == c) & (t["score"] >= s) for c, s in sorted(least.items()))))
    return scanned.withColumn("found", found).mapInArrow(_finish, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def mask_secrets(docs: DataFrame, q: float = 0.01, tail: float = 27.0, mask: str = "[secret]") -> DataFrame:
    """docs with every span that scan_secrets finds replaced in text; null texts stay null, all columns stay."""
    _, null, least = _scanned(docs, q, tail)
    scan = _scan(null, tail)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), batch.column(at)], ["doc_id", "text"])
            for out in scan(iter([rows])):
                for r in out.select(["doc_id", "base", "tokens"]).to_pylist():
                    spans = [(int(x.split(":")[1]), int(x.split(":")[2])) for x in r["base"].split(",") if x]
                    spans += [(t["start"], t["end"]) for t in r["tokens"] if t["score"] >= least.get(t["cls"], BINS + 1)]
                    if spans:
                        texts[r["doc_id"]] = _masked(texts[r["doc_id"]], merged(spans), mask)
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column(at).type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, schema)


def _masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    parts, last = [], 0
    for s, e in spans:
        if s >= last:
            parts += [text[last:s], mask]
        last = max(last, e)
    return "".join([*parts, text[last:]])


def _finish(batches):
    for b in batches:
        rows = b.select(["base", "found"]).to_pylist()
        spans, digest, more = [], [], []
        for r in rows:
            own = [(int(s), k, int(e)) for k, s, e in (x.split(":") for x in r["base"].split(",") if x)]
            new = [(s, "random", e) for s, e in merged([(t["start"], t["end"]) for t in r["found"] or []])]
            order = [*KINDS, "random"]
            spans.append(",".join(f"{k}:{s}:{e}" for s, k, e in sorted(own + new, key=lambda x: (x[0], order.index(x[1])))))
            digest.append(hashlib.sha256(r["base"].encode()).hexdigest())
            more.append(len(new))
        yield pa.RecordBatch.from_arrays(
            [*(b.column(b.schema.get_field_index(c)) for c in ("doc_id", "n_assign", "n_access", "n_hex")), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
        )
