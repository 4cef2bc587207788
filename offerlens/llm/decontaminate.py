"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Windows of WINDOW bytes start at every STRIDE-th byte of a benchmark text; a document region that aligns with a
window at no more than the edit budget is a match, and overlapping matches of one text are one region. By the
q-gram lemma a window of m bytes and a region within k edits share at least m + 1 - q (k + 1) q-grams whose
diagonals (document position less benchmark position) differ by k at most. So: every q-gram of the document is
looked up in the index of the benchmark's positions; each shared one counts in the two overlapping diagonal bands
of 2k + 2 diagonals that hold its diagonal; a window is a candidate in a band where enough of its own positions
are shared; there an alignment of the band's diagonals alone (edit distance, free ends in the document) decides,
for many candidates at once. Shared q-grams are counted a bounded number at a time: the benchmark's positions,
then the document's, are halved, with an overlap that leaves every match whole, until a part is small enough.

Texts are compared in lower case with every run of space and punctuation as one space. Null or empty texts match
nothing. A benchmark text shorter than a window is one window with the budget of its length; one of fewer than
LEAST bytes matches where its words stand exactly. Repeated rows, equal and null doc_ids are each judged on their
own text; equal item_ids and equal texts of the benchmark count each. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import distinct, mix, powers, slices, utf8

WINDOW = 96
STRIDE = 4
RATE = 0.08
Q, FINE_Q = 10, 5
LEAST = 24
MOST_SHARED = 1 << 20  # shared q-grams counted at once
_space = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def normal(col: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(col), _space, " "), characters=" ")


def window_starts(n: int, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Starts of a text's windows; the last window ends with the text."""
    last = max(n - window, 0)
    return np.unique(np.append(np.arange(0, last + 1, stride), last))


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each position on."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
    return mix((total[n:] - total[:-n]) * q[: len(data) - n + 1])


class Postings:
    """Places of the q-grams of the benchmark's texts, and the windows that share enough of them in a band."""

    def __init__(self, index: Index, q: int):
        self.index, self.q, self.room = index, q, len(index.text) + WINDOW + 1
        self.bound = index.size + 1 - q * (index.k + 1)
        h = grams(index.text, q)
        at = np.arange(len(h))
        if len(h):
            inside = at + q <= index.off[np.searchsorted(index.off, at, side="right")]
            h, at = h[inside], at[inside]
        order = np.lexsort((at, h))
        self.place = at[order]
        self.grams, first = np.unique(h[order], return_index=True)
        self.count = np.diff(np.append(first, len(at)))
        # postings of one q-gram are in order of place: a key finds those of a range of places
        self.key = np.repeat(np.arange(len(self.grams)), self.count) * self.room + self.place
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.grams >> np.uint64(42)).astype(np.int64)] = True

    def shared(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, which q-gram) of the documents' q-grams that the benchmark has."""
        g = grams(data, self.q)
        at = np.flatnonzero(self.bits[(g >> np.uint64(42)).astype(np.int64)]) if len(g) else np.zeros(0, np.int64)
        which = np.searchsorted(self.grams, g[at])
        on = which < len(self.grams)
        at, which = at[on], which[on]
        on = (self.grams[which] == g[at]) & (at + self.q <= off[np.searchsorted(off, at, side="right")])
        return at[on], which[on]

    def candidates(self, at: np.ndarray, which: np.ndarray, most: int = MOST_SHARED):
        """Arrays of (window, band) whose windows share enough positions in a band of diagonals.

        Parts of the work overlap by more than a window with its edits, so each match lies whole in one of them.
        """
        wide = self.index.wide
        todo = [(0, len(self.index.text), 0, len(at))] if len(at) else []
        while todo:
            low, high, i, j = todo.pop()
            lo = np.searchsorted(self.key, which[i:j] * self.room + low)
            count = np.searchsorted(self.key, which[i:j] * self.room + high) - lo
            if count.sum() > most:
                span = int(at[j - 1] - at[i])
                if span > 2 * wide:
                    mid = at[i] + span // 2
                    todo += [(low, high, i, i + int(np.searchsorted(at[i:j], mid + wide))), (low, high, i + int(np.searchsorted(at[i:j], mid)), j)]
                    continue
                if high - low > 2 * wide:
                    mid = (low + high) // 2
                    todo += [(low, mid + wide, i, j), (mid, high, i, j)]
                    continue
            if count.any():
                yield self._banded(at[i:j], lo, count)

    def _banded(self, at: np.ndarray, lo: np.ndarray, count: np.ndarray) -> np.ndarray:
        index, room, q = self.index, self.room, self.q
        post = self.place[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        shift = np.repeat(at, count) - post + len(index.text)  # never negative
        out = [np.zeros((0, 2), np.int64)]
        for k in np.unique(index.k).tolist():
            mine = np.flatnonzero(index.k == k)
            need, size = int(self.bound[mine].min()), int(index.size[mine].max())
            band = shift // (k + 1)
            key = distinct(np.concatenate([band, band[band > 0] - 1]) * room + np.concatenate([post, post[band > 0]]))
            # a window can hold `need` positions from the i-th on only if the need-th of them is near
            near = np.flatnonzero(key[need - 1 :] - key[: len(key) - need + 1] <= size - q) if len(key) >= need else np.zeros(0, np.int64)
            b, first, last = key[near] // room, key[near] % room, key[near + need - 1] % room
            begins = index.start[mine]
            x, y = np.searchsorted(begins, last + q - size), np.searchsorted(begins, first, side="right")
            # the windows of a band's consecutive finds are ranges that grow: each window once
            same = np.append(False, b[1:] == b[:-1])
            x = np.maximum(x, np.where(same, np.append(0, y[:-1]), 0))
            m = np.maximum(y - x, 0)
            w = mine[np.repeat(x - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            b = np.repeat(b, m)
            base = b * room + index.start[w]
            got = np.searchsorted(key, base + index.size[w] - q, side="right") - np.searchsorted(key, base)
            on = got >= self.bound[w]
            out.append(np.stack([w[on], b[on]], 1))
        return np.concatenate(out)


class Index:
    """The benchmark's distinct texts, their windows, and postings of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        own: dict[bytes, set[int]] = {}
        if items:
            for (item, _), raw in zip(items, normal(pa.array([t or "" for _, t in items], pa.large_string())).to_pylist(), strict=True):
                if raw:
                    own.setdefault(raw.encode(), set()).add(item)
        long = [t for t in own if len(t) >= LEAST]
        self.items = [sorted(own[t]) for t in long]
        self.text = np.frombuffer(b"".join(long), np.uint8)
        self.off = np.cumsum([0, *map(len, long)])
        # windows, in order of their start in `text`
        starts = [window_starts(len(t)) + at for t, at in zip(long, self.off[:-1], strict=True)]
        self.owner = np.repeat(np.arange(len(long)), [len(s) for s in starts])
        self.start = np.concatenate([np.zeros(0, np.int64), *starts])
        self.size = np.minimum(WINDOW, self.off[self.owner + 1] - self.start)
        self.k = (self.size * rate).astype(np.int64)
        # a q that leaves every window a q-gram to share
        q = int(min(Q, (self.size // (self.k + 1)).min())) if len(self.start) else Q
        self.wide = WINDOW + 2 * int(self.k.max(initial=0)) + q
        self.coarse, self._fine = Postings(self, q), None
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for t, ids in own.items():
            if len(t) < LEAST:
                self.short.setdefault(len(t), {})[t] = sorted(ids)

    @property
    def fine(self) -> Postings:
        """Of shorter q-grams, of which a window must share a larger part."""
        if self._fine is None:
            self._fine = Postings(self, min(FINE_Q, self.coarse.q))
        return self._fine

    def aligned(self, data: np.ndarray, off: np.ndarray, pairs: np.ndarray, most: int = 4096) -> np.ndarray:
        """Rows (document, window, start, end, edits) of the candidates within budget; positions in the document.

        The band's cells alone are filled: row i of the table holds document positions low + i .. low + i + 2k + 1.
        """
        out = [np.zeros((0, 5), np.int64)]
        for k in np.unique(self.k[pairs[:, 0]]).tolist():
            for size in np.unique(self.size[pairs[:, 0]][self.k[pairs[:, 0]] == k]).tolist():
                group = pairs[(self.k[pairs[:, 0]] == k) & (self.size[pairs[:, 0]] == size)]
                for i in range(0, len(group), most):
                    out.append(self._align(data, off, group[i : i + most], size, k))
        return np.concatenate(out)

    def _align(self, data: np.ndarray, off: np.ndarray, pairs: np.ndarray, m: int, k: int) -> np.ndarray:
        w, wide = pairs[:, 0], 2 * k + 2
        # the band lies in data from `low` on; a band that meets two documents is judged in both
        low = pairs[:, 1] * (k + 1) - len(self.text) + self.start[w]
        a = np.clip(np.searchsorted(off, low, side="right") - 1, 0, len(off) - 2)
        z = np.clip(np.searchsorted(off, low + m + wide - 1, side="right") - 1, 0, len(off) - 2)
        spread = z - a + 1
        doc = np.repeat(a, spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
        w, low = np.repeat(w, spread), np.repeat(low, spread)
        pattern = self.text[self.start[w][:, None] + np.arange(m)[None]].astype(np.int16)
        place = low[:, None] + np.arange(m + wide)[None]
        ours = (place >= off[doc][:, None]) & (place < off[doc + 1][:, None])
        region = np.where(ours, data[np.clip(place, 0, max(len(data) - 1, 0))], 256).astype(np.int16)
        d = np.arange(wide)
        cost = np.broadcast_to(d, (len(w), wide)).astype(np.int32)  # 64 x edits + the diagonal of the start
        shift = 64 * d.astype(np.int32)
        for i in range(m):
            step = cost + 64 * (region[:, i : i + wide] != pattern[:, i : i + 1])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 64)
            cost = np.minimum.accumulate(step - shift, axis=1) + shift
        at = (cost >> 6).argmin(1)
        best = cost[np.arange(len(w)), at]
        on = best >> 6 <= k
        start, end = low + (best & 63), low + m + at
        start, end = np.maximum(start, off[doc]) - off[doc], np.minimum(end, off[doc + 1]) - off[doc]
        return np.stack([doc, w, start, end, best >> 6], 1)[on & (end > start)]

    def exact(self, data: np.ndarray, off: np.ndarray):
        """(document, item, start, end, 0) where a short text's words stand."""
        begin, end = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        begin[off] = end[off] = True
        begin[1:] |= data == 32
        end[:-1] |= data == 32
        for n, texts in self.short.items():
            g = grams(data, n)
            wanted = np.concatenate([grams(np.frombuffer(t, np.uint8), n) for t in texts])
            at = np.flatnonzero(begin[: len(g)] & end[n : n + len(g)])
            at = at[np.isin(g[at], wanted)]
            doc = np.searchsorted(off, at, side="right") - 1
            for i, d in zip(at.tolist(), doc.tolist(), strict=True):
                if i + n <= off[d + 1]:
                    for item in texts.get(data[i : i + n].tobytes(), ()):
                        yield d, item, i - int(off[d]), i + n - int(off[d]), 0

    def regions(self, data: np.ndarray, off: np.ndarray, most: int = MOST_SHARED) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, end, least edits): every region, those of one item that overlap joined.

        Where the benchmark or the documents repeat themselves so much that there are more than `most` shared
        q-grams, shorter ones are counted, at one place of each repeated context, and what is found there is told
        of every place of that context.
        """
        at, which = self.coarse.shared(data, off)
        places, postings = None, self.coarse
        if self.coarse.count[which].sum() > most:
            places, postings = Contexts(data, off, self.wide), self.fine
            at, which = postings.shared(data, off)
            at, which = at[places.kept[at]], which[places.kept[at]]
        found = [np.zeros((0, 5), np.int64)]
        for pairs in postings.candidates(at, which, most):
            rows = self.aligned(data, off, pairs)
            rows[:, 1] = self.owner[rows[:, 1]]
            found.append(np.unique(rows, axis=0))
        rows = np.concatenate(found)
        rows = places.everywhere(rows, off) if places else _joined(rows)
        hits = [(d, item, s, e, k) for d, text, s, e, k in rows.tolist() for item in self.items[text]]
        hits += self.exact(data, off)
        if not hits:
            return []
        ids, item = np.unique([h[1] for h in hits], return_inverse=True)
        every = np.array([(d, i, s, e, k) for (d, _, s, e, k), i in zip(hits, item.tolist(), strict=True)], np.int64)
        return [(d, int(ids[i]), s, e, k) for d, i, s, e, k in _joined(every).tolist()]


class Contexts:
    """Places of equal context: `wide` bytes on either side, with the documents' bounds among them."""

    def __init__(self, data: np.ndarray, off: np.ndarray, wide: int):
        n, self.wide = len(data), wide
        marked = np.zeros(n + 2 * wide, np.uint64)
        marked[wide : wide + n] = data.astype(np.uint64) + np.uint64(1)
        marked[off[:-1][off[:-1] < n] + wide] += np.uint64(512)
        p, q = powers(len(marked) + 1)
        total = np.zeros(len(marked) + 1, np.uint64)
        np.cumsum(marked * p[:-1], out=total[1:])
        size = 2 * wide
        h = mix((total[size:] - total[:-size]) * q[: len(marked) - size + 1])[:n]
        _, first, self.which, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        self.order = np.argsort(self.which, kind="stable")
        self.start = np.concatenate(([0], np.cumsum(count)))
        near = np.zeros(n + 1, np.int64)
        np.add.at(near, np.maximum(first - wide, 0), 1)
        np.add.at(near, np.minimum(first + wide + 1, n), -1)
        self.kept = np.cumsum(near)[:n] > 0

    def everywhere(self, rows: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Joined regions of all places whose context is that of a found one (document, text, start, end, edits)."""
        rows = rows[np.lexsort(rows.T[::-1])]
        pieces: dict[int, set] = {}
        text = at = end = edits = -1

        def put():
            if text >= 0:  # the same for every place of the context
                mid = (at + end) // 2
                pieces.setdefault(text, set()).add((int(self.which[mid]), mid - at, end - mid, edits))

        for d, t, s, e, k in rows.tolist():
            s, e = s + int(off[d]), e + int(off[d])
            if t == text and s < end and max(e, end) - at <= self.wide:
                end, edits = max(e, end), min(edits, k)
            elif t != text or s >= end or e > end:
                put()
                text, at, end, edits = t, s, e, k
        put()
        told: dict[tuple, np.ndarray] = {}
        out = [np.zeros((0, 5), np.int64)]
        for t, own in pieces.items():
            key = tuple(sorted(own))
            if key not in told:
                joined = []
                for c, before, after, k in key:
                    place = self.order[self.start[c] : self.start[c + 1]]
                    doc = np.searchsorted(off, place, side="right") - 1
                    joined.append(np.stack([doc, np.zeros_like(doc), place - before - off[doc], place + after - off[doc], np.full(len(doc), k)], 1))
                told[key] = _joined(np.concatenate(joined))
            one = told[key].copy()
            one[:, 1] = t
            out.append(one)
        return np.concatenate(out)


def _joined(rows: np.ndarray) -> np.ndarray:
    """Rows (document, text, start, end, edits), those of one document and text that overlap joined."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    group = np.cumsum(fresh) - 1
    span = int(rows[:, 3].max()) + 1
    reach = np.maximum.accumulate(rows[:, 3] + group * span) - group * span  # of the rows so far, within a group
    fresh[1:] |= rows[1:, 2] >= reach[:-1]
    at = np.flatnonzero(fresh)
    return np.stack([rows[at, 0], rows[at, 1], rows[at, 2], np.maximum.reduceat(rows[:, 3], at), np.minimum.reduceat(rows[:, 4], at)], 1)


_OUT = "doc_id long, item_id long, region_start int, region_end int, edits int"
_indexes: dict[tuple, Index] = {}


def _index(items: list[tuple[int, str]], rate: float) -> Index:
    """A worker's index of this block; one at a time is kept."""
    key = (rate, tuple(items))
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(items, rate)
    return _indexes[key]


def _find(items: list[tuple[int, str]], rate: float):
    def run(batches):
        index = _index(items, rate)
        for b, col in slices(batches):
            rows = index.regions(*utf8(normal(col)))
            doc = pa.array([r[0] for r in rows], pa.int64())
            cols = [b.column(b.schema.get_field_index("doc_id")).take(doc)]
            cols += [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "region_start", "region_end", "edits"])

    return run


def _clean(items: list[tuple[int, str]], rate: float):
    def run(batches):
        index = _index(items, rate)
        for b, col in slices(batches):
            clean = np.ones(b.num_rows, bool)
            clean[[r[0] for r in index.regions(*utf8(normal(col)))]] = False
            yield b.filter(pa.array(clean))

    return run


def blocks(benchmark: DataFrame, block_bytes: int = 4 << 20, piece: int = 100_000):
    """The benchmark's (item_id, text) in lists of about block_bytes, dealt by a hash of the row.

    A text of more than `piece` characters is cut into pieces that overlap by more than a window.
    """
    lap = 4 * WINDOW
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - lap - 1), F.lit(piece)), lambda i: F.substring(F.col("text"), i + 1, F.lit(piece + lap)))
    items = items.select("item_id", F.explode(cut).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64(F.lit(3), "item_id", "text"), F.lit(n)) == i)
        yield sorted((r["item_id"], r["text"]) for r in part.collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, region_start, region_end, edits): one row for each region of a document that holds part of a benchmark text.

    Positions are bytes of the normalised document. A task holds block_bytes of benchmark text with its index;
    each block is a pass over the documents.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in blocks(benchmark, block_bytes):
        found = docs.mapInArrow(_find(items, rate), _OUT)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], _OUT) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = 4 << 20) -> DataFrame:
    """docs without the rows whose text holds part of a benchmark text; all columns are kept. No shuffle."""
    for items in blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(_clean(items, rate), docs.schema)
    return docs
