"""SentencePiece N-best encoding and decoding over a given model file.

The piece lattice of a text has an edge for every piece of the vocabulary (and one of byte pieces for a
character without a piece). A forward Viterbi pass gives each position its best score; a backward A* search
from the end uses those scores as an exact heuristic and yields segmentations from the best on. No piece
crosses a cut between a word and the following space, nor a character that no longer piece holds, so the
lattice of a whole text is a chain of independent lattices. Viterbi runs over all distinct segments of a
batch at once, forward and backward, which gives each segment its best path and the gap to its second; only
the n - 1 segments of a text with the least gaps can differ from the best in its n best, and those alone are
searched by A*; their combinations are exact. A piece's score is the model's own (for a BPE
model the negated merge rank); byte pieces cost ten less than the lowest of them.

Null or empty texts have no pieces and the one empty segmentation of score 0. Ties are broken by the order of
the search, the same for every run. Repeated rows are encoded alike; extra columns are ignored. The space
mark U+2581 in a text decodes as a space, the one loss; `lossless` tells.
"""

from __future__ import annotations

import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from offerlens.llm.common import mix, slices

MARK = "▁"
_BASE = 0xD1342543DE82EF95
REMEMBER = 50_000  # searched segments that a worker remembers at most
LONGEST = 48  # characters of a segment that is handled together with others


class Model:
    """Pieces of a model file as a trie of characters."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap:
            raise ValueError("the model's normaliser is not the identity")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.strings = [p.piece for p in proto.pieces]
        self.bytes: dict[int, int] = {}
        self.trie: dict = {}
        self.least = min((p.score for p in proto.pieces if p.type == 1 and p.score > -1e8), default=0.0) - 10
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[1:-1], 16)] = i
            elif p.type == 1:
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError(f"the piece {p.piece!r} crosses words")
                node = self.trie
                for c in p.piece:
                    node = node.setdefault(c, {})
                node[""] = (i, p.score)
        self.is_byte = np.zeros(len(self.strings), bool)
        self.is_byte[list(self.bytes.values())] = True
        joined = {c for p in proto.pieces if p.type == 1 and len(p.piece) > 1 for c in p.piece}
        inside = "".join(sorted(joined - {MARK}))
        # segments: marks and the characters that longer pieces hold; or one character alone
        self.split = re.compile(f"{MARK}*[{re.escape(inside)}]+|{MARK}+|[^{MARK}]", re.DOTALL)
        self.longest = max((len(p.piece) for p in proto.pieces if p.type == 1), default=1)
        whole = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        hashed = mix(np.array([self._hash(x) for _, x, _ in whole], np.uint64))
        self.key = np.append(hashed, np.uint64(0))
        self.id = np.array([i for i, _, _ in whole] + [-1], np.int32)
        self.cost = np.array([x for _, _, x in whole] + [-np.inf])
        # two tables by different bits of the hash: the second holds what the first has no room for
        self.tables = []
        rest = np.arange(len(hashed))
        for shift in (42, 20):
            t = np.full(1 << 22, len(hashed), np.int32)
            at = ((hashed >> np.uint64(shift)) & np.uint64((1 << 22) - 1)).astype(np.int64)
            t[at[rest]] = rest
            rest = rest[t[at[rest]] != rest]
            self.tables.append((np.uint64(shift), t))
        if len(rest):
            raise ValueError("pieces' hashes collide")

    @staticmethod
    def _hash(s: str) -> int:
        h = 0
        for c in s:
            h = (h * _BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def look(self, h: np.ndarray) -> np.ndarray:
        """Place of the piece with each hash; the last place is none."""
        m = mix(h)
        none = len(self.key) - 1
        out = np.full(h.shape, none, np.int32)
        for shift, t in self.tables:
            got = t[((m >> shift) & np.uint64((1 << 22) - 1)).astype(np.int64)]
            out = np.where((out == none) & (self.key[got] == m), got, out)
        return out

    def lattice(self, s: str) -> tuple[list[list], list[float]]:
        """(edges that end at each position as (start, ids, score), best score of each position)."""
        n = len(s)
        ends: list[list] = [[] for _ in range(n + 1)]
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            node, single, here = self.trie, False, best[i]
            for j in range(i, n):
                node = node.get(s[j])
                if node is None:
                    break
                hit = node.get("")
                if hit is not None:
                    single = single or j == i
                    ends[j + 1].append((i, hit[0], hit[1]))
                    if here + hit[1] > best[j + 1]:
                        best[j + 1] = here + hit[1]
            if not single:
                ids = tuple(self.bytes[b] for b in s[i].encode("utf-8", "surrogatepass"))
                ends[i + 1].append((i, ids, self.least))
                best[i + 1] = max(best[i + 1], here + self.least)
        return ends, best

    def nbest(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations (score, ids), the best first.

        A position is expanded n times at most: a path that is the n + 1st best to reach it from the end goes on no
        better than the n before it, so the n best are exact and a long run of equal scores stays linear. Of
        equal scores the path taken up last goes first.
        """
        ends, best = self.lattice(s)
        out, count = [], 0
        times = [0] * (len(s) + 1)
        heap = [(-best[len(s)], 0, len(s), 0.0, None)]
        while heap and len(out) < n:
            _, _, at, g, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    head, path = path
                    ids.extend(head if isinstance(head, tuple) else (head,))
                out.append((g, ids))
                continue
            if times[at] >= n:
                continue
            times[at] += 1
            for start, piece, score in ends[at]:
                if start == 0 or times[start] < n:
                    count -= 1
                    heapq.heappush(heap, (-(g + score + best[start]), count, start, g + score, (piece, path)))
        return out

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        s = text.replace(" ", MARK)
        return self.split.findall(MARK + s if self.prefix else s)

    def decode(self, ids: np.ndarray) -> str:
        """Text of piece ids; runs of byte pieces are UTF-8."""
        if not len(ids):
            return ""
        if self.is_byte[ids].any():
            parts, raw = [], bytearray()
            for i in ids.tolist():
                if self.is_byte[i]:
                    raw.append(int(self.strings[i][1:-1], 16))
                    continue
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
                parts.append(self.strings[i])
            parts.append(raw.decode("utf-8", "replace"))
            s = "".join(parts)
        else:
            s = "".join(map(self.strings.__getitem__, ids.tolist()))
        s = s.replace(MARK, " ")
        return s[1:] if self.prefix else s


def viterbi(model: Model, segs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, score, gap to the second best) of segments, all of them together."""
    u = len(segs)
    size = np.array([len(s) for s in segs], np.int64)
    width, top = int(size.max()), model.longest
    codes = np.frombuffer("".join(segs).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # positions are rows, segments are columns
    c = np.zeros((u, width), np.uint64)
    c[np.arange(width)[None] < size[:, None]] = codes + np.uint64(1)
    c = np.ascontiguousarray(c.T)
    base, power = np.uint64(_BASE), 1
    h = np.zeros((width + 1, u), np.uint64)
    for j in range(width):
        h[j + 1] = h[j] * base + c[j]
    edge, cost = {}, {}
    for n in range(1, min(top, width) + 1):
        power = power * _BASE & 0xFFFFFFFFFFFFFFFF
        k = model.look(h[n:] - h[:-n] * np.uint64(power))
        if n > 1:
            k[np.arange(width - n + 1)[:, None] + n > size[None]] = len(model.key) - 1
        edge[n], cost[n] = model.id[k], model.cost[k]
    alone = (edge[1] < 0) & (np.arange(width)[:, None] < size[None])
    cost[1][alone] = model.least
    edge[1][alone] = -2
    some = {n: cost[n].max(1) > -np.inf for n in cost}
    alpha = np.full((width + 1, u), -np.inf)
    alpha[0] = 0
    back = np.zeros((width + 1, u), np.int8)
    for j in range(1, width + 1):
        for n in range(1, min(top, j) + 1):
            if some[n][j - n]:
                x = alpha[j - n] + cost[n][j - n]
                on = x > alpha[j]
                alpha[j] = np.where(on, x, alpha[j])
                back[j] = np.where(on, np.int8(n), back[j])
    beta = np.full((width + 1, u), -np.inf)
    beta[size, np.arange(u)] = 0
    for i in range(width - 1, -1, -1):
        for n in range(1, min(top, width - i) + 1):
            if some[n][i]:
                np.maximum(beta[i], cost[n][i] + beta[i + n], out=beta[i])
    score = alpha[size, np.arange(u)]
    row, at, got = [], [], []
    live, cur = np.arange(u), size.copy()
    path = {n: np.zeros(cost[n].shape, bool) for n in cost}
    while len(live):
        n = back[cur, live].astype(np.int64)
        for m in np.unique(n).tolist():
            on = n == m
            r, i = live[on], cur[on] - m
            path[m][i, r] = True
            row.append(r)
            at.append(i)
            got.append(edge[m][i, r])
        cur = cur - n
        live, cur = live[cur > 0], cur[cur > 0]
    second = np.full(u, -np.inf)
    for n in cost:
        for i in np.flatnonzero(some[n]):
            through = alpha[i] + cost[n][i] + beta[i + n]
            np.maximum(second, np.where(path[n][i], -np.inf, through), out=second)
    row, at, got = map(np.concatenate, (row, at, got))
    order = np.lexsort((at, row))
    row, at, got = row[order], at[order], got[order]
    raw = np.flatnonzero(got == -2)
    if len(raw):  # byte pieces in place of a character
        more = [[model.bytes[b] for b in segs[row[i]][at[i]].encode("utf-8", "surrogatepass")] for i in raw]
        n = np.ones(len(got), np.int64)
        n[raw] = [len(x) for x in more]
        row = np.repeat(row, n)
        flat = np.repeat(got, n)
        flat[np.repeat(got == -2, n)] = list(itertools.chain.from_iterable(more))
        got = flat
    return got.astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(row, minlength=u)))), score, score - second


class Encoder:
    """Texts to their n best segmentations."""

    def __init__(self, model: Model, n: int):
        self.model, self.n = model, n
        self.searched: dict[str, list] = {}

    def distinct(self, segs: list[str]):
        """viterbi() of distinct segments, by length so that little is padding."""
        size = np.array([len(s) for s in segs], np.int64)
        ids: list = [None] * len(segs)
        score, gap = np.zeros(len(segs)), np.full(len(segs), np.inf)
        low = 0
        for high in (6, 10, 16, 28, LONGEST):
            part = np.flatnonzero((size > low) & (size <= high))
            low = high
            for i in range(0, len(part), 4096):
                some = part[i : i + 4096]
                got, off, score[some], gap[some] = viterbi(self.model, [segs[k] for k in some])
                for k, a, b in zip(some.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    ids[k] = got[a:b]
        for k in np.flatnonzero(size > LONGEST):
            best = self.model.nbest(segs[k], 2)
            ids[k], score[k] = np.array(best[0][1], np.int32), best[0][0]
            gap[k] = best[0][0] - best[1][0] if len(best) > 1 else np.inf
        return ids, score, gap

    def search(self, seg: str, best: list[int], score: float) -> list[tuple[float, list[int]]]:
        """The segment's other segmentations, (score less the best, ids)."""
        got = self.searched.get(seg)
        if got is None:
            if len(self.searched) >= REMEMBER:
                self.searched.clear()
            got = self.searched[seg] = [(s - score, x) for s, x in self.model.nbest(seg, self.n) if x != best][: self.n - 1]
        return got

    def batch(self, texts: list[str]):
        """(ids of all texts, offsets, scores, per text: [(score, [(place, dropped, ids)])] of the next best)."""
        place: dict[str, int] = {}
        rows = []
        for t in texts:
            rows.append([place.setdefault(s, len(place)) for s in self.model.segments(t)])
        sizes = np.array([len(r) for r in rows], np.int64)
        every = np.fromiter(itertools.chain.from_iterable(rows), np.int64, int(sizes.sum()))
        segs = list(place)
        own, score, gap = self.distinct(segs) if segs else ([], np.zeros(0), np.zeros(0))
        length = np.array([len(x) for x in own], np.int64)
        flat = np.concatenate(own) if own else np.zeros(0, np.int32)
        start = np.cumsum(length) - length
        n = length[every]
        ends = np.concatenate(([0], np.cumsum(n)))
        first = ends[:-1]
        ids = flat[np.repeat(start[every] - first, n) + np.arange(n.sum())] if len(every) else flat
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        best, more = [], []
        for a, b in itertools.pairwise(bounds.tolist()):
            k = every[a:b]
            base = float(score[k].sum())
            best.append(base)
            more.append(self.others(segs, own, score, k, gap[k], first[a:b] - ends[a], base) if len(k) else [])
        return ids, ends[bounds], best, more

    def others(self, segs, own, score, k: np.ndarray, gap: np.ndarray, at: np.ndarray, base: float) -> list:
        """The second to n-th best of a text."""
        want = self.n - 1
        if not want:
            return []
        if len(gap) > want:
            cut = np.partition(gap, want - 1)[want - 1]
            pick = np.concatenate([np.flatnonzero(gap < cut), np.flatnonzero(gap == cut)])[:want]
        else:
            pick = np.arange(len(gap))
        pick = [i for i in sorted(pick.tolist()) if np.isfinite(gap[i])]
        choices = [[(0.0, None), *self.search(segs[k[i]], own[k[i]].tolist(), float(score[k[i]]))] for i in pick]
        combos = sorted(((sum(c[0] for c in combo), j, combo) for j, combo in enumerate(itertools.product(*choices)) if j), key=lambda c: (-c[0], c[1]))
        return [(base + d, [(int(at[i]), len(own[k[i]]), c[1]) for i, c in zip(pick, combo, strict=True) if c[1] is not None]) for d, _, combo in combos[:want]]


_CHANGE = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
_OTHERS = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(_CHANGE))]))
SCHEMA = "doc_id long, n_pieces long, score double, ids array<int>, others array<struct<score:double,changes:array<struct<at:int,drop:int,ids:array<int>>>>>, lossless boolean"
_models: dict[str, Model] = {}


def _encode(path: str, n: int):
    def run(batches):
        if path not in _models:
            _models[path] = Model(path)
        model = _models[path]
        encoder = Encoder(model, n)
        for b, col in slices(batches, most=4 << 20):
            texts = col.to_pylist()
            ids, off, best, more = encoder.batch(texts)
            back = [model.decode(ids[off[i] : off[i + 1]]) == t for i, t in enumerate(texts)]
            others = pa.array([[{"score": s, "changes": [{"at": a, "drop": d, "ids": x} for a, d, x in c]} for s, c in m] for m in more], _OTHERS)
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")), pa.array(np.diff(off).astype(np.int64)), pa.array(best, pa.float64()), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)), others, pa.array(back, pa.bool_())],
                ["doc_id", "n_pieces", "score", "ids", "others", "lossless"],
            )

    return run


def encode_pieces(docs: DataFrame, model: str = "/opt/tokenizers/piece_bpe_32k.model", n: int = 4) -> DataFrame:
    """One row for each document: ids and score of the best segmentation and what the next n - 1 change in it.

    A change drops `drop` ids from `at` on and puts `ids` there. `lossless`: the decoded ids are the text.
    """
    return docs.select("doc_id", "text").mapInArrow(_encode(model, n), SCHEMA)
