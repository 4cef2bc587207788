"""Token ids packed into rows of fixed length: best-fit decreasing with a segment tree over capacities.

Each text is encoded by a byte-level BPE vocabulary and ends with the end id; a document longer than a row is
split into pieces of whole rows and a rest, none of its ids lost. The pieces of a packing window (a bounded
number of ids within one scan task) go, longest first, into the open row of the least room that still holds
them, which the segment tree finds in logarithmic time. Packing is local to a scan task, so there is no
shuffle, and a task that is run again gives the same rows.

A null or empty text is the end id alone, so every document is in some row. Rows of one or no doc_id are packed
each.
Ties go to the earlier document and the earlier row. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from offerlens.llm.common import slices

# Fixed value: the vocabulary's own pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_TEXT = 100_000
_encodings: dict = {}


class CapacityTree:
    """For each room 0..length the rows that have it; finds the least room of at least n."""

    def __init__(self, length: int):
        self.size = 1 << (length).bit_length()
        self.any = np.zeros(2 * self.size, bool).tolist()
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = True
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, row): the least room >= least; None if there is none."""
        i = least + self.size
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):  # up until a right sibling holds a row
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[i] = False
            i >>= 1
            while i and self.any[i] and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = False
                i >>= 1
        return room, row


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of item places by best-fit decreasing; every size is 1..length."""
    tree, rows = CapacityTree(length), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        hit = tree.take(n)
        if hit is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = hit
        rows[row].append(i)
        if room > n:
            tree.add(room - n, row)
    return rows


def encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def chunks(text: str, most: int = LONG_TEXT):
    """Cut a long text where a token must begin: at a single space between two other characters."""
    start = 0
    while len(text) - start > most:
        i = start + most
        while (i := text.find(" ", i)) >= 0 and (i + 1 >= len(text) or text[i - 1].isspace() or text[i + 1].isspace()):
            i += 1
        if i < 0:
            break
        yield text[start:i]
        start = i
    yield text[start:]


def ids_of(enc, text: str) -> np.ndarray:
    if len(text) <= LONG_TEXT:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(x, disallowed_special=()) for x in chunks(text)])


SCHEMA = "shard int, row long, n_ids int, doc_ids array<long>, places array<long>, starts array<int>, cu_seqlens array<int>, ids binary, positions binary"


def _pack(path: str, length: int, end: int, window: int, pad: int):
    kind = np.uint16 if max(end, pad) < 65536 else np.uint32

    def flush(shard: int, first: int, before: int, docs: list[int], parts: list[np.ndarray]):
        doc, place, start, piece = [], [], [], []
        for n, (d, x) in enumerate(zip(docs, parts, strict=True), before):
            for s in range(0, len(x), length):
                doc.append(d)
                place.append(n)
                start.append(s)
                piece.append(x[s : s + length])
        rows = best_fit(np.array([len(p) for p in piece], np.int64), length)
        for i in range(0, len(rows), 256):
            out: dict[str, list] = {c: [] for c in ("n_ids", "doc_ids", "places", "starts", "cu_seqlens", "ids", "positions")}
            for r in rows[i : i + 256]:
                n = [len(piece[k]) for k in r]
                line, pos = np.full(length, pad, kind), np.zeros(length, np.uint32 if length > 65535 else np.uint16)
                total = sum(n)
                line[:total] = np.concatenate([piece[k] for k in r])
                pos[:total] = np.concatenate([np.arange(x) for x in n])  # positions restart with each segment
                out["n_ids"].append(total)
                out["doc_ids"].append([doc[k] for k in r])
                out["places"].append([place[k] for k in r])
                out["starts"].append([start[k] for k in r])
                out["cu_seqlens"].append([0, *np.cumsum(n).tolist()])
                out["ids"].append(line.tobytes())
                out["positions"].append(pos.tobytes())
            types = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            m = len(out["ids"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * m, pa.int32()), pa.array(range(first + i, first + i + m), pa.int64()), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))],
                ["shard", "row", *out],
            )

    def run(batches):
        enc = encoding(path)
        shard = TaskContext.get().partitionId() if TaskContext.get() else 0
        docs, parts, held, first, before = [], [], 0, 0, 0
        for b, col in slices(batches):
            own = b.column(b.schema.get_field_index("doc_id")).to_pylist()
            for d, text in zip(own, col.to_pylist(), strict=True):
                x = np.append(ids_of(enc, text), end).astype(kind)
                docs.append(d)
                parts.append(x)
                held += len(x)
            if held >= window:
                for out in flush(shard, first, before, docs, parts):
                    first += out.num_rows
                    yield out
                before += len(docs)
                docs, parts, held = [], [], 0
        if docs:
            yield from flush(shard, first, before, docs, parts)

    return run


def pack(docs: DataFrame, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", length: int = 2048, end: int = 50256, pad: int = 50256, window: int = 4_000_000) -> DataFrame:
    """One row for each packed row.

    ids and positions are little-endian integers, `length` of each (16 bits if the ids fit, as they do here;
    positions 16 bits up to length 65,535); what is beyond n_ids is padding. Segment j is
    ids[cu_seqlens[j]:cu_seqlens[j + 1]], from id starts[j] of document doc_ids[j] on; its positions restart at 0.
    places[j] is that document's number within the shard, which tells rows of one or no doc_id apart.
    """
    return docs.select("doc_id", "text").mapInArrow(_pack(vocabulary, length, end, window, pad), SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, a directory for each shard, its rows in order: the matrices' rows are binary."""
    packed.sortWithinPartitions("shard", "row").write.partitionBy("shard").parquet(path)


def unpack(packed: DataFrame, bits: int = 16) -> DataFrame:
    """shard, place, doc_id and ids (32 bits, little-endian) of each packed document, put together again from its segments."""
    from pyspark.sql import functions as F

    def cut(batches):
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{bits // 8}")
                for j, (d, p, s) in enumerate(zip(r["doc_ids"], r["places"], r["starts"], strict=True)):
                    out.append((r["shard"], p, d, s, ids[r["cu_seqlens"][j] : r["cu_seqlens"][j + 1]].astype("<u4").tobytes()))
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["shard", "place", "doc_id", "start", "part"])

    parts = packed.select("shard", "doc_ids", "places", "starts", "cu_seqlens", "ids").mapInArrow(cut, "shard int, place long, doc_id long, start int, part binary")
    joined = F.sort_array(F.collect_list(F.struct("start", F.hex("part").alias("part"))))
    return parts.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.unhex(F.array_join(F.transform(joined, lambda x: x["part"]), "")).alias("ids"))
