"""Shared helpers: Arrow text slices as numpy byte buffers, vectorised word and shingle hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text handled at once by a Python worker; a longer text stands alone.
SLICE_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch between JVM and worker, in sessions that bounded() has seen.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}

#: Words: runs of ASCII letters and digits and of anything beyond ASCII.
WORD_CLASS = np.zeros(256, bool)
WORD_CLASS[128:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    WORD_CLASS[ord(_a) : ord(_b) + 1] = True


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut batches so that each has at most `most` bytes of text; null texts become empty."""
    for b in batches:
        if not b.num_rows:
            continue
        raw = b.column(b.schema.get_field_index(text))
        size = pc.fill_null(pc.binary_length(raw), 0).to_numpy()
        cut = lambda start, n: (b.slice(start, n), pc.fill_null(raw.slice(start, n).cast(pa.large_string()), ""))  # noqa: B023, E731
        start, total = 0, 0
        for i, n in enumerate(size):
            if total and total + n > most:
                yield cut(start, i - start)
                start, total = i, 0
            total += int(n)
        yield cut(start, b.num_rows - start)
        del b, raw, cut
    freed()


def freed() -> None:
    """Give what this worker no longer uses back to the system: a worker outlives its task and the next job's memory comes on top."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bounded(spark) -> None:
    """From now on this session hands Python workers batches of BATCH_ROWS rows and BATCH_BYTES bytes at most."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def offsets(arr: pa.Array) -> np.ndarray:
    """Byte offsets of a large_string array, absolute."""
    if not len(arr):
        return np.zeros(1, np.int64)
    return np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array, offsets from 0."""
    off = offsets(arr)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def distinct(a: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting."""
    a = np.sort(a)
    return a[np.append(True, a[1:] != a[:-1])] if len(a) else a


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n."""
    if len(_powers.get("p", ())) < n:
        size = -(-n // 65536) * 65536  # as long as the texts need it
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("p", _P), ("q", inverse)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["p"][:n], _powers["q"][:n]


def spans_of(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at document offsets."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n, bool)
    first[off[:-1][off[:-1] < n]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (first | ~before))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~mask[1:] | first[1:]
    return starts, np.flatnonzero(mask & after) + 1


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, index of its document), in order."""
    starts, ends = spans_of(WORD_CLASS[data], off)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
    h = mix((total[ends] - total[starts]) * q[starts])
    return h, np.searchsorted(off, starts, side="right") - 1


def shingles(h: np.ndarray, doc: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words of a document; a shorter document is one shingle of all its words."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), doc
    size = np.bincount(doc)
    short = np.flatnonzero((size > 0) & (size < width))
    first = np.searchsorted(doc, short)
    m = np.uint64(0xD1342543DE82EF95)
    out_h, out_d = [], []
    if n >= width:
        acc = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            acc = acc * m + h[j : n - width + 1 + j]
        same = doc[: n - width + 1] == doc[width - 1 :]
        out_h.append(acc[same])
        out_d.append(doc[: n - width + 1][same])
    if len(short):
        acc = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            on = j < size[short]
            acc = np.where(on, acc * m + h[np.minimum(first + j, n - 1)], acc)
        out_h.append(acc ^ np.uint64(0xA5A5A5A5))
        out_d.append(short)
    hs, ds = np.concatenate(out_h), np.concatenate(out_d)
    return mix(hs), ds


def weighted_sets(arr: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 40-bit shingle, count) of the distinct shingles of each text, sorted; case is folded."""
    data, off = utf8(pc.utf8_lower(arr))
    hs, ds = shingles(*word_hashes(data, off), width)
    key = np.sort((ds.astype(np.uint64) << np.uint64(40)) | (hs >> np.uint64(24)))
    if not len(key):
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1), n


def read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared(spark) -> str:
    """This application's folder below spark.checkpoint.dir; a local master alone may go without that setting."""
    import os
    import tempfile

    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "offerlens-local")
    return f"{base.rstrip('/')}/offerlens-{sc.applicationId}"


def saved(df, name: str):
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    import uuid

    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(df) -> None:
    """Delete the table that saved() wrote for df; no later plan may read it."""
    jvm, path = df.sparkSession._jvm, df.saved_at
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark) -> None:
    """Delete all working tables of this application, once no result that reads them is needed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(shared(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
