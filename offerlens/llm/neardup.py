"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

1. Document frequencies of five-word shingles. A count-min sketch of fixed width over all texts never counts a
   shingle too low, so it leaves the few that may stand in more than `floor` of all texts; these are counted
   exactly in a second pass. There are no more of them than a text has shingles on average, divided by the floor.
   IDF is ln(1 + N / df), relative to its value at the floor; below the floor, a share of N and so the same at
   every size, it stays at that value: else the few own shingles of a near copy in a large group would weigh many
   times what the whole group shares.
2. Each text's weighted set (count x IDF) is sampled by improved consistent weighted sampling: SAMPLES
   samples, of which `rows` at a time make a band's key.
3. Equal texts collapse to one representative. In every bucket each member is paired with one hub, the most
   central member (the one whose buckets are the fullest), so pairs grow with members and not with their
   square. Pairs are verified by the weighted Jaccard similarity of the whole texts.
4. Connected components of the verified links. Buckets that still hold several components have their pairs of
   different components verified: in small buckets as pairs (those whose samples agree too rarely to reach the
   threshold are left out: an exact pair falls below that with a chance of about 1e-5), in larger ones by blocks
   of bounded rows and bytes in which nothing is left out. Components are taken anew.

Every row is a document of its own, whether its doc_id is null, repeated or not. Texts of fewer than five words
are one shingle of all their words; texts without words, null included, are only grouped with equal texts (null
counts as empty). A class is named by its least doc_id, and has no name if no row of it has one. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import dropped, mix, saved, slices, weighted_sets
from offerlens.llm.components import components

WIDTH = 5
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
CELLS = 1 << 16
DEPTH = 2
FLOOR = 1 / 64
SMALL, BLOCK, BLOCK_BYTES = 32, 384, 8 << 20  # members of a small bucket; rows and text of a block of a larger one
HOT = 1000  # a key with more than this part of all rows is broadcast: there are no more such keys

_ODD = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _cells(key: np.ndarray, d: int) -> np.ndarray:
    """A sketch row's cell of a 40-bit shingle."""
    return ((key >> np.uint64(4 + 16 * d)) & np.uint64(CELLS - 1)).astype(np.int64)


def _sketch(batches):
    total, docs = np.zeros((DEPTH, CELLS), np.int64), 0
    for _, col in slices(batches):
        d, key, _ = weighted_sets(col, WIDTH)
        docs += np.count_nonzero(np.bincount(d))
        for r in range(DEPTH):
            total[r] += np.bincount(_cells(key, r), minlength=CELLS)
    flat = total.reshape(-1)
    at = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(flat[at], docs))], ["cell", "n"])


def _counted(full: np.ndarray):
    """Exact counts of the shingles all of whose cells are full."""

    def run(batches):
        for _, col in slices(batches):
            _, key, _ = weighted_sets(col, WIDTH)
            on = np.ones(len(key), bool)
            for r in range(DEPTH):
                on &= full[r][_cells(key, r)]
            key = np.sort(key[on])
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[at].astype(np.int64)), pa.array(np.diff(np.append(at, len(key))).astype(np.int64))], ["shingle", "n"])

    return run


class Idf:
    """IDF of shingles relative to that at the floor, from the exact counts of the frequent ones."""

    def __init__(self, docs: int, frequent: dict[int, int], floor: float):
        self.docs, self.floor = max(docs, 1), floor
        self.key = np.array(sorted(frequent), np.uint64)
        share = np.array([frequent[int(k)] for k in self.key], float) / self.docs
        self.weight = np.log1p(1 / np.maximum(share, floor)) / np.log1p(1 / floor)

    def weights(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key))
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out = np.where(self.key[at] == key, self.weight[at], out)
        return out


def document_frequencies(docs: DataFrame, floor: float = FLOOR) -> Idf:
    """Only shingles of more than floor x N texts reach the driver: at most a text's mean shingles / floor."""
    counts = saved(docs.select("text").mapInArrow(_sketch, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "sketch")
    n = (counts.where("cell = -1").first() or [0, 0])[1] or 0
    full = np.zeros(DEPTH * CELLS, bool)
    full[[r["cell"] for r in counts.where((F.col("cell") >= 0) & (F.col("n") > floor * n)).collect()]] = True
    dropped(counts)
    if not full.any():
        return Idf(n, {}, floor)
    exact = docs.select("text").mapInArrow(_counted(full.reshape(DEPTH, CELLS)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return Idf(n, {r["shingle"]: r["n"] for r in exact.where(F.col("n") > floor * n).collect()}, floor)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2010)
    return rng.gamma(2.0, 1.0, 65536), np.log(rng.gamma(2.0, 1.0, 65536)), rng.random(65536)


def _ordered(a: np.ndarray) -> np.ndarray:
    """float32 to uint32 of the same order, in the upper half of a uint64."""
    u = a.astype(np.float32).view(np.uint32)
    u = np.where(u >> 31, ~u, u | np.uint32(1 << 31))
    return u.astype(np.uint64) << np.uint64(32)


_r, _lnc, _beta = _tables()
_plain = _ordered(_lnc + _r * _beta - _r)  # ln a at weight 1


def samples(d: np.ndarray, key: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """n x SAMPLES: 32-bit identities of the sampled (shingle, step); rows without shingles are 0.

    Improved consistent weighted sampling: r, c ~ Gamma(2, 1), beta ~ U(0, 1) by shingle and sample;
    t = floor(ln w / r + beta), ln y = r (t - beta), ln a = ln c - ln y - r; the least ln a wins. At weight 1
    t is 0 and ln a comes from one table.
    """
    out = np.zeros((n, SAMPLES), np.uint32)
    if not len(key):
        return out
    starts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
    who = d[starts]
    low = key & np.uint64(0xFFFFFFFF)
    h = mix(key + np.uint64(1))
    other = np.flatnonzero(w != 1.0)
    ln_w = np.log(w[other])
    for k in range(SAMPLES):
        at = ((h * _ODD[k]) >> np.uint64(48)).astype(np.int64)
        value = _plain[at] | low
        if len(other):
            i = at[other]
            t = np.floor(ln_w / _r[i] + _beta[i])
            ident = (mix(low[other] ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(32))
            ident = np.where(t == 0, low[other], ident)
            value[other] = _ordered(_lnc[i] - _r[i] * (t - _beta[i]) - _r[i]) | ident
        out[who, k] = np.minimum.reduceat(value, starts).astype(np.uint32)
    return out


def _signatures(idf: Idf):
    def run(batches):
        for b, col in slices(batches):
            n = b.num_rows
            d, key, count = weighted_sets(col, WIDTH)
            s = samples(d, key, count * idf.weights(key), n)
            bands = np.zeros((n, BANDS), np.uint64)
            for j in range(BANDS):
                x = np.full(n, j + 1, np.uint64)
                for r in range(ROWS):
                    x = mix(x * np.uint64(0xD1342543DE82EF95) + s[:, j * ROWS + r])
                bands[:, j] = x
            some = np.bincount(d, minlength=n) > 0
            flat = pa.array(bands.view(np.int64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), flat)
            sig = pa.array([s[i].tobytes() if some[i] else None for i in range(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("row", "doc_id", "digest", "size")), lists, sig], ["row", "doc_id", "digest", "size", "bands", "sig"])

    return run


def _similarity(idf: Idf):
    """Weighted Jaccard of text_a and text_b in each row."""

    def run(batches):
        for b in batches:
            ids = [b.column(b.schema.get_field_index(c)) for c in ("a", "b")]
            rest = pa.RecordBatch.from_arrays([*ids, b.column(b.schema.get_field_index("text_a")), b.column(b.schema.get_field_index("text_b"))], ["a", "b", "text", "text_b"])
            for part, left in slices(iter([rest]), most=1 << 20):
                both = pa.concat_arrays([left, part.column(3).cast(pa.large_string())])
                n = part.num_rows
                d, key, count = weighted_sets(both, WIDTH)
                w = count * idf.weights(key)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(paired_jaccard(d, key, w, n))], ["a", "b", "similarity"])

    return run


def paired_jaccard(d: np.ndarray, key: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Weighted Jaccard of documents i and n + i, for i below n."""
    pair, k = (d % n).astype(np.uint64), key
    joint = (pair << np.uint64(40)) | k
    order = np.argsort(joint, kind="stable")
    joint, w, pair = joint[order], w[order], pair[order].astype(np.int64)
    same = joint[1:] == joint[:-1]
    both = np.bincount(pair[1:][same], np.minimum(w[1:], w[:-1])[same], n)
    total = np.bincount(pair, w, n)
    return both / np.maximum(total - both, 1e-300)


def verify(docs: DataFrame, pairs: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of row numbers whose whole texts reach the threshold."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    texts = docs.join(needed.hint("shuffle_hash"), "row", "left_semi").select("row", "text")
    left = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    rows = left.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    found = rows.select("a", "b", "text_a", "text_b").mapInArrow(_similarity(idf), "a long, b long, similarity double")
    return found.where(F.col("similarity") >= threshold)


def across(docs: DataFrame, mixed: DataFrame, idf: Idf, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join the components within large buckets; mixed: band, key, rep, size, comp.

    A bucket's largest component is its main one. Blocks of bounded size of the other members meet all blocks of
    the bucket; main blocks do not meet each other, as their members are joined already. A task compares two
    blocks in memory and gives links that span what it joins, fewer than its rows.
    """
    bucket = ["band", "key"]
    per = mixed.groupBy(*bucket, "comp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    size = per.groupBy(bucket).agg(F.max(F.struct("n", F.col("comp").alias("main"), "bytes")).alias("m"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    parts = lambda n, size: F.ceil(F.greatest(n / block, size / BLOCK_BYTES))
    size = size.select(*bucket, "m.main", parts(F.col("m.n"), F.col("m.bytes")).alias("mains"), parts(F.col("n") - F.col("m.n"), F.col("bytes") - F.col("m.bytes")).alias("others"))
    rows = mixed.join(size, bucket).withColumn("is_main", F.col("comp") == F.col("main"))
    own = F.pmod(F.xxhash64(F.lit(29), "rep"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others")))
    to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_main = F.transform(to(F.when(F.col("is_main"), F.col("others")).otherwise(F.col("mains"))), lambda j: F.when(F.col("is_main"), F.concat_ws("m", j, "own")).otherwise(F.concat_ws("m", "own", j)))
    with_other = F.transform(to(F.col("others")), lambda j: F.concat_ws("o", F.least("own", j), F.greatest("own", j)))
    tasks = F.when(F.col("is_main"), with_main).otherwise(F.concat(with_main, with_other))
    dealt = rows.withColumn("own", own).select(*bucket, "rep", "comp", F.explode(tasks).alias("task"))
    needed = dealt.select(F.col("rep").alias("row")).distinct()
    texts = docs.join(needed.hint("shuffle_hash"), "row", "left_semi").select(F.col("row").alias("rep"), "text")

    def link(table):
        comp, rep = table.column("comp").to_numpy(), table.column("rep").to_numpy()
        a, b = [], []
        if len(rep) > 1:
            d, key, count = weighted_sets(pa.concat_arrays([c.cast(pa.large_string()) for c in table.column("text").chunks]), WIDTH)
            for i, j in joining(d, key, count, idf.weights(key), comp, threshold):
                a.append(min(rep[i], rep[j]))
                b.append(max(rep[i], rep[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.join(texts, "rep").groupBy(*bucket, "task").applyInArrow(link, "a long, b long")


def joining(d: np.ndarray, key: np.ndarray, count: np.ndarray, w: np.ndarray, comp: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of rows that reach the threshold and join different components, enough to span what they join.

    Overlaps come from products of 0/1 matrices over the shingles (each occurrence a column) that two rows at
    least share, a bounded number of columns at a time.
    """
    n = len(comp)
    times = count.astype(np.int64)
    row, k, weight = np.repeat(d, times), np.repeat(key, times), np.repeat(w, times)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    k = mix(k * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64))
    total = np.bincount(row, weight, n)
    distinct, col, df = np.unique(k, return_inverse=True, return_counts=True)
    shared = df[col] > 1
    place = np.cumsum(df > 1) - 1
    row, col, weight = row[shared], place[col[shared]], weight[shared]
    order = np.argsort(col, kind="stable")
    row, col, weight = row[order], col[order], weight[order]
    over = np.zeros((n, n), np.float64)
    step = 4096
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        i, j = np.searchsorted(col, [c, c + step])
        x = np.zeros((n, step), np.float32)
        x[row[i:j], col[i:j] - c] = np.sqrt(weight[i:j])
        over += x @ x.T
    reach = over >= (threshold - 1e-6) * (total[:, None] + total[None] - over)
    a, b = np.nonzero(np.triu(reach & (comp[:, None] != comp[None]), 1))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(int(comp[i])), root(int(comp[j]))
        if p != q:
            parent[p] = q
            out.append((i, j))
    return out


def spread(left: DataFrame, right: DataFrame, key: list[str], total: int) -> DataFrame:
    """left join right on key, which right has once, with `n` rows of left: keys of more than total / HOT rows, HOT at most, are broadcast."""
    hot = F.broadcast(right.where(F.col("n") * HOT > total))
    rest = left.join(hot.select(*key), key, "left_anti").join(right.where(F.col("n") * HOT <= total), key)
    return left.join(hot, key).unionByName(rest)


def _classes(rows: DataFrame, threshold: float, floor: float) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Of rows (row, doc_id, text), a written table: the rows' digests; each distinct text with its class; the classes; how many rows."""
    idf = document_frequencies(rows, floor)
    signed = rows.withColumns({"digest": F.unhex(F.md5("text")), "size": F.octet_length("text").cast("long")}).mapInArrow(_signatures(idf), "row long, doc_id long, digest binary, size long, bands array<long>, sig binary")
    signed = saved(signed, "signatures")
    total = signed.count()
    pick = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")  # the least doc_id, then the first row
    rep = signed.groupBy("digest").agg(F.min("row").alias("rep"), F.min(pick).alias("pick"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    rep = saved(rep, "texts")
    banded = rep.where("sig is not null").select("rep", "size", F.posexplode("bands").alias("band", "key"))
    bucket = ["band", "key"]
    full = saved(banded.groupBy(bucket).agg(F.count("*").alias("n")).where("n > 1"), "counts")
    shared = saved(spread(banded, full, bucket, total), "shared")
    # the hub is the most central member: the one whose buckets are the fullest
    central = shared.groupBy("rep").agg(F.sum("n").alias("c"))
    hubs = shared.join(central, "rep").groupBy(bucket).agg(F.max(F.struct("c", F.xxhash64("rep", "band").alias("h"), "rep")).alias("hub"), F.first("n").alias("n"))
    hubs = saved(hubs.select(*bucket, F.col("hub.rep").alias("hub"), "n"), "hubs")
    paired = spread(shared.drop("n"), hubs, bucket, total)
    pairs = saved(paired.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), "pairs")
    links = saved(verify(rows, pairs, idf, threshold), "links")
    label = saved(components(links), "labels")
    # buckets of several components
    named = saved(shared.join(label.withColumnRenamed("id", "rep"), "rep", "left").select(*bucket, "rep", "size", "n", F.coalesce("comp", "rep").alias("comp")), "buckets")
    split = saved(named.groupBy(bucket).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.first("n").alias("n")).where("low < high").select(*bucket, "n"), "split")
    mixed = spread(named.drop("n"), split, bucket, total)
    few = mixed.where(F.col("n") <= SMALL).join(rep.select("rep", "sig"), "rep")
    agree = lambda x, y: F.aggregate(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), F.lit(0), lambda n, i: n + (F.substring(x, i * 4 + 1, F.lit(4)) == F.substring(y, i * 4 + 1, F.lit(4))).cast("int"))
    one, two = (few.select(*bucket, F.col("rep").alias(r), F.col("comp").alias(f"comp_{r}"), F.col("sig").alias(f"sig_{r}")) for r in ("a", "b"))
    least = int(SAMPLES * (threshold - 4.4 * (threshold * (1 - threshold) / SAMPLES) ** 0.5))
    rest = one.join(two, bucket).where((F.col("comp_a") != F.col("comp_b")) & (F.col("a") < F.col("b")) & (agree(F.col("sig_a"), F.col("sig_b")) >= least))
    rest = rest.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    more = verify(rows, saved(rest, "pairs"), idf, threshold).select("a", "b").unionByName(across(rows, mixed.where(F.col("n") > SMALL), idf, threshold))
    more = saved(more, "links")
    if not more.isEmpty():
        joined = label.where("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b"))
        label = saved(components(joined.unionByName(more)), "labels")
    linked = links.select("a", "b").unionByName(more).select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    texts = rep.select("digest", "rep", "pick", "n").join(label.withColumnRenamed("id", "rep"), "rep", "left").join(linked, "rep", "left")
    texts = saved(texts.select("digest", "pick", "n", F.coalesce("comp", "rep").alias("comp"), F.coalesce("links", F.lit(0)).alias("links")), "texts")
    classes = texts.groupBy("comp").agg(F.min("pick").alias("pick"), F.sum("n").alias("class_size"), F.count("*").alias("n"))
    return signed, texts, saved(classes.select("comp", F.col("pick.doc_id").alias("class_id"), F.col("pick.row").alias("first"), "class_size", "n"), "classes"), total


def near_duplicates(docs: DataFrame, threshold: float = 0.8, floor: float = FLOOR) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size in rows, and links: how many verified near
    copies its text was linked to (a spanning part of all there are); one row for each row of docs."""
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "rows")
    signed, texts, classes, total = _classes(rows, threshold, floor)
    told = spread(texts.select("digest", "comp", "links", F.col("n").alias("rows")), classes.select("comp", "class_id", "class_size", "n"), ["comp"], total)
    told = saved(told.select("digest", "class_id", "class_size", "links", F.col("rows").alias("n")), "told")
    return spread(signed.select("doc_id", "digest"), told, ["digest"], total).select("doc_id", "class_id", "class_size", "links")


def keep_one(docs: DataFrame, threshold: float = 0.8, floor: float = FLOOR) -> DataFrame:
    """docs with one row of each class: that of its least doc_id, else its first; all columns are kept."""
    row = next(c for c in ("row", *(f"row_{i}" for i in range(len(docs.columns)))) if c not in docs.columns)
    every = saved(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    _, _, classes, _ = _classes(every.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), threshold, floor)
    return every.join(classes.select(F.col("first").alias(row)).hint("shuffle_hash"), row, "left_semi").select(*docs.columns)
