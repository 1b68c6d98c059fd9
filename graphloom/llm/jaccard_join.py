"""Exact Jaccard join of documents on shingles in the metric space of the distance 1 - |a & b| / |a | b|.

Copies are folded into classes of equal shingle sets first. Unrelated texts all lie at distance 1 from one another, so
pivots drawn from the documents alone would part nothing. The first partition is therefore by single shingles: two
sets within the distance share one of the first n - ceil(sim * n) + 1 shingles of each in any common order, and the
order here puts shingles last whose hash bucket is frequent in the corpus (a sketch of fixed size, counted over all
documents). The documents that hold a shingle in that prefix are a region, cut wherever the next larger member is too large
to be similar to any before it, and every region is joined exactly:

- the least member of each region is a pivot; all members' distances to it are bounded by parity bitmaps (the set bits in
  the difference of two bitmaps are at most the size of the symmetric difference) and measured where that leaves a
  doubt. A pivot that links to no lesser one is a hub, and the members linked to it, each at its nearest hub, are its
  cell. A region whose members are connected by now is done: however many near copies it holds, that took one distance
  for each of them;
- of the other regions only the hubs are compared. By the triangle inequality two cells have a link between them only
  if their hubs are at most the threshold and both radii apart; what bitmaps say of that distance gives every cell a
  window, the least distance from its hub that a member with a link to another cell can have;
- the members in the windows are replicated to their regions and joined there in the same way, between parts that are
  still not connected.

The candidates' distances are computed from whole shingle sets; links are those within the threshold, and components
follow from them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, parted, written
from .components import components
from .encoding import slices

WIDTH, PERCENT = 5, 80
SKETCH_BITS, CHUNK = 20, 4096
#: Bits of the least bitmap; larger sets have as many as the next power of two.
BITMAP = 1024
#: Rows of a region (of a few hundred bytes each) that meet in one task; a larger one is joined block by block.
LEAF = 4096
#: Open regions of a row up to which it carries their list, so that a pair is told in the first region that both are in only; a row in more tells its pairs in all.
LISTED = 512
#: Sketches that are added up by one task at most are about this many, in two steps.
SALTS = 1024
#: Shingles that more documents than this may hold are parted by sums over sizes; fewer are sorted by one task.
SORTED = 200_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


# ---- shingles ------------------------------------------------------------------------------------------------------
def shingles(x: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; of the whole sequence where it has fewer words; none without words."""
    words = (x or b"").lower().split()
    n = len(words)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    s = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        s = (s ^ (s >> np.uint64(29))) * MIX[0] + h[k : n - width + 1 + k] * MIX[k % 5]
    s ^= s >> np.uint64(32)
    s *= MIX[1]
    return np.unique(s ^ (s >> np.uint64(29)))


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _count_buckets(width: int):
    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for b in slices(batches):
            sets = [shingles(x, width) for x in b.column(0).to_pylist()]
            total += np.bincount(_bucket(np.concatenate(sets)), minlength=len(total)).astype(np.uint32)
        parts = total.reshape(-1, CHUNK).astype(np.int64)
        at, salt = np.flatnonzero(parts.any(axis=1)), TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([salt] * len(at), pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in at], pa.binary())], ["chunk", "salt", "counts"])

    return run


def _add_chunks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, dtype=np.int64)
    for x in rows["counts"]:
        total += np.frombuffer(zlib.decompress(x), dtype=np.int64)
    return pd.DataFrame({"chunk": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def bucket_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many shingles of all texts fall into each of 2^SKETCH_BITS buckets of their hashes; tasks' counts are added by salt, then over salts."""
    got, kind = texts.mapInArrow(_count_buckets(width), "chunk int, salt int, counts binary"), "chunk int, counts binary"
    got = got.groupBy("chunk", "salt").applyInPandas(_add_chunks, kind).groupBy("chunk").applyInPandas(_add_chunks, kind)
    total = np.zeros((1 << SKETCH_BITS) // CHUNK * CHUNK, dtype=np.int64).reshape(-1, CHUNK)
    for r in got.collect():  # 2^SKETCH_BITS numbers
        total[r.chunk] = np.frombuffer(zlib.decompress(r.counts), dtype=np.int64)
    return total.ravel()


def frequent_levels(total: np.ndarray) -> np.ndarray:
    """For each bucket 0, or how many doublings its count lies above one and a half times the mean."""
    return np.maximum(0, np.floor(np.log2(np.maximum(1, total) / (1.5 * total.mean() + 2)) + 1)).astype(np.uint8)


def bitmap(s: np.ndarray) -> bytes:
    """The parity of the number of hashes at each of 2^k places."""
    size = max(BITMAP, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _features(levels, width: int, percent: int):
    def run(batches):
        level, row = levels.value, TaskContext.get().partitionId() << 33
        for b in slices(batches):
            sets = [shingles(x, width) for x in b.column(3).to_pylist()]
            first, bits, digest = [], [], []
            for s in sets:
                k = prefix_length(len(s), percent) if len(s) else 0
                order = (level[_bucket(s)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                first.append(s[np.argsort(order, kind="stable")[:k]].view(np.int64))
                bits.append(bitmap(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            ends = np.cumsum([0] + [len(x) for x in first])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first) if first else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(sets)), pa.int64()), *b.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), lists, pa.array(bits, pa.binary())], ["row", "doc_id", "key", "key2", "n", "class", "prefix", "bits"])
            row += len(sets)

    return run


# ---- bounds and pairs within regions ---------------------------------------------------------------------------------
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def _folded(m: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of 16-bit words) at `size` words: places that fall together add their parities."""
    while m.shape[-1] > size:
        half = m.shape[-1] // 2
        m = m[..., :half] ^ m[..., half:]
    return m


def least_distance(n1, n2, apart):
    """What the sizes of two sets, and some of the elements that only one has, say of their distance."""
    total = n1 + n2
    return np.maximum(1 - np.minimum(n1, n2) / np.maximum(n1, n2), 2 * apart / (total + apart))


def _bounds(n: np.ndarray, m: np.ndarray, i: int) -> np.ndarray:
    """What sizes and bitmaps (rows of 16-bit words) of a region say of the distances of one row to all of them."""
    return least_distance(n, n[i], _ONES[m ^ m[i]].sum(axis=1, dtype=np.int64))


def _region_pairs(threshold: float):
    """Rows (s, x, n, small, part, r, block, i, j, regions) sorted by s, i, j -> (u, v, null) and (x, null, window).

    u > v: pairs of different parts that bounds allow to be linked. window: the least distance from x that a member of
    its cell with a link to a cell of another part can have, where the cell has a member at that distance or beyond
    (none for two cells without members, whose only pair is the first kind). Rows of block i meet those of block j.
    """

    def first(a, b, s):
        return a[8] is None or b[8] is None or min(set(a[8]) & set(b[8])) == s

    def two(a, b, s):
        total, radii = a[1] + b[1], a[4] + b[4]
        if a[3] == b[3] or (a[5] == b[5]) != (a[6] == a[7]):
            return
        apart = (int.from_bytes(a[2], "little") ^ int.from_bytes(b[2], "little")).bit_count()
        d = max(1 - min(a[1], b[1]) / max(a[1], b[1]), 2 * apart / (total + apart))
        if d > threshold + radii + 1e-9:
            return
        if d <= threshold + 1e-9 and first(a, b, s):
            yield max(a[0], b[0]), min(a[0], b[0]), None
        for own, other in ((a, b), (b, a)):
            if radii and own[4] + 1e-9 >= d - threshold - other[4]:
                yield own[0], None, d - threshold - other[4]

    def pairs(rows: list[tuple], s: int | None):
        if len(rows) < 3:
            if len(rows) == 2:
                yield from two(*rows, s)
            return
        if len({r[3] for r in rows}) < 2:
            return
        x, n, part, radius, block = (np.array([r[i] for r in rows]) for i in (0, 1, 3, 4, 5))
        m = np.stack([np.frombuffer(r[2], np.uint16) for r in rows])
        one, other = rows[0][6], rows[0][7]
        window = np.full(len(rows), np.inf)
        for i in np.flatnonzero(block == one):
            d = _bounds(n, m, i)
            ok = (part != part[i]) & (x < x[i] if one == other else block == other) & (d <= threshold + radius + radius[i] + 1e-9)
            near = np.flatnonzero(ok & (d <= threshold + 1e-9)).tolist()
            yield from ((max(int(x[i]), int(x[j])), min(int(x[i]), int(x[j])), None) for j in near if first(rows[i], rows[j], s))
            ok &= radius + radius[i] > 0
            window[i] = min(window[i], (d - threshold - radius)[ok].min(initial=np.inf))
            window[ok] = np.minimum(window[ok], (d - threshold - radius[i])[ok])
        yield from ((int(x[i]), None, float(window[i])) for i in np.flatnonzero(window <= radius + 1e-9))

    def run(batches):
        region, rows, got = None, [], []
        for b in slices(batches, 4096):
            for s, *row in zip(*(c.to_pylist() for c in b.columns)):
                at = s, row[6], row[7]
                if at != region:
                    got += pairs(rows, region and region[0])
                    region, rows = at, []
                rows.append(tuple(row))
            yield _batch(got)
            got = []
        yield _batch(list(pairs(rows, region and region[0])))

    def _batch(got):
        return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["u", "v", "window"])

    return run


def _plausible(threshold: float):
    def run(batches):
        for b in slices(batches, 4096):
            u, v, n1, b1, n2, b2 = b.columns
            apart = []
            for x, y in zip(b1.to_pylist(), b2.to_pylist()):
                x, y = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
                size = min(len(x), len(y))
                apart.append(int(_ONES[_folded(x, size) ^ _folded(y, size)].sum(dtype=np.int64)))
            ok = pa.array(least_distance(n1.to_numpy(), n2.to_numpy(), np.array(apart)) <= threshold + 1e-9)
            yield pa.RecordBatch.from_arrays([u.filter(ok), v.filter(ok)], ["u", "v"])

    return run


def _small(batches):
    """x, n, bits -> x, n and the bitmap at its least width."""
    for b in slices(batches, 4096):
        small = [_folded(np.frombuffer(m, np.uint16), BITMAP // 16).tobytes() for m in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(small, pa.binary())], ["x", "n", "small"])


def _cross(rows: DataFrame, about: DataFrame, threshold: float) -> DataFrame:
    """Of rows s, x, part, r, with n and bits of x from `about`, what _region_pairs says, each once.

    A region of more than LEAF rows is dealt out in blocks, and every two blocks meet in a group of their own.
    """
    sizes = rows.groupBy("s").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("blocks"))
    large = sizes.filter("blocks > 1").withColumnRenamed("s", "l")  # at most one in LEAF of the rows
    rows = rows.join(large, F.col("s") == F.col("l"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    regions = rows.groupBy("x").agg(F.collect_list("s").alias("regions")).select("x", F.when(F.size("regions") <= LISTED, F.col("regions")).alias("regions"))
    dealt = rows.select("s", "x", "part", "r", "block", F.inline(meets)).join(regions, "x")
    about = parted(about, "x", rows)[0].mapInArrow(_small, "x long, n long, small binary")
    dealt = dealt.join(about, "x").select("s", "x", "n", "small", "part", "r", "block", "i", "j", "regions").repartition("s", "i", "j").sortWithinPartitions("s", "i", "j")
    said = dealt.mapInArrow(_region_pairs(threshold), "u long, v long, window double")
    return said.groupBy("u", "v").agg(F.min("window").alias("window"))


# ---- exact distances -----------------------------------------------------------------------------------------------
def _sets(width: int):
    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x, width).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["x", "set"])

    return run


def _measured(batches):
    for b in slices(batches, 1024):
        got = []
        for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            got.append((len(np.intersect1d(s, t, assume_unique=True)), len(s) + len(t)))
        both = np.array([x for x, _ in got], dtype=np.int64)
        either = np.array([y for _, y in got], dtype=np.int64) - both
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(both), pa.array(either)], ["u", "v", "both", "either"])


class _Corpus:
    """Classes with their prefixes and bitmaps, and the texts to measure distances by.

    key and key2 are two 64-bit hashes of a row's id and text: what they tell apart is 128 bits wide.
    """

    def __init__(self, docs: DataFrame, width: int, percent: int, work: Tables):
        self.width, self.percent, self.work = width, percent, work
        self.docs = docs.select("doc_id", *keys(), F.col("text").cast("binary").alias("text"))
        total = bucket_counts(self.docs.select("text"), width)
        levels = docs.sparkSession.sparkContext.broadcast(frequent_levels(total))
        self.frequent = np.flatnonzero(total > SORTED)  # no other bucket has a shingle that more than SORTED documents hold
        schema = "row long, doc_id long, key long, key2 long, n long, class binary, prefix array<long>, bits binary"
        features = work.write(self.docs.mapInArrow(_features(levels, width, percent), schema), "features")
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "key2").alias("first")
        self.rows = work.write(features.select("doc_id", "n", "class", first), "rows")
        # copies of one class agree in everything but row, id and key
        kinds = features.filter("n > 0").groupBy("class").agg(F.min(F.struct("row", "key", "key2")).alias("r"), F.min(first).alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
        self.classes = work.write(kinds.select("class", F.col("r.row").alias("x"), "r.key", "r.key2", "first", "n", "prefix", "bits"), "classes")
        work.discard("features")

    def about(self, name: str, pairs: DataFrame) -> DataFrame:
        some, _ = parted(self.classes.select("x", "n", "bits"), "x", pairs.select(F.col(name).alias("x")))
        return some.withColumnsRenamed({"x": name, "n": f"n_{name}", "bits": f"b_{name}"})

    def plausible(self, pairs: DataFrame, name: str) -> DataFrame:
        pairs = self.work.write(pairs, f"{name}-asked")
        both = pairs.join(self.about("u", pairs), "u").join(self.about("v", pairs), "v")
        return both.select("u", "v", "n_u", "b_u", "n_v", "b_v").mapInArrow(_plausible(1 - self.percent / 100), "u long, v long")

    def measured(self, pairs: DataFrame, name: str) -> DataFrame:
        """u, v, both, either of each pair, from the whole texts of those that are in one."""
        work, steps = self.work, [f"{name}-{x}" for x in ("pairs", "texts", "sets")]
        pairs = work.write(pairs.distinct(), steps[0])
        asked = pairs.select(F.explode(F.array("u", "v")).alias("x")).distinct().join(self.classes.select("x", "key", "key2"), "x")
        asked = work.write(asked, steps[1])
        sets = parted(self.docs, "key", asked)[0].join(asked, ["key", "key2"]).select("x", "text").mapInArrow(_sets(self.width), "x long, set binary")
        sets = work.write(sets.dropDuplicates(["x"]), steps[2])  # a row may be there more than once
        both = pairs.join(sets.withColumnsRenamed({"x": "u", "set": "s"}), "u").join(sets.withColumnsRenamed({"x": "v", "set": "t"}), "v")
        out = work.write(both.select("u", "v", "s", "t").mapInArrow(_measured, "u long, v long, both long, either long"), name)
        work.discard(*steps)
        return out

    def linked(self, measured: DataFrame) -> DataFrame:
        return measured.filter(F.col("both") * 100 >= F.col("either") * self.percent).select("u", "v")

    def links(self, said: DataFrame, name: str) -> DataFrame:
        """The links among what _cross says."""
        return self.linked(self.measured(self.plausible(said.filter("v IS NOT NULL").select("u", "v"), name), name))


def keys() -> list:
    """Two 64-bit hashes of a row's id and text."""
    return [F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), "doc_id", "text").alias("key2")]


def _regions(classes: DataFrame, percent: int, frequent: np.ndarray) -> DataFrame:
    """s, x and p, the least member, with sizes n and n_p, of every region of two members or more.

    Where a shingle is the first that two sets share, what they share lies from its place on in both, so its place bounds
    the size of a similar set (`most`). A shingle's members in order of size part where the next is beyond what all
    before it bound; a member stays where a larger one is within its bound or the least one is. Shingles of `frequent`
    buckets, which may be those of very many members, are parted without bringing their members to one task.
    """
    posts = classes.select(F.posexplode("prefix").alias("i", "s"), "x", "n")
    most = F.floor((100 + percent) * (F.col("n") - F.col("i")) / percent) - F.col("n")
    # 48 bits of a shingle are enough: shingles that agree in them make one region
    few = F.col("s").bitwiseAND(F.lit((1 << 48) - 1)).alias("s")
    bucket = F.shiftrightunsigned("s", 64 - SKETCH_BITS).cast("int").alias("bucket")
    posts = posts.select(few, bucket, "x", F.col("n").cast("int").alias("n"), F.least(most, F.floor(100 * F.col("n") / percent)).cast("int").alias("most"))
    if not len(frequent):
        return _sorted_regions(posts.drop("bucket"))
    hot = F.broadcast(classes.sparkSession.createDataFrame([(int(x),) for x in frequent], "bucket int"))  # at most 2^SKETCH_BITS
    rare, often = posts.join(hot, "bucket", "left_anti").drop("bucket"), posts.join(hot, "bucket", "left_semi").drop("bucket")
    return _sorted_regions(rare).unionByName(_summed_regions(often))


def _sorted_regions(posts: DataFrame) -> DataFrame:
    by_size = Window.partitionBy("s").orderBy("n", "x")
    cut = F.coalesce(F.max("most").over(by_size.rowsBetween(Window.unboundedPreceding, -1)) < F.col("n"), F.lit(True))
    posts = posts.withColumns({"cut": cut, "up": F.coalesce(F.lead("n").over(by_size) <= F.col("most"), F.lit(False))})
    posts = posts.filter("NOT cut OR up").withColumn("part", F.sum(F.col("cut").cast("int")).over(by_size))
    inside = Window.partitionBy("s", "part").orderBy("n", "x")
    posts = posts.withColumns({"first": F.first("n").over(inside), "other": F.row_number().over(inside) > 1}).filter("up OR (other AND first <= most)")
    posts = posts.withColumn("alone", F.lag("x").over(inside).isNull() & F.lead("x").over(inside).isNull()).filter("NOT alone")
    by_id = Window.partitionBy("s", "part").orderBy("x")
    return posts.select(F.xxhash64("s", "part").alias("s"), "x", F.first("x").over(by_id).alias("p"), "n", F.first("n").over(by_id).alias("n_p"))


def _summed_regions(posts: DataFrame) -> DataFrame:
    """The same, with cuts only between sizes: what is known of each shingle and size is summed first, so windows hold a row for each size."""
    by_size = Window.partitionBy("s").orderBy("n")
    sizes = posts.groupBy("s", "n").agg(F.count("*").alias("k"), F.max("most").alias("m"))
    cut = F.coalesce(F.max("m").over(by_size.rowsBetween(Window.unboundedPreceding, -1)) < F.col("n"), F.lit(True)).cast("int")
    sizes = sizes.withColumns({"cut": cut, "next": F.lead("n").over(by_size)}).withColumn("part", F.sum("cut").over(by_size))
    up = (F.col("next") <= F.col("most")) | ((F.col("k") > 1) & (F.col("n") <= F.col("most")))
    rows = posts.join(sizes, ["s", "n"]).filter((F.col("cut") == 0) | (F.col("k") > 1) | up).select(F.xxhash64("s", "part").alias("s"), "x", "n")
    least = rows.groupBy("s").agg(F.min(F.struct("x", "n")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("s", F.col("m.x").alias("p"), F.col("m.n").alias("n_p"))
    return rows.join(least, "s").select("s", "x", "p", "n", "n_p")


def _told_apart(rows: DataFrame, *more) -> DataFrame:
    """s and more aggregates of the regions of rows s, x, with what tells sets of members apart: their number and two 64-bit hashes of all of them."""
    return rows.groupBy("s").agg(*more, F.count("*").alias("k"), F.bit_xor(F.xxhash64("x")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "x")).alias("h2"))


def _one_of_equal(regions: DataFrame) -> DataFrame:
    """s of one of the regions with the same members, as texts that share a passage share all of its shingles."""
    return regions.groupBy("k", "h", "h2").agg(F.min("s").alias("s")).select("s")


def _open_regions(rows: DataFrame) -> DataFrame:
    """s of the regions of rows s, x, part that are not connected, one of those with the same members."""
    each = _told_apart(rows, F.min("part").alias("a"), F.max("part").alias("b"))
    return _one_of_equal(each.filter("a <> b"))


def _classes(docs: DataFrame, width: int, percent: int, work: Tables) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, class, first of every row; class, first, best of every class): best is the least `first` that links reach."""
    corpus = _Corpus(docs, width, percent, work)
    threshold = 1 - percent / 100
    every = work.write(_regions(corpus.classes, percent, corpus.frequent), "every")
    members = work.write(every.join(_one_of_equal(_told_apart(every)), "s", "left_semi"), "members")
    work.discard("every")
    # cells around hubs
    alike = (F.col("x") != F.col("p")) & (100 * F.least("n", "n_p") >= percent * F.greatest("n", "n_p"))
    near = corpus.measured(corpus.plausible(members.filter(alike).select(F.col("x").alias("u"), F.col("p").alias("v")).distinct(), "near"), "near")
    members = members.select("s", "x")
    edges = work.write(corpus.linked(near), "edges")
    distance = 1 - F.col("both") / F.col("either")
    to_hub = near.select("u", "v", distance.alias("d")).join(edges, ["u", "v"], "left_semi").join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_anti")
    cells = work.write(to_hub.groupBy(F.col("u").alias("x")).agg(F.min(F.struct("d", "v")).alias("m")).select("x", F.col("m.v").alias("hub"), F.col("m.d").alias("d")), "cells")
    radius = cells.groupBy(F.col("hub").alias("x")).agg(F.max("d").alias("r"))
    # regions that are not connected, by their hubs
    parts = components(edges, work, "parts").withColumnsRenamed({"u": "x", "v": "part"})
    some = members.join(cells, "x", "left").select("s", F.coalesce("hub", "x").alias("x")).distinct().join(parts, "x", "left").withColumn("part", F.coalesce("part", "x"))
    some = work.write(some, "hubs")
    about = corpus.classes.select("x", "n", "bits")
    hubs = some.join(_open_regions(some), "s", "left_semi").join(radius, "x", "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    hubs = work.write(hubs, "open-hubs")
    said = work.write(_cross(hubs, about, threshold), "cross")
    edges = work.write(edges.unionByName(corpus.links(said, "between")), "edges-2")
    work.discard("hubs", "open-hubs", "near", "edges")
    # members in the windows of cells that may still have links to others
    window = said.filter("v IS NULL").select(F.col("u").alias("hub"), "window")
    own = cells.unionByName(window.select(F.col("hub").alias("x"), "hub", F.lit(0.0).alias("d")))
    border = own.join(window, "hub").filter(F.col("d") >= F.col("window") - 1e-9).select("x").distinct()
    parts = components(edges, work, "parts-2").withColumnsRenamed({"u": "x", "v": "part"})
    border = work.write(border.join(parts, "x", "left").withColumn("part", F.coalesce("part", "x")), "border")
    rows = work.write(members.join(border, "x"), "border-members")
    work.discard("members", "cross")
    rows = work.write(rows.join(_open_regions(rows), "s", "left_semi").withColumn("r", F.lit(0.0)), "open-members")
    said = work.write(_cross(rows, about, threshold), "cross-2")
    edges = work.write(edges.unionByName(corpus.links(said, "within")), "edges-3")
    # a class without links is a component of its own
    parts = components(edges, work, "parts-3")
    parts = parts.unionByName(parts.select(F.col("v").alias("u"), "v").distinct()).withColumnsRenamed({"u": "x", "v": "part"})
    firsts = work.write(corpus.classes.select("x", "first").join(parts, "x"), "firsts")
    best = firsts.join(firsts.groupBy("part").agg(F.min("first").alias("best")), "part").select("x", "best")
    kinds = corpus.classes.select("class", "x", "first").join(best, "x", "left").select("class", "first", F.coalesce("best", "first").alias("best"))
    return corpus.rows, work.write(kinds, "kinds")


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    Two rows link when 100 * |a & b| >= percent * |a | b| for their shingle sets; component_id is the least doc_id that
    links reach, a null only if there is no other. A text without words, or null, has an empty set and links with
    nothing; rows of equal sets are linked. Repeated ids are rows of their own. No rows give no rows.
    """
    work = Tables(docs.sparkSession, "jaccard")
    rows, kinds = _classes(docs, width, percent, work)
    out = rows.join(kinds.select("class", "best"), "class", "left")
    out = written(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id")), "components")
    work.close()
    return out


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The row of docs with the least doc_id of every group of linked rows; of rows that agree in id and text one.

    Rows without words are groups of their own. Rows that agree in id and text but not in other columns: any one of them.
    """
    work = Tables(docs.sparkSession, "jaccard")
    rows, kinds = _classes(docs, width, percent, work)
    stays = F.col("best").isNull() | F.col("first").eqNullSafe(F.col("best"))
    per = rows.join(kinds.select("class", "best"), "class", "left").select("first.key", "first.key2", stays.alias("stays"))
    # keys of rows that go, or that are there more than once
    marked = per.groupBy("key", "key2").agg(F.bool_and("stays").alias("stays"), F.count("*").alias("n")).filter("NOT stays OR n > 1")
    marked = written(marked.select(F.col("key").alias("__key"), F.col("key2").alias("__key2"), F.col("stays").alias("__stays")), "marked")
    work.close()
    key, key2 = keys()
    some, rest = parted(docs.withColumns({"__key": key, "__key2": key2}), "__key", marked)
    some = some.join(marked, ["__key", "__key2"], "left").filter(F.coalesce("__stays", F.lit(True))).dropDuplicates(["__key", "__key2"])
    return some.select(*rest.columns).unionByName(rest).drop("__key", "__key2")
