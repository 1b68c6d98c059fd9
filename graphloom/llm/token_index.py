"""Token ids as raw binary shards with a minimal perfect hash index from document keys to places in them.

Files under a folder that driver and executors share:

- ids-<shard>-<attempt>.bin: 16 bytes of header (`GLID`, version 1, bytes an id as unsigned 32-bit little-endian, 0),
  then the ids of the shard's documents in a row, 2 bytes each for vocabularies up to 65,536 ids, else 4.
- ids-<shard>-<attempt>.dir: where each of its documents starts, in ids, and where the last ends, 8 bytes each.
- mph-<slot>-<attempt>.bin: for the keys whose hash falls in the slot, a header, the bit levels of the hash function in
  blocks of 64 bytes (the number of set bits before the block, then 448 bits), at each key's number its fingerprint and
  runs, and the runs: shard, first document, documents. There is no list of keys.

Documents lie in ascending order of doc_id over the shards, so all those of one key are one run in each shard they
reach, however many they are. A lookup hashes the key to its slot and reads one block for each level up to the first
set bit, whose rank is the key's number, one entry and its runs: a constant number of bytes at given places. A task
that is run again writes files of its own; only those named in the manifest count.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written
from .encoding import encoder, slices

HEADER = 16
GAMMA, LEVELS = 2.0, 48
KEYS_A_SLOT = 200_000
#: Bytes of text in one shard of ids.
SHARD_BYTES = 1 << 26


# ---- minimal perfect hash ------------------------------------------------------------------------------------------
def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 + np.uint64(level + 1) * (h2 | np.uint64(1))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def build_mph(h1: np.ndarray, h2: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(bits of each level, number of each key) for distinct pairs of hashes; numbers are 0 to n - 1.

    A key goes to the first level on which no other remaining key has its position.
    """
    left, levels, number, base = np.arange(len(h1)), [], np.full(len(h1), -1, dtype=np.int64), 0
    while len(left) and len(levels) < LEVELS:
        size = max(64, int(GAMMA * len(left)))
        at = (_mix(h1[left], h2[left], len(levels)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        number[left[alone]] = base + (np.cumsum(bits) - 1)[at[alone]]
        base += int(bits.sum())
        levels.append(bits)
        left = left[~alone]
    if len(left):
        raise ValueError(f"{len(left)} keys share both 64-bit hashes")
    return levels, number


BLOCK, BITS = 64, 448
ENTRY = np.dtype([("print", "<u4"), ("runs", "<u4"), ("run", "<u8")])
RUN = np.dtype([("shard", "<u8"), ("first", "<u8"), ("docs", "<u8")])
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def packed_level(bits: np.ndarray, rank: int) -> np.ndarray:
    """Blocks of a level; rank: set bits of all levels before it."""
    n = -(-len(bits) // BITS)
    rows = np.zeros((n, BITS), dtype=np.uint8)
    rows.ravel()[: len(bits)] = bits
    each = rows.sum(axis=1, dtype=np.uint64)
    before = (np.cumsum(each) - each + np.uint64(rank)).astype("<u8")
    return np.concatenate([before.view(np.uint8).reshape(n, 8), np.packbits(rows, axis=1, bitorder="little")], axis=1)


def pack_index(levels: list[np.ndarray], entries: np.ndarray, runs: np.ndarray) -> bytes:
    """The bytes of an index file."""
    parts, rank = [], 0
    for bits in levels:
        parts.append(packed_level(bits, rank).tobytes())
        rank += int(bits.sum())
    head = np.array([int.from_bytes(b"GLMPHASH", "little"), len(levels), len(entries), len(runs), *map(len, levels)], dtype="<u8")
    return b"".join([head.tobytes(), *parts, entries.tobytes(), runs.tobytes()])


class SlotIndex:
    """An index file, read block by block where they are asked for; `whole` reads it at once, for many keys."""

    def __init__(self, read_at, whole: bool = False):
        """read_at: (number of bytes, offset) -> bytes."""
        magic, n, self.keys, self.n_runs = (int(x) for x in np.frombuffer(read_at(32, 0), "<u8"))
        if magic != int.from_bytes(b"GLMPHASH", "little"):
            raise ValueError("not an index")
        self.sizes = np.frombuffer(read_at(8 * n, 32), "<u8").astype(np.int64)
        blocks = -(-self.sizes // BITS)
        self.at = 32 + 8 * n + BLOCK * (np.cumsum(blocks) - blocks)
        self.entries = int(32 + 8 * n + BLOCK * blocks.sum())
        self.runs = self.entries + ENTRY.itemsize * self.keys
        if whole:
            data = read_at(self.runs + RUN.itemsize * self.n_runs, 0)
            read_at = lambda size, at: data[at : at + size]
        self.read_at, self.data = read_at, np.frombuffer(data, np.uint8) if whole else None

    def _rows(self, at: int, size: int, which: np.ndarray) -> np.ndarray:
        """Records number `which` of those of `size` bytes from `at` on."""
        if self.data is not None and len(which):
            end = at + size * (int(which.max()) + 1)
            return self.data[at:end].reshape(-1, size)[which]
        return np.frombuffer(b"".join(self.read_at(size, at + size * int(i)) for i in which), np.uint8).reshape(-1, size)

    def number(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for some keys that were never put in, any number for the others of those."""
        number, left = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (_mix(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
            rows, bit = self._rows(int(self.at[level]), BLOCK, at // BITS), at % BITS
            bits = rows[:, 8:]
            hit = (bits[np.arange(len(at)), bit // 8] >> (bit % 8).astype(np.uint8)) & 1 == 1
            inside = np.arange(BITS // 8)[None, :] * 8
            mask = np.where(inside + 8 <= bit[:, None], 255, np.where(inside <= bit[:, None], (1 << np.clip(bit[:, None] - inside, 0, 7)) - 1, 0)).astype(np.uint8)
            rank = rows[:, :8].copy().view("<u8").ravel().astype(np.int64) + _ONES[bits & mask].sum(axis=1, dtype=np.int64)
            number[left[hit]] = rank[hit]
            left = left[~hit]
        return number

    def lookup(self, h1: np.ndarray, h2: np.ndarray, fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(for each run found the place of its key among those asked for, the runs)."""
        number = self.number(h1, h2)
        there = np.flatnonzero(number >= 0)
        entries = self._rows(self.entries, ENTRY.itemsize, number[there]).copy().view(ENTRY).ravel()
        same = entries["print"] == fingerprint[there].astype(np.uint32)
        there, entries = there[same], entries[same]
        n = entries["runs"].astype(np.int64)
        which = np.repeat(entries["run"].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(there, n), self._rows(self.runs, RUN.itemsize, which).copy().view(RUN).ravel()


# ---- writing -------------------------------------------------------------------------------------------------------
def _open(folder: str):
    return pafs.FileSystem.from_uri(folder)


def _writer(folder: str, tokenizer: str, keeps_space: bool, dtype: str, end_id: int):
    def run(batches):
        fs, root = _open(folder)
        enc, end, width = encoder(tokenizer, dtype, keeps_space), np.array([end_id], dtype=dtype).tobytes(), np.dtype(dtype).itemsize
        shard, at, docs, file, out, starts = TaskContext.get().partitionId(), 0, 0, "", None, []
        for b in slices(batches):
            ids = [x + end for x in enc.encode([t or "" for t in b.column(1).to_pylist()])]
            if out is None:
                file = f"ids-{shard:06d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{root}/{file}.bin", compression=None)
                out.write(b"GLID" + np.array([1, width, 0], dtype="<u4").tobytes())
            n = np.array([len(x) // width for x in ids], dtype=np.int64)
            starts.append(at + np.cumsum(n) - n)
            at += int(n.sum())
            out.write(b"".join(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shard] * len(n), pa.int32()), pa.array([file] * len(n)), pa.array(np.arange(docs, docs + len(n))), pa.array(n)], ["doc_id", "shard", "file", "doc", "length"])
            docs += len(n)
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{file}.dir", compression=None) as f:
                f.write(np.append(np.concatenate(starts), at).astype("<u8").tobytes())

    return run


def _key_hash(key: Column, salt: int) -> Column:
    return F.xxhash64(key, F.lit(salt))


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(_key_hash(key, 0), F.lit(slots)).cast("int")


def _hashed(keys: DataFrame, slots: int, *more: str) -> DataFrame:
    """doc_id as text (a null has a key of its own), its slot, two hashes and fingerprint."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return keys.select(key.alias("key"), _slot(key, slots).alias("slot"), _key_hash(key, 1).alias("h1"), _key_hash(key, 2).alias("h2"), (_key_hash(key, 3).bitwiseAND(F.lit(0xFFFFFFFF))).alias("print"), *more)


def _u64(s: pd.Series) -> np.ndarray:
    return s.to_numpy(dtype=np.int64).view(np.uint64)


def _indexer(folder: str):
    def run(slot: tuple, runs: pd.DataFrame) -> pd.DataFrame:
        fs, root = _open(folder)
        runs = runs.sort_values(["h1", "h2", "shard"], kind="stable")
        first = ~runs.duplicated(["h1", "h2"]).to_numpy()
        keys, start = runs[first], np.flatnonzero(first)
        levels, number = build_mph(_u64(keys["h1"]), _u64(keys["h2"]))
        entries, order = np.zeros(len(keys), dtype=ENTRY), np.argsort(number)
        for name, column in (("print", keys["print"].to_numpy()), ("runs", np.diff(np.append(start, len(runs)))), ("run", start)):
            entries[name] = column[order]
        packed = np.zeros(len(runs), dtype=RUN)
        for name in RUN.names:
            packed[name] = runs[name].to_numpy()
        file = f"mph-{slot[0]:06d}-{uuid.uuid4().hex}.bin"
        with fs.open_output_stream(f"{root}/{file}", compression=None) as f:
            f.write(pack_index(levels, entries, packed))
        return pd.DataFrame({"slot": [slot[0]], "index_file": [file], "keys": [len(keys)]})

    return run


def write_index(docs: DataFrame, tokenizer: str, end_id: int, keeps_space: bool = True, dtype: str = "<u2", folder: str | None = None) -> tuple[str, DataFrame, DataFrame]:
    """Write shards and index; returns (folder, shards, slots).

    shards: shard, file, base (ids of all shards before it), ids. slots: slot, of (how many there are, with those
    that no key falls into and that have no file), index_file, keys. Null texts are empty, null ids come first, equal
    ids lie side by side in the order of their texts' hashes, over as many shards as they need. No row, no file.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "ids")
    fs, root = _open(folder)
    fs.create_dir(root)
    size = docs.agg(F.sum(F.length(F.col("text").cast("binary")))).first()[0] or 0
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select("doc_id", "text").repartitionByRange(max(spark.sparkContext.defaultParallelism, size // SHARD_BYTES + 1), *by).sortWithinPartitions(*by)
    manifest = written(rows.mapInArrow(_writer(folder, tokenizer, keeps_space, dtype, end_id), "doc_id long, shard int, file string, doc long, length long"), "manifest")
    shards = manifest.groupBy("shard").agg(F.first("file").alias("file"), F.sum("length").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each shard
    shards = written(shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long")), "shards")
    runs = written(manifest.groupBy("doc_id", "shard").agg(F.min("doc").alias("first"), F.count("*").alias("docs")), "runs")
    slots = max(1, -(-runs.select("doc_id").distinct().count() // KEYS_A_SLOT))
    index = _hashed(runs, slots, "shard", "first", "docs").groupBy("slot").applyInPandas(_indexer(folder), "slot int, index_file string, keys long")
    return folder, shards, written(index.withColumn("of", F.lit(slots)), "slots")


# ---- reading -------------------------------------------------------------------------------------------------------
def _finder(folder: str):
    def run(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        fs, root = _open(folder)
        with fs.open_input_file(f"{root}/{asked['index_file'].iloc[0]}") as f:
            index = SlotIndex(f.read_at, whole=len(asked) > 1000)
            at, runs = index.lookup(_u64(asked["h1"]), _u64(asked["h2"]), asked["print"].to_numpy())
        return pd.DataFrame({"key": asked["key"].to_numpy()[at]} | {name: runs[name].astype(np.int64) for name in RUN.names})

    return run


def _payloads(folder: str):
    def run(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        fs, root = _open(folder)
        found, file = found.sort_values("first"), found["file"].iloc[0]
        keys, start, n, crc = [], [], [], []
        with fs.open_input_file(f"{root}/{file}.bin") as f, fs.open_input_file(f"{root}/{file}.dir") as g:
            head = f.read_at(HEADER, 0)
            if head[:4] != b"GLID":
                raise ValueError("not a shard of ids")
            width = int(np.frombuffer(head, "<u4", offset=8, count=1)[0])
            for k, first, docs in zip(found["key"], found["first"], found["docs"]):
                ends = np.frombuffer(g.read_at(8 * (int(docs) + 1), 8 * int(first)), "<u8").astype(np.int64)
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    crc.append(zlib.crc32(np.frombuffer(f.read_at((b - a) * width, HEADER + a * width), f"<u{width}").astype("<u4").tobytes()))
                keys += [k] * int(docs)
                start.append(ends[:-1])
                n.append(np.diff(ends))
        return pd.DataFrame({"key": keys, "start": np.concatenate(start) + found["base"].iloc[0], "n_tokens": np.concatenate(n), "ids_crc32": np.array(crc, dtype=np.int64)})

    return run


def read_keys(keys: DataFrame, folder: str, shards: DataFrame, slots: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document under the given doc_ids, read from the files.

    Keys that are not there give no row (a strange key passes for another with a chance of 2^-32); repeated keys are
    asked once. A group is the keys asked of one slot, then the runs asked of one shard.
    """
    n = getattr(slots.select("of").first(), "of", 1)
    asked = _hashed(keys.select("doc_id").distinct(), n).join(slots.select("slot", "index_file"), "slot")
    found = asked.groupBy("slot").applyInPandas(_finder(folder), "key string, shard long, first long, docs long")
    found = found.join(shards.select("shard", "file", "base"), "shard")
    out = found.groupBy("shard").applyInPandas(_payloads(folder), "key string, start long, n_tokens long, ids_crc32 long")
    return out.select(F.expr("try_cast(key AS BIGINT)").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def token_index_round_trip(docs: DataFrame, tokenizer: str, end_id: int, **kw) -> DataFrame:
    """Write docs and read every document back by its key: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is its end id alone. A null doc_id is a key of its own, before all others; rows that repeat a
    key are documents of their own. A long text is encoded whole and may fill a shard by itself. Other columns are not looked
    at. No rows give no files and no rows.
    """
    folder, shards, slots = write_index(docs, tokenizer, end_id, **kw)
    return read_keys(docs, folder, shards, slots)
