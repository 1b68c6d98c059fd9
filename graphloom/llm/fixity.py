"""Merkle fixity audit of WARC replicas.

Pages are written as WARC files of records that are compressed one by one; a task begins a new file after RECORDS
records or BYTES bytes. The manifest holds every record's file, number, offset range and SHA-256 of its bytes as stored,
and after a file's records one row for its end. A leaf of the tree is the digest of offset, length and bytes: for a
replica, of what lies there in the manifest's range, and at the end of whatever follows, so appended bytes make a leaf
differ as changed, moved or missing ones do. Over the ordered leaves of each file stands a tree of digests with FANOUT
children to a node, and over the files' roots one more, up to a single root; every level is written once. An audit
compares roots and goes down only where they differ: each step joins the children of the differing nodes of both trees,
down to the records. Files of a replica that no manifest names are found by listing it.
"""

from __future__ import annotations

import uuid
import zlib
from hashlib import sha256

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, scratch, written
from .encoding import slices

FANOUT = 64
RECORDS, BYTES = 4096, 1 << 27
MANIFEST = "page_id long, file string, seq long, offset long, length long, sha256 string, end boolean"
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
_NAMES = ["page_id", "file", "seq", "offset", "length", "sha256", "end"]


def warc_record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A compressed resource record; its id is made from its content, so writing again gives the same bytes."""
    block = (html or "").encode()
    digest = sha256(block).hexdigest()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}")
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {url or f'urn:page:{page_id}'}\r\nWARC-Block-Digest: sha256:{digest}\r\nContent-Type: text/html\r\nContent-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _writer(folder: str):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        task, number, file, out, seq, at = TaskContext.get().partitionId(), 0, "", None, 0, 0

        def end():
            out.close()
            return None, file, seq, at, 0, sha256(b"").hexdigest(), True

        for b in slices(batches):
            rows = []
            for page, url, html in zip(*(c.to_pylist() for c in b.columns)):
                r = warc_record(page, url, html)
                if out is not None and (seq >= RECORDS or at + len(r) > BYTES):
                    rows.append(end())
                    out = None
                if out is None:
                    file, number, seq, at = f"part-{task:06d}-{number:05d}-{uuid.uuid4().hex}.warc.gz", number + 1, 0, 0
                    out = fs.open_output_stream(f"{root}/{file}", compression=None)
                rows.append((page, file, seq, at, len(r), sha256(r).hexdigest(), False))
                out.write(r)
                seq, at = seq + 1, at + len(r)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(end(), _KINDS)], _NAMES)

    return run


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) under folder; returns the manifest. A null url gets a name, a null html is empty."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    return written(pages.select("page_id", "url", "html").mapInArrow(_writer(folder), MANIFEST), "manifest")


def label(file: Column) -> Column:
    """What of a file's name is the same on every run: its task and number."""
    return F.substring(file, 1, 17)


def _copier(source: str, to: str, every: int):
    def run(records: pd.DataFrame) -> pd.DataFrame:
        fs, root = pafs.FileSystem.from_uri(source)
        fs2, root2 = pafs.FileSystem.from_uri(to)
        file = records["file"].iloc[0]
        copy = f"{file}.{uuid.uuid4().hex}"
        with fs.open_input_file(f"{root}/{file}") as f, fs2.open_output_stream(f"{root2}/{copy}", compression=None) as g:
            for at, n in records.sort_values("seq")[["offset", "length"]].itertuples(index=False):
                data = bytearray(f.read_at(int(n), int(at)))
                if every and zlib.crc32(f"{file[:17]}|{at}".encode()) % every == 0 and n:
                    data[len(data) // 2] ^= 1
                g.write(bytes(data))
        return pd.DataFrame({"file": [file], "copy": [copy]})

    return run


def replicate(manifest: DataFrame, source: str, to: str, fault_every: int = 0) -> DataFrame:
    """Copy the files of a manifest; returns (file, copy). With fault_every, one bit is wrong in about one record of so many: a drill.

    A group is one file, of at most RECORDS records.
    """
    fs, root = pafs.FileSystem.from_uri(to)
    fs.create_dir(root)
    return written(manifest.groupBy("file").applyInPandas(_copier(source, to, fault_every), "file string, copy string"), "copies")


def _hasher(folder: str):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        name, f, size = "", None, 0
        for b in slices(batches):
            found, digest = [], []
            for at, n, end, copy in zip(*(c.to_pylist() for c in b.columns[2:])):
                if copy != name:
                    if f is not None:
                        f.close()
                    there = copy is not None and fs.get_file_info(f"{root}/{copy}").type == pafs.FileType.File
                    name, f = copy, fs.open_input_file(f"{root}/{copy}") if there else None
                    size = f.size() if there else 0
                n, h = max(0, size - at) if end else min(n, max(0, size - at)), sha256()
                for k in range(at, at + n, 1 << 24):
                    h.update(f.read_at(min(1 << 24, at + n - k), k))
                found.append(None if f is None else n)
                digest.append("missing" if f is None else h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.int64()), pa.array(digest)], ["file", "seq", "offset", "length", "sha256"])
        if f is not None:
            f.close()

    return run


def hash_replica(manifest: DataFrame, copies: DataFrame, folder: str) -> DataFrame:
    """file, seq, offset, length, sha256 of what lies in each offset range of the manifest.

    length is null where the file is gone and less than asked where it is short; an end has all that follows.
    """
    asked = manifest.join(copies.select("file", "copy"), "file", "left").select("file", "seq", "offset", "length", "end", "copy")
    return written(asked.mapInArrow(_hasher(folder), "file string, seq long, offset long, length long, sha256 string"), "hashes")


def unlisted(copies: DataFrame, folder: str) -> DataFrame:
    """file, length of the files in a replica's folder that are no copy of a file in the manifest. Names with a leading _ or . aren't looked at."""
    there = copies.sparkSession.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    return there.join(copies.select(F.col("copy").alias("file")), "file", "left_anti")


def leaf() -> Column:
    return F.sha2(F.concat_ws("|", F.col("offset").cast("string"), F.coalesce(F.col("length").cast("string"), F.lit("gone")), "sha256"), 256)


def _joined(order: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("i"), F.col("sha256").alias("h")))), lambda x: x["h"]), ""), 256)


class Tree:
    """Levels of (file, node, sha256): 0 the leaves, then FANOUT to one, with an empty name for file from the files' roots on. Each is written."""

    def __init__(self, records: DataFrame, files: DataFrame, heights: tuple[int, int], work: Tables, name: str):
        """files: file, number; heights: levels above leaves within a file, and above files."""
        self.levels, self.within = [], heights[0]
        level = records.select("file", F.col("seq").alias("node"), leaf().alias("sha256"))
        for k in range(heights[0] + 2 + heights[1]):
            if k == heights[0] + 1:
                level = level.join(files, "file").select(F.lit("").alias("file"), F.col("number").alias("node"), "sha256")
            elif k:
                level = level.groupBy("file", F.floor(F.col("node") / FANOUT).alias("node")).agg(_joined(F.col("node")).alias("sha256"))  # at most FANOUT rows in a group
            level = work.write(level, f"{name}-{k}")
            self.levels.append(level)


def _height(n: int) -> int:
    levels = 1
    while n > FANOUT**levels:
        levels += 1
    return levels


def differing(manifest: DataFrame, hashes: DataFrame) -> DataFrame:
    """file, seq of the leaves that differ, found from the roots down; nothing below equal nodes is compared."""
    work = Tables(manifest.sparkSession, "fixity")
    files = manifest.groupBy("file").agg(F.max("seq").alias("last"))
    n_files, last = files.agg(F.count("*"), F.coalesce(F.max("last"), F.lit(0))).first()
    files = work.write(files.select("file", F.expr("CAST(row_number() OVER (ORDER BY file) - 1 AS BIGINT)").alias("number")), "files")  # a row for each file
    heights = (_height(last + 1), _height(max(1, n_files)))
    a, b = Tree(manifest, files, heights, work, "first"), Tree(hashes, files, heights, work, "second")
    diff = None
    for level in range(len(a.levels) - 1, -1, -1):
        x, y = a.levels[level], b.levels[level].withColumnRenamed("sha256", "other")
        if diff is not None:
            up = diff.select(F.col("file").alias("f"), F.col("node").alias("up"))
            if level == a.within:  # from the files' roots to the files
                up = up.join(files, F.col("up") == F.col("number")).select(F.col("file").alias("f"), F.lit(0).cast("long").alias("up"))
                inside = (F.col("file") == F.col("f")) & (F.col("node") == F.col("up"))
            else:
                inside = (F.col("file") == F.col("f")) & (F.floor(F.col("node") / FANOUT) == F.col("up"))
            x = x.join(up, inside, "left_semi")
        diff = work.write(x.join(y, ["file", "node"], "left").filter(~F.col("sha256").eqNullSafe(F.col("other"))).select("file", "node"), f"diff-{level}")
        if diff.isEmpty():
            break
    found = written(diff.filter(F.col("file") != "").select("file", F.col("node").alias("seq")), "differing")
    work.close()
    return found


def audit_replica(manifest: DataFrame, copies: DataFrame, folder: str) -> DataFrame:
    """page_id, file, seq, offset, length, sha256, fault: every record of the manifest, and every fault that is no record's.

    fault is null for an intact record; else `missing file`, `short`, `changed`, or, without a page_id, `trailing bytes`
    after a file's last record and `unlisted file` with that file's name and length.
    """
    hashes = hash_replica(manifest, copies, folder)
    found = differing(manifest, hashes).join(hashes.select("file", "seq", F.col("length").alias("found"), F.lit(True).alias("bad")), ["file", "seq"])
    out = manifest.join(found, ["file", "seq"], "left")
    fault = F.when(F.col("bad").isNull(), F.lit(None).cast("string")).when(F.col("found").isNull(), "missing file").when(F.col("end"), "trailing bytes").when(F.col("found") < F.col("length"), "short").otherwise("changed")
    out = out.withColumn("fault", fault).filter("NOT end OR fault = 'trailing bytes'")
    length = F.when(F.col("end"), F.col("found")).otherwise(F.col("length"))
    out = out.select("page_id", "file", "seq", "offset", length.alias("length"), "sha256", "fault")
    none = lambda kind: F.lit(None).cast(kind)
    extra = unlisted(copies, folder).select(none("long").alias("page_id"), "file", none("long").alias("seq"), none("long").alias("offset"), "length", none("string").alias("sha256"), F.lit("unlisted file").alias("fault"))
    return out.unionByName(extra)


def audit(pages: DataFrame, fault_every: int = 0, folder: str | None = None) -> DataFrame:
    """page_id, file, seq, offset, length, sha256, intact, fault of every page, for a first copy and a replica of it.

    Repeated pages and null ids are records of their own; a null or empty page is a record with an empty block; other
    columns are not written. No rows give no files and no rows.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    manifest = write_warc(pages, f"{folder}/first")
    copies = replicate(manifest, f"{folder}/first", f"{folder}/second", fault_every)
    out = audit_replica(manifest, copies, f"{folder}/second")
    return out.select("page_id", label(F.col("file")).alias("file"), "seq", "offset", "length", "sha256", F.col("fault").isNull().alias("intact"), "fault")
