"""Operator 3, token counts: a scan of flat unindexed token files for the identifier that ends a document.

A file is nothing but little-endian ids of 2 or 4 bytes; a document ends with its end-of-document id. Spark's own text
reader cuts files into blocks at a byte that the identifier has not, wherever it stands in an id, so a file of any size and in any store
is read in parallel. A block does not know its place, nor whether its first byte begins an id. So each block searches,
vectorised, for the identifier at every alignment and keeps what it found by alignment. A prefix sum over the blocks'
lengths then gives each block its offset and its true alignment, and the last separator before it, which stitches the
document that crosses its boundary. Only these few numbers a block are ordered; the counts stay with their blocks.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrade.llm.common import append_columns, as_bytes, space_words
from loomgrade.session import fresh_path, materialise, ship, table

EOD = 50_256
WIDTH = 2
FILE_BYTES = 128 << 20


def scan_blocks(spark: SparkSession, path: str, eod: int = EOD, width: int = WIDTH) -> DataFrame:
    """One row for each block: file, start, size, and for each alignment the separators' places within the block."""
    mark = eod.to_bytes(width, "little")
    feed = bytes([next(b for b in (10, *range(256)) if b not in mark)])  # blocks end with a byte that no separator has
    lines = spark.read.option("lineSep", feed.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    raw = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("whole"), F.col("value").cast("binary").alias("line"))

    def find(batches):
        block, carry, size, found, whole = None, b"", 0, [], 0

        def row():
            own = np.concatenate(found) if found else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([block[0]]), pa.array([block[1]], pa.int64()), pa.array([whole], pa.int64()), pa.array([size], pa.int64()), pa.array([[own[own % width == p].tolist() for p in range(width)]], pa.list_(pa.list_(pa.int64())))],
                names=["file", "start", "whole", "size", "marks"],
            )

        for batch in batches:
            files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
            wholes, texts = batch.column("whole").to_pylist(), as_bytes(batch.column("line"))
            a = 0
            while a < len(texts):
                b = a
                while b < len(texts) and starts[b] == starts[a] and files[b] == files[a]:
                    b += 1
                if block != (files[a], starts[a]):
                    if block:
                        yield row()
                    block, carry, size, found, whole = (files[a], starts[a]), b"", 0, [], wholes[a]
                data = carry + feed.join(texts[a:b]) + feed
                base = size - len(carry)
                bytes_ = np.frombuffer(data, np.uint8)
                hit = np.ones(max(0, len(bytes_) - width + 1), bool)
                for j, x in enumerate(mark):
                    hit &= bytes_[j : len(bytes_) - width + 1 + j] == x
                found.append(np.flatnonzero(hit) + base)
                size = base + len(data)
                carry = data[len(data) - width + 1 :] if width > 1 else b""
                a = b
        if block:
            yield row()

    return raw.mapInArrow(find, "file string, start bigint, whole bigint, size bigint, marks array<array<bigint>>")


def count_tokens(spark: SparkSession, path: str, eod: int = EOD, width: int = WIDTH) -> DataFrame:
    """One row for each document: file, ordinal (from 0 in its file), n_tokens without its end, closed.

    path: a file, a folder or a pattern; folders named key=value add no columns. A last document without its end has
    closed false. An empty file has no documents; an end alone is a document of no tokens. A file whose size is not a
    whole number of ids ends with a broken one, which is not counted. No separator can cross from one block to the
    next, as a block ends with a byte that the separator has not, or with the file.
    """
    ship(spark)
    blocks = materialise(scan_blocks(spark, path, eod, width), "blocks")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # places, not the arrays, are what the prefix scan orders
    ends = F.transform("marks", lambda m: F.struct(F.size(m).cast("bigint").alias("n"), F.get(m, F.size(m) - 1).alias("last")))
    few = blocks.select("file", "start", "whole", "size", ends.alias("ends"))
    few = few.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    own = F.get("ends", F.pmod(-F.col("offset"), F.lit(width)).cast("int"))
    few = few.withColumn("own", own).withColumn("n", F.col("own.n")).withColumn("end", F.col("offset") + F.col("own.last") + width)
    few = few.withColumn("first_ordinal", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("previous", F.coalesce(F.max("end").over(before), F.lit(0))).withColumn("more", F.lead("start").over(Window.partitionBy("file").orderBy("start")).isNotNull())
    few = few.select("file", "start", "offset", "whole", "first_ordinal", "previous", "more", "end", "n")
    placed = blocks.select("file", "start", "marks").join(few, ["file", "start"])
    places = F.transform(F.get("marks", F.pmod(-F.col("offset"), F.lit(width)).cast("int")), lambda p: p + F.col("offset"))
    rows = placed.select("file", "first_ordinal", "previous", "offset", places.alias("at"))
    sizes = F.transform("at", lambda p, i: F.struct((F.col("first_ordinal") + i).alias("ordinal"), F.floor((p - F.when(i == 0, F.col("previous")).otherwise(F.get("at", i - 1) + width)) / width).cast("bigint").alias("n_tokens")))
    closed = rows.select("file", F.explode(sizes).alias("d")).select("file", "d.ordinal", "d.n_tokens", F.lit(True).alias("closed"))
    tail = few.where(~F.col("more")).select("file", (F.col("first_ordinal") + F.col("n")).alias("ordinal"), F.floor((F.col("whole") - F.greatest(F.coalesce("end", F.lit(0)), "previous")) / width).cast("bigint").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail.where("n_tokens > 0"))


def write_flat(docs: DataFrame, path: str, files: int) -> None:
    """Token files of documents for the query below: hashed word ids, file=<k> by the document's hash, in order of doc_id.

    The text writer ends every record with the bytes of the end-of-document id, so what it writes is a flat token file.
    Null and empty texts are an end alone. Rows of equal doc_id go by their texts' hashes, equal rows in any order, as
    they have equal tokens. An empty table gives no file.
    """

    def make():
        def work(batch):
            known: dict[bytes, int] = {}
            out = []
            for text in as_bytes(batch.column("text")):
                words = space_words(text)
                for w in words:
                    if w not in known:
                        known[w] = crc32(w) % EOD
                out.append(np.fromiter(map(known.__getitem__, words), "<u2", len(words)).tobytes())
                if len(known) > 500_000:
                    known.clear()
            return [out]

        return work

    placed = docs.select(*_place(files), "text")
    flat = append_columns(placed, make, "ids binary", drop=("text",))
    ordered = flat.repartition(files, "file").sortWithinPartitions("file", "doc_id", "tie")
    ordered.select("file", F.col("ids").cast("string").alias("value")).write.partitionBy("file").option("lineSep", EOD.to_bytes(2, "little").decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def _place(files: int) -> list:
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    return [F.pmod(F.xxhash64("doc_id", tie), F.lit(files)).cast("int").alias("file"), F.col("doc_id"), tie.alias("tie")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted from flat files that hold neither ids nor offsets of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # as many files as keep each below about the bytes of text that FILE_BYTES says, by the scan's own estimate
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    path = fresh_path(spark, "tokens")
    write_flat(docs, path, files)
    counted = count_tokens(spark, path).where("closed").select(F.regexp_extract("file", r"/file=(\d+)/", 1).cast("int").alias("file"), "ordinal", "n_tokens")
    # the writer's order is the only link to the documents
    order = Window.partitionBy("file").orderBy("doc_id", "tie")
    places = docs.select(*_place(files)).withColumn("ordinal", (F.row_number().over(order) - 1).cast("bigint"))
    return places.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")


SQL = r"""
SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
"""
