"""Merkle fixity audit of web archives.

A record's leaf is the SHA-256 of its bytes. Records whose offset lies in one range of a
file form a range hash, in order of offset; FANOUT neighbouring ranges form one of the next
level, up to a single root for each file. Replicas are compared at the roots, and only the
children of nodes that differ are read on the way down; the records of the ranges that
differ at the bottom are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackweave.llm.common import written

#: Bytes of a file in one bottom range, and ranges under one node.
RANGE, FANOUT = 64 << 10, 16


ROW = ("page_id", "file", "offset", "length", "leaf")


def leaves(records: DataFrame) -> DataFrame:
    """records (page_id, file, tie, shift, payload) with length and leaf hash in place of the payload. Null payloads are empty, of length null."""
    body = F.col("payload").cast("binary")
    leaf = F.sha2(F.concat(F.lit("leaf:").cast("binary"), F.coalesce(body, F.lit("").cast("binary"))), 256)
    return records.select("page_id", "file", "tie", "shift", F.octet_length(body).cast("long").alias("length"), leaf.alias("leaf"))


def index(leaves_: DataFrame) -> DataFrame:
    """Offset of each record (file, page_id, tie): running sums over the blocks of a file, then inside each block.

    Copies of a page are spread over blocks, so that many of them are not one task's work; the sum over
    a file has a row for each page and block, and a file is taken to hold a bounded number of pages.
    """
    rows = leaves_.groupBy("file", "page_id", "tie").agg(F.coalesce(F.max("length"), F.lit(0)).alias("length")).withColumn("block", F.shiftright("tie", 54))
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "page_id", "block").agg(F.sum("length").alias("size"))
    base = blocks.select("file", "page_id", "block", F.coalesce(F.sum("size").over(before("file").orderBy("page_id", "block")), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("length").over(before("file", "page_id", "block").orderBy("tie")), F.lit(0))
    return rows.withColumn("inner", inner).join(base, ["file", "page_id", "block"]).select("file", "page_id", "tie", (F.col("base") + F.col("inner")).alias("offset"))


def placed(leaves_: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rows to audit; copies of one row count once."""
    return leaves_.join(offsets, ["file", "page_id", "tie"]).select("page_id", "file", (F.col("offset") + F.col("shift")).alias("offset"), "length", "leaf").distinct()


def bottom(rows: DataFrame) -> DataFrame:
    """Hash of each bottom range over its records in order of offset."""
    entry = F.concat_ws(":", F.col("offset").cast("string"), F.coalesce(F.col("length").cast("string"), F.lit("-")), "leaf")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", entry.alias("entry")))), lambda x: x["entry"]), "\n")
    return rows.groupBy("file", "node").agg(F.sha2(ordered, 256).alias("hash"))


def above(level: DataFrame, fanout: int) -> DataFrame:
    """Hashes of the next level over the children in order."""
    child = F.struct("node", F.concat_ws(":", F.col("node").cast("string"), "hash").alias("entry"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["entry"]), "\n")
    return level.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("node")).agg(F.sha2(ordered, 256).alias("hash"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes whose hashes differ, or that one side lacks."""
    both = a.withColumnRenamed("hash", "hash_a").join(b.withColumnRenamed("hash", "hash_b"), ["file", "node"], "full")
    return both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("file", "node")


def audit(good: DataFrame, replica: DataFrame, span: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """page_id, file, offset, length, status and both leaves of every record that the replicas don't share.

    Inputs: page_id, file, offset, length, leaf. status: changed (both have a record at the
    offset, with other bytes), missing (the replica has none), extra (only the replica has one).
    Of several records at one offset those without an equal on the other side are paired in order of
    leaf, the rest are missing or extra. Rows without file or offset can't be placed and are left
    out. An empty table is a tree without nodes: all records of the other side are missing or extra.
    """
    node = F.floor(F.col("offset") / span).cast("long").alias("node")
    rows_a, rows_b = (written(x.where("file is not null and offset is not null").select(*ROW, node)) for x in (good, replica))
    top = max(x.agg(F.max("node")).first()[0] or 0 for x in (rows_a, rows_b))
    trees = [tuple(written(bottom(x)) for x in (rows_a, rows_b))]
    while top:
        top //= fanout
        trees.append(tuple(written(above(x, fanout)) for x in trees[-1]))
    suspects = written(differing(*trees[-1]))  # of the roots
    for a, b in reversed(trees[:-1]):
        parent = F.floor(F.col("node") / fanout).cast("long")
        a, b = (x.withColumn("parent", parent).join(suspects.withColumnRenamed("node", "parent"), ["file", "parent"], "left_semi").drop("parent") for x in (a, b))
        suspects = written(differing(a, b))
    rows_a, rows_b = (x.join(suspects, ["file", "node"], "left_semi").drop("node") for x in (rows_a, rows_b))
    sides = rows_a.withColumn("a", F.lit(1)).unionByName(rows_b.withColumn("b", F.lit(1)), allowMissingColumns=True)
    apart = sides.groupBy(*ROW).agg(F.count("a").alias("a"), F.count("b").alias("b")).where("a <> b")
    at = W.partitionBy("file", "offset", F.col("a") > F.col("b")).orderBy("leaf", "page_id", "length")
    numbered = apart.withColumn("n", F.row_number().over(at))
    left = numbered.where("a > b").select("file", "offset", "n", F.col("page_id").alias("page_a"), F.col("length").alias("length_a"), F.col("leaf").alias("leaf_a"))
    right = numbered.where("b > a").select("file", "offset", "n", F.col("page_id").alias("page_b"), F.col("length").alias("length_b"), F.col("leaf").alias("leaf_b"))
    status = F.when(F.col("leaf_b").isNull(), "missing").when(F.col("leaf_a").isNull(), "extra").otherwise("changed")
    return left.join(right, ["file", "offset", "n"], "full").select(F.coalesce("page_a", "page_b").alias("page_id"), "file", "offset", F.coalesce("length_a", "length_b").alias("length"), status.alias("status"), "leaf_a", "leaf_b")


def warc_records(pages: DataFrame, per_file: int = 256) -> DataFrame:
    """Response records of pages, dealt to archive files by id. Null urls and bodies are empty; rows without an id belong to no file and are left out."""
    url, html = (F.coalesce(F.col(c), F.lit("")) for c in ("url", "html"))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    rows = pages.where("page_id is not null").select("page_id", F.concat(head, html, F.lit("\r\n\r\n")).alias("payload"))
    file = F.concat(F.lit("pages-"), F.floor(F.col("page_id") / per_file).cast("string"), F.lit(".warc"))
    return rows.select("page_id", file.alias("file"), F.xxhash64("payload").alias("tie"), F.lit(0).alias("shift"), "payload")


def damaged(records: DataFrame) -> DataFrame:
    """A replica in which, by the remainder of the id by 97, records are altered (5), lost (31), cut to half (60) or followed by a stray one (77)."""
    rest = F.pmod("page_id", F.lit(97))
    altered = F.concat(F.expr("left(payload, char_length(payload) - 2)"), F.lit("?!"))
    half = F.expr("left(payload, char_length(payload) div 2)")
    stayed = records.where(rest != 31).withColumn("payload", F.when(rest == 5, altered).when(rest == 60, half).otherwise(F.col("payload")))
    stray = records.where(rest == 77).select("page_id", "file", "tie", F.lit(1).alias("shift"), F.concat(F.lit("stray "), F.col("page_id").cast("string")).alias("payload"))
    return stayed.unionByName(stray)


def audit_pages(pages: DataFrame) -> DataFrame:
    """The audit of a damaged replica against the pages' archive; a replica keeps its records at the offsets of the archive's index."""
    archive = warc_records(pages)
    good = written(leaves(archive))
    offsets = written(index(good))
    return audit(placed(good, offsets), placed(leaves(damaged(archive)), offsets))
