"""What the operators share: Arrow batches, scratch tables and the fold rule."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a worker holds as Python objects at a time.
SLICE_BYTES = 4 << 20


#: Rows in an Arrow batch: whole batches are held on both sides of the pipe to a worker.
BATCH_ROWS = 1_000


def batched(df: DataFrame) -> DataFrame:
    """df, to be mapped in Arrow batches of BATCH_ROWS rows, if the session doesn't ask for fewer. Sets that for the session."""
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return df


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage, survives lost executors."""
    return Scratch(df.sparkSession).written(df, codec)


class Scratch:
    """Tables of the shared folder that are deleted together when no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        self.paths.append(f"{scratch_dir(self.spark)}/table-{uuid.uuid4().hex}")
        df.write.option("compression", codec).parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def dropped(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self.paths.clear()


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column has it (letter case aside)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def tag_of(text: str) -> Column:
    """A number for a text, which tells rows of one id apart: the first 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.col(text).cast("binary")), 1, 15), 16, 10).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold -1, so never in a held-out fold 0 or 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(-1)).cast("int")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each part has about `most` bytes of `column`, one row at least."""
    if not batch.num_rows:
        return
    sizes = batch.column(column).cast(pa.large_binary())
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_numpy(zero_copy_only=False))
    part = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def map_text(df: DataFrame, column: str, fields: list[T.StructField], fn: Callable[[list[bytes]], list], keep: list[str]) -> DataFrame:
    """Columns `keep` of df and, from fn over the texts of a slice, one new column for each of fields (Arrow or numpy arrays, or lists).

    The new fields replace kept columns of the same name.
    """
    new = {f.name for f in fields}
    keep = [c for c in keep if c not in new]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    types = [to_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                made = fn(texts(part, column))
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *arrays], names=[*keep, *(f.name for f in fields)])

    return batched(df).select(*dict.fromkeys(f"`{c}`" for c in [*keep, column])).mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def packed(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each closed by a newline, and where each begins (one more for the end)."""
    starts = np.zeros(len(texts_) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts_], out=starts[1:])
    return np.frombuffer(b"\n".join([*texts_, b""]), np.uint8), starts


def stars(pairs: DataFrame) -> DataFrame:
    """A round of `connected`: all hang on the smallest node that they see. Both ends of a pair come of one row, so that no branch of the plan stands there twice."""
    both = pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(low, "a")
    small = joined.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).where("a <> b")
    return small.distinct()


def connected(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that it can reach.

    Alternating large-star and small-star steps, each a group-by minimum and a join, until
    nothing changes. Hot nodes meet in partial minimums and in joins that Spark can split.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs, before = written(pairs), None
    for _ in range(rounds):
        pairs = written(stars(pairs))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
