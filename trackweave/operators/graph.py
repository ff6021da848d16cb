"""Graphs as DataFrames: components, spanning forests, parities, batch routing, paths."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of our own only where that is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Whether what a statement has shuffled is deleted when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    """df as files; what was shuffled for them goes at once, and not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(FREED)
        else:
            conf.set(FREED, before)


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that rounds don't pile up plans and lost executors cost no rounds."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The tables of an iteration's rounds: of those before the last one the files are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def settled(self, df: DataFrame) -> DataFrame:
        """df as the next round's table; what was read of the last one is no longer needed afterwards."""
        out = self.added(df)
        if self.n > 1:
            self._drop(self.n - 1)
        return out

    def added(self, df: DataFrame) -> DataFrame:
        """df as the next round's table, beside all others."""
        self.n += 1
        self.schema = T.StructType([*df.schema.fields, T.StructField("round", T.IntegerType())])
        path = f"{self.folder}/round={self.n}"
        _write(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        """The rows of all tables, with column round."""
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def _drop(self, n: int) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/round={n}")
        path.getFileSystem(conf).delete(path, True)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its smallest member) of every node; edges a, b.

    Rounds in which every node hands its larger neighbours to the smallest one, then its smaller neighbours and itself,
    until all hang on their smallest member. A chain of n nodes takes about log n rounds, whatever the order of its names.
    """
    tables = Rounds(nodes.sparkSession)
    pairs = tables.settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            named = nodes.select("node").distinct().join(pairs.select(F.col("a").alias("node"), "b"), "node", "left")
            return settled(named.select("node", F.coalesce("b", "node").alias("component")))
        before = now
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        pairs = tables.settled(small.distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def spanning_forest(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """The edges (a, b, rank and the rest) of the forest that takes them in order of rank, each that joins two trees.

    Rounds in which every tree takes its first edge out. Trees that joined are one node of the next
    round, which has half as many nodes at most and no edges inside trees. Ranks tell all edges apart.
    """
    rest, chosen = Rounds(edges.sparkSession), Rounds(edges.sparkSession)
    live = rest.settled(edges.select("*", F.col("a").alias("_ca"), F.col("b").alias("_cb")).where("a <> b"))
    chosen.added(live.limit(0))
    for _ in range(rounds):
        if not live.limit(1).count():
            return chosen.all().drop("round").select(*edges.columns)
        out = live.select("_ca", "rank").unionByName(live.select(F.col("_cb").alias("_ca"), "rank")).groupBy("_ca").agg(F.min("rank").alias("rank")).select("rank").distinct()
        picked = chosen.added(live.join(out, "rank", "left_semi").select(*edges.columns, "_ca", "_cb"))
        trees = components(picked.select(F.col("_ca").alias("node")).unionByName(picked.select(F.col("_cb").alias("node"))), picked.select(F.col("_ca").alias("a"), F.col("_cb").alias("b")))
        name = lambda c: trees.select(F.col("node").alias(c), F.col("component").alias(f"_new{c}"))  # noqa: E731, B023
        live = rest.settled(live.join(name("_ca"), "_ca").join(name("_cb"), "_cb").where("_new_ca <> _new_cb").select(*edges.columns, F.col("_new_ca").alias("_ca"), F.col("_new_cb").alias("_cb")))
    raise RuntimeError(f"the forest did not settle in {rounds} rounds")


def parities(nodes: DataFrame, forest: DataFrame) -> DataFrame:
    """node, component (its smallest member) and parity (0 or 1: of the odd edges on the way from that member) of every node.

    forest: a, b, odd (0 or 1), without rings. Each node stands there twice, even and odd; an edge joins
    copies of one kind, an odd one those of two, so that components of the copies tell parities, in as
    many rounds as those take: a long chain needs its length's logarithm.
    """
    copies = nodes.select(F.explode(F.array(*(F.struct(F.col("node").alias("n"), F.lit(side).alias("side")) for side in (0, 1)))).alias("node"))
    sides = F.explode(F.array(*(F.struct(F.struct(F.col("a").alias("n"), F.lit(side).alias("side")).alias("a"), F.struct(F.col("b").alias("n"), F.when(F.col("odd") == 1, 1 - side).otherwise(side).alias("side")).alias("b")) for side in (0, 1))))
    found = components(copies, forest.select(sides.alias("e")).select("e.*"))
    return found.where("node.side = 0").select("node.n", F.col("component.n").alias("component"), F.col("component.side").alias("parity")).withColumnRenamed("n", "node")


def batch_routes(edges: DataFrame, trips: DataFrame, rounds: int | None = None) -> DataFrame:
    """All nodes that the cheapest paths of all trips reach: trip_id, node, cost, hops, previous and via.

    edges: src, dst, metres, ref (null: untagged), service and, where wanted in via, edge_id. trips:
    trip_id, source, target, refs (array), budget. An edge costs its metres, four times as much with
    another reference than the trip states (untagged: no more), and four times as much again on service
    track. A frontier of (trip, node, cost) relaxes by a join on the node; costs past the budget, the best
    arrival so far or what is known of the node are dropped. A round writes what it has improved, no more.
    Its joins are merged, since a table that is broadcast in each of many rounds passes through the driver as often;
    edges are dealt by their first node once for all rounds.
    It ends when no cost falls any more, which the budgets bring about; where `rounds` are given and don't suffice, it raises.
    """
    kinds = dict(edges.dtypes)
    if "edge_id" not in kinds:
        edges, kinds = edges.withColumn("edge_id", F.lit(None).cast("string")), kinds | {"edge_id": "string"}
    trips = settled(trips.where("source <> target"))
    tables = Rounds(edges.sparkSession)
    none = lambda c: F.lit(None).cast(kinds[c])
    edges = edges.select("src", "dst", "metres", "ref", "service", "edge_id").repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src").sortWithinPartitions("src").persist(StorageLevel.DISK_ONLY)
    frontier = tables.added(trips.select("trip_id", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), none("src").alias("previous"), none("edge_id").alias("via")))
    while True:
        known = tables.all()
        before = known.groupBy("trip_id", "node").agg(F.min("cost").alias("_cost"))
        best = before.join(trips.select("trip_id", F.col("target").alias("node")).hint("merge"), ["trip_id", "node"]).groupBy("trip_id").agg(F.min("_cost").alias("best"))
        steps = frontier.join(edges.hint("merge"), frontier.node == edges.src).join(trips.select("trip_id", "refs", "budget").hint("merge"), "trip_id").join(best.hint("merge"), "trip_id", "left")
        other = (F.size("refs") > 0) & F.col("ref").isNotNull() & ~F.array_contains("refs", F.col("ref"))
        weight = F.col("metres") * F.when(other, 4).otherwise(1) * F.when(F.col("service"), 4).otherwise(1)
        moved = steps.select("trip_id", F.col("dst").alias("node"), (F.col("cost") + weight).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("previous"), F.col("edge_id").alias("via"), "budget", "best")
        moved = moved.where("cost <= budget and (best is null or cost < best)").groupBy("trip_id", "node").agg(F.min(F.struct("cost", "hops", "previous", "via")).alias("s")).select("trip_id", "node", "s.*")
        frontier = tables.added(moved.join(before.hint("merge"), ["trip_id", "node"], "left").where("_cost is null or cost < _cost").drop("_cost"))
        if not frontier.limit(1).count():
            edges.unpersist()
            return tables.all().groupBy("trip_id", "node").agg(F.min(F.struct("cost", "round", "hops", "previous", "via")).alias("s")).select("trip_id", "node", "s.cost", "s.hops", "s.previous", "s.via")
        if tables.n - 1 == rounds:
            edges.unpersist()
            raise RuntimeError(f"routes did not settle in {rounds} rounds")


def arrivals(reached: DataFrame, trips: DataFrame) -> DataFrame:
    """trip_id, cost and hops of every trip; null where it finds no path within its budget."""
    found = reached.withColumnRenamed("node", "target")
    return trips.select("trip_id", "target").join(found, ["trip_id", "target"], "left").select("trip_id", "cost", "hops")


def path_nodes(reached: DataFrame, trips: DataFrame) -> DataFrame:
    """trip_id, node, hops, previous and via of the nodes on each found path.

    List ranking: each node points to the one before it; in every round the nodes found bring those they
    point to, and pointers are composed, so that a path of n nodes takes log n rounds.
    """
    tables, marks = Rounds(reached.sparkSession), Rounds(reached.sparkSession)
    ends = trips.select("trip_id", F.col("target").alias("node"))
    rows = settled(reached.join(ends.select("trip_id"), "trip_id", "left_semi"))
    found = marks.settled(ends.join(rows, ["trip_id", "node"], "left_semi"))
    jumps = tables.settled(rows.where("previous is not null").select("trip_id", "node", F.col("previous").alias("to")))
    while jumps.limit(1).count():
        found = marks.settled(found.unionByName(found.join(jumps, ["trip_id", "node"]).select("trip_id", F.col("to").alias("node"))).distinct())
        further = jumps.select("trip_id", F.col("node").alias("to"), F.col("to").alias("further"))
        jumps = tables.settled(jumps.join(further, ["trip_id", "to"]).select("trip_id", "node", F.col("further").alias("to")))
    return rows.join(found, ["trip_id", "node"], "left_semi").select("trip_id", "node", "hops", "previous", "via")


def route_budget(chord: Column, stated: Column) -> Column:
    """Metres that a path between two points may cost: 8 km or 3.5 times the straight line, four times that if references are stated."""
    return F.greatest(F.lit(8000.0), chord * 3.5) * F.when(stated, 4).otherwise(1)
