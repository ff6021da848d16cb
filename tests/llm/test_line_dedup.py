"""Line dedup: what is shuffled."""

from trackweave.llm import line_dedup


def test_variants_that_no_other_line_has_are_not_shuffled(spark):
    lines = spark.createDataFrame([(1, b"a b c d e"), (2, b"a b c d f"), (3, b"v w x y z")], "id long, line binary")
    every = line_dedup.variant_keys(lines)
    shared = every.groupBy("v1").count().where("count > 1").select("v1")
    kept = line_dedup.variant_keys(lines, shared)
    assert every.count() == 18 and sorted(map(tuple, kept.collect())) == sorted(map(tuple, every.join(shared, "v1").select(*every.columns).collect())) and kept.count() == 2
