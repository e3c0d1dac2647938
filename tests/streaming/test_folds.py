import datetime

from pyspark.sql import functions as F

from tessera.streaming import folds

T0 = datetime.datetime(2024, 1, 1)
BIG = (1 << 60) + 1


def events(spark, rows, key="long"):
    made = [(k, T0 + datetime.timedelta(seconds=s), i) for i, (k, s) in enumerate(rows)]
    return spark.createDataFrame(made, f"k {key}, ts timestamp, id long")


def test_null_and_long_keys_carry_their_state(spark):
    rows = [(None, 1), (None, 2), (None, 3), (BIG, 1), (BIG + 1, 2), (BIG, 3), (BIG, 4), (7, 0)]
    got = {r.id: (r.k, r.accepted) for r in folds.anchored_limit(events(spark, rows), "k", "ts", "id", 60, 2).collect()}
    assert got == {0: (None, True), 1: (None, True), 2: (None, False), 3: (BIG, True), 4: (BIG + 1, True), 5: (BIG, True), 6: (BIG, False), 7: (7, True)}


def test_window_begins_with_the_first_event_after_its_end(spark):
    got = folds.anchored_limit(events(spark, [(1, 0), (1, 30), (1, 59), (1, 60), (1, 119), (1, 120)]), "k", "ts", "id", 60, 2).orderBy("id").collect()
    assert [r.accepted for r in got] == [True, True, False, True, True, True]


def test_failures_block(spark):
    df = events(spark, [(1, 0), (1, 10), (1, 20), (1, 500), (1, 1000), (None, 0)]).withColumn("failed", F.lit(True))
    got = folds.failure_block(df, "k", "ts", "id", "failed", 2, 900, 900).orderBy("id").collect()
    assert [r.blocked for r in got] == [False, False, True, True, False, False]


def test_sliding_limit_counts_accepted_events_only(spark):
    got = folds.sliding_limit(events(spark, [(1, s) for s in (0, 1, 2, 59, 60, 61, 62, 300)]), "k", "ts", "id", 60, 2, 5).orderBy("id").collect()
    assert [r.accepted for r in got] == [True, True, False, False, True, True, False, True]
    got = folds.sliding_limit(events(spark, [(1, s) for s in range(0, 700, 100)]), "k", "ts", "id", 60, 2, 5).orderBy("id").collect()
    assert [r.accepted for r in got] == [True] * 5 + [False] * 2


def test_throttle(spark):
    got = folds.throttled(events(spark, [(1, s) for s in (0, 0, 1, 1, 3)]), "k", "ts", "id").collect()
    assert sorted(r.id for r in got) == [0, 2, 4]


def test_micro_batches(spark):
    deltas = [(0, "Hello", 0), (1, "!", 10), (2, " more", 100), (3, "x" * 30, 101), (4, "好的，完成。", 110), (5, "tail ##side", 120), (6, "car text", 130), (None, None, None)]
    rows = spark.createDataFrame([(1, *d) for d in deltas], "k long, o long, t string, ms long")
    got = [r.chunk for r in folds.micro_batches(rows, "k", "o", "t", "ms", chunk=20, stop="##").orderBy("seq").collect()]
    assert got == ["Hello!", (" more" + "x" * 30)[:20], (" more" + "x" * 30)[20:], "好的，完成。", "tail "]


def test_a_key_is_folded_whole_though_its_rows_come_from_two_dealt_parts(spark):
    """Large words and small ends, both dealt by the key: merged partitions of one are not those of the other."""
    words = spark.range(40_000).select((F.col("id") % 50).alias("k"), (F.col("id") / 50).cast("long").alias("o"), F.sha2(F.col("id").cast("string"), 512).alias("t"), F.lit(0).cast("long").alias("ms"))
    words = words.groupBy("k", "o").agg(F.first("t").alias("t"), F.first("ms").alias("ms")).repartition("k")
    ends = words.select("k").distinct().select("k", *[F.lit(None).cast(c).alias(n) for n, c in (("o", "long"), ("t", "string"), ("ms", "long"))])
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    try:
        for c, v in zip(before, ("16", "600k", "false"), strict=True):
            spark.conf.set(c, v)
        got = folds.micro_batches(words.unionByName(ends), "k", "o", "t", "ms", least=1 << 20, chunk=1 << 20).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)
    assert sorted(r.k for r in got) == list(range(50)) and {len(r.chunk) for r in got} == {800 * 128}


def test_evidence_rounds_end_for_good(spark):
    rows = [(1, 1, "a", "d1", True), (1, 2, "a", "d2", True), (1, 3, "b", "d1", True), (1, 4, "c", "d3", True), (1, 5, None, None, False), (1, 6, None, None, False), (1, 7, None, None, False), (1, 8, "e", "d9", True)]
    df = spark.createDataFrame(rows, "k long, seq long, rec string, dig string, ok boolean")
    got = folds.evidence_rounds(df, "k", ["seq"], "rec", "dig", "ok", 3).orderBy("seq").collect()
    assert [r.stale for r in got] == [0, 1, 2, 0, 1, 2, 3, 3]
    assert [r.status for r in got] == ["ACTIVE"] * 6 + ["ESCALATED"] * 2


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "state")
    schema = "k long, v string, seq long"
    spark.createDataFrame([(1, "queued", 1), (2, "queued", 1)], schema).write.parquet(log)
    stream = folds.latest_state_stream(folds.file_stream(spark, log, spark.read.parquet(log).schema), "k", "v", "seq")
    assert {(r.k, r.v, r.n) for r in folds.run_to_end(stream, folder, ["k"]).collect()} == {(1, "queued", 1), (2, "queued", 1)}
    spark.createDataFrame([(1, "running", 2)], schema).write.mode("append").parquet(log)
    assert {(r.k, r.v, r.n) for r in folds.run_to_end(stream, folder, ["k"]).collect()} == {(1, "running", 2), (2, "queued", 1)}
