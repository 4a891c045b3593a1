from pyspark.sql import functions as F

from defectflow.session import spread, write_and_reread


def test_spread_only_when_splits_are_few(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    small = spread(spark.read.parquet(path))
    assert small.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and small.count() == 100
    many = str(tmp_path / "m")
    spark.range(0, 3_000_000, 1, 32).write.parquet(many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64KB")
    try:
        scan = spark.read.parquet(many)
        assert spread(scan) is scan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_written_hand_off_cuts_lineage(spark):
    out = write_and_reread(spark.range(10).select(F.col("id").alias("x")), "t")
    assert out.count() == 10 and "Range" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_shuffle_files_of_a_hand_off_go_with_its_write(spark):
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    rows = spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = tracker.shuffleStatuses().size()
    out = write_and_reread(rows, "t")
    assert tracker.shuffleStatuses().size() <= before
    assert out.count() == 7 and rows.count() == 7  # what was planned by then can run again
