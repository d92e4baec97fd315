import time

from evidentia.llm.store import written


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (found.apply(i).getName() for i in range(found.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, there = spark.conf.get(name), shuffle_files(spark)
    counts = spark.range(20_000).selectExpr("id % 1000 as k").groupBy("k").count()
    out = written(counts.join(counts.withColumnRenamed("count", "n"), "k"), "counts")
    until = time.time() + 20
    while shuffle_files(spark) - there and time.time() < until:  # they are removed in the background
        time.sleep(0.2)
    assert not shuffle_files(spark) - there and spark.conf.get(name) == was
    assert out.count() == 1000 and counts.count() == 1000  # what was computed may be asked for again
