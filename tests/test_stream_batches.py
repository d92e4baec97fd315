"""Streams whose keys come again in later micro-batches."""

from collections import Counter

from evidentia.operators import corpus
from evidentia.plans.structures import lines
from evidentia.streaming import stream

COLUMNS = ["doc_id", "document_order", "stable_key", "text"]
SCHEMA = "doc_id long, pos int, text string"


def rows(df):
    return Counter(map(tuple, df.select(COLUMNS).collect()))


def run(spark, path, **options):
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/lines")
    q = stream.stream_materialize(src, f"{path}/table", f"{path}/checkpoint", **options)
    q.awaitTermination()
    return [p for p in q.recentProgress if p["numInputRows"]]


def test_materialize_over_batches_that_split_documents(spark, sf, tmp_path):
    blocks = lines(spark, sf).selectExpr("doc_id", "cast(pos as int) pos", "text").cache()
    for i in range(3):
        blocks.filter(blocks["pos"] % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/lines")
    assert len(run(spark, tmp_path)) == 3
    want = rows(corpus.reproject(blocks))
    assert rows(stream.materialized(spark, f"{tmp_path}/table")) == want and want
    assert len(list((tmp_path / "table").iterdir())) == 3  # a folder for a batch, none for a document
    stream.compact(spark, f"{tmp_path}/table", f"{tmp_path}/small", buckets=4)
    assert rows(stream.materialized(spark, f"{tmp_path}/small")) == want


def test_later_batches_touch_their_documents_only(spark, tmp_path):
    def add(*new):
        spark.createDataFrame(list(new), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/lines")
        return run(spark, tmp_path)

    add((1, 0, "Art. 1º One."), (2, 0, "Art. 1º Two."), (2, 1, "I - first"), (3, 0, "Art. 9º Three."))
    progress = add((2, 1, "I - changed"), (2, 1, "I - changed"), (3, 0, None))
    assert progress[-1]["stateOperators"][0]["numRowsUpdated"] == 2
    assert spark.read.parquet(f"{tmp_path}/table/batch=1").select("doc_id").distinct().collect() == [(2,)]
    add((4, 0, "Art. 4º Four."))
    now = {1: ["Art. 1º One."], 2: ["Art. 1º Two.", "I - changed"], 4: ["Art. 4º Four."]}  # of document 3 nothing is left
    want = rows(corpus.reproject(spark.createDataFrame([(d, i, t) for d, ts in now.items() for i, t in enumerate(ts)], SCHEMA)))
    assert rows(stream.materialized(spark, f"{tmp_path}/table")) == want


def test_store_keeps_one_of_each_over_batches(spark, tmp_path):
    kind = "source_id string, sha256 string, n int"
    for i in range(3):
        new = [("a", "x", i), ("a", "x", i), ("b", "x", i), ("c", str(i), i), (None, "x", i)]
        spark.createDataFrame(new, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream.stream_store(src, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("source_id", "sha256", "n").collect()), key=str)
    assert got == sorted([("a", "x", 0), ("b", "x", 0), (None, "x", 0)] + [("c", str(i), i) for i in range(3)], key=str)
