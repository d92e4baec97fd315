"""The pipeline's Python functions get whole texts in short batches."""

import corpus_pipeline
import pandas as pd
import pytest
from pyspark.sql import functions as F

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("stage", ["language_id", "simhash_near_dedup", "best_fit_packing"])
def test_batches_of_a_stage_are_short(spark, stage):
    before = spark.conf.get(NAME)

    @F.pandas_udf("long")
    def held(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    try:
        spark.conf.set(NAME, "10000")
        d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
        assert dict(corpus_pipeline.STAGES)[stage](spark, d, "").count() == 0
        assert spark.range(0, 5_000, 1, 1).select(held("id").alias("n")).agg(F.max("n")).first()[0] == 1_000
        spark.conf.set(NAME, "10")
        dict(corpus_pipeline.STAGES)[stage](spark, d, "")
        assert spark.conf.get(NAME) == "10"
    finally:
        spark.conf.set(NAME, before)
