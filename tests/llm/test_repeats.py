from collections import Counter

from pyspark.sql import functions as F

from tickstrata.llm import repeats


def test_rows_come_back_as_often_as_they_were(spark):
    rows = [(None, None)] * 5 + [(1, "a")] * 23 + [(1, "b")] + [(2, "a")] * 10 + [(k, "c") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for portion in (1, 5, 10, 4096):
        back = repeats.dealt(repeats.counted(df, "repeats"), portion).collect()
        assert Counter((r.doc_id, r.text) for r in back) == Counter(rows)
        assert len({(r.doc_id, r.text, r.k) for r in back}) == len(rows) and min(r.k for r in back) == 0
    assert repeats.dealt(repeats.counted(df.limit(0), "repeats")).count() == 0


def test_a_row_that_very_many_repeat_goes_to_many_tasks(spark):
    df = spark.range(40_000).select(F.lit(1).alias("doc_id"))
    at = repeats.dealt(repeats.counted(df, "repeats"), 1000).select(F.spark_partition_id().alias("at")).groupBy("at").count().collect()
    assert sum(r["count"] for r in at) == 40_000 and max(r["count"] for r in at) < 25_000
