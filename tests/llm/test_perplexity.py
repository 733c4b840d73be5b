import re

from pyspark.sql import functions as F

from lexiforge.llm import ngrams, perplexity


def rows(df):
    return sorted(map(repr, df.select("doc_id", "__grams", "__loss", "__limit", "__kept").collect()))


def test_ids_by_broadcast_and_by_join_judge_alike(spark, documents, odd):
    few = documents.select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang"))
    labels = few.select("doc_id", F.when(F.pmod("doc_id", F.lit(7)) < 4, 1).otherwise(0).alias("quality"))
    near, far = perplexity.judged(few, labels), perplexity.judged(few, labels, broadcast_ids=0)
    named = perplexity.judged(few.withColumn("doc_id", F.col("doc_id").cast("string")), labels.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert rows(near) == rows(far) == rows(named.withColumn("doc_id", F.col("doc_id").cast("bigint"))) and len(rows(near)) == few.count()


def test_texts_are_not_exchanged_to_meet_labels(spark, documents, monkeypatch):
    plans, counted = [], ngrams.counted
    monkeypatch.setattr(ngrams, "counted", lambda df, *a, **k: plans.append(df) or counted(df, *a, **k))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        perplexity.judged(documents, documents.select("doc_id", F.lit(1).alias("quality"))).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans and not re.search("Exchange|Join", plans[0]._jdf.queryExecution().executedPlan().toString())
