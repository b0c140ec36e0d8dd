"""The bound of the language stage comes from all held-out texts."""

from pyspark.sql import functions as F

from reelgraph.llm import langid


def test_bound_from_all_held_out_texts(spark, monkeypatch):
    word = lambda k: F.conv(F.substring(F.sha2((F.col("id") * 31 + k).cast("string"), 256), 1, 10), 16, 36)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words and"), *[word(k) for k in range(4)]).alias("text"), F.lit("en").alias("lang"))
    model = langid.train(docs)
    whole = langid.least_likeness(docs, model)
    assert whole > 0
    monkeypatch.setattr(langid, "SAMPLE", 2)
    assert langid.least_likeness(docs, model) == whole
