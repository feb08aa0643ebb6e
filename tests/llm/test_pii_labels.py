"""The trees of op5 learn from every label, each kind, pattern and label weighing alike."""

from pyspark.sql import functions as F

from rankflow.llm import pii


def test_every_label_teaches(spark, monkeypatch):
    kept, plain = {}, pii.written
    monkeypatch.setattr(pii, "written", lambda df, name: kept.setdefault(name, plain(df, name)))
    docs = spark.range(2600).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, F.format_string("mail me: user%d@example.com", "id")).otherwise(F.format_string("order 1234.%04d.9999.1111", "id")).alias("text"))
    pii.find_personal_data(docs).count()
    part = kept[next(k for k in kept if "label" in kept[k].columns)]
    told = {r["label"]: (r["n"], r["w"]) for r in part.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()}
    strata = pii.label(pii.candidates(docs).where("valid or not base")).where("view is not null").groupBy("kind", "base", "view").count().collect()
    total = sum(g["count"] for g in strata)
    for label in (0.0, 1.0):
        own = [g["count"] for g in strata if g["view"] == label]
        assert told[label][0] == sum(own)
        assert abs(told[label][1] - total * len(own) / len(strata)) < 1e-6
    assert told[1.0][0] >= 2500
