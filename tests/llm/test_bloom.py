from pyspark.sql import functions as F

from tessella.llm.bloom import membership


def test_membership_has_no_false_negatives_and_few_false_positives(spark):
    ids = spark.range(0, 60_000, 3).toDF("doc")
    test = membership(ids.union(spark.createDataFrame([(None,)], "doc long")), "doc")
    out = spark.range(0, 60_000).toDF("doc").withColumn("m", test(F.col("doc"))).collect()
    assert all(r.m for r in out if r.doc % 3 == 0)
    assert sum(r.m for r in out if r.doc % 3) < 0.12 * 40_000
    assert not spark.createDataFrame([(None,)], "doc long").select(test(F.col("doc"))).first()[0]
    none = membership(ids.limit(0), "doc")
    assert not spark.range(9).toDF("doc").where(none(F.col("doc"))).count()
