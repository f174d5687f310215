from pyspark.sql import functions as F

from parlance.operators import speech

DOC = "video_id string, text string"


def test_clocks_cut_each_sentence_once(spark):
    s = speech.clocked(speech.spoken(F.col("text")))
    plan = spark.createDataFrame([("v", "One two three. " * 5)], DOC).select(s)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\s+, -1") < 8
