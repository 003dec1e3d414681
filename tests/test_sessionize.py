import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoplens.operators.sessionize import sessionize


def test_chunked_equals_single_window(spark):
    rnd = random.Random(7)
    rows = []
    t = 1_700_000_000
    for i in range(3000):
        k = 0 if rnd.random() < 0.4 else rnd.randrange(1, 8)  # key 0 is hot
        t += rnd.choice([1, 30, 600, 1727, 1728, 1729, 4000, 20000])
        rows.append((i, k, t + rnd.random()))
    df = spark.createDataFrame(rows, "id long, k long, t double").withColumn(
        "ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    got = sessionize(df, ["k"], "ts", "id", 1728, chunk_s=3600).select("id", "session_no")
    w = Window.partitionBy("k").orderBy("ts", "id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    ref = (df.withColumn("f", F.when(gap.isNull() | (gap >= 1728 * 1_000_000), 1).otherwise(0))
             .withColumn("session_no", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .select("id", "session_no"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ref.collect()))
