from pyspark.sql import functions as F

from plumbline import session
from plumbline.dataset import Chain, Dataset
from plumbline.operators.scale import MinMax
from plumbline.streaming.scoring import once_per_key, transform_stream


def test_copies(spark):
    df = spark.range(50).withColumn("r", F.rand())
    a = session.keep(df)
    assert a.agg(F.max("r")).first() == a.agg(F.max("r")).first() and a.dtypes == df.dtypes
    c = session.cut(df)
    assert c.agg(F.max("r")).first() == c.agg(F.max("r")).first()
    session.tidy(spark)


def test_one_delivery(spark):
    rows = [(1, "b", 2), (1, "a", 1), (1, "c", 1), (2, None, None), (None, "x", 0)]
    df = spark.createDataFrame(rows, "k int, v string, at int").withColumn("_first", F.lit(0))
    assert sorted(tuple(r) for r in session.one_delivery(df, "k", "at", ["v"]).collect()) == [(1, "a"), (2, None)]


def test_spread(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, "2024-01-01"), (2, 5.0, "2024-01-02"), (1, 0.0, "2024-01-03"), (3, 10.0, "2024-01-02")], "id int, v double, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    chain = Chain(MinMax(targets=["v"]))
    chain.fit_transform(Dataset.of(df, ["v"], keep=("id", "at")))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = once_per_key(transform_stream(stream, chain, ["v"], {"v": "numerical"}, ("id", "at")), "id", "at")
    q = out.writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("select id, v from scored").collect()) == [(1, 0.0), (2, 0.5), (3, 1.0)]
