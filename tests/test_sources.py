from pyspark.sql import functions as F

from plumbline.__main__ import main
from plumbline.sources import tables


def test_csv_variants(spark, tmp_path):
    (tmp_path / "a.csv").write_text('num;txt;y\n1;a;p\n2.5;?;q\nn/a;"b;c";p\n--;x;\n;;\n')
    ds = tables.train_csv(spark, str(tmp_path / "a.csv"), sep=";")
    rows = [tuple(r) for r in ds.df.select("y", F.col("num").cast("string"), "txt").collect()]
    assert ds.label == "y" and ds.kinds == {"num": "numerical", "txt": "categorical"}
    assert set(rows) == {("p", "1.0", "a"), ("q", "2.5", None), ("p", None, "b;c")}
    (tmp_path / "b.csv").write_text("7,p,1\n8,q,2\n")
    first = tables.train_csv(spark, str(tmp_path / "b.csv"), label_col=0, drop_index=[2], header=False)
    assert first.features == ["_c1"] and first.label == "_c0"
    test = tables.test_csv(spark, str(tmp_path / "a.csv"), ds.kinds, label_col=2, sep=";")
    assert test.df.count() == 4 and dict(test.df.dtypes)["num"] == "double"


def test_word_vectors(spark, tmp_path):
    (tmp_path / "w.txt").write_text("cat 1 2.5\ndog 0 -1e-2\nbroken x y\nalone\n")
    got = {r.word: list(r.vector) for r in tables.word_vectors(spark, str(tmp_path / "w.txt")).collect()}
    assert set(got) == {"cat", "dog"} and got["cat"] == [1.0, 2.5]


def test_command_line(spark, tmp_path):
    df = spark.range(120).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 7 > 3, "yes").otherwise("no").alias("y"))
    df.write.parquet(str(tmp_path / "t.parquet"))
    main([str(tmp_path / "t.parquet"), "--label", "y", "--trials", "1", "--test", str(tmp_path / "t.parquet"), "--out", str(tmp_path / "o")], spark)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 120
