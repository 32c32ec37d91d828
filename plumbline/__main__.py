"""python -m plumbline: search a pipeline for a CSV or Parquet table, and predict another."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.automl import Classifier, Regressor
from plumbline.sources.tables import test_csv, train_csv


def keyed(df: DataFrame) -> DataFrame:
    """With a row number in reading order as the key."""
    return df.withColumn("_row", F.monotonically_increasing_id())


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    p.add_argument("train")
    p.add_argument("--label", help="name of the label; the last column of a CSV file by default")
    p.add_argument("--test")
    p.add_argument("--out", help="folder for the predictions")
    p.add_argument("--task", choices=["classification", "regression"], default="classification")
    p.add_argument("--trials", type=int, default=10)
    p.add_argument("--metric")
    p.add_argument("--optimizer", default="smac")
    p.add_argument("--ensemble")
    p.add_argument("--sep", default=",")
    o = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    kinds = None
    if o.train.endswith(".parquet"):
        train, label = spark.read.parquet(o.train), o.label
        if not label:
            p.error("--label is needed for Parquet tables")
    else:
        ds = train_csv(spark, o.train, sep=o.sep)
        train, label, kinds = ds.df, o.label or ds.label, ds.kinds
    make = Classifier if o.task == "classification" else Regressor
    a = make("_row", trials=o.trials, optimizer=o.optimizer, ensemble_method=o.ensemble, **({"metric": o.metric} if o.metric else {}))
    a.fit(keyed(train), label)
    a.trials_frame(spark).orderBy(F.desc("score")).show(truncate=False)
    if o.test:
        test = spark.read.parquet(o.test) if o.test.endswith(".parquet") else test_csv(spark, o.test, kinds or {}, sep=o.sep).df
        found = a.predict(keyed(test))
        if o.out:
            found.write.mode("overwrite").parquet(o.out)
        else:
            found.show()
    a.close()


if __name__ == "__main__":
    main()
