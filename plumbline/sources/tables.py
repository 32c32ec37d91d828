"""Tables read from and written to files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.dataset import CATEGORICAL, NUMBERS, Dataset
from plumbline.operators.clean import NULL_TOKENS, drop_empty_rows, infer_kinds, nulls_for, typed
from plumbline.session import shared_folder


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, na_values: list[str] | None = None) -> DataFrame:
    """All columns as text, null tokens as null, rows of nothing but nulls dropped. Spreadsheets aren't read."""
    if path.lower().endswith((".xls", ".xlsx")):
        raise ValueError("spreadsheets must be exported as CSV first")
    df = spark.read.option("header", header).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    tokens = NULL_TOKENS + (na_values or [])
    return drop_empty_rows(df.select(*[nulls_for(F.col(f"`{c}`"), tokens).alias(c) for c in df.columns]))


def train_csv(spark: SparkSession, path: str, label_col: int = -1, drop_index: list[int] | None = None, **options) -> Dataset:
    """A training table: kinds are inferred, rows without a label go, the label's name is kept."""
    df = read_csv(spark, path, **options)
    names = df.columns
    label = names[label_col]
    df = df.drop(*[names[i] for i in drop_index or []]).where(F.col(f"`{label}`").isNotNull())
    kinds = infer_kinds(df)
    df = typed(df, kinds)
    features = [c for c in df.columns if c != label]
    return Dataset.of(df, features, label, kinds={c: kinds[c][0] for c in features})


def test_csv(spark: SparkSession, path: str, kinds: dict[str, str], label_col: int | None = None, **options) -> Dataset:
    """A test table under the kinds of the training table; cells that don't fit are null."""
    df = read_csv(spark, path, **options)
    label = df.columns[label_col] if label_col is not None else None
    cols = [(F.col(f"`{c}`").try_cast("double") if kinds.get(c, CATEGORICAL) in NUMBERS else F.col(f"`{c}`")).alias(c) for c in df.columns]
    df = df.select(*cols)
    return Dataset.of(df, [c for c in df.columns if c != label], label, kinds=kinds)


#: Label columns of the known tables.
LABELS = {"lineitem": "l_returnflag", "orders": "o_orderstatus", "customer": "c_mktsegment", "embeddings": "label", "node_rows": "y", "split_rows": "y"}


def load(spark: SparkSession, folder: str, name: str) -> Dataset:
    """A known table by name, with its label."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return Dataset.of(df, label=LABELS.get(name))


def round_trip_csv(df: DataFrame, label_col: int | None, kinds: dict[str, str] | None = None) -> Dataset:
    """``df`` written as CSV to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    df.write.option("header", True).option("escape", '"').csv(path)
    if label_col is None:
        return test_csv(df.sparkSession, path, kinds or {})
    return train_csv(df.sparkSession, path, label_col)


def write_lines(df: DataFrame) -> str:
    path = f"{shared_folder(df.sparkSession)}/lines-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a text file with a word and its numbers on each line; it stays a distributed table. Lines without numbers are left out."""
    parts = F.split("value", " ")
    df = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("word"), F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("float")).alias("vector"))
    return df.where((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull()))


def save_model(model, path: str) -> None:
    """A wrapped ``pyspark.ml`` model in Spark's own format."""
    model.state["model"].write().overwrite().save(path)


def model_round_trip(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Predictions before and after a model was saved and loaded."""
    from pyspark.ml.classification import RandomForestClassificationModel

    from plumbline.models.trees import RandomForestClassifier

    model = RandomForestClassifier(features, label, params={"numTrees": 3}).fit(df)
    path = f"{shared_folder(df.sparkSession)}/model-{uuid.uuid4().hex}"
    save_model(model, path)
    first = model.predict(df).select(F.col("prediction").alias("a"), *features)
    again = RandomForestClassifier(features, label)
    again.state = {"model": RandomForestClassificationModel.load(path)}
    both = again.predict(first)
    return both.agg(F.count("*").alias("n"), F.min((F.col("a") == F.col("prediction")).cast("int")).alias("same"))


SCHEMA_OF_KINDS = T.StructType([T.StructField("feature", T.StringType()), T.StructField("kind", T.StringType())])
