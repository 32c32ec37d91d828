"""Type inference, null handling, imputation and encoding."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.dataset import CATEGORICAL, DISCRETE, NUMBERS, NUMERICAL, ORDINAL, Chain, Dataset, Stage, one_row
from plumbline.operators.quantiles import exact_quantiles

#: Texts that mean a missing value in a file.
NULL_TOKENS = ["n/a", "na", "--", "-", "?"]
#: A column whose other cells are at most this share is of the kind of the rest.
MINORITY = 0.05
#: One-hot columns of one feature, at most; more categories than that are an error, not a silent cut.
MAX_CATEGORIES = 10_000


def nulls_for(c: Column, tokens: list[str] = NULL_TOKENS) -> Column:
    return F.when(F.trim(c).isin(*tokens) | (F.trim(c) == ""), None).otherwise(c)


def infer_kinds(df: DataFrame, columns: list[str] | None = None) -> dict[str, tuple[str, str]]:
    """(kind, repair) of each column from one pass.

    Whole-number columns are discrete; floating ones are if every value is whole. A text column is a number column
    if all but one cell, or all but MINORITY of them, are numbers; the odd cells are to become null. The other way round it is categorical
    and the odd numbers are to become null. ``repair`` is "none", "numbers" or "texts": what is kept.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    exprs: dict[str, Column] = {}
    for f in fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            v = c.cast("double")
            exprs[f"{f.name}|whole"] = F.coalesce(F.bool_and(F.when(c.isNotNull() & ~F.isnan(v), v == F.floor(v))), F.lit(False))
        elif isinstance(f.dataType, T.StringType):
            v = c.try_cast("double")
            exprs[f"{f.name}|n"] = F.count(c)
            exprs[f"{f.name}|num"] = F.count(v)
            exprs[f"{f.name}|whole"] = F.coalesce(F.bool_and(F.when(v.isNotNull() & ~F.isnan(v), v == F.floor(v))), F.lit(False))
    got = one_row(df, exprs)
    out = {}
    for f in fields:
        if f"{f.name}|n" in got:
            n, num = got[f"{f.name}|n"], got[f"{f.name}|num"]
            number = DISCRETE if got[f"{f.name}|whole"] else NUMERICAL
            if n and num == n:
                out[f.name] = (number, "none")
            elif n and num and (n - num == 1 or n - num <= MINORITY * n):
                out[f.name] = (number, "numbers")
            elif n and num and (num == 1 or num <= MINORITY * n):
                out[f.name] = (CATEGORICAL, "texts")
            else:
                out[f.name] = (CATEGORICAL, "none")
        elif f"{f.name}|whole" in got:
            out[f.name] = (DISCRETE if got[f"{f.name}|whole"] else NUMERICAL, "none")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out[f.name] = (DISCRETE, "none")
        else:
            out[f.name] = (CATEGORICAL, "none")
    return out


def typed(df: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns as their inferred kind; cells of the minority become null."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind, repair = kinds.get(f.name, (CATEGORICAL, "none"))
        if isinstance(f.dataType, T.StringType) and kind in NUMBERS:
            c = c.try_cast("double")
        elif repair == "texts":
            c = F.when(c.try_cast("double").isNull(), c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def is_discrete(c: Column) -> Column:
    """Aggregate: every value is whole."""
    return F.bool_and(c == F.floor(c))


def looks_categorical(c: Column) -> Column:
    """Aggregate: fewer than one distinct value in a thousand rows."""
    return F.count_distinct(c) / F.count(F.lit(1)) < 0.001


def drop_null_labels(ds: Dataset) -> Dataset:
    return replace(ds, df=ds.df.where(F.col(ds.label).isNotNull()))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows whose cells are all null go."""
    return df.na.drop(how="all")


class DropColumns(Stage):
    """The named features go, and the label too if it is named; names that aren't there are left out."""

    def __init__(self, columns: list[str]) -> None:
        super().__init__(name="drop_columns")
        self.columns = columns

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        return {}

    def transform(self, ds: Dataset) -> Dataset:
        gone = set(self.columns)
        return replace(ds, df=ds.df.drop(*gone), kinds={f: k for f, k in ds.kinds.items() if f not in gone}, label=None if ds.label in gone else ds.label)


class DropUninformative(Stage):
    """Columns that are all null go, and categorical ones where at least 80 % of the rows have values of their own."""

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        exprs = {"n": F.count(F.lit(1))}
        for i, f in enumerate(targets):
            exprs[f"c{i}"] = F.count(f)
            if ds.kinds[f] == CATEGORICAL:
                exprs[f"d{i}"] = F.count_distinct(f)
        got = one_row(ds.df, exprs)
        keep = []
        for i, f in enumerate(targets):
            distinct = got.get(f"d{i}", 0) + (got[f"c{i}"] < got["n"])  # null counts as a value
            if got[f"c{i}"] and not (ds.kinds[f] == CATEGORICAL and distinct >= int(0.8 * got["n"])):
                keep.append(f)
        return {"keep": keep}

    def chosen(self, ds: Dataset) -> list[str]:
        return ds.features

    def transform(self, ds: Dataset) -> Dataset:
        kept = {f: ds.kinds[f] for f in self.state["keep"]}
        return ds.project({f: F.col(f) for f in kept}, kept, "drop_uninformative")


class DropConstant(Stage):
    """Number columns whose population variance isn't above the threshold go."""

    def __init__(self, threshold: float = 1e-7) -> None:
        super().__init__(name="drop_constant")
        self.threshold = threshold

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        got = one_row(ds.df, {f"v{i}": F.var_pop(f) for i, f in enumerate(targets)})
        return {"drop": [f for i, f in enumerate(targets) if not (got[f"v{i}"] or 0) > self.threshold]}

    def transform(self, ds: Dataset) -> Dataset:
        kept = {f: k for f, k in ds.kinds.items() if f not in self.state.get("drop", [])}
        return ds.project({f: F.col(f) for f in kept}, kept, self.name)


def modes(df: DataFrame, columns: list[str]) -> dict:
    """The most frequent value of each column, the smallest of equally frequent ones.

    One pass counts all columns at once; what comes to the driver is one row per column.
    """
    if not columns:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(columns)])).alias("p")).select("p.*")
    numbers = {i for i, c in enumerate(columns) if not isinstance(df.schema[c].dataType, T.StringType)}
    counts = long.where("v is not null").groupBy("i", "v").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("n").alias("n"), F.when(F.col("i").isin(*numbers) if numbers else F.lit(False), -F.col("v").try_cast("double")).alias("x"))
    best = counts.groupBy("i").agg(F.max(rank).alias("r"))
    top = counts.withColumn("r", rank).join(best.select(F.col("i").alias("bi"), F.col("r").alias("br")), (F.col("i") == F.col("bi")) & F.col("r").eqNullSafe(F.col("br")))
    got = {r["i"]: r["v"] for r in top.groupBy("i").agg(F.min("v").alias("v")).collect()}
    return {c: got.get(i) for i, c in enumerate(columns)}


@dataclass
class Impute(Stage):
    """Missing cells get a statistic of the fitted data: mean, median, mode, or auto (mode for categories, median for numbers).

    A column that holds nothing stays as it is.
    """

    strategy: str = "auto"

    def __post_init__(self) -> None:
        self.name = f"impute_{self.strategy}"

    def chosen(self, ds: Dataset) -> list[str]:
        return self.targets or (ds.features if self.strategy in ("auto", "mode") else ds.of_kind(*NUMBERS))

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        by_mode = [f for f in targets if self.strategy == "mode" or (self.strategy == "auto" and ds.kinds[f] in (CATEGORICAL, ORDINAL))]
        rest = [f for f in targets if f not in by_mode]
        clean = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
        if self.strategy == "mean":
            fill = one_row(ds.df, {f: F.avg(clean(f)) for f in rest})
        else:
            fill = {f: v[0] if v else None for f, v in exact_quantiles(ds.df, {f: [0.5] for f in rest}).items()}
        return {"fill": {**fill, **modes(ds.df, by_mode)}, "types": {f: ds.df.schema[f].dataType for f in targets}, "by_mode": by_mode}

    def transform(self, ds: Dataset) -> Dataset:
        cols = {}
        for f in ds.features:
            v = self.state.get("fill", {}).get(f)
            if v is None:
                cols[f] = F.col(f)
            elif f in self.state["by_mode"]:
                cols[f] = F.coalesce(F.col(f), F.lit(v).cast(self.state["types"][f]))
            else:
                cols[f] = F.nanvl(F.coalesce(F.col(f).cast("double"), F.lit(v)), F.lit(v))
        return ds.project(cols, ds.kinds, self.name)


@dataclass
class OneHot(Stage):
    """Each category of the fitted data becomes a 0/1 column, in the order of the categories; unseen ones give zeros."""

    takes: tuple[str, ...] = (CATEGORICAL,)
    mode: str = "replace"
    name: str = "onehot"
    gives: str = DISCRETE

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        sets = one_row(ds.df, {f: F.count_distinct(f) for f in targets})
        if any(n > MAX_CATEGORIES for n in sets.values()):
            raise ValueError(f"more than {MAX_CATEGORIES} categories: {sets}")
        got = one_row(ds.df, {f: F.array_sort(F.collect_set(f)) for f in targets})  # bounded by the check above
        return {"values": got}

    def columns(self, targets: list[str]) -> dict[str, Column]:
        return {f"{f}_{v}": F.coalesce((F.col(f) == F.lit(v)).cast("double"), F.lit(0.0)) for f in targets for v in self.state["values"][f]}


@dataclass
class DiscreteCategories(OneHot):
    """One-hot columns for discrete features of at most ``max_unique`` values."""

    takes: tuple[str, ...] = (DISCRETE,)
    name: str = "discrete_categories"
    max_unique: int = 10

    def fit(self, ds: Dataset) -> Stage:
        targets = self.chosen(ds)
        counts = one_row(ds.df, {f: F.count_distinct(f) for f in targets})
        few = [f for f in targets if counts[f] <= self.max_unique]
        self.state = {"targets": few, **(self.learn(ds, few) if few else {})}
        return self


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the sorted distinct values numbered from 0; null has no code. For labels, of which there are few."""
    distinct = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    if distinct.limit(MAX_CATEGORIES + 1).count() > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} values of {column}")
    values = sorted(r[0] for r in distinct.collect())
    return df.sparkSession.createDataFrame(list(enumerate(values)), T.StructType([T.StructField("code", T.IntegerType()), T.StructField("value", df.schema[column].dataType)]))


def encode_labels(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the code of ``column``; null and unseen values keep a null code."""
    codes = label_codes(df, column)
    return df.join(F.broadcast(codes.withColumnRenamed("value", "_value").withColumnRenamed("code", out)), F.col(column) == F.col("_value"), "left").drop("_value")


def preprocess(ds: Dataset, classify: bool = True) -> tuple[Dataset, Chain]:
    """The usual chain: drop uninformative columns, impute, one-hot, drop constants; class labels as codes.

    The chain is fitted on ``ds`` and can be applied to other data, which then gets the statistics of ``ds``.
    """
    chain = Chain(DropUninformative(), Impute(), OneHot(), DropConstant())
    out = chain.fit_transform(ds)
    if classify and ds.label:
        coded = encode_labels(out.df, ds.label, "_code")
        out = replace(out, df=coded.drop(ds.label).withColumnRenamed("_code", ds.label))
    return out, chain


def merge_columns(left: Dataset, right: Dataset, key: str) -> Dataset:
    """Two datasets over the same rows side by side."""
    df = left.df.join(right.df.select(key, *right.features), key)
    return replace(left, df=df, kinds={**left.kinds, **right.kinds})
