"""The dataset type that all feature operators take and give, and the contract of a feature operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERICAL, DISCRETE, CATEGORICAL, ORDINAL, TEXT, EMBEDDING = "numerical", "discrete", "categorical", "ordinal", "text", "embedding"
NUMBERS = (NUMERICAL, DISCRETE)


def kind_of(t: T.DataType) -> str:
    """The feature kind that a column type stands for, where nothing better is known."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return DISCRETE
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return NUMERICAL
    if isinstance(t, T.ArrayType):
        return EMBEDDING
    return CATEGORICAL


@dataclass(frozen=True)
class Dataset:
    """A frame with the kind of each feature. Frames are immutable, so a dataset is never copied."""

    df: DataFrame
    kinds: dict[str, str]
    label: str | None = None
    keep: tuple[str, ...] = ()  # columns that are no features, such as a row id
    history: tuple[str, ...] = ()
    weight: str | None = None

    @staticmethod
    def of(df: DataFrame, features: list[str] | None = None, label: str | None = None, keep: tuple[str, ...] = (), kinds: dict[str, str] | None = None) -> Dataset:
        names = features if features is not None else [c for c in df.columns if c != label and c not in keep]
        known = {f.name: kind_of(f.dataType) for f in df.schema.fields}
        return Dataset(df.select(*keep, *names, *([label] if label else [])), {n: (kinds or {}).get(n, known[n]) for n in names}, label, keep)

    @property
    def features(self) -> list[str]:
        return list(self.kinds)

    def of_kind(self, *kinds: str) -> list[str]:
        return [n for n, k in self.kinds.items() if k in kinds]

    def project(self, columns: dict[str, Column], kinds: dict[str, str], step: str) -> Dataset:
        """Features replaced by ``columns``; label, weight and kept columns stay."""
        rest = [*self.keep, *([self.label] if self.label else []), *([self.weight] if self.weight else [])]
        return replace(self, df=self.df.select(*rest, *[c.alias(n) for n, c in columns.items()]), kinds=kinds, history=(*self.history, step))

    def union(self, other: Dataset) -> Dataset:
        """The rows of both; columns go by name."""
        return replace(self, df=self.df.unionByName(other.df))

    def same_rows(self, other: Dataset) -> bool:
        """Equal as a bag of rows, in any order."""
        return self.df.exceptAll(other.df).isEmpty() and other.df.exceptAll(self.df).isEmpty()


@dataclass
class Stage:
    """A feature operator: ``fit`` learns a small state from one pass over the data, ``transform`` is a projection.

    ``mode`` says how new columns meet the old ones: in_place (same names), concatenate, replace (the targets go)
    or only_new. With no column of the kinds it takes, a stage changes nothing.
    """

    targets: list[str] | None = None
    takes: tuple[str, ...] = NUMBERS
    gives: str = NUMERICAL
    mode: str = "in_place"
    name: str = "stage"
    state: dict = field(default_factory=dict)

    def chosen(self, ds: Dataset) -> list[str]:
        return [t for t in (self.targets or ds.of_kind(*self.takes)) if t in ds.kinds]

    def learn(self, ds: Dataset, targets: list[str]) -> dict:
        return {}

    def columns(self, targets: list[str]) -> dict[str, Column]:
        raise NotImplementedError

    def fit(self, ds: Dataset) -> Stage:
        targets = self.chosen(ds)
        self.state = {"targets": targets, **(self.learn(ds, targets) if targets else {})}
        return self

    def transform(self, ds: Dataset) -> Dataset:
        targets = self.state["targets"]
        if not targets:
            return ds
        new = self.columns(targets)
        if self.mode == "in_place":
            cols = {n: new.get(n, F.col(n)) for n in ds.features}
            kinds = {n: self.gives if n in new else k for n, k in ds.kinds.items()}
        else:
            old = [] if self.mode == "only_new" else [n for n in ds.features if self.mode == "concatenate" or n not in targets]
            cols = {**{n: F.col(n) for n in old}, **new}
            kinds = {**{n: ds.kinds[n] for n in old}, **{n: self.gives for n in new}}
        return ds.project(cols, kinds, self.name)

    def fit_transform(self, ds: Dataset) -> Dataset:
        return self.fit(ds).transform(ds)


class Chain:
    """Stages one after the other, each fitted on what the one before gives."""

    def __init__(self, *stages: Stage) -> None:
        self.stages = list(stages)

    def fit_transform(self, ds: Dataset) -> Dataset:
        for s in self.stages:
            ds = s.fit_transform(ds)
        return ds

    def transform(self, ds: Dataset) -> Dataset:
        for s in self.stages:
            ds = s.transform(ds)
        return ds


def one_row(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """Aggregates of one pass, as a dictionary."""
    return df.agg(*[e.alias(k) for k, e in exprs.items()]).first().asDict() if exprs else {}


#: A column function of other columns, for user-defined stages.
Expression = Callable[[Column], Column]
