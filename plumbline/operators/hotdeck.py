"""Filling missing cells from the nearest observed record of the same group (sequential hot-deck)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.cells import is_missing, lower_tokens
from plumbline.session import keep, one_delivery


def hot_deck(rows: DataFrame, missing: dict[str, Column], group: str, time: str, key: str) -> DataFrame:
    """Every missing cell filled from the previous or next observed record of its group.

    ``missing`` gives for each feature a condition over ``rows`` that is never null. Records of a
    group stand in the order of ``time`` (null first), then ``key``. Of the nearest observed record
    before and after, the one closer in time is the donor; the earlier one of two that are equally
    close, or where a time is null.

    Result: ``key``, ``group``, ``time`` and for each feature ``f`` the columns ``f`` (the value, or
    null where the group never observed it), ``f_missing``, ``f_filled`` and ``f_distance`` (seconds
    to the donor; null where not filled or a time is null). Other columns of ``rows`` don't come out,
    so their names can't clash. Rows without a group have no similar records and are never filled.
    An empty table gives an empty result.

    A group may hold a third of all rows: the records are range-partitioned by (group, time, key),
    so a large group spreads over many tasks. Each task fills inside its own range with windows, and what
    crosses a boundary is one first and one last observed record per feature and range. The
    ranges come from a sample, so they are written once, as a Parquet table, and read twice.
    """
    features = list(missing)
    base = rows.select(
        F.col(key).alias("_key"), F.col(group).alias("_group"), F.col(time).alias("_time"), *[F.when(~missing[f], F.col(f)).alias(f"v{i}") for i, f in enumerate(features)]
    )
    ranged = keep(base.repartitionByRange("_group", "_time", "_key").withColumn("_range", F.spark_partition_id()))

    forward = Window.partitionBy("_range", "_group").orderBy(F.col("_time").asc_nulls_first(), F.col("_key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy("_range", "_group").orderBy(F.col("_time").desc_nulls_last(), F.col("_key").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    n = range(len(features))
    seen = lambda i: F.when(F.col(f"v{i}").isNotNull(), F.struct(F.col("_time").alias("t"), F.col("_key").alias("k"), F.col(f"v{i}").alias("v")))
    near = ranged.select("*", *[F.last(seen(i), True).over(forward).alias(f"p{i}") for i in n]).select("*", *[F.last(seen(i), True).over(backward).alias(f"n{i}") for i in n])

    # what a range can hand on to the others: at most two rows per range, for only groups that cross a boundary matter
    edge = ranged.where(F.col("_group").isNotNull()).groupBy("_group", "_range").agg(*[F.max(seen(i)).alias(f"l{i}") for i in n], *[F.min(seen(i)).alias(f"f{i}") for i in n])
    edge = edge.withColumn("_ranges", F.count("*").over(Window.partitionBy("_group"))).where("_ranges > 1")
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_group").orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = edge.select("_group", "_range", *[F.last(f"l{i}", True).over(before).alias(f"cp{i}") for i in n], *[F.last(f"f{i}", True).over(after).alias(f"cn{i}") for i in n])

    out = near.join(carried, ["_group", "_range"], "left")
    grouped = F.col("_group").isNotNull()
    prev = lambda i: F.when(grouped, F.coalesce(f"p{i}", f"cp{i}"))
    nxt = lambda i: F.when(grouped, F.coalesce(f"n{i}", f"cn{i}"))
    picked = out.select("_key", "_group", "_time", *[f"v{i}" for i in n], *[prev(i).alias(f"a{i}") for i in n], *[nxt(i).alias(f"b{i}") for i in n])
    gap = lambda c: F.abs(F.unix_micros(F.col(f"{c}.t").cast("timestamp")) - F.unix_micros(F.col("_time").cast("timestamp"))) / 1e6
    donor = lambda i: F.when(F.col(f"v{i}").isNull(), F.when(F.col(f"a{i}").isNull() | (gap(f"b{i}") < gap(f"a{i}")), F.coalesce(f"b{i}", f"a{i}")).otherwise(F.col(f"a{i}")))
    given = picked.select("_key", "_group", "_time", *[f"v{i}" for i in n], *[donor(i).alias(f"d{i}") for i in n])
    cols = [F.col("_key").alias(key), F.col("_group").alias(group), F.col("_time").alias(time)]
    for i, f in enumerate(features):
        cols += [
            F.coalesce(f"v{i}", f"d{i}.v").alias(f),
            F.col(f"v{i}").isNull().alias(f"{f}_missing"),
            F.col(f"d{i}").isNotNull().alias(f"{f}_filled"),
            F.when(F.col(f"d{i}").isNotNull(), gap(f"d{i}")).alias(f"{f}_distance"),
        ]
    return given.select(*cols)


def fill_nodes(node_rows: DataFrame, datasets: DataFrame, features: list[str]) -> DataFrame:
    """``hot_deck`` over data nodes: what counts as missing follows each data set's null tokens and types.

    Records delivered twice count once. A data set that isn't known, or knows no tokens or types,
    has none: only null and blank cells are missing there. Spark broadcasts ``datasets`` only where its size
    is under the session's threshold.
    """
    rows = one_delivery(node_rows, "row_id", "arrived_at", ["node_id", "dataset_id", "recorded_at", *features])
    known = datasets.where(F.col("dataset_id").isNotNull()).groupBy("dataset_id").agg(F.min(F.struct("na_values", "feature_types")).alias("d"))
    known = known.select("dataset_id", lower_tokens(F.col("d.na_values")).alias("_tokens"), F.col("d.feature_types").alias("_types"))
    rows = rows.join(known, "dataset_id", "left").withColumn("_tokens", F.coalesce("_tokens", F.array().cast("array<string>")))
    missing = {f: is_missing(F.col(f), F.get("_types", F.lit(i)), F.col("_tokens")) for i, f in enumerate(features)}
    return hot_deck(rows, missing, "node_id", "recorded_at", "row_id")
