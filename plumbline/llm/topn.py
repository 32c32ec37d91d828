"""The N best items of every group by secondary sort, streamed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import map_arrow


def _codes(column: pa.Array) -> np.ndarray:
    """Equal values get equal numbers; null is a value of its own."""
    d = column.dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy(zero_copy_only=False)


def first_n(groups: list[str], item: str, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over batches sorted by group, then best first: the first ``n`` distinct items of each group.

    Between batches only the rows kept so far of the last group are held, at most ``n``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            old = held.num_rows if held is not None else 0
            both = pa.Table.from_batches([held, batch] if old else [batch]).combine_chunks()
            size = both.num_rows
            new = np.zeros(size, bool)
            new[0] = True
            for g in groups:
                c = _codes(both[g].combine_chunks())
                new[1:] |= c[1:] != c[:-1]
            group = np.cumsum(new) - 1
            codes = _codes(both[item].combine_chunks()).astype(np.int64)
            # a stable sort by (group, item) puts the best row of each pair first
            order = np.lexsort((np.arange(size), codes, group))
            pair = np.ones(size, bool)
            pair[1:] = (group[order][1:] != group[order][:-1]) | (codes[order][1:] != codes[order][:-1])
            best = np.sort(order[pair])
            g = group[best]
            start = np.searchsorted(g, g, side="left")
            kept = best[np.arange(len(best)) - start < n]
            last = kept[group[kept] == group[-1]]
            held = both.take(pa.array(last)).combine_chunks().to_batches()[0]
            out = kept[kept >= old]
            if len(out):
                yield from both.take(pa.array(out)).combine_chunks().to_batches()

    return run


def top_n(rows: DataFrame, groups: dict[str, Column], order: list[tuple[Column, bool]], item: Column, output: list[str], n: int) -> DataFrame:
    """Of every group the first ``n`` rows in ``order``, only the first of rows with the same ``item``.

    ``groups`` names the group columns, ``order`` lists (column, descending), ending in a unique one;
    nulls come last. Rows with a null item stand for themselves only if ``item`` gives them a value of their own.
    Null group values form a group. Result: the group columns and ``output``; other columns don't
    come out. Ties never depend on row order. An empty table gives an empty result.

    Each task first sorts its own rows and keeps ``n`` of each group, so a group with a third of all
    rows sends at most ``n`` rows per task through the shuffle. A second sort over the hash-partitioned
    rest gives the result. Neither pass buffers a group.
    """
    names = list(groups)
    keys = [f"_o{i}" for i in range(len(order))]
    base = rows.select(*[c.alias(g) for g, c in groups.items()], *[c.alias(k) for k, (c, _) in zip(keys, order)], item.alias("_item"), *[F.col(c).alias(f"_r_{c}") for c in output])
    by = [F.col(g).asc_nulls_first() for g in names] + [F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_last() for k, (_, down) in zip(keys, order)]
    step = first_n(names, "_item", n)
    local = map_arrow(base.sortWithinPartitions(*by), step, base.schema)
    best = map_arrow(local.repartition(*names).sortWithinPartitions(*by), step, base.schema)
    return best.select(*names, *[F.col(f"_r_{c}").alias(c) for c in output])


def best_trials(trial_runs: DataFrame, n: int = 5) -> DataFrame:
    """The best ``n`` configurations of every session and estimator, each by its best trial.

    Estimators count trimmed and in lower case. Trials with null, NaN or infinite ``perf`` don't count.
    Order: larger ``perf``, earlier ``finished_at`` (null last), smaller ``trial_id``. A trial without
    ``config_id`` counts as a configuration of its own.
    """
    ok = F.col("perf").isNotNull() & ~F.isnan("perf") & (F.abs("perf") < F.lit(float("inf")))
    item = F.when(F.col("config_id").isNotNull(), F.concat(F.lit("c"), "config_id")).otherwise(F.concat(F.lit("t"), F.col("trial_id").cast("string")))
    groups = {"session_id": F.col("session_id"), "estimator_id": F.lower(F.trim("estimator_id", F.lit(" \t")))}
    return top_n(trial_runs.where(ok), groups, [(F.col("perf"), True), (F.col("finished_at"), False), (F.col("trial_id"), False)], F.coalesce(item, F.lit("")), ["trial_id"], n)
