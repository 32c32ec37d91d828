"""Exact quantiles of number columns of any size, linearly interpolated between order statistics."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.dataset import one_row

#: Bins of a histogram, rows that one bin may hold before it is cut again, and cuts that are tried.
BINS, ROWS, CUTS = 4096, 1_000_000, 12


def _bin(v: Column, lo: Column, hi: Column, by_size: bool) -> Column:
    """The bin of a value between two ends, of equal widths on a line or, ``by_size``, on a scale of logarithms. Both rise with the value, so order is kept."""
    if by_size:
        v, lo, hi = (F.signum(x) * F.log1p(F.abs(x)) for x in (v, lo, hi))
    at = F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS)  # halves, for the whole width may overflow
    return F.when(hi > lo, F.greatest(F.lit(0), F.least(F.lit(BINS - 1), at))).otherwise(0).cast("int")


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float] | None]:
    """column -> its values at the wanted shares; None for a column without a number.

    Null, NaN and infinite values don't count. A histogram of equal widths gives the bin of each order statistic. Bins that hold
    one value need no more. Bins of more than ROWS rows are cut again, by turns on a scale of logarithms and on a line, until few rows or one value
    are left, and inside the bins left the rows are ranked. So no task holds a column, and what comes to the driver is histograms and the
    order statistics themselves.
    """
    cols = list(wanted)
    if not cols:
        return {}
    number = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))  # noqa: E731  (NaN isn't smaller)
    ends = one_row(df, {f"{a}{i}": g(number(c)) for i, c in enumerate(cols) for a, g in (("lo", F.min), ("hi", F.max), ("n", F.count))})
    live = [i for i in range(len(cols)) if ends[f"n{i}"]]
    ranks = {i: sorted({r for q in wanted[cols[i]] for r in (floor((ends[f"n{i}"] - 1) * q), ceil((ends[f"n{i}"] - 1) * q))}) for i in live}
    values: dict[tuple[int, int], float] = {}
    spark = df.sparkSession
    cells, cut = None, 0
    if live:
        cell = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(i).alias("g"), _bin(number(cols[i]), F.lit(ends[f"lo{i}"]), F.lit(ends[f"hi{i}"]), False).alias("b"), number(cols[i]).alias("v")) for i in live])).alias("c")
        cells = df.select(cell).select("c.*").where("v is not null")
    before, need = dict.fromkeys(live, 0), ranks  # of a group: rows before the bin at hand, order statistics that are looked for
    while cells is not None:
        todo, heavy = [], []
        # at most BINS bins of a column, or of a bin that is cut again
        for r in cells.groupBy("i", "g", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i", "g", "b").collect():
            first, n = before[r["g"]], r["n"]
            before[r["g"]] += n
            rest = []
            for x in need[r["g"]]:
                if not first <= x < first + n:
                    continue
                if r["lo"] == r["hi"] or x == first:
                    values[(r["i"], x)] = r["lo"]
                elif x == first + n - 1:
                    values[(r["i"], x)] = r["hi"]
                else:
                    rest.append(x)
            if rest and n > ROWS and cut < CUTS:
                heavy.append((r["i"], r["g"], r["b"], len(heavy), float(r["lo"]), float(r["hi"]), first, rest))
            else:
                todo += [(r["i"], r["g"], r["b"], x - first, x) for x in rest]
        if todo:
            plan = spark.createDataFrame(todo, "i int, g int, b int, at int, x long")
            inside = cells.join(F.broadcast(plan.select("i", "g", "b").distinct()), ["i", "g", "b"])
            ranked = inside.withColumn("at", F.row_number().over(Window.partitionBy("i", "g", "b").orderBy("v")) - 1)
            for r in ranked.join(F.broadcast(plan), ["i", "g", "b", "at"]).select("i", "x", "v").collect():
                values[(r["i"], r["x"])] = r["v"]
        if not heavy:
            break
        again = F.broadcast(spark.createDataFrame([h[:6] for h in heavy], "i int, g int, b int, next int, lo double, hi double"))
        cut += 1
        cells = cells.join(again, ["i", "g", "b"]).select("i", F.col("next").alias("g"), _bin(F.col("v"), F.col("lo"), F.col("hi"), cut % 2 == 1).alias("b"), "v")
        before, need = {h[3]: h[6] for h in heavy}, {h[3]: h[7] for h in heavy}
    out: dict[str, list[float] | None] = {}
    for i, c in enumerate(cols):
        if i not in ranks:
            out[c] = None
            continue
        n = ends[f"n{i}"]
        got = []
        for q in wanted[c]:
            h = (n - 1) * q
            lo, hi = values[(i, floor(h))], values[(i, ceil(h))]
            got.append(lo + (hi - lo) * (h - floor(h)))
        out[c] = got
    return out
