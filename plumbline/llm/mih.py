"""The most similar vectors of every vector by multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import cut, map_arrow, one_delivery, ship

#: Vectors that the rotations are learned from, at most.
SAMPLE = 20_000
#: Substrings of a code, each with an index of its own.
SUBSTRINGS = 8
#: Vectors that share a substring's value, on average; a substring has log2(n / PER_VALUE) bits.
PER_VALUE = 16
#: Hamming distance within which every code is reached: some substring then differs in at most RADIUS // SUBSTRINGS
#: bits (pigeonhole). As many as the code has bits make the search exact.
RADIUS = 31
#: Queries that one task holds of one index, at most on average, and how many times as many vectors.
PER_TASK, SHARE = 250_000, 2
#: A class of equal vectors that holds more rows than this, and more than a thousandth of all, is hot; there are at most 1,000 such.
HOT = 100_000


@dataclass
class Code:
    """A learned code: bit i of a vector tells whether ``vector @ rotation[:, i]`` exceeds ``thresholds[i]``. A substring is ``bits`` consecutive bits."""

    rotation: np.ndarray
    thresholds: np.ndarray
    bits: int

    @property
    def substrings(self) -> int:
        return self.rotation.shape[1] // self.bits

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.rotation) > self.thresholds

    def values(self, vectors: np.ndarray) -> np.ndarray:
        """One integer per vector and substring."""
        powers = 1 << np.arange(self.bits, dtype=np.int64)
        return self.encode(vectors).reshape(len(vectors), self.substrings, self.bits) @ powers


def learn(sample: np.ndarray, bits: int, substrings: int = SUBSTRINGS, rounds: int = 12) -> Code:
    """Scaled principal axes, turned so that values lie near +-1 (iterative quantisation); as many turns side by side as the code's bits take."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    variance, axes = np.linalg.eigh(np.atleast_2d(np.cov(centred.T)))
    scale = axes / np.maximum(variance, 1e-9 * max(variance.max(), 1e-30)) ** 0.25
    few = (centred @ scale)[:: max(1, len(centred) // 4000)]
    width, turns = sample.shape[1], []
    for j in range(-(-bits * substrings // width)):
        r = np.linalg.qr(np.random.default_rng(j).normal(size=(width, width)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(few.T @ np.sign(few @ r), full_matrices=False)
            r = u @ vt
        turns.append(r)
    rotation = (scale @ np.hstack(turns))[:, : bits * substrings]
    return Code(rotation.astype(np.float32), np.median(sample @ rotation, axis=0).astype(np.float32), bits)


def ball(bits: int, radius: int) -> np.ndarray:
    """The differences of at most ``radius`` of ``bits`` bits."""
    masks = np.array([0], dtype=np.int64)
    for _ in range(min(radius, bits)):
        masks = np.unique(np.concatenate([masks, *(masks ^ (1 << i) for i in range(bits))]))
    return masks


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(len(column), -1)


@dataclass
class Layout:
    """How indexes are spread over tasks: by the leading bits of a value, and a prefix that many vectors share into parts."""

    code: Code
    reach: int  # bits in which a probed value may differ
    prefix_bits: int
    parts: np.ndarray  # [index or queries, substring, prefix]

    @property
    def shift(self) -> int:
        return self.code.bits - self.prefix_bits

    @property
    def near(self) -> np.ndarray:
        """The differences between a query's own prefix and those that its probes touch, none first."""
        return np.unique(ball(self.code.bits, self.reach) >> self.shift)


def counts(layout: Layout) -> Callable:
    """(kind, substring, prefix, n) of each batch: vectors in a prefix, and queries that touch it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own = layout.code.values(_vectors(b["vec"])) >> layout.shift
            n = np.zeros_like(layout.parts)
            for j in range(own.shape[1]):
                n[0, j] = np.bincount(own[:, j], minlength=n.shape[2])
                for mask in layout.near:
                    n[1, j] += np.bincount(own[:, j] ^ mask, minlength=n.shape[2])
            kind, j, p = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(p.astype(np.int64)), pa.array(n[kind, j, p])], names=["kind", "table", "prefix", "n"])

    return run


INDEX, QUERY, BOTH = 0, 1, 2


def spread_out(layout: Layout) -> Callable:
    """Rows for the indexes: (table, prefix, ipart, qpart, role, value, id, vec).

    A vector goes to the prefix of its value in each index, to one part of the vectors for all parts of the queries, and as a
    query to the prefixes that its probes touch, the other way round. Where both meet, one row stands for both.
    """
    code = layout.code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vec, ident, spread = b["vec"], b["id"], b["spread"].to_numpy()
            values = code.values(_vectors(vec))
            for j in range(values.shape[1]):
                own = values[:, j] >> layout.shift
                ni, nq = layout.parts[0, j, own], layout.parts[1, j, own]
                rows = np.repeat(np.arange(len(own)), nq)
                q = np.arange(len(rows)) - np.repeat(np.cumsum(nq) - nq, nq)
                pieces = [(rows, own[rows], (spread % ni)[rows], q, np.where(q == (spread % nq)[rows], BOTH, INDEX))]
                for mask in layout.near:
                    prefix = own ^ mask
                    ni, nq = layout.parts[0, j, prefix], layout.parts[1, j, prefix]
                    rows = np.repeat(np.arange(len(own)), ni)
                    i = np.arange(len(rows)) - np.repeat(np.cumsum(ni) - ni, ni)
                    keep = (i != (spread % ni)[rows]) if mask == 0 else np.ones(len(rows), bool)
                    pieces.append((rows[keep], prefix[rows[keep]], i[keep], (spread % nq)[rows[keep]], np.full(int(keep.sum()), QUERY)))
                rows = np.concatenate([p[0] for p in pieces])
                cols = [np.full(len(rows), j, np.int32), np.concatenate([p[1] for p in pieces]), *(np.concatenate([p[k] for p in pieces]).astype(np.int32) for k in (2, 3)), np.concatenate([p[4] for p in pieces]).astype(np.int8), values[rows, j]]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), ident.take(at), vec.take(at)], names=["table", "prefix", "ipart", "qpart", "role", "value", "id", "vec"])

    return run


CODED = "table int, prefix bigint, ipart int, qpart int, role tinyint, value bigint, id string, vec binary"
NEAR = "id string, near array<struct<d: double, id: string>>"


def not_under(d: np.ndarray, k: int, groups: int = 64) -> np.ndarray:
    """A bound at or above each row's ``k`` + 1 smallest values: the ``k`` + 1st of the least values of groups of columns, which costs one plain pass."""
    wide = d.shape[1] // groups
    if wide < 4 or k >= groups:
        return np.partition(d, k, axis=1)[:, k]
    least = d[:, :groups].copy()
    for at in range(groups, wide * groups, groups):
        np.minimum(least, d[:, at : at + groups], out=least)
    return np.partition(least, k, axis=1)[:, k]


def search(bits: int, reach: int, k: int) -> Callable[[pa.Table], pa.Table]:
    """Of one part of one index: for each query the ``k`` nearest of the vectors its probes reach, by exact distance, then id."""
    masks = ball(bits, reach)

    def run(t: pa.Table) -> pa.Table:
        role = t["role"].to_numpy()
        value = t["value"].to_numpy()
        ids = np.array(t["id"].to_pylist(), dtype=object)
        vec = _vectors(t["vec"].combine_chunks())
        order = np.lexsort((ids, value))
        index, asked = order[role[order] != QUERY], order[role[order] != INDEX]
        qv = value[asked]
        held, first, many = np.unique(value[index], return_index=True, return_counts=True)
        x = vec[index]
        norm = (x.astype(np.float64) ** 2).sum(1).astype(np.float32)
        out_ids, out_n, out_d, out_near = [], [], [], []
        starts = np.flatnonzero(np.r_[True, qv[1:] != qv[:-1]]) if len(qv) else []
        for s, e in zip(starts, [*starts[1:], len(qv)]):
            probes = np.sort(qv[s] ^ masks) if len(masks) < len(held) else held[np.isin(held ^ qv[s], masks)]
            at = np.searchsorted(held, probes)
            hit = at[(at < len(held)) & (held[np.minimum(at, len(held) - 1)] == probes)] if len(held) else at[:0]
            n = many[hit]
            reached = np.repeat(first[hit] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(hit) else hit
            if not len(reached):
                continue
            cand, cn, cid = x[reached], norm[reached], index[reached]
            twice = cand.T * np.float32(-2)
            step = max(1, 4_000_000 // len(reached))
            for at in range(s, e, step):
                rows = asked[at : min(e, at + step)]
                q = vec[rows]
                qn = (q.astype(np.float64) ** 2).sum(1).astype(np.float32)
                d = q @ twice  # less the query's own norm, which is the same for all
                d += cn
                # float32 sums are off by a few units in the last place of the norms
                slack = 1e-5 * (qn + cn.max()) + 1e-30
                if len(reached) > k + 1:
                    kth = not_under(d, k) + 2 * slack
                else:
                    kth = np.full(len(rows), np.inf, np.float32)
                r, c = np.nonzero(d <= kth[:, None])
                name = ids[cid[c]]  # of the few that are close, not of all that are reached
                other = name != ids[rows[r]]
                r, c, name = r[other], c[other], name[other]
                exact = ((q[r].astype(np.float64) - cand[c].astype(np.float64)) ** 2).sum(1)
                best = np.lexsort((name, exact, r))
                r, name, exact = r[best], name[best], exact[best]
                top = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
                r, name, exact = r[top], name[top], exact[top]
                got, sizes = np.unique(r, return_counts=True)
                out_ids.append(ids[rows[got]])
                out_n.append(sizes)
                out_d.append(exact)
                out_near.append(name)
        if not out_ids:
            return pa.table({"id": pa.array([], pa.string()), "near": pa.array([], pa.list_(pa.struct([("d", pa.float64()), ("id", pa.string())])))})
        entries = pa.StructArray.from_arrays([pa.array(np.concatenate(out_d), pa.float64()), pa.array(np.concatenate(out_near), pa.string())], names=["d", "id"])
        offsets = pa.array(np.r_[0, np.cumsum(np.concatenate(out_n))].astype(np.int32))
        return pa.table({"id": pa.array(np.concatenate(out_ids), pa.string()), "near": pa.ListArray.from_arrays(offsets, entries)})

    return run


def usable_vectors(task_vectors: DataFrame, size: int = 32) -> DataFrame:
    """(task_id, vec) of the tasks whose vector has exactly ``size`` finite entries, each once."""
    rows = one_delivery(task_vectors, "task_id", "arrived_at", ["dataset_embedding"])
    good = (F.size("dataset_embedding") == size) & F.forall("dataset_embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(good, F.lit(False))).select("task_id", F.transform("dataset_embedding", lambda x: x.cast("float") + F.lit(0.0).cast("float")).alias("vec"))


def nearest(
    vectors: DataFrame, k: int = 5, sample: int = SAMPLE, substrings: int = SUBSTRINGS, per_value: int = PER_VALUE, per_task: int = PER_TASK, radius: int = RADIUS, hot: int = HOT
) -> DataFrame:
    """For each (task_id, vec) the ``k`` nearest vectors of other tasks: (task_id, near array of (d, id)), nearest first.

    ``d`` is the squared Euclidean distance, of equal ones the smaller id comes first. Equal
    vectors form one class, named by a digest of the vector, that is searched once and keeps its ``k`` + 1 smallest ids, so copies that hold a
    third of all rows cost what one vector costs.

    Every class has one code of ``substrings`` times b bits, from rotations learned on at most ``sample`` classes; all are indexed
    under each substring and all are queries. A query probes the values that differ in at most ``radius`` // ``substrings`` bits, which reaches every code within the
    Hamming distance ``radius``, and others; all that are reached are compared by their floats. What no
    probe reaches is lost: that is the accuracy loss, measured in the README. A ``radius`` of all bits loses nothing.

    With fewer than two tasks nothing is near anything.
    """
    spark = vectors.sparkSession
    tasks = cut(vectors.select("task_id", "vec", F.md5(F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")).alias("class")))
    # the ids of a class are limited before they are shuffled
    ranked = tasks.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy("task_id"))).where(F.col("rank") <= k + 1)
    own = cut(ranked.groupBy("class").agg(F.array_sort(F.collect_list("task_id")).alias("ids"), F.min(F.when(F.col("rank") == 1, F.col("vec"))).alias("vec")))
    classes = own.select(F.get("ids", F.lit(0)).alias("id"), "vec")
    n = classes.count()
    if n > 1:
        rows = classes.orderBy(F.xxhash64("id")).limit(sample).select("vec").collect()
        bits = max(1, round(log2(max(2.0, n / per_value))))
        code = learn(np.array([r[0] for r in rows], dtype=np.float64), bits, substrings)
        reach = min(bits, radius // substrings)
        prefix_bits = min(bits, max(0, round(log2(max(1.0, n / (SHARE * per_task))))))
        layout = Layout(code, reach, prefix_bits, np.ones((2, substrings, 1 << prefix_bits), np.int64))
        packed = classes.select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("spread"), F.col("vec"))
        packed = map_arrow(packed, _pack, "id string, spread bigint, vec binary")
        _set_parts(packed, layout, n, per_task)
        coded = map_arrow(packed, spread_out(layout), CODED)
        ship(spark)
        found = coded.groupBy("table", "prefix", "ipart", "qpart").applyInArrow(search(bits, reach, k), NEAR)
        best = found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    else:
        best = spark.createDataFrame([], NEAR)
    # from classes back to tasks
    named = own.select(F.get("ids", F.lit(0)).alias("id"), "class", "ids")
    flat = best.select("id", F.explode("near").alias("n")).select("id", F.col("n.d").alias("d"), F.col("n.id").alias("other"))
    flat = flat.join(named.select(F.col("id").alias("other"), "ids"), "other").select("id", "d", F.explode("ids").alias("task"))
    near = flat.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", F.col("task").alias("id")))), 1, k).alias("others"))
    equal = F.transform("ids", lambda t: F.struct(F.lit(0.0).alias("d"), t.alias("id"))).alias("equal")
    per = named.join(near, "id", "left").select("class", equal, F.coalesce("others", F.array().cast("array<struct<d: double, id: string>>")).alias("others"))
    out = _with_class(tasks.select("task_id", "class"), per, hot)
    return out.select("task_id", F.slice(F.concat(F.filter("equal", lambda e: e["id"] != F.col("task_id")), "others"), 1, k).alias("near"))


def _with_class(tasks: DataFrame, per: DataFrame, hot: int) -> DataFrame:
    """``tasks`` with the row of their class. Hot classes, at most 1,000 of them, are joined by broadcast, so their tasks stay where they are."""
    sizes = tasks.groupBy("class").count()
    heavy = [r["class"] for r in sizes.where(F.col("count") > F.greatest(F.lit(hot), F.lit(tasks.count() // 1000))).select("class").collect()]
    if not heavy:
        return tasks.join(per, "class")
    is_heavy = F.col("class").isin(heavy)
    return tasks.where(~is_heavy).join(per, "class").unionByName(tasks.where(is_heavy).join(F.broadcast(per.where(is_heavy)), "class"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            flat = b["vec"].flatten().to_numpy().astype(np.float32).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b["id"], b["spread"], pa.array([r.tobytes() for r in flat], pa.binary())], names=["id", "spread", "vec"])


def _set_parts(packed: DataFrame, layout: Layout, n: int, per_task: int) -> None:
    """Into how many parts each prefix of each index is split, for its vectors and for its queries.

    What comes to the driver is one count per index and prefix, about n / (SHARE * per_task) of each index.
    """
    limit = np.array([SHARE * per_task, per_task])
    if not layout.prefix_bits:
        layout.parts[:] = np.maximum(1, -(-n // limit))[:, None, None]
        return
    for r in map_arrow(packed, counts(layout), "kind int, table int, prefix bigint, n bigint").groupBy("kind", "table", "prefix").agg(F.sum("n").alias("n")).collect():
        if r["n"] > 1.5 * limit[r["kind"]]:
            layout.parts[r["kind"], r["table"], r["prefix"]] = -(-r["n"] // limit[r["kind"]])


def similar_pairs(task_vectors: DataFrame, k: int = 5) -> DataFrame:
    """Distinct (task_a, task_b), smaller id first, where either task is among the other's ``k`` nearest."""
    near = nearest(usable_vectors(task_vectors), k).select("task_id", F.explode("near.id").alias("other"))
    return near.select(F.least("task_id", "other").alias("task_a"), F.greatest("task_id", "other").alias("task_b")).distinct()
