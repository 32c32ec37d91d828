"""Texts put into containers of fixed capacity by bin completion."""

from __future__ import annotations

import base64
import random
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut, map_arrow, ship

TOKENIZERS = "/opt/tokenizers"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Containers that the items of one task fill, about. More waste less (only the last is partly empty) and take longer.
BINS = 256
#: Items of one task, at most on average.
ITEMS = 8192
#: Steps of one search for a packing of one task's items, three a microsecond. Where they end first, the packing is marked as not proved.
STEPS = 1_500_000
#: Steps after which a search for fillings looks up.
PAUSE = 32
#: Steps that a band of waste gets at first, in a first and a second search: few, and as many as it takes.
PATIENCE = (128, 1 << 40)
PACKED = "target_id int, container bigint, doc_id bigint, part int, start bigint, n_tokens bigint"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; ``sizes`` descending. Containers as lists of positions."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (space left, container), ascending
    for i, s in enumerate(sizes):
        at = bisect_left(room, (s, -1))
        if at == len(room):
            bins.append([i])
            left, b = capacity - s, len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            left -= s
        insort(room, (left, b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs: by volume, and with items over half the capacity apart (Martello and Toth)."""
    total = sum(sizes)
    bound = -(-total // capacity)
    ascending = sizes[::-1]
    sums = [0]
    for s in ascending:
        sums.append(sums[-1] + s)
    n = len(sizes)
    half = n - bisect_right(ascending, capacity // 2)
    for k in {s for s in ascending[: bisect_right(ascending, capacity // 2)]} | {0}:
        large = n - bisect_right(ascending, capacity - k)
        middle = half - large
        lo, hi = bisect_left(ascending, k), n - half
        small = sums[hi] - sums[lo]
        space = middle * capacity - (sums[n - large] - sums[hi])
        bound = max(bound, large + middle + max(0, -(-(small - space) // capacity)))
    return bound


class Remaining:
    """Sizes still to be packed, with their counts, and a key that tells such states apart."""

    def __init__(self, sizes: list[int]) -> None:
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.sizes = sorted(self.count)
        self.left = len(sizes)
        self.total = sum(sizes)
        rng = random.Random(0)
        self.mark = {s: rng.getrandbits(120) for s in self.sizes}
        self.key = sum(self.mark[s] * n for s, n in self.count.items())

    def take(self, chosen: list[int]) -> None:
        for s in chosen:
            self.left -= 1
            self.total -= s
            self.key -= self.mark[s]
            if self.count[s] == 1:
                del self.count[s]
                self.sizes.pop(bisect_left(self.sizes, s))
            else:
                self.count[s] -= 1

    def put(self, chosen: list[int]) -> None:
        for s in chosen:
            self.left += 1
            self.total += s
            self.key += self.mark[s]
            if s not in self.count:
                self.count[s] = 0
                insort(self.sizes, s)
            self.count[s] += 1


class Spent(Exception):
    """The steps of a search are used up, so what it didn't find may still exist."""


class Steps:
    def __init__(self, n: int) -> None:
        self.left = n

    def use(self, n: int = 1) -> None:
        self.left -= n
        if self.left < 0:
            raise Spent


def dominated(rest: Remaining, chosen: list[int], slack: int) -> bool:
    """Whether some of the ``chosen`` sizes, or none, can give way to one larger size at hand within the space left.

    What fits the larger size's place elsewhere then fits the smaller ones too, so the filling need not be tried. Of
    fillings with more than ten sizes only exchanges of up to two are looked at; more fillings are tried then, none is lost.
    """
    most = len(chosen) if len(chosen) <= 10 else 2
    used = Counter(chosen)
    for k in range(most + 1):
        for given in set(combinations(chosen, k)):
            total = sum(given)
            at = bisect_right(rest.sizes, total) if k == 1 else bisect_left(rest.sizes, total)
            while at < len(rest.sizes) and rest.sizes[at] <= total + slack:
                if rest.count[rest.sizes[at]] > used[rest.sizes[at]]:
                    return True
                at += 1
    return False


def fillings(rest: Remaining, space: int, waste: int, steps: Steps, patience: int) -> Iterator[list[int]]:
    """All undominated ways to fill ``space`` from ``rest`` that leave at most ``waste``, one at a time.

    They are looked for in bands of waste: none, then wider and wider ones. A band in which ``patience`` steps find nothing waits until
    the wider ones had theirs, then goes on with twice as many, so full fillings come early and all come in the end.
    ``rest`` must be the same whenever the next filling is asked for.
    """
    bands, lo = [], 0
    while lo <= min(waste, space):
        hi = min(waste, space, 2 * lo)
        bands.append(_sums(rest, space - hi, space - lo))
        lo = hi + 1
    while bands:
        waiting = []
        for band in bands:
            spent = 0
            for chosen in band:
                if chosen is None:
                    steps.use(PAUSE)
                    spent += PAUSE
                    if spent >= patience:
                        waiting.append(band)
                        break
                    continue
                steps.use(len(chosen) + 1)
                if not dominated(rest, chosen, space - sum(chosen)):
                    yield chosen
                    spent = 0
            else:
                steps.use(PAUSE // 2)
        bands, patience = waiting, 2 * patience


def _sums(rest: Remaining, low: int, high: int) -> Iterator[list[int] | None]:
    """All multisets of the sizes at hand whose sum lies in [low, high], each once, larger sizes first; None after every PAUSE steps."""
    sizes, count = rest.sizes, rest.count
    if low <= 0:
        yield []
    chosen: list[int] = []
    levels = [bisect_right(sizes, high) - 1]  # per level: where the size to try next stands
    total = taken = 0
    while levels:
        at = levels[-1]
        taken += 1
        if taken == PAUSE:
            taken = 0
            yield None
        if at < 0 or total + min(rest.total, sizes[at] * rest.left) < low:  # all that is left falls short
            levels.pop()
            if chosen:
                total -= chosen.pop()
            continue
        s = sizes[at]
        if total + s < low and total + s + sizes[0] > high:  # too small to close the gap, too large for another beside it
            levels[-1] = min(at - 1, bisect_right(sizes, high - total - sizes[0]) - 1)
            continue
        levels[-1] = at - 1
        if chosen and s == chosen[-1] and count[s] <= chosen.count(s):
            continue
        chosen.append(s)
        total += s
        if total >= low:
            yield list(chosen)
        levels.append(min(at, bisect_right(sizes, high - total) - 1))


def complete(sizes: list[int], capacity: int, most: int, steps: Steps, patience: int = PATIENCE[0]) -> list[list[int]] | None:
    """A packing (as sizes) into at most ``most`` containers, or None if there is none; raises Spent when the steps end first.

    Depth-first over the undominated fillings around the largest item left. A branch ends where the space wasted so far
    exceeds what ``most`` containers can waste, and where the same items were left before with no less waste to spare.
    """
    rest = Remaining(sizes)
    waste = most * capacity - rest.total
    if waste < 0:
        return None
    failed: dict[int, int] = {}
    path: list[list[int]] = []
    stack: list[tuple[Iterator[list[int]], int, int]] = []  # fillings to try, waste to spare, key of the items left

    def enter(waste: int) -> None:
        largest = rest.sizes[-1]
        key = rest.key
        rest.take([largest])
        stack.append((fillings(rest, capacity - largest, waste, steps, patience), waste, key))
        path.append([largest])

    if not rest.left:
        return []
    enter(waste)
    while stack:
        options, waste, key = stack[-1]
        filling = next(options, None)
        if filling is None:
            failed[key] = max(waste, failed.get(key, -1))
            stack.pop()
            rest.put(path.pop()[:1])
            if path:
                rest.put(path[-1][1:])
                del path[-1][1:]
            continue
        rest.take(filling)
        path[-1] += filling
        left = waste - (capacity - sum(path[-1]))
        if not rest.left:
            return path
        if failed.get(rest.key, -1) >= left:
            rest.put(filling)
            del path[-1][1:]
            continue
        enter(left)
    return None


def _search(sizes: list[int], capacity: int, most: int, steps: int) -> tuple[list[list[int]] | None, bool]:
    """(a packing into ``most`` containers or None, whether that is certain)."""
    for patience in PATIENCE:
        try:
            return complete(sizes, capacity, most, Steps(steps), patience), True
        except Spent:
            continue
    return None, False


def pack(sizes: list[int], capacity: int, steps: int = STEPS) -> tuple[list[list[int]], int]:
    """(containers as lists of positions in ``sizes``, a bound that no packing can go below).

    Best fit decreasing gives the first packing. Bin completion then looks for one with as many containers as the lower bound says.
    Where it shows that there is none, the bound goes up by one. Where its ``steps`` end before, it looks for packings that are one container
    better than the best so far, as long as it finds any in as many steps. The packing is proved optimal if it has as many
    containers as the bound. Items of size 0 go where there is a container; every size must be within the capacity.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    real = [i for i in order if sizes[i] > 0]
    empty = [i for i in order if sizes[i] == 0]
    down = [sizes[i] for i in real]
    best = [[down[p] for p in b] for b in best_fit(down, capacity)]
    bound = lower_bound(down, capacity) if down else 0
    while len(best) > bound:
        found, certain = _search(down, capacity, bound, steps)
        if found is not None:
            best = found
        elif certain:
            bound += 1
        else:
            break
    while len(best) > bound + 1:
        found, certain = _search(down, capacity, len(best) - 1, steps)
        if found is None:
            bound = len(best) if certain else bound
            break
        best = found
    by: dict[int, list[int]] = {}
    for i in reversed(real):
        by.setdefault(sizes[i], []).append(i)
    bins = [[by[s].pop() for s in b] for b in best]
    if empty:
        if not bins:
            bins.append([])
            bound = 1
        bins[-1].extend(empty)
    return bins, bound


def _count(batches: Iterator[pa.RecordBatch], tokenizers: str) -> Iterator[pa.RecordBatch]:
    lines = Path(tokenizers, "byte_bpe_50k.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for b in batches:
        n = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["mark"], pa.array(n, pa.int64())], names=["doc_id", "mark", "n"])


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, mark, n): tokens of byte_bpe_50k in each text, 0 for null and empty ones. Equal rows come out once; mark tells texts under one id apart."""
    rows = documents.select("doc_id", F.xxhash64(F.lit(7), "text").alias("mark"), "text")
    return map_arrow(rows, partial(_count, tokenizers=tokenizers), "doc_id bigint, mark bigint, n bigint").distinct()


def _pack_group(steps: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        target, capacity, chunk = t["target_id"][0].as_py(), t["capacity"][0].as_py(), t["chunk"][0].as_py()
        docs = sorted(zip(t["doc_id"].to_pylist(), t["mark"].to_pylist(), t["n"].to_pylist()), key=lambda d: (d[0] is None, d[0] or 0, d[1]))
        items, full = [], []
        for doc, _, n in docs:
            whole, rest = divmod(n, capacity)
            if whole and not rest:
                whole, rest = whole - 1, capacity
            full += [(doc, p, p * capacity, capacity) for p in range(whole)]
            items.append((doc, whole, whole * capacity, rest))
        packed, least = pack([x[3] for x in items], capacity, steps)
        bins = [[x] for x in full] + [[items[i] for i in b] for b in packed]
        rows = [(chunk * (1 << 32) + k, *x) for k, b in enumerate(bins) for x in b]
        cols = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        arrays = [pa.array([target] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array([len(full) + least] * len(rows), pa.int64())]
        return pa.table(arrays, names=["target_id", "container", "doc_id", "part", "start", "n_tokens", "least"])

    return run


def _packed(documents: DataFrame, targets: DataFrame, tokenizers: str, bins: int, items: int, steps: int) -> DataFrame:
    """The packed rows with ``least``: how many containers their group needs at least."""
    counts = cut(token_counts(documents, tokenizers))
    size = counts.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    wanted = targets.where("capacity > 0").select(F.col("target_id").cast("int").alias("target_id"), F.col("capacity").cast("long").alias("capacity")).distinct()
    chunks = F.greatest(F.lit(1), F.least(F.ceil(F.lit(size["n"] or 0) / (F.col("capacity") * bins)), F.lit(max(1, size["k"] // (items // 2)))), F.lit(-(-size["k"] // items)))
    wanted = wanted.withColumn("chunks", chunks.cast("long")).orderBy("target_id", "capacity").limit(1001).collect()
    if len(wanted) > 1000:
        raise ValueError("more than 1000 targets")
    if not wanted:
        return documents.sparkSession.createDataFrame([], PACKED + ", least bigint")
    each = F.explode(F.array(*[F.struct(F.lit(w["target_id"]).cast("int").alias("target_id"), F.lit(w["capacity"]).cast("long").alias("capacity"), F.lit(w["chunks"]).cast("long").alias("chunks")) for w in wanted]))
    rows = counts.select("doc_id", "mark", "n", each.alias("t")).select("t.target_id", "t.capacity", F.pmod(F.xxhash64("doc_id", "mark"), F.col("t.chunks")).alias("chunk"), "doc_id", "mark", "n")
    # the rows are few bytes and long work, so the number of tasks follows the groups, not the bytes
    groups, cores = sum(w["chunks"] for w in wanted), documents.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(max(1, min(groups, max(4 * cores, groups // 8))), "target_id", "capacity", "chunk")
    ship(documents.sparkSession)
    return rows.groupBy("target_id", "capacity", "chunk").applyInArrow(_pack_group(steps), PACKED + ", least bigint")


def containers(documents: DataFrame, targets: DataFrame, tokenizers: str = TOKENIZERS, bins: int = BINS, items: int = ITEMS, steps: int = STEPS) -> DataFrame:
    """Every text assigned to a container of each target: (target_id, container, doc_id, part, start, n_tokens).

    A text is cut only where it alone exceeds the capacity: into full containers and a rest that is packed
    like other items; ``start`` is the first token of the part. Null and empty texts have no tokens and go into some
    container. Rows that are equal in doc_id and text are one item; texts under one id are items of
    their own. Targets with a null or non-positive capacity hold nothing.

    Texts are counted where they are read; only (doc_id, count) is shuffled, by target and a hash, into groups
    of at most about ``items`` texts and at least half as many, unless fewer fill ``bins`` containers. A group is packed by itself; its last container may stay partly
    empty, so less than about 1 / ``bins`` of the space is lost to the division. A search in a group ends after ``steps``;
    ``report`` tells where that left a packing unproved.
    """
    return _packed(documents, targets, tokenizers, bins, items, steps).drop("least")


def report(documents: DataFrame, targets: DataFrame, tokenizers: str = TOKENIZERS, bins: int = BINS, items: int = ITEMS, steps: int = STEPS) -> DataFrame:
    """How full the containers of each target are: (target_id, n_containers, volume_bound, group_bound, fill, n_groups, n_proved).

    ``volume_bound`` is the tokens over the capacity, rounded up: no packing of all texts needs fewer. ``group_bound`` is what the groups of texts need at least, each
    packed by itself; ``n_proved`` of the ``n_groups`` groups are packed into just as many.
    """
    packed = _packed(documents, targets, tokenizers, bins, items, steps)
    groups = packed.groupBy("target_id", F.shiftright("container", 32).alias("chunk")).agg(F.count_distinct("container").alias("n"), F.min("least").alias("least"), F.sum("n_tokens").alias("tokens"))
    per = groups.groupBy("target_id").agg(F.sum("n").alias("n_containers"), F.sum("least").alias("group_bound"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_groups"), F.sum((F.col("n") == F.col("least")).cast("long")).alias("n_proved"))
    known = targets.where("capacity > 0").select(F.col("target_id").cast("int").alias("target_id"), "capacity").distinct()
    return per.join(known, "target_id").select("target_id", "n_containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("volume_bound"), "group_bound", F.round(F.col("tokens") / (F.col("capacity") * F.col("n_containers")), 4).alias("fill"), "n_groups", "n_proved")
