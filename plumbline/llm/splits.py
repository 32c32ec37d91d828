"""Records of evaluation splits that recur, exactly or nearly, in the training split."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut, one_delivery

NUMBERS = [f"n{i}" for i in range(8)]
TEXTS = [f"c{i}" for i in range(4)]
FEATURES = NUMBERS + TEXTS
TOLERANCE = 0.005
#: At least so many of the 12 features agree.
NEED = 10
#: A normalised record is cut into six chunks of two features. Two features that differ spoil two chunks at most,
#: so near copies share at least four whole chunks.
CHUNKS = [FEATURES[i : i + 2] for i in range(0, 12, 2)]
SHARED = len(CHUNKS) - (len(FEATURES) - NEED)
#: Width of a number's cell as a logarithm. A value lies within the tolerance of a second cell with
#: probability 0.1, so probes stay few.
CELL = 0.1
#: Rows that a class of equal records, or a part of it, holds in a join.
HOT = 100_000
#: -ln(1 - TOLERANCE), rounded up.
REACH = 0.00502


def normal_text(c: Column) -> Column:
    """Lower case, letters and digits only; null stays null."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def number_cells(c: Column, reach: float) -> Column:
    """The cells on a logarithmic grid that hold values within ``reach`` of a number, one or two.

    Two numbers that agree share a cell if one of them is taken with ``reach`` 0 and the other with REACH.
    Null, zero and non-finite values have cells of their own.
    """
    ln = F.ln(F.abs(c))
    near = F.transform(F.sequence(F.floor((ln - reach) / CELL).cast("long"), F.floor((ln + reach) / CELL).cast("long")), lambda k: k * 2 + F.when(c < 0, 1).otherwise(0))
    own = lambda k: F.array(F.lit(k).cast("long"))
    return F.when(c.isNull(), own(1 << 60)).when(F.isnan(c) | (F.abs(c) == float("inf")), own(1 << 61)).when(c == 0, own(1 << 62)).otherwise(near)


def _product(parts: list[Column], combine) -> Column:
    """``combine`` of every choice of one element from each array."""

    def over(rest: list[Column], chosen: list[Column]) -> Column:
        if len(rest) == 1:
            return F.transform(rest[0], lambda x: combine([*chosen, x]))
        return F.flatten(F.transform(rest[0], lambda x: over(rest[1:], [*chosen, x])))

    return over(parts, [])


def with_digests(records: DataFrame, reach: float) -> DataFrame:
    """(_class, _digest): a record under each choice of SHARED of its chunks and of the cells at hand."""
    cells = {f: number_cells(F.col(f), reach) for f in NUMBERS} | {f: F.array(F.xxhash64(F.col(f).isNull(), F.coalesce(F.col(f), F.lit("")))) for f in TEXTS}
    chunks = [_product([cells[f] for f in c], lambda xs, i=i: F.xxhash64(F.lit(i), *xs)).alias(f"_chunk{i}") for i, c in enumerate(CHUNKS)]
    digests = [
        _product([F.col(f"_chunk{i}") for i in chosen], lambda xs, k=k: F.xxhash64(F.lit(k), F.col("dataset_id"), *xs))
        for k, chosen in enumerate(combinations(range(len(CHUNKS)), SHARED))
    ]
    return records.select("_class", "dataset_id", *chunks).select("_class", F.explode(F.array_distinct(F.flatten(F.array(*digests)))).alias("_digest"))


def agreeing(a: str, b: str) -> Column:
    """How many of the features agree; null agrees only with null, NaN and infinite values with nothing."""

    def number(f: str) -> Column:
        x, y = F.col(f"{a}.{f}"), F.col(f"{b}.{f}")
        big = F.greatest(F.abs(x), F.abs(y))
        finite = ~F.isnan(x) & ~F.isnan(y) & (big < float("inf"))
        return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(finite & (F.abs(x - y) <= TOLERANCE * big))

    same = [number(f) for f in NUMBERS] + [F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")) for f in TEXTS]
    return reduce(lambda s, c: s + c.cast("int"), same, F.lit(0))


def records(split_rows: DataFrame) -> DataFrame:
    """Rows that take part, each once, normalised, with a digest of everything that is compared."""
    rows = one_delivery(split_rows, "row_id", "loaded_at", ["dataset_id", "split", "source", *FEATURES])
    kind = F.lower(F.trim("split", F.lit(" \t")))
    rows = rows.select("row_id", "dataset_id", kind.alias("split"), "source", *NUMBERS, *[normal_text(F.col(c)).alias(c) for c in TEXTS])
    rows = rows.where(F.col("split").isin("train", "test", "valid") & F.col("dataset_id").isNotNull()).withColumn("_train", F.col("split") == "train")
    return rows.withColumn("_class", F.md5(F.to_json(F.struct("dataset_id", "_train", *FEATURES))))


def overlaps(split_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overlaps between classes of equal records, and the rows of each class.

    First table: (train_class, eval_class, agree, overlap): the number of agreeing features, and the shared
    length as a fraction of the record. Second table: the rows that take part, with their class.

    Equal records form one class, found once, so a group of copies that holds a third of all rows costs what
    one record costs. Classes that share the digest of four chunks are candidates; every overlap with at least NEED
    agreeing features is one, and each candidate is compared feature by feature.
    Splits other than train, test and valid, rows without a data set, and rows without a key take no part.
    An empty table gives empty results.
    """
    rows = cut(records(split_rows))
    classes = cut(rows.groupBy("_class").agg(F.min(F.struct("row_id", "_train", "dataset_id", *FEATURES)).alias("r")).select("_class", "r.*"))
    train = with_digests(classes.where("_train"), 0.0).withColumnRenamed("_class", "train_class")
    test = with_digests(classes.where("not _train"), REACH).withColumnRenamed("_class", "eval_class")
    pairs = train.join(test, "_digest").select("train_class", "eval_class").distinct()
    whole = F.struct(*FEATURES)
    pairs = pairs.join(classes.select(F.col("_class").alias("train_class"), whole.alias("a")), "train_class").join(classes.select(F.col("_class").alias("eval_class"), whole.alias("b")), "eval_class")
    found = pairs.select("train_class", "eval_class", agreeing("a", "b").alias("agree")).where(F.col("agree") >= NEED)
    return found.withColumn("overlap", F.col("agree") / len(FEATURES)), rows


def hot_classes(rows: DataFrame, hot: int = HOT) -> dict[str, int]:
    """Classes with more than ``hot`` rows and more than a thousandth of all, so at most 1,000, and into how many parts they are dealt."""
    sizes = rows.groupBy("_class").count()
    limit = F.greatest(F.lit(hot), F.lit(rows.count() // 1000))
    return {r["_class"]: -(-r["count"] // hot) for r in sizes.where(F.col("count") > limit).collect()}


def spread_join(classes: DataFrame, rows: DataFrame, key: str, row: str, parts: dict[str, int]) -> DataFrame:
    """The join of ``classes`` with the rows of each class on ``key``; the rows of a hot class are dealt into parts by ``row``, for each of which its classes stand once more."""
    if not parts:
        return classes.join(rows, key)
    n = F.coalesce(F.try_element_at(F.create_map(*[x for c, k in parts.items() for x in (F.lit(c), F.lit(k))]), F.col(key)), F.lit(1))
    left = classes.withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1)))
    return left.join(rows.withColumn("_part", F.pmod(F.xxhash64(row), n).cast("int")), [key, "_part"]).drop("_part")


def overlapping_rows(split_rows: DataFrame, hot: int = HOT) -> DataFrame:
    """The overlaps as pairs of rows: (train_row, eval_row, split, source, agree, overlap). ``overlap_classes`` doesn't list the rows of copies."""
    found, rows = overlaps(split_rows)
    parts = hot_classes(rows, hot)
    a = rows.select(F.col("_class").alias("train_class"), F.col("row_id").alias("train_row"))
    b = rows.select(F.col("_class").alias("eval_class"), F.col("row_id").alias("eval_row"), "split", "source")
    pairs = spread_join(spread_join(found, a, "train_class", "train_row", parts), b, "eval_class", "eval_row", parts)
    return pairs.select("train_row", "eval_row", "split", "source", "agree", "overlap")


def overlap_classes(split_rows: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Overlaps between classes of equal records without listing their rows.

    First table: (train_row, eval_row, agree, n_train, n_eval), one row per pair of classes, each named by its smallest row id, with the number of its rows. Second table:
    (row_id, class_row, train), one row per record that takes part. Classes with no overlap stand in the second table only.
    """
    found, rows = overlaps(split_rows)
    sizes = rows.groupBy("_class").agg(F.min("row_id").alias("class_row"), F.count("*").alias("n"))
    a = sizes.select(F.col("_class").alias("train_class"), F.col("class_row").alias("train_row"), F.col("n").alias("n_train"))
    b = sizes.select(F.col("_class").alias("eval_class"), F.col("class_row").alias("eval_row"), F.col("n").alias("n_eval"))
    pairs = found.join(a, "train_class").join(b, "eval_class").select("train_row", "eval_row", "agree", "n_train", "n_eval")
    members = spread_join(sizes.select("_class", "class_row"), rows.select("_class", "row_id", F.col("_train").alias("train")), "_class", "row_id", hot_classes(rows, hot))
    return pairs, members.select("row_id", "class_row", "train")


def overlap_report(split_rows: DataFrame) -> DataFrame:
    """For each evaluation split and source: rows that overlap the training split, pairs, and pairs that agree in every feature.

    Pairs are counted by class, not listed, so many copies on both sides cost nothing.
    """
    found, rows = overlaps(split_rows)
    train = rows.where("_train").groupBy(F.col("_class").alias("train_class")).agg(F.count("*").alias("_n"))
    per = found.join(train, "train_class").groupBy("eval_class").agg(F.sum("_n").alias("_pairs"), F.sum(F.when(F.col("agree") == len(FEATURES), F.col("_n")).otherwise(0)).alias("_same"))
    own = rows.where("not _train").groupBy(F.col("_class").alias("eval_class"), "split", "source").agg(F.count("*").alias("_m"))
    return own.join(per, "eval_class").groupBy("split", "source").agg(F.sum("_m").alias("n_rows"), F.sum(F.col("_m") * F.col("_pairs")).alias("n_pairs"), F.sum(F.col("_m") * F.col("_same")).alias("n_equal_pairs"))
