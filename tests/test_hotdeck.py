import random

from pyspark.sql import functions as F

from plumbline.operators.hotdeck import fill_nodes, hot_deck


def brute(rows):
    """rows: (key, group, time, value); the donor by scanning the group."""
    out = {}
    for key, group, time, value in rows:
        own = sorted([r for r in rows if r[1] == group and group is not None], key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        at = next((i for i, r in enumerate(own) if r[0] == key), None)
        if value is not None or at is None:
            out[key] = (value, False, None)
            continue
        prev = next((r for r in own[:at][::-1] if r[3] is not None), None)
        nxt = next((r for r in own[at + 1 :] if r[3] is not None), None)
        gap = lambda r: None if r is None or r[2] is None or time is None else abs(r[2] - time)
        donor = nxt if prev is None or (nxt is not None and gap(nxt) is not None and gap(prev) is not None and gap(nxt) < gap(prev)) else prev
        out[key] = (None, False, None) if donor is None else (donor[3], True, gap(donor))
    return out


def test_nearest_donor(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None] + list(range(40))), rng.choice([None, None, "a", "b", "c"])) for k in range(600)]
    df = spark.createDataFrame(rows, "k long, g long, s long, v string").withColumn("t", F.timestamp_seconds("s")).withColumn("_key", F.lit("clash"))
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    got = {r.k: (r.v, r.v_filled, r.v_distance) for r in hot_deck(df, {"v": F.col("v").isNull()}, "g", "t", "k").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == {k: (v, f, None if d is None else float(d)) for k, (v, f, d) in brute(rows).items()}


def test_missing_rules_and_edges(spark):
    sets = spark.createDataFrame([("d", ["numerical", "categorical"], ["N/A", "9999", None]), ("e", None, None), (None, None, None)], "dataset_id string, feature_types array<string>, na_values array<string>")
    rows = spark.createDataFrame(
        [(1, 1, "d", "1.5", "n/a"), (2, 1, "d", " 9999\t", "9999x"), (3, 1, "d", "abc", "  "), (4, 1, "d", "-.5e3", "abc"), (4, 1, "d", "-.5e3", "abc"), (5, 2, "e", "N/A", None), (6, 3, "zz", None, "n/a"), (None, 1, "d", None, None), (7, 4, "d", "1\n", "x" * 100000)],
        "row_id long, node_id long, dataset_id string, x0 string, x1 string",
    ).withColumn("recorded_at", F.timestamp_seconds(F.col("row_id"))).withColumn("arrived_at", F.timestamp_seconds(F.col("row_id"))).withColumn("v0", F.lit(0))
    got = {r.row_id: r for r in fill_nodes(rows, sets, ["x0", "x1"]).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}
    assert [(got[k].x0, got[k].x0_missing, got[k].x0_filled, got[k].x0_distance) for k in (1, 2, 3, 4)] == [("1.5", False, False, None), ("1.5", True, True, 1.0), ("-.5e3", True, True, 1.0), ("-.5e3", False, False, None)]
    assert [(got[k].x1, got[k].x1_missing, got[k].x1_filled) for k in (1, 2, 3, 4)] == [("9999x", True, True), ("9999x", False, False), ("9999x", True, True), ("abc", False, False)]
    assert (got[5].x0, got[5].x0_missing, got[5].x1_missing, got[5].x1_filled) == ("N/A", False, True, False)
    assert (got[6].x0_filled, got[6].x1) == (False, "n/a")
    assert got[7].x0_missing and not got[7].x0_filled
    assert fill_nodes(rows.limit(0), sets, ["x0", "x1"]).count() == 0
