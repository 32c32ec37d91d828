import random
import re

from pyspark.sql import functions as F

from plumbline.llm.splits import FEATURES, overlap_classes, overlap_report, overlapping_rows

SCHEMA = "row_id long, dataset_id string, split string, source string, " + ", ".join(f"n{i} double" for i in range(8)) + ", " + ", ".join(f"c{i} string" for i in range(4)) + ", y string"


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, str):
        norm = lambda s: re.sub(r"[\W_]", "", s.lower())
        return norm(a) == norm(b)
    if not all(abs(x) < float("inf") for x in (a, b)):
        return False
    return abs(a - b) <= 0.005 * max(abs(a), abs(b))


def brute(rows):
    rows = list({r[0]: r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None}.values())
    kind = lambda r: r[2].strip(" \t").lower()
    train, test = [r for r in rows if kind(r) == "train"], [r for r in rows if kind(r) in ("test", "valid")]
    return {(a[0], b[0]): n for a in train for b in test if a[1] == b[1] and (n := sum(same(x, y) for x, y in zip(a[4:16], b[4:16]))) >= 10}


def make(rng):
    base = [[rng.choice([None, 0.0, float("nan"), rng.gauss(0, 1), rng.lognormvariate(0, 3), -1e-310, 170.0]) for _ in range(8)] + [rng.choice([None, "", "Lower Ridge", "forêt", "q1", "."]) for _ in range(4)] for _ in range(7)]
    rows = []
    for k in range(500):
        f = list(rng.choice(base))
        for i in range(8):
            if f[i] is not None and rng.random() < 0.5:
                f[i] *= rng.choice([1, 1.0049, 0.9952, 1 / 0.995, 1.0052, 0.994, -1])
        for i in range(8, 12):
            if f[i] and rng.random() < 0.3:
                f[i] = rng.choice([f[i].upper() + " ", f[i].replace(" ", "_") + ".", "other"])
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            f[rng.randrange(12)] = None
        rows.append((k, rng.choice(["d", "d", "e", None]), rng.choice(["train", " TRAIN", "test\t", "Valid", None, "dev"]), rng.choice(["s", None]), *f, "1"))
    return rows + rng.sample(rows, 60) + [(None, "d", "train", None, *base[0], None)]


def test_all_pairs_found(spark):
    rows = make(random.Random(11))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("loaded_at", F.current_timestamp()).withColumn("agree", F.lit(0))
    want = brute(rows)
    got = overlapping_rows(df).collect()
    assert {(r.train_row, r.eval_row): r.agree for r in got} == want and len(got) == len(want) > 100
    assert all(abs(r.overlap - r.agree / len(FEATURES)) < 1e-12 for r in got)
    report = {(r.split, r.source): (r.n_rows, r.n_pairs, r.n_equal_pairs) for r in overlap_report(df).collect()}
    by = {r[0]: r for r in rows}
    made = {}
    for (_, b), n in want.items():
        made.setdefault((by[b][2].strip(" \t").lower(), by[b][3]), []).append((b, n))
    assert report == {k: (len({b for b, _ in v}), len(v), sum(n == 12 for _, n in v)) for k, v in made.items()}


def test_copies_and_empty(spark):
    one = (1.5,) * 8 + ("a",) * 4
    rows = [(k, "d", "train" if k % 2 else "test", "s", *one, None) for k in range(60)] + [(100, "d", "test", "s", *one[:11], "x" * 200000, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("loaded_at", F.lit(None).cast("timestamp"))
    assert overlapping_rows(df).count() == 31 * 30
    assert [tuple(r) for r in overlap_report(df).collect()] == [("test", "s", 31, 930, 900)]
    assert overlapping_rows(df.limit(0)).count() == 0


def test_classes_and_hot_copies(spark):
    rng = random.Random(11)
    rows = make(rng)
    last = max(r[0] for r in rows if r[0] is not None)
    copy = next(r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and r[2].strip(" \t").lower() == "train")
    rows += [(last + 1 + i, *copy[1:]) for i in range(40)] + [(last + 100 + i, copy[1], "test", *copy[3:]) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("loaded_at", F.lit(None).cast("timestamp"))
    want = brute(rows)
    got = {(r.train_row, r.eval_row): r.agree for r in overlapping_rows(df, hot=8).collect()}
    assert got == want
    pairs, members = overlap_classes(df, hot=8)
    of = {r.row_id: r.class_row for r in members.collect()}
    listed = {(r.train_row, r.eval_row): r for r in pairs.collect()}
    assert {(of[a], of[b]): n for (a, b), n in want.items()} == {k: r.agree for k, r in listed.items()}
    assert sum(r.n_train * r.n_eval for r in listed.values()) == len(want)
