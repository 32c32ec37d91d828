import random
from datetime import datetime, timedelta

from plumbline.llm.topn import best_trials

SCHEMA = "trial_id long, session_id long, estimator_id string, config_id string, perf double, finished_at timestamp, _item int"
AT = datetime(2024, 1, 1)


def brute(rows):
    groups = {}
    for r in {r for r in rows if r[4] is not None and r[4] == r[4] and abs(r[4]) != float("inf")}:
        e = None if r[2] is None else r[2].strip(" \t").lower()
        groups.setdefault((r[1], e), []).append(r)
    out = set()
    for (s, e), own in groups.items():
        seen = set()
        for r in sorted(own, key=lambda r: (-r[4], r[5] is None, r[5] or AT, r[0])):
            c = ("t", r[0]) if r[3] is None else ("c", r[3])
            if c not in seen and len(seen) < 5:
                seen.add(c)
                out.add((s, e, r[0]))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(4000):
        hot = rng.random() < 0.35
        rows.append((k, 1 if hot else rng.choice([None, 2, 3, 4]), "svm" if hot else rng.choice(["a", " A\t", "b", None]), rng.choice([None, *"uvwxyz"]),
                     rng.choice([None, float("nan"), float("inf"), -0.0, 0.0, 0.5, 0.5, 0.7]), rng.choice([None, AT, AT + timedelta(1)]), 1))
    rows += rng.sample(rows, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # groups go over batch ends
    got = [tuple(r) for r in best_trials(df).collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_empty(spark):
    assert best_trials(spark.createDataFrame([], SCHEMA)).count() == 0
