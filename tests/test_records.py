"""Parsing against a plain character-by-character machine."""

import random
import re

from pyspark.sql import functions as F

from plumbline.sources.records import Layout, assemble, loaded_rows, parse, parse_records, rejected


def brute(line, lay):
    """The stated rule, one character at a time."""
    sep, q = lay["sep"], lay["quote_char"]
    if line.endswith("\r"):
        line = line[:-1]
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == q:
            i += 1
            f = ""
            while True:
                if i >= n:
                    return "broken_quoting"
                if line[i] == q:
                    if i + 1 < n and line[i + 1] == q:
                        f += q
                        i += 2
                        continue
                    i += 1
                    break
                f += line[i]
                i += 1
            if i < n and line[i] != sep:
                return "broken_quoting"
        else:
            f = ""
            while i < n and line[i] != sep:
                if line[i] == q:
                    return "broken_quoting"
                f += line[i]
                i += 1
        fields.append(f)
        if i >= n:
            break
        i += 1
    if len(fields) != lay["n_cols"]:
        return "wrong_column_count"
    for f, t in zip(fields, lay["feature_types"]):
        f = f.strip(" \t")
        if not f or f.lower() in {x.lower() for x in lay["na_values"]}:
            continue
        if t == "numerical" and not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", f):
            return "invalid_value"
        if t == "discrete" and not re.fullmatch(r"[+-]?[0-9]+", f):
            return "invalid_value"
    return None


def test_parse_follows_the_rule():
    import json

    rng = random.Random(1)
    for _ in range(30000):
        lay = {"sep": rng.choice(",;|\t"), "quote_char": rng.choice("\"'"), "n_cols": 3, "na_values": ["NA", "-"], "feature_types": ["numerical", "categorical", "discrete"]}
        s, q = lay["sep"], lay["quote_char"]
        parts = ["1", "2.5", "1e5", ".", "x", q, q + q, " ", "\t", "\n", "\r", s, s, "na", "-", q + "a" + s + "b" + q, q + "7" + q, "½", "\x0b", " "]
        line = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        if not line.strip(" \r"):
            continue
        reason, fields = parse(line, json.dumps(lay))
        assert reason == brute(line, lay), (line, lay)
        assert (fields is None) == (reason is not None)


def test_table(spark):
    files = spark.createDataFrame(
        [("a", ",", '"', True, 3, ["p", "q", "r"], ["numerical", "discrete", "categorical"], ["NA", None]), ("b", ";", None, None, 2, None, None, None)],
        "file_id string, sep string, quote_char string, has_header boolean, n_cols int, col_names array<string>, feature_types array<string>, na_values array<string>",
    )
    lines = [
        (1, "a", 1, "p,q,r"), (2, "a", 2, '1.5,7,"x, ""y"""\r'), (3, "a", 3, "na,NA, keep "), (4, "a", 4, "1,2"), (5, "a", 5, '1,2,"x'), (6, "a", 6, "1,2.5,x"),
        (7, "a", 7, "  \r"), (8, "a", 8, None), (9, "b", 1, 'u;"v'), (10, "zz", 1, "1"), (2, "a", 2, '1.5,7,"x, ""y"""\r'), (11, "a", 9, "1,99999999999999999999,x"), (4, "a", 4, "1,2"), (12, "b", 2, "y;" + "z" * 300000), (None, "a", 10, "bad"),
    ]
    raw = spark.createDataFrame(lines, "line_id long, file_id string, line_no long, raw_line string").withColumn("layout", F.lit(1)).withColumn("reason", F.lit(2))
    parsed = parse_records(raw, files)
    assert {tuple(r) for r in rejected(parsed).collect()} == {(4, "wrong_column_count"), (5, "broken_quoting"), (6, "invalid_value"), (10, "no_layout"), (None, "wrong_column_count")}
    rows = {r.line_id: [(c.name, c.kind, c.number, c.whole, c.text) for c in r.cells] for r in loaded_rows(parsed, files).collect()}
    assert set(rows) == {2, 3, 9, 11, 12}
    assert rows[2] == [("p", "numerical", 1.5, None, "1.5"), ("q", "discrete", None, 7, "7"), ("r", "categorical", None, None, 'x, "y"')]
    assert rows[3] == [("p", "numerical", None, None, None), ("q", "discrete", None, None, None), ("r", "categorical", None, None, " keep ")]
    assert rows[11][1] == ("q", "discrete", None, None, "99999999999999999999")
    assert len(rows[12][1][4]) == 300000
    assert parse_records(raw.limit(0), files).count() == 0


def test_layout_without_quote():
    assert Layout('{"sep": ";;", "n_cols": 2}').split('a"b;;c') == ['a"b', "c"]


def test_assemble(spark):
    text = ['a,b', '"x', 'y",c', '', '"p ""q""', '', 'r"', 'end']
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(text)] + [("g", 1, '"open'), ("g", 2, None)], "f string, n long, t string")
    got = {(r.f, r.n): r.t for r in assemble(lines, "f", "n", "t", block=2).collect()}
    assert got == {("f", 1): "a,b", ("f", 2): '"x\ny",c', ("f", 4): "", ("f", 5): '"p ""q""\n\nr"', ("f", 8): "end", ("g", 1): '"open\n'}
