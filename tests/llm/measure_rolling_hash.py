"""How much of near-equal records rolling-hash chunks share: run as ``python tests/llm/measure_rolling_hash.py FOLDER``; not a test.

A record is written as its normalised features, numbers with so many significant digits or as cells of the logarithmic grid of ``splits.number_cells``,
cut where a rolling hash over eight characters is 0 modulo 8, and two records share the chunks that are equal.
"""

import math
import re
import sys
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from plumbline.llm.queries import _P3  # noqa: E402
from plumbline.llm.splits import CELL, NUMBERS, TEXTS  # noqa: E402


def chunks(text: str, window: int = 8, modulus: int = 8) -> list[str]:
    out, start, h = [], 0, 0
    for i, c in enumerate(text):
        h = (h * 257 + ord(c)) % (1 << 61)
        if i >= window:
            h = (h - ord(text[i - window]) * pow(257, window, 1 << 61)) % (1 << 61)
        if (h >> 20) % modulus == 0 and i + 1 > start:
            out.append(text[start : i + 1])
            start = i + 1
    return [*out, text[start:]] if start < len(text) else out


def written(row, numbers: str) -> str:
    cells = []
    for x in row[: len(NUMBERS)]:
        if x is None or not math.isfinite(x) or x == 0:
            cells.append(str(x))
        elif numbers == "cells":
            cells.append(f"{'-' if x < 0 else ''}{math.floor(math.log(abs(x)) / CELL)}")
        else:
            cells.append(f"{x:.{numbers}g}")
    return "|".join(cells + [str(x) for x in row[len(NUMBERS) :]])


def main(folder: str) -> None:
    con = duckdb.connect()
    con.sql(f"create view split_rows as select * from '{folder}/split_rows.parquet'")
    pairs = con.sql(_P3 + "select ra, rb from p where agree >= 10").fetchall()
    rows = {r[0]: [*r[1:9], *(None if t is None else re.sub(r"[\W_]", "", t.lower()) for t in r[9:])] for r in con.sql(f"select distinct row_id, {', '.join(NUMBERS + TEXTS)} from split_rows").fetchall()}
    for numbers in ("6", "3", "2", "cells"):
        share = []
        for a, b in pairs:
            x, y = written(rows[a], numbers), written(rows[b], numbers)
            both = Counter(chunks(x)) & Counter(chunks(y))
            share.append(sum(len(c) * n for c, n in both.items()) / max(1, min(len(x), len(y))))
        print(f"numbers as {numbers}: of {len(pairs)} pairs {sum(s >= 0.8 for s in share) / len(share):.0%} share at least 0.8 of the shorter record, {sum(s == 0 for s in share) / len(share):.0%} nothing")


if __name__ == "__main__":
    main(sys.argv[1])
