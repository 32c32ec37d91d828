"""Delimited records parsed under their file's layout; what can't be loaded comes out with a reason."""

from __future__ import annotations

import csv
import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import map_arrow

DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
WHOLE = re.compile(r"[+-]?[0-9]+")
BROKEN, COUNT, INVALID, UNKNOWN = "broken_quoting", "wrong_column_count", "invalid_value", "no_layout"
PARSED = "line_id bigint, file_id string, line_no bigint, reason string, fields array<string>"


class Layout:
    """How one file is laid out, with its patterns compiled; kept for all records of a task."""

    def __init__(self, text: str) -> None:
        d = json.loads(text)
        self.sep, self.quote = d.get("sep") or ",", d.get("quote_char") or ""
        self.n = d.get("n_cols")
        self.tokens = {t.lower() for t in d.get("na_values") or [] if t is not None}
        types = [(t or "").lower() for t in d.get("feature_types") or []]
        self.check = [DECIMAL.fullmatch if t == "numerical" else WHOLE.fullmatch if t == "discrete" else None for t in types]
        s, q = re.escape(self.sep), re.escape(self.quote)
        plain = rf"(?:(?!{s}){f'(?!{q})' if q else ''}.)*+"
        self.field = re.compile(rf"{q}(?:[^{q}]|{q}{q})*+{q}(?={s}|\Z)|{plain}(?={s}|\Z)" if q else plain, re.S)
        # the csv module takes one character each, and no line break or equal pair
        self.csv = len(self.sep) == 1 and len(self.quote) <= 1 and self.sep != self.quote and not {self.sep, self.quote} & {"\n", "\r"} and self.sep != " "

    def split(self, line: str) -> list[str] | None:
        """The fields, or None where the quoting is broken."""
        quoted = self.quote and self.quote in line
        if self.csv:
            # the strict reader assembles the physical lines of a quoted field; whatever it refuses is broken,
            # but for line breaks outside quotes, which belong to their field here
            parts = line.split("\n")
            source = [x + "\n" for x in parts[:-1]] + [x for x in parts[-1:] if x]
            reader = csv.reader(source, delimiter=self.sep, quotechar=self.quote or None, quoting=csv.QUOTE_MINIMAL if self.quote else csv.QUOTE_NONE, doublequote=True, strict=True)
            try:
                rows = list(reader)
            except csv.Error as e:
                if quoted and "new-line" not in str(e):
                    return None
                rows = []
            if len(rows) == 1 and not quoted:
                if not line.endswith("\n"):
                    return rows[0]
            elif len(rows) == 1 and not line.endswith("\n"):
                # the reader lets a quote character inside an unquoted field pass
                return rows[0] if self.whole(line) else None
        elif not quoted:
            return line.split(self.sep)
        return self.scan(line)

    def whole(self, line: str) -> bool:
        return self.scan(line) is not None

    def scan(self, line: str) -> list[str] | None:
        fields, at, end, step = [], 0, len(line), len(self.sep)
        while True:
            m = self.field.match(line, at)
            if m is None:
                return None
            f, at = m[0], m.end()
            if self.quote and f[:1] == self.quote:
                f = f[1:-1].replace(self.quote * 2, self.quote)
            fields.append(f)
            if at >= end:
                return fields
            at += step

    def typed(self, fields: list[str]) -> list[str | None] | None:
        """Fields with null tokens and blanks as None, numbers trimmed; None where a value is invalid."""
        out: list[str | None] = []
        for f, fits in zip(fields, self.check + [None] * (len(fields) - len(self.check))):
            t = f.strip(" \t")
            if not t or t.lower() in self.tokens:
                out.append(None)
            elif fits is None:
                out.append(f)
            elif fits(t):
                out.append(t)
            else:
                return None
        return out


@lru_cache(maxsize=4096)
def layout(text: str) -> Layout:
    csv.field_size_limit(sys.maxsize)  # texts may be very long
    return Layout(text)


def parse(line: str, text: str | None) -> tuple[str | None, list[str | None] | None]:
    """(reason, fields): exactly one of them is set."""
    if text is None:
        return UNKNOWN, None
    own = layout(text)
    fields = own.split(line[:-1] if line.endswith("\r") else line)
    if fields is None:
        return BROKEN, None
    if len(fields) != own.n:
        return COUNT, None
    values = own.typed(fields)
    return (INVALID, None) if values is None else (None, values)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())]
    for b in batches:
        made = [parse(line, text) for line, text in zip(b["raw_line"].to_pylist(), b["layout"].to_pylist())]
        cols = [b["line_id"], b["file_id"], b["line_no"], [r for r, _ in made], [f for _, f in made]]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds)], names=["line_id", "file_id", "line_no", "reason", "fields"])


def parse_records(raw_lines: DataFrame, csv_files: DataFrame) -> DataFrame:
    """Each record as (line_id, file_id, line_no, reason, fields).

    ``reason`` is null where the record was loaded, else the first that applies: ``broken_quoting``,
    ``wrong_column_count``, ``invalid_value``, or ``no_layout`` where the file isn't known. ``fields``
    are the values of a loaded record in column order, null for blanks and null tokens; else null.
    Null and blank records, and a header as record 1, don't come out. A record without ``line_id``
    is parsed like any other. Records delivered twice come out twice; ``loaded_rows`` counts them once.

    The strict csv reader parses in Python, batch by batch and without a shuffle, so it doesn't matter
    how many records one file holds. Layouts are joined, not collected; equal layouts are compiled once
    per task.
    """
    known = csv_files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.min(F.struct("sep", "quote_char", "has_header", "n_cols", "na_values", "feature_types")).alias("d"))
    known = known.select("file_id", F.coalesce("d.has_header", F.lit(False)).alias("_header"), F.to_json(F.struct("d.sep", "d.quote_char", "d.n_cols", "d.na_values", "d.feature_types")).alias("layout"))
    rows = raw_lines.select("line_id", "file_id", "line_no", "raw_line").where(F.col("raw_line").isNotNull() & (F.trim("raw_line", F.lit(" \r")) != ""))
    rows = rows.join(known, "file_id", "left").where(~F.coalesce(F.col("_header") & (F.col("line_no") == 1), F.lit(False)))
    return map_arrow(rows.select("line_id", "file_id", F.col("line_no").cast("long").alias("line_no"), "raw_line", "layout"), _parse_batches, PARSED)


def rejected(parsed: DataFrame) -> DataFrame:
    """Distinct (line_id, reason) of the records that can't be loaded."""
    return parsed.where(F.col("reason").isNotNull()).select("line_id", "reason").distinct()


def loaded_rows(parsed: DataFrame, csv_files: DataFrame) -> DataFrame:
    """The loaded records, each once, as typed cells: (line_id, file_id, line_no, cells).

    ``cells`` is an array of (name, kind, number double, whole long, text string): numbers of numerical
    columns in ``number``, of discrete ones in ``whole`` (null beyond 64 bits, where ``text`` still has
    the digits), other values in ``text``. A missing value has all three null.
    """
    names = csv_files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.min(F.struct("col_names", "feature_types")).alias("_d"))
    once = parsed.where(F.col("reason").isNull()).groupBy("line_id").agg(F.min(F.struct("file_id", "line_no", "fields")).alias("_r")).select("line_id", "_r.*")
    kind = lambda i: F.lower(F.get("_d.feature_types", i))
    cell = lambda v, i: F.struct(
        F.get("_d.col_names", i).alias("name"), kind(i).alias("kind"), F.when(kind(i) == "numerical", v.try_cast("double")).alias("number"), F.when(kind(i) == "discrete", v.try_cast("long")).alias("whole"), v.alias("text")
    )
    return once.join(names, "file_id", "left").select("line_id", "file_id", "line_no", F.transform("fields", cell).alias("cells"))


def assemble(lines: DataFrame, file: str, number: str, text: str, quote: str = '"', block: int = 65536) -> DataFrame:
    """Physical lines put together into records, quote-aware: (file, first line number, record).

    A record ends where the number of quote characters so far is even. Line breaks between the
    joined lines are kept as ``\\n``. The parity at each line is a prefix sum in two levels, blocks of
    ``block`` line numbers and then the blocks' own totals, so a file of any size spreads over many
    tasks. Null texts count as empty lines. An open quote at the end makes the rest one record.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = lines.select(F.col(file).alias("_f"), F.col(number).cast("long").alias("_n"), t.alias("_t"), ((F.length(t) - F.length(F.replace(t, F.lit(quote), F.lit("")))) % 2).alias("_q"))
    base = base.withColumn("_b", F.floor(F.col("_n") / block))
    sums = base.groupBy("_f", "_b").agg(F.sum("_q").alias("_s"))
    offset = sums.select("_f", "_b", F.coalesce(F.sum("_s").over(Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_f", "_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    open_ = base.join(offset, ["_f", "_b"]).withColumn("_open", (F.col("_o") + F.coalesce(F.sum("_q").over(inside), F.lit(0))) % 2 == 1)
    # the line a record starts at: the last line that doesn't begin inside quotes, in this block or an earlier one
    last = open_.where(~F.col("_open")).groupBy("_f", "_b").agg(F.max("_n").alias("_l"))
    blocks = sums.select("_f", "_b").join(last, ["_f", "_b"], "left")
    carried = blocks.select("_f", "_b", F.max("_l").over(Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    upto = Window.partitionBy("_f", "_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    start = open_.withColumn("_in", F.max(F.when(~F.col("_open"), F.col("_n"))).over(upto)).join(carried, ["_f", "_b"], "left").withColumn("_start", F.coalesce("_in", "_c"))
    made = start.groupBy("_f", "_start").agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_p"))
    return made.select(F.col("_f").alias(file), F.col("_start").alias(number), F.array_join(F.transform("_p", lambda p: p["_t"]), "\n").alias(text))
