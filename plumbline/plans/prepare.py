"""Queries of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.hotdeck import fill_nodes
from plumbline.session import table
from plumbline.sources.records import loaded_rows, parse_records, rejected

CELLS = [f"x{i}" for i in range(8)]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The cells that the hot-deck fills."""
    filled = fill_nodes(table(spark, d, "node_rows"), table(spark, d, "datasets"), CELLS)
    return filled.select("row_id", F.explode(F.filter(F.array(*[F.when(F.col(f"{f}_filled"), F.lit(f)) for f in CELLS]), lambda x: x.isNotNull())).alias("feature"))


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its cells filled, and for each cell whether it was missing, whether it was filled and from how far."""
    return fill_nodes(table(spark, d, "node_rows"), table(spark, d, "datasets"), CELLS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The records that can't be loaded, with the reason."""
    return rejected(parse_records(table(spark, d, "raw_lines"), table(spark, d, "csv_files"))).where("reason <> 'no_layout'")


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    """The loaded records as typed cells."""
    return loaded_rows(parse_records(table(spark, d, "raw_lines"), table(spark, d, "csv_files")), table(spark, d, "csv_files"))


QUERIES = {"p1_found": p1_found, "p1_filled": p1_filled, "p4_found": p4_found, "p4_rows": p4_rows}

_CELLS = " union all ".join(f"select row_id, node_id, dataset_id, '{f}' as feature, {i + 1} as i, {f} as cell from r" for i, f in enumerate(CELLS))
P1_SQL = rf"""
with r as (select distinct row_id, node_id, dataset_id, {', '.join(CELLS)} from node_rows where row_id is not null),
c as ({_CELLS}),
m as (
  select row_id, node_id, feature,
    cell is null or trim(cell, ' ' || chr(9)) = ''
    or coalesce(list_contains(list_transform(d.na_values, lambda t: lower(t)), lower(trim(cell, ' ' || chr(9)))), false)
    or (coalesce(d.feature_types[i] in ('numerical', 'discrete'), false)
        and not regexp_full_match(trim(cell, ' ' || chr(9)), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')) as missing
  from c left join datasets d using (dataset_id))
select distinct row_id, feature from m
where missing and (node_id, feature) in (select (node_id, feature) from m where not missing)
"""
_MISSING = P1_SQL[P1_SQL.index("cell is null") : P1_SQL.index(" as missing")]
_V = ",\n".join(f"case when not ({_MISSING.replace('cell', f).replace('[i]', f'[{i + 1}]')}) then {f} end as v{i}" for i, f in enumerate(CELLS))
_SEEN = "case when v{i} is not null then {{'t': recorded_at, 'v': v{i}}} end"
_NEAR = ", ".join(f"last_value({_SEEN.format(i=i)} ignore nulls) over before as p{i}, first_value({_SEEN.format(i=i)} ignore nulls) over after as n{i}" for i in range(len(CELLS)))
_GAP = "(abs(epoch_us({c}.t) - epoch_us(recorded_at)) / 1e6)"
_DONOR = ", ".join(f"case when node_id is not null and v{i} is null then case when p{i} is null or {_GAP.format(c=f'n{i}')} < {_GAP.format(c=f'p{i}')} then coalesce(n{i}, p{i}) else p{i} end end as d{i}" for i in range(len(CELLS)))
_OUT = ", ".join(f"coalesce(v{i}, d{i}.v) as {f}, v{i} is null as {f}_missing, d{i} is not null as {f}_filled, {_GAP.format(c=f'd{i}')} as {f}_distance" for i, f in enumerate(CELLS))
P1_FILLED_SQL = f"""
with r as (select distinct row_id, node_id, dataset_id, recorded_at, {', '.join(CELLS)} from node_rows where row_id is not null),
v as (select row_id, node_id, recorded_at, {_V} from r left join datasets d using (dataset_id)),
o as (select *, {_NEAR} from v
      window before as (partition by node_id order by recorded_at nulls first, row_id rows between unbounded preceding and current row),
             after as (partition by node_id order by recorded_at nulls first, row_id rows between current row and unbounded following)),
e as (select *, {_DONOR} from o)
select row_id, node_id, recorded_at, {_OUT} from e"""
SQL = {"p1_found": P1_SQL, "p1_filled": P1_FILLED_SQL}
