"""Registered queries of the subpackage with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, pack
from plumbline.llm.mih import similar_pairs
from plumbline.llm.pii import find, found_items
from plumbline.llm.splits import FEATURES, NUMBERS, TEXTS, overlap_classes, overlap_report, overlapping_rows
from plumbline.llm.topn import best_trials
from plumbline.session import spread, table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return best_trials(table(spark, d, "trial_runs"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(documents(spark, d)).select("doc_id", bpe.ids(F.col("codes")).alias("ids"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(table(spark, d, "task_vectors"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlapping_rows(table(spark, d, "split_rows"))
    return pairs.select(F.least("train_row", "eval_row").alias("row_a"), F.greatest("train_row", "eval_row").alias("row_b"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(table(spark, d, "split_rows"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of equal records that overlap, each named by its smallest row id."""
    return overlap_classes(table(spark, d, "split_rows"))[0]


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack.containers(documents(spark, d), table(spark, d, "pack_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each target are, and how far that is proved to be the best."""
    return pack.report(documents(spark, d), table(spark, d, "pack_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return found_items(documents(spark, d))


def p8_masked(spark: SparkSession, d: str) -> DataFrame:
    return find(documents(spark, d)).select("doc_id", "text")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_report": p3_report, "p3_classes": p3_classes, "p5_found": p5_found, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_report": p7_report, "p8_found": p8_found, "p8_masked": p8_masked}

P5_SQL = """
with t as (select session_id, lower(trim(estimator_id, ' ' || chr(9))) as estimator_id, trial_id, perf, finished_at, config_id
           from trial_runs where perf is not null and isfinite(perf)),
c as (select *, row_number() over (partition by session_id, estimator_id, coalesce('c' || config_id, 't' || trial_id)
                                   order by perf desc, finished_at nulls last, trial_id) as k from t),
r as (select *, row_number() over (partition by session_id, estimator_id order by perf desc, finished_at nulls last, trial_id) as n from c where k = 1)
select session_id, estimator_id, trial_id from r where n <= 5
"""
_AGREE = " + ".join(
    [f"(case when a.{f} is null or b.{f} is null then (a.{f} is null and b.{f} is null)::int else (isfinite(a.{f}) and isfinite(b.{f}) and abs(a.{f} - b.{f}) <= 0.005 * greatest(abs(a.{f}), abs(b.{f})))::int end)" for f in NUMBERS]
    + [f"(a.{f} is not distinct from b.{f})::int" for f in TEXTS]
)
_P3 = f"""
with s as (select distinct row_id, dataset_id, lower(trim(split, ' ' || chr(9))) as split, source, {', '.join(NUMBERS)},
                  {', '.join(rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]', '', 'g') as {c}" for c in TEXTS)}
           from split_rows),
p as (select a.row_id as ra, b.row_id as rb, b.split, b.source, {_AGREE} as agree
      from s a join s b on a.dataset_id = b.dataset_id and a.split = 'train' and b.split in ('test', 'valid'))
"""
P3_SQL = _P3 + "select least(ra, rb) as row_a, greatest(ra, rb) as row_b from p where agree >= 10"
P3_REPORT_SQL = _P3 + f"""
select split, source, count(distinct rb) as n_rows, count(*) as n_pairs, count(*) filter (agree = {len(FEATURES)}) as n_equal_pairs
from p where agree >= 10 group by split, source"""
_KEY = ", ".join(["dataset_id", "split = 'train'", *FEATURES])
P3_CLASSES_SQL = _P3.replace("p as (select a.row_id", f"""c as (select *, min(row_id) over (partition by {_KEY}) as class_row, count(*) over (partition by {_KEY}) as size from s where split in ('train', 'test', 'valid') and dataset_id is not null and row_id is not null),
p as (select a.row_id""").replace("select a.row_id as ra, b.row_id as rb, b.split, b.source,", "select a.row_id as ra, b.row_id as rb, a.size as n_train, b.size as n_eval,").replace("from s a join s b on", "from c a join c b on a.row_id = a.class_row and b.row_id = b.class_row and") + "select ra as train_row, rb as eval_row, agree, n_train, n_eval from p where agree >= 10"
P2_SQL = """
with u as (select distinct task_id, dataset_embedding as v from task_vectors
           where len(dataset_embedding) = 32 and len(list_filter(dataset_embedding, lambda x: x is not null and isfinite(x))) = 32),
e as (select task_id, generate_subscripts(v, 1) as i, unnest(v)::double as x from u),
d as (select a.task_id as q, b.task_id as t, sum((a.x - b.x) * (a.x - b.x)) as d from e a join e b on a.i = b.i and a.task_id <> b.task_id group by 1, 2),
r as (select q, t, row_number() over (partition by q order by d, t) as n from d)
select distinct least(q, t) as task_a, greatest(q, t) as task_b from r where n <= 5
"""
SQL = {"p2_found": P2_SQL, "p3_found": P3_SQL, "p3_report": P3_REPORT_SQL, "p3_classes": P3_CLASSES_SQL, "p5_found": P5_SQL}
