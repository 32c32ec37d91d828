"""Queries of the search strategies, the whole search and streams with their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from plumbline.automl import Classifier, Regressor
from plumbline.dataset import Chain, Dataset
from plumbline.operators.scale import MinMax
from plumbline.search import optimizers as O
from plumbline.search.blocks import plan
from plumbline.search.space import SearchSpace, categorical, uniform
from plumbline.search.trials import nearest_datasets
from plumbline.session import shared_folder, spread, table
from plumbline.streaming.scoring import once_per_key, profile_stream, transform_stream

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def bowl() -> tuple[SearchSpace, O.Evaluate]:
    """A known target: best near x = 0.3 under arm a."""
    space = SearchSpace([categorical("algorithm", ["a", "b"]), uniform("fe:z", 0, 1), uniform("x", 0, 1)])
    return space, lambda c, share: 1 - (c["x"] - 0.3) ** 2 - 0.1 * (c["fe:z"] - 0.5) ** 2 - (0.4 if c["algorithm"] == "b" else 0) - 0.01 * (1 - share)


def _strategy(name: str, n: int):
    def run(spark, d):
        space, f = bowl()
        o = O.build(name, space, f)
        o.iterate(n)
        return spark.createDataFrame([(o.best.config["algorithm"], bool(o.best.score > 0.9))], "algorithm string, good boolean")

    return run


for _n, _k in (("random", 40), ("smac", 25), ("tpe", 30), ("hyperband", 3), ("bohb", 4), ("mfes", 4)):
    Q[f"opt_{_n}"] = _strategy(_n, _k)


@query()
def opt_tlbo(spark, d):
    """A search that starts from the trials of a task alike."""
    space, f = bowl()
    past = O.build("random", space, f, seed=9)
    past.iterate(20)
    x, y = np.array([space.vector(t.config) for t in past.history]), np.array([t.score for t in past.history])
    o = O.build("tlbo", space, f, past=[(x, y)])
    o.iterate(15)
    return spark.createDataFrame([(o.best.config["algorithm"], bool(o.best.score > 0.9))], "algorithm string, good boolean")


def _plan(number: int, n: int):
    def run(spark, d):
        space, f = bowl()
        b = plan(number, space, f, ["a", "b"])
        b.iterate(n)
        return spark.createDataFrame([(b.best.config["algorithm"], bool(b.best.score > 0.9))], "algorithm string, good boolean")

    return run


for _n, _k in (("joint", (0, 25)), ("condition", (1, 12)), ("alternate", (3, 25))):
    Q[f"block_{_n}"] = _plan(*_k)


@query()
def space_joint(spark, d):
    space, _ = bowl()
    got = space.distinct(40, np.random.default_rng(1))
    return spark.createDataFrame([(sum(c == space.default() for c in got), len(got))], "n_default int, n int")


@query("""with u as (select distinct task_id, dataset_id, dataset_embedding as v from task_vectors where len(dataset_embedding) = 32 and len(list_filter(dataset_embedding, lambda x: x is not null and isfinite(x))) = 32),
e as (select dataset_id, i, avg(v[i]) as m from u cross join (select unnest(range(1, 33)) as i) group by 1, 2), s as (select i, min(m) as lo, max(m) as hi from e group by 1)
select dataset_id, round(sqrt(sum(power(m / case when hi = lo then 1 else hi - lo end, 2))), 5) as dist from e join s using (i) group by 1 order by sqrt(sum(power(m / case when hi = lo then 1 else hi - lo end, 2))), 1 limit 3""")
def meta_warm_start(spark, d):
    t = table(spark, d, "task_vectors").where(F.forall("dataset_embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select("task_id", "dataset_id", "dataset_embedding").distinct()
    return nearest_datasets(t, [0.0] * 32, 3).withColumn("dist", F.round("dist", 5))


@query("""with s as (select unnest(range(0, 5)) as s), b as (select s, ceil(5.0 / (s + 1) * power(3, s) - 1e-9) as n from s), r as (select s, n, unnest(range(0, s + 1)) as i from b)
select s::int as bracket, i::int as round, greatest(1, floor(n * power(3.0, -i) + 1e-9))::int as configs, round(power(3.0, i - s), 9) as share from r""")
def opt_hyperband_rounds(spark, d):
    space, f = bowl()
    rows = [(len(b) - 1, i, n, round(float(share), 9)) for b in O.Hyperband(space, f).brackets() for i, (n, share) in enumerate(b)]
    return spark.createDataFrame(rows, "bracket int, round int, configs int, share double")


@query()
def automl_classifier(spark, d):
    df = spread(table(spark, d, "orders")).select("o_orderkey", "o_totalprice", "o_orderpriority", F.when(F.col("o_totalprice") > 250000, "high").otherwise("low").alias("y"))
    a = Classifier("o_orderkey", trials=3, include_algorithms=["lda", "random_forest"], ensemble_method="ensemble_selection").fit(df, "y")
    out = a.predict(df).join(df.select("o_orderkey", "y"), "o_orderkey")
    return out.agg(F.count("*").alias("n"), (F.avg((F.col("prediction") == F.col("y")).cast("double")) > 0.9).alias("learned"))


@query()
def automl_regressor(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", (F.col("c_acctbal") * 2 + F.col("c_nationkey")).alias("y"))
    a = Regressor("c_custkey", trials=3, include_algorithms=["ridge"], include_steps={"preprocessor": ["empty"], "rescaler": ["empty", "standard"]}).fit(df, "y")
    out = a.predict(df).join(df.select("c_custkey", "y"), "c_custkey")
    return out.agg(F.count("*").alias("n"), (F.max(F.abs(F.col("prediction") - F.col("y"))) < 100).alias("learned"))


def _drained(spark, frame, name_prefix: str, mode: str = "append"):
    """A stream run to its end; its result as a table in the shared folder.

    In append mode a window comes out only once the watermark has passed it. In complete mode all groups do, open ones
    too, and no row is too late; each batch writes the result anew.
    """
    base = f"{shared_folder(spark)}/stream-{name_prefix}-{uuid.uuid4().hex}"
    w = frame.writeStream.option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").start(f"{base}/out")
    else:
        spark.createDataFrame([], frame.schema).write.parquet(f"{base}/out")  # what a stream without rows gives
        q = w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    q.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{base}/out")


def _stream(spark, d, name: str):
    path = f"{d}/{name}.parquet"
    # as a pattern, which a table of one file and a folder of files both match
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")


@query("select event_id, round((value - (select min(value) from events)) / ((select max(value) from events) - (select min(value) from events)), 6) as v from events")
def streaming_scoring(spark, d):
    chain = Chain(MinMax(targets=["value"]))
    chain.fit_transform(Dataset.of(table(spark, d, "events"), ["value"], keep=("event_id",)))
    out = transform_stream(_stream(spark, d, "events"), chain, ["value"], {"value": "numerical"}, ("event_id",))
    return _drained(spark, out, "score").select("event_id", F.round("value", 6).alias("v"))


def streaming_profile(spark, d):
    return _drained(spark, profile_stream(_stream(spark, d, "events"), "ts", "value", "1 day"), "profile", "complete")


def _rounded_profile(spark, d):
    """As compared with SQL, which adds up in another order."""
    out = streaming_profile(spark, d)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("mean", 6).alias("mean"), "missing")


Q["streaming_profile"] = _rounded_profile
SQL["streaming_profile"] = """select time_bucket(interval '1 day', ts) as start, time_bucket(interval '1 day', ts) + interval '1 day' as "end", count(*) as n, round(avg(value), 6) as mean, avg((value is null)::int) as missing
from events where ts is not null group by 1, 2"""


@query("select count(distinct row_id) as n from node_rows")
def streaming_dedup(spark, d):
    out = once_per_key(_stream(spark, d, "node_rows").select("row_id", "arrived_at"), "row_id", "arrived_at", "4000 days")
    return _drained(spark, out, "dedup").agg(F.count("*").alias("n"))


QUERIES = Q
