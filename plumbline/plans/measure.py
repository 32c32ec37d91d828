"""Queries of metrics, meta-features, estimators, sources, ensembles and reports with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import ensemble as E
from plumbline import explain as X
from plumbline.dataset import Chain, Dataset
from plumbline.models import classic as M
from plumbline.models import trees as T
from plumbline.operators import metrics as MT
from plumbline.operators import profile as PR
from plumbline.operators.generate import Arithmetic
from plumbline.operators.scale import MinMax
from plumbline.search import trials as TR
from plumbline.session import table
from plumbline.sources import tables as ST

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# metrics: deterministic predictions over orders

_PRED = """(select (o_orderstatus = 'F')::int as label, ((o_orderkey * 37) % 101) / 101.0 as probability, ((o_orderkey * 37) % 101 > 50)::int as prediction from orders)"""
_MULTI = "(select (case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end) as label, (o_orderkey * 7) % 3 as prediction from orders)"
_REG = "(select o_totalprice as label, o_totalprice * (1 + ((o_orderkey * 37) % 101 - 50) / 500.0) as prediction from orders)"


def _pred(spark, d):
    k = F.col("o_orderkey") * 37 % 101
    return table(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("label"), (k / 101).alias("probability"), (k > 50).cast("int").alias("prediction"))


def _multi(spark, d):
    return table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("label"), (F.col("o_orderkey") * 7 % 3).cast("int").alias("prediction"))


def _reg(spark, d):
    return table(spark, d, "orders").select(F.col("o_totalprice").alias("label"), (F.col("o_totalprice") * (1 + (F.col("o_orderkey") * 37 % 101 - 50) / 500)).alias("prediction"))


_CLS = "with p as " + _PRED + " select round({}, 9) as score from p"
_LL = "greatest(1e-15, least(1 - 1e-15, case when label = 1 then probability else 1 - probability end))"
_F1 = """with p as {src}, c as (select label as c from p union select prediction from p),
s as (select c, count(*) filter (label = c and prediction = c) as tp, count(*) filter (label <> c and prediction = c) as fp, count(*) filter (label = c and prediction <> c) as fn from c cross join p group by c)
select round(avg(case when tp = 0 then 0 else 2.0 * tp / (2 * tp + fp + fn) end), 9) as score from s"""
_BA = "with p as {src} select round(avg(r), 9) as score from (select avg((label = prediction)::int) as r from p group by label)"
_METRIC_SQL = {
    "acc": (_pred, _CLS.format("avg((label = prediction)::int)")),
    "bal_acc": (_multi, _BA.format(src=_MULTI)),
    "f1": (_multi, _F1.format(src=_MULTI)),
    "precision": (_pred, _CLS.format("count(*) filter (label = 1 and prediction = 1) / count(*) filter (prediction = 1)")),
    "recall": (_pred, _CLS.format("count(*) filter (label = 1 and prediction = 1) / count(*) filter (label = 1)")),
    "auc": (_pred, f"with p as {_PRED}, r as (select label, rank() over (order by probability) + (count(*) over (partition by probability) - 1) / 2.0 as r from p) select round((sum(r) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2.0) / (count(*) filter (label = 1) * count(*) filter (label = 0)), 9) as score from r"),
    "log_loss": (_pred, _CLS.format(f"-avg(ln({_LL}))")),
    "mse": (_reg, f"with p as {_REG} select round(avg(power(label - prediction, 2)), 3) as score from p"),
    "rmse": (_reg, f"with p as {_REG} select round(sqrt(avg(power(label - prediction, 2))), 5) as score from p"),
    "msle": (_reg, f"with p as {_REG} select round(avg(power(ln(1 + label) - ln(1 + prediction), 2)), 9) as score from p"),
    "evs": (_reg, f"with p as {_REG} select round(1 - var_pop(label - prediction) / var_pop(label), 9) as score from p"),
    "r2": (_reg, f"with p as {_REG} select round(1 - sum(power(label - prediction, 2)) / sum(power(label - m, 2)), 9) as score from p, (select avg(label) as m from p)"),
    "max_error": (_reg, f"with p as {_REG} select round(max(abs(label - prediction)), 5) as score from p"),
    "mae": (_reg, f"with p as {_REG} select round(avg(abs(label - prediction)), 5) as score from p"),
    "median_absolute_error": (_reg, f"with p as {_REG} select round(quantile_cont(abs(label - prediction), 0.5), 5) as score from p"),
    "balanced_accuracy": (_pred, _BA.format(src=_PRED)),
    "pac_score": (_pred, f"with p as {_PRED}, t as (select avg(label) as s, exp(avg(ln({_LL}))) as e from p) select round((e - exp(s * ln(s) + (1 - s) * ln(1 - s))) / (1 - exp(s * ln(s) + (1 - s) * ln(1 - s))), 9) as score from t"),
}
_DIGITS = {"mse": 3, "rmse": 5, "max_error": 5, "mae": 5, "median_absolute_error": 5}
for _n, (_src, _sql) in _METRIC_SQL.items():
    Q[f"metric_{_n}"] = lambda spark, d, n=_n, src=_src: MT.METRICS[n][0](src(spark, d)).select(F.round("score", _DIGITS.get(n, 9)).alias("score"))
    SQL[f"metric_{_n}"] = _sql


# predictions as arrays by class

_ARRAY = """(select label, [a / (a + b + c), b / (a + b + c), c / (a + b + c)] as probability from
(select (case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end) as label, 1.0 + (o_orderkey * 37) % 101 as a, 1.0 + (o_orderkey * 11) % 67 as b, 1.0 + (o_orderkey * 5) % 13 as c from orders))"""


def _array(spark, d):
    k = F.col("o_orderkey")
    a, b, c = 1.0 + k * 37 % 101, 1.0 + k * 11 % 67, 1.0 + k * 5 % 13
    return table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("label"), F.array(a / (a + b + c), b / (a + b + c), c / (a + b + c)).alias("probability"))


_ARRAY_SQL = {
    "auc": f"""with p as {_ARRAY}, e as (select c, (label = c)::int as y, probability[c + 1] as s from p, (select unnest([0, 1, 2]) as c)),
r as (select c, y, rank() over (partition by c order by s) + (count(*) over (partition by c, s) - 1) / 2.0 as r from e),
a as (select (sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0)) as a from r group by c)
select round(avg(a), 6) as score from a""",
    "log_loss": f"with p as {_ARRAY} select round(-avg(ln(probability[label + 1])), 6) as score from p",
    "pac_score": f"""with p as {_ARRAY}, t as (select exp(avg(ln(probability[label + 1]))) as e from p), s as (select exp(sum(n / t * ln(n / t))) as q from (select count(*) as n, sum(count(*)) over () as t from p group by label))
select round((e - q) / (1 - q), 6) as score from t, s""",
}
for _n, _sql in _ARRAY_SQL.items():
    Q[f"metric_{_n}_by_class"] = lambda spark, d, n=_n: MT.METRICS[n][0](_array(spark, d)).select(F.round("score", 6).alias("score"))
    SQL[f"metric_{_n}_by_class"] = _sql


# meta-features


def _profile_ds(spark, d) -> Dataset:
    df = table(spark, d, "lineitem").select(F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("y"))
    return Dataset.of(df, label="y")


_PROF = """
with r as (select case when l_partkey % 7 <> 0 then l_quantity end as q, l_extendedprice as p, l_returnflag as f, l_linestatus as y from lineitem),
t as (select count(*) as n, count(*) - count(q) as h, kurtosis_pop(q) as kq, kurtosis_pop(p) as kp, count(distinct f) as s,
  skewness(q) * (count(q) - 2) / sqrt(count(q) * (count(q) - 1.0)) as wq, skewness(p) * (count(p) - 2) / sqrt(count(p) * (count(p) - 1.0)) as wp from r),
c as (select count(*) / sum(count(*)) over () as pr from r group by y),
e as (select min(pr) as lo, max(pr) as hi, avg(pr) as m, stddev_pop(pr) as sd, count(*) as k, -sum(pr * log2(pr)) as ent from c)
select feature, round(value, 6) as value from (
select unnest(['NumberOfInstances', 'LogNumberOfInstances', 'NumberOfFeatures', 'LogNumberOfFeatures', 'NumberOfInstancesWithMissingValues', 'PercentageOfInstancesWithMissingValues',
 'NumberOfFeaturesWithMissingValues', 'PercentageOfFeaturesWithMissingValues', 'NumberOfMissingValues', 'PercentageOfMissingValues', 'NumberOfNumericFeatures', 'NumberOfCategoricalFeatures',
 'RatioNumericalToNominal', 'RatioNominalToNumerical', 'DatasetRatio', 'LogDatasetRatio', 'InverseDatasetRatio', 'LogInverseDatasetRatio', 'SymbolsMin', 'SymbolsMax', 'SymbolsMean', 'SymbolsSTD', 'SymbolsSum',
 'KurtosisMin', 'KurtosisMax', 'KurtosisMean', 'KurtosisSTD', 'SkewnessMin', 'SkewnessMax', 'SkewnessMean', 'SkewnessSTD', 'NumberOfClasses', 'ClassProbabilityMin', 'ClassProbabilityMax', 'ClassProbabilityMean', 'ClassProbabilitySTD', 'ClassEntropy']) as feature,
unnest([n::double, ln(n), 3, ln(3), h, h / n, 1, 1 / 3.0, h, h / (3.0 * n), 2, 1, 2, 0.5, 3.0 / n, ln(3.0 / n), n / 3.0, ln(n / 3.0), s, s, s, 0, s,
 least(kq, kp), greatest(kq, kp), (kq + kp) / 2, abs(kq - kp) / 2, least(wq, wp), greatest(wq, wp), (wq + wp) / 2, abs(wq - wp) / 2, k, lo, hi, m, sd, ent]) as value from t, e)
"""


@query(_PROF)
def meta_features(spark, d):
    return PR.as_frame(table(spark, d, "lineitem"), PR.simple_features(_profile_ds(spark, d))).withColumn("value", F.round("value", 6))


@query()
def meta_pca(spark, d):
    return PR.as_frame(table(spark, d, "lineitem"), PR.pca_features(_profile_ds(spark, d)))


@query()
def meta_landmarks(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") > 250000).cast("int").alias("y"))
    ds = Dataset.of(df, ["o_totalprice"], "y", keep=("o_orderkey",))
    return PR.as_frame(df, PR.landmarks(ds, "o_orderkey"))


# estimators


def _dims(n: int):
    return [F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(n)]


_KNN = """with e as (select vec_id, label, embedding::double[64] as v from embeddings),
d as (select a.vec_id as query, b.vec_id as neighbour, b.label, row_number() over (partition by a.vec_id order by round(array_distance(a.v, b.v), 9), b.vec_id) as rank, array_distance(a.v, b.v) as dist
      from e a join e b on a.vec_id % 50 = 0)
"""


@query(_KNN + "select query, neighbour, rank, round(dist, 6) as dist from d where rank <= 5")
def knn_search(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *_dims(64))
    near = M.nearest(e.where("vec_id % 50 = 0"), e, [f"e{i}" for i in range(64)], "vec_id", 5)
    return near.select("query", "neighbour", F.col("rank").cast("long").alias("rank"), F.round("dist", 6).alias("dist"))


@query(_KNN + "select query as vec_id, (max_by(label, (n * 100 - label)))::int as prediction from (select query, label, count(*) as n from d where rank <= 5 group by 1, 2) group by 1")
def c_knn(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", *_dims(64))
    m = M.NearestNeighbours([f"e{i}" for i in range(64)], "label", key="vec_id", k=5).fit(e)
    return m.predict(e.where("vec_id % 50 = 0")).select("vec_id", "prediction")


@query(_KNN + "select query as vec_id, round(avg(label), 6) as prediction from d where rank <= 5 group by 1")
def r_knn(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", *_dims(64))
    m = M.NearestNeighbours([f"e{i}" for i in range(64)], "label", key="vec_id", k=5, regress=True).fit(e)
    return m.predict(e.where("vec_id % 50 = 0")).select("vec_id", F.round("prediction", 6).alias("prediction"))


@query("""with m as (select o_orderstatus as y, ln(count(*) / sum(count(*)) over ()) as p, avg(o_totalprice) as m, var_pop(o_totalprice) as v from orders group by 1),
s as (select o_orderkey, y, p - 0.5 * ln(2 * pi() * v) - power(o_totalprice - m, 2) / (2 * v) as s from orders cross join m)
select (case max_by_y when 'F' then 0 when 'O' then 1 else 2 end)::int as prediction, count(*) as n from (select o_orderkey, max_by(y, s) as max_by_y from s group by 1) group by 1""")
def c_gaussian_nb(spark, d):
    df = _status(spark, d)
    return M.GaussianNB(["o_totalprice"], "y").fit(df).predict(df).groupBy("prediction").agg(F.count("*").alias("n"))


def _status(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("y"))


def _separable(spark, d) -> DataFrame:
    """Three classes that the first columns of lineitem decide."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", F.least(F.lit(2), F.floor(F.col("l_quantity") / 17)).cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("b"), (3 * F.col("l_quantity") - 200 * F.col("l_discount")).alias("t"))


_X = ["l_quantity", "l_discount", "l_tax"]


def _accuracy(make, label="y", floor=0.8):
    def run(spark, d):
        df = _separable(spark, d)
        got = make(label).fit(df).predict(df)
        return got.agg((F.avg((F.col("prediction") == F.col(label)).cast("double")) > floor).alias("learned"), F.count("*").alias("n"))

    return run


def _close(make, label="t", floor=0.8):
    def run(spark, d):
        df = _separable(spark, d)
        got = make(label).fit(df).predict(df)
        fit = 1 - F.avg((F.col("prediction") - F.col(label)) * (F.col("prediction") - F.col(label))) / F.var_pop(label)
        return got.agg((fit > floor).alias("learned"), F.count("*").alias("n"))

    return run


_CLASSIFIERS = {
    "c_adaboost": lambda y: T.AdaBoost(_X, y, n_estimators=4, depth=2), "c_extra_trees": lambda y: T.ExtraTrees(_X, y, trees=5), "c_random_forest": lambda y: T.RandomForestClassifier(_X, y, params={"numTrees": 5}),
    "c_gradient_boosting": lambda y: T.GradientBoostingClassifier(_X, y, params={"maxIter": 3, "maxDepth": 3}), "c_lightgbm": lambda y: T.GradientBoostingClassifier(_X, y, params={"maxIter": 3, "maxDepth": 4, "subsamplingRate": 0.8}),
    "c_logistic": lambda y: T.LogisticRegression(_X, y, params={"maxIter": 50}),
    "c_liblinear_svc": lambda y: M.Margin(_X, y, steps=25), "c_libsvm_svc": lambda y: T.KernelMachine(_X, y, gamma=0.01, n_components=20),
}
_BINARY = {"c_liblinear_svc", "c_libsvm_svc"}
for _n, _m in _CLASSIFIERS.items():
    Q[_n] = _accuracy(_m, "b" if _n in _BINARY else "y")
for _n, _m in {"i_balanced_bagging": "tree", "i_balanced_rf": "forest", "i_easy_ensemble": "boost"}.items():
    Q[_n] = _accuracy(lambda y, b=_m: T.BalancedBag(_X, y, base=b), "b")
Q["i_rusboost"] = _accuracy(lambda y: T.RUSBoost(_X, y), "b")
_REGRESSORS = {
    "r_adaboost": lambda y: T.AdaBoostR2(_X, y, n_estimators=3, depth=5), "r_extra_trees": lambda y: T.ExtraTrees(_X, y, trees=5, depth=7, regress=True), "r_random_forest": lambda y: T.RandomForestRegressor(_X, y, params={"numTrees": 5, "maxDepth": 7, "featureSubsetStrategy": "all"}),
    "r_gradient_boosting": lambda y: T.GradientBoostingRegressor(_X, y, params={"maxIter": 5}), "r_lightgbm": lambda y: T.GradientBoostingRegressor(_X, y, params={"maxIter": 5, "maxDepth": 6}),
    "r_liblinear_svr": lambda y: M.Margin(_X, y, loss="squared_epsilon", C=100.0, steps=40), "r_libsvm_svr": lambda y: T.KernelMachine(_X, y, loss="squared_epsilon", C=100.0, gamma=0.001, n_components=20),
}
for _n, _m in _REGRESSORS.items():
    Q[_n] = _close(_m)


@query("""with s as (select count(*) as n, var_pop(l_quantity) as a, covar_pop(l_quantity, l_tax) as b, var_pop(l_tax) as c, covar_pop(l_quantity, l_extendedprice) as p, covar_pop(l_tax, l_extendedprice) as q from lineitem),
r as (select a + 10.0 / n as a, b, c + 10.0 / n as c, p, q from s)
select 'l_quantity' as feature, round((c * p - b * q) / (a * c - b * b), 4) as coefficient from r union all select 'l_tax', round((a * q - b * p) / (a * c - b * b), 4) from r""")
def r_ridge(spark, d):
    m = M.Ridge(["l_quantity", "l_tax"], "l_extendedprice", alpha=10.0).fit(table(spark, d, "lineitem"))
    return spark.createDataFrame([(f, round(float(w), 4)) for f, w in zip(m.features, m.state["w"])], "feature string, coefficient double")


@query("select 'l_quantity' as feature, round(sign(p) * greatest(abs(p) - 1.0, 0) / v, 6) as coefficient from (select covar_pop(l_quantity, l_extendedprice) as p, var_pop(l_quantity) as v from lineitem)")
def r_lasso(spark, d):
    m = M.Lasso(["l_quantity"], "l_extendedprice", alpha=1.0).fit(table(spark, d, "lineitem"))
    return spark.createDataFrame([(f, round(float(w), 6)) for f, w in zip(m.features, m.state["w"])], "feature string, coefficient double")


@query()
def lda_decomp(spark, d):
    df = _separable(spark, d)
    out = M.LDA(_X, "y").fit(df).project(df)
    return out.agg(F.count("*").alias("n"), (F.abs(F.corr("ld0", "l_quantity")) > 0.99).alias("apart"))


_ONE = "(select l_quantity as x, least(2, floor(l_quantity / 17))::int as y from lineitem)"


def _one_column(model):
    def run(spark, d):
        df = _separable(spark, d)
        return model(["l_quantity"], "y").fit(df).predict(df).groupBy("prediction").agg(F.count("*").alias("n"))

    return run


Q["c_lda"], Q["c_qda"] = _one_column(M.LDA), _one_column(M.QDA)
_SCORED = "select prediction, count(*) as n from (select x, (max_by(y, s))::int as prediction, any_value(k) as k from (select x, k, m.y, {} as s from (select x, row_number() over () as k from {}) cross join m) group by x, k) group by 1"
_MOMENTS = f"with m as (select y, count(*) as n, avg(x) as mu, var_pop(x) as v from {_ONE} group by 1), t as (select sum(n) as n, sum(n * v) / sum(n) as v from m) "
SQL["c_lda"] = _MOMENTS + _SCORED.format("mu * x / (select v from t) - mu * mu / (2 * (select v from t)) + ln(n / (select n from t))", _ONE)
SQL["c_qda"] = _MOMENTS + _SCORED.format("-0.5 * ln(v) - power(x - mu, 2) / (2 * v) + ln(n / (select n from t))", _ONE)


# sources and sinks


@query("select count(*) as n, round(sum(c_acctbal), 2) as total, count(distinct c_mktsegment) as k from customer")
def src_csv_train(spark, d):
    ds = ST.round_trip_csv(table(spark, d, "customer").select("c_name", "c_acctbal", "c_mktsegment"), label_col=-1)
    return ds.df.agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.count_distinct(ds.label).alias("k"))


@query("select count(*) as n, round(sum(c_acctbal), 2) as total from customer")
def src_csv_test(spark, d):
    df = table(spark, d, "customer").select("c_name", "c_acctbal")
    ds = ST.round_trip_csv(df, label_col=None, kinds={"c_name": "categorical", "c_acctbal": "numerical"})
    return ds.df.agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("select s_suppkey, s_acctbal, s_nationkey from supplier")
def src_array(spark, d):
    return Dataset.of(table(spark, d, "supplier"), ["s_acctbal"], "s_nationkey", keep=("s_suppkey",)).df


@query("select n_name from nation")
def src_named(spark, d):
    return ST.load(spark, d, "nation").df.select("n_name")


@query("select count(*) as n, round(sum(s_acctbal), 2) as total from supplier")
def src_tabular(spark, d):
    ds = ST.round_trip_csv(table(spark, d, "supplier").select("s_acctbal", "s_nationkey"), label_col=1)
    return ds.df.agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("""with t as (select trial_id, lower(trim(estimator_id, ' ' || chr(9))) as algorithm, perf from (select distinct trial_id, estimator_id, perf from trial_runs) where isfinite(perf)),
r as (select *, row_number() over (partition by algorithm order by perf desc, trial_id) as rank from t) select algorithm, trial_id, rank from r where rank <= 50""")
def snk_topk(spark, d):
    t = table(spark, d, "trial_runs").select("trial_id", F.lower(F.trim("estimator_id", F.lit(" \t"))).alias("algorithm"), F.col("perf").alias("score")).distinct()
    return TR.top_k(t, 50).select("algorithm", "trial_id", F.col("rank").cast("long").alias("rank"))


@query("""with t as (select distinct trial_id, session_id, config from trial_runs),
k as (select session_id, trial_id, list_sort(list_transform(json_keys(config), lambda k: k || '-' || coalesce(case when contains(json_extract_string(config, '$.' || k), '.') then round(try_cast(json_extract_string(config, '$.' || k) as double), 5)::varchar end, json_extract_string(config, '$.' || k), 'null'))) as id from t where config is not null)
select s.session_id, coalesce(n, 0) as n_configs from (select distinct session_id from t) s left join (select session_id, count(distinct id) as n from k group by 1) c on s.session_id is not distinct from c.session_id""")
def snk_config_id(spark, d):
    t = table(spark, d, "trial_runs").select("trial_id", "session_id", "config").distinct()
    return TR.config_ids(t, "config").groupBy("session_id").agg(F.count_distinct("config_sha1").alias("n_configs"))


@query("select count(*) as n from orders")
def snk_arff(spark, d):
    """Meta-features written as Parquet and read again."""
    from plumbline.session import keep

    df = table(spark, d, "orders")
    ds = Dataset.of(df, ["o_totalprice", "o_custkey", "o_orderpriority"], "o_orderstatus", keep=("o_orderkey",))
    return keep(PR.as_frame(df, PR.simple_features(ds))).where("feature = 'NumberOfInstances'").select(F.col("value").cast("long").alias("n"))


@query()
def snk_model(spark, d):
    return ST.model_round_trip(_separable(spark, d), _X, "b")


@query("select count(*) as n, min(len(embedding)) as size from embeddings")
def src_emb_index(spark, d):
    return ST.word_vectors(spark, ST.write_lines(table(spark, d, "embeddings").select(F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id")), F.concat_ws(" ", F.transform("embedding", lambda x: x.cast("string")))).alias("value")))).agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("size"))


# ensembles, trials, reports

_MEMBERS = """(select o_orderkey as row_id, m as model_id, (o_orderstatus = 'F')::int as label, ((o_orderkey * (37 + 2 * m)) % 101) / 101.0 * 0.5 + (case when (o_orderkey + m) % 3 = 0 then 0.4 else 0 end) * (o_orderstatus = 'F')::int as prob from orders, (select unnest([0, 1, 2, 3]) as m))"""


def _members(spark, d):
    m = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("model_id")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", m)
    y = (F.col("o_orderstatus") == "F").cast("int")
    prob = F.col("o_orderkey") * (37 + 2 * F.col("model_id")) % 101 / 101 * 0.5 + F.when((F.col("o_orderkey") + F.col("model_id")) % 3 == 0, 0.4).otherwise(0.0) * y
    return o.select(F.col("o_orderkey").alias("row_id"), "model_id", y.alias("label"), prob.alias("prob"))


@query(f"select row_id, round(avg(prob), 6) as prob from {_MEMBERS} group by 1")
def ens_bagging(spark, d):
    return E.bagging(_members(spark, d)).select("row_id", F.round("prob", 6).alias("prob"))


@query(f"""with p as {_MEMBERS}, e as (select model_id as i, avg(power(label - prob, 2)) as e from p group by 1), f as (select * from e order by round(e, 14), i limit 1),
g as (select b.model_id as i, avg(power(a.label - (a.prob + b.prob) / 2, 2)) as e from p a join p b using (row_id) where a.model_id = (select i from f) group by 1 order by round(avg(power(a.label - (a.prob + b.prob) / 2, 2)), 14), 1 limit 1)
select m as model_id, count(*) / (case when (select e from g) < (select e from f) - 1e-15 then 2.0 else 1.0 end) as weight
from (select i as m from f union all select i from g where (select e from g) < (select e from f) - 1e-15) group by 1""")
def ens_selection(spark, d):
    return spark.createDataFrame(list(E.greedy_selection(_members(spark, d), size=2).items()), "model_id int, weight double")


@query(f"""with p as (select row_id, max(label)::double as y, max(prob) filter (model_id = 0) as a, max(prob) filter (model_id = 1) as b from {_MEMBERS} where model_id < 2 group by 1),
m as (select count(*) as n, avg(y) as my, avg(a) as ma, avg(b) as mb, covar_pop(a, a) as aa, covar_pop(a, b) as ab, covar_pop(b, b) as bb, covar_pop(a, y) as ay, covar_pop(b, y) as by_ from p),
w as (select *, ((bb + 1.0 / n) * ay - ab * by_) / ((aa + 1.0 / n) * (bb + 1.0 / n) - ab * ab) as wa, ((aa + 1.0 / n) * by_ - ab * ay) / ((aa + 1.0 / n) * (bb + 1.0 / n) - ab * ab) as wb from m)
select row_id, round(greatest(0, least(1, my + wa * (a - ma) + wb * (b - mb))), 6) as prob from p, w""")
def ens_blending(spark, d):
    return E.blend(_members(spark, d).where("model_id < 2"), share=1.0).select("row_id", F.round("prob", 6).alias("prob"))


@query()
def ens_stacking(spark, d):
    df = _separable(spark, d).withColumn("row_id", F.monotonically_increasing_id())
    out = E.stack(df, "row_id", _X, "b", [lambda: M.GaussianNB(_X, "b"), lambda: M.LDA(_X, "b")], k=2)
    return out.agg((F.avg((F.col("prediction") == F.col("b")).cast("double")) > 0.8).alias("learned"), F.count("*").alias("n"))


@query(f"select a.model_id as a, b.model_id as b, round(avg((a.s <> b.s)::int), 6) as distance from (select row_id, model_id, prob > 0.5 as s from {_MEMBERS}) a join (select row_id, model_id, prob > 0.5 as s from {_MEMBERS}) b on a.row_id = b.row_id and a.model_id < b.model_id group by 1, 2")
def ens_model_distance(spark, d):
    return E.sign_distances(_members(spark, d)).select("a", "b", F.round("distance", 6).alias("distance"))


@query(f"""with p as {_MEMBERS}, a as (select model_id, avg(((prob > 0.5)::int = label)::int) as a from p group by 1),
w as (select model_id, greatest(1e-6, ln(greatest(a, 1e-6) / greatest(1 - a, 1e-6))) as w from a), q as (select p.*, greatest(1e-12, least(1 - 1e-12, prob)) as c from p),
e as (select row_id, prob, w * (1 + c * log2(c) + (1 - c) * log2(1 - c) + 1e-9) as w from q join w using (model_id))
select row_id, round(sum(prob * w) / sum(w), 6) as prob from e group by 1""")
def ens_unnamed(spark, d):
    return E.confidence_weighted(_members(spark, d)).select("row_id", F.round("prob", 6).alias("prob"))


@query("select 'l_quantity' as original, 'l_tax' as other, round(corr(l_quantity, l_tax), 6) as corr from lineitem union all select 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) from lineitem")
def feature_correlation(spark, d):
    return X.correlations(table(spark, d, "lineitem"), ["l_quantity"], ["l_tax", "l_discount"]).withColumn("corr", F.round("corr", 6))


@query()
def tree_importance(spark, d):
    return X.tree_importance(_separable(spark, d), _X, "y")


@query()
def linear_importance(spark, d):
    return X.linear_importance(_separable(spark, d), _X, "b")


@query("""with s as (select count(*) as n, var_pop(l_quantity) as a, covar_pop(l_quantity, l_tax) as b, var_pop(l_tax) as c, covar_pop(l_quantity, l_extendedprice) as p, covar_pop(l_tax, l_extendedprice) as q from lineitem),
r as (select a as va, c as vc, a + 10.0 / n as a, b, c + 10.0 / n as c, p, q from s)
select 'l_quantity' as feature, round(sqrt(va) * (c * p - b * q) / (a * c - b * b), 3) as value from r union all select 'l_tax', round(sqrt(vc) * (a * q - b * p) / (a * c - b * b), 3) from r""")
def linear_impact(spark, d):
    return X.linear_impact(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice", classify=False, alpha=10.0).withColumn("value", F.round("value", 3))


@query("select * from (values (0, 'minmax'), (1, 'arithmetic')) t(step, operator)")
def feature_origin(spark, d):
    ds = Dataset.of(table(spark, d, "lineitem").select("l_quantity", "l_tax"))
    return X.origin(Chain(MinMax(), Arithmetic()).fit_transform(ds))


@query("""with t as (select distinct trial_id, session_id, perf, state from trial_runs)
select session_id, count(*) as n, count(*) filter (state <> 0) as failed, max(perf) filter (state = 0 and isfinite(perf)) as best from t group by 1""")
def summary(spark, d):
    return TR.summary(table(spark, d, "trial_runs").select("trial_id", "session_id", "perf", "state").distinct())


@query("""with t as (select distinct trial_id, dataset_id, lower(trim(estimator_id, ' ' || chr(9))) as algorithm, perf from trial_runs where isfinite(perf))
select dataset_id, algorithm, quantile_cont(perf, 0.5) as score from t group by 1, 2""")
def meta_runs(spark, d):
    t = table(spark, d, "trial_runs").select("trial_id", "dataset_id", F.lower(F.trim("estimator_id", F.lit(" \t"))).alias("algorithm"), F.col("perf").alias("score")).distinct()
    return TR.median_scores(t)


@query()
def advisor(spark, d):
    return TR.advise(table(spark, d, "trial_runs"), table(spark, d, "task_vectors"))


@query("""with b as (select session_id, finished_at, trial_id, perf from (select distinct trial_id, session_id, finished_at, perf from trial_runs) where isfinite(perf))
select session_id, trial_id, max(perf) over (partition by session_id order by finished_at, trial_id rows unbounded preceding) as best from b""")
def trial_trajectory(spark, d):
    return TR.trajectory(table(spark, d, "trial_runs").select("trial_id", "session_id", "finished_at", "perf").distinct())


QUERIES = Q
