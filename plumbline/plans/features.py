"""Queries of the feature operators with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.dataset import CATEGORICAL, DISCRETE, NUMERICAL, Chain, Dataset
from plumbline.functions import scalar as S
from plumbline.operators import balance as B
from plumbline.operators import clean as K
from plumbline.operators import generate as G
from plumbline.operators import scale as R
from plumbline.operators import select as L
from plumbline.operators import split as P
from plumbline.session import spread, table

Q: dict = {}
SQL: dict[str, str] = {}
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None):
    """Registers a query under its own name, with its SQL."""

    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def lineitem(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*(cols or NUM))


def holes(df: DataFrame) -> DataFrame:
    """lineitem with every seventh part's quantity missing."""
    return df.withColumn("l_quantity", F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")))


def checks(df: DataFrame, cols: list[str], digits: int = 4) -> DataFrame:
    """Sum, smallest, largest and sum of squares of each column: a fingerprint of a transformed table."""
    return df.agg(*[e.alias(f"{c}_{n}") for c in cols for n, e in (("sum", F.round(F.sum(c), digits)), ("min", F.round(F.min(c), digits)), ("max", F.round(F.max(c), digits)), ("ss", F.round(F.sum(F.col(c) * F.col(c)), digits)))])


def checks_sql(cols: list[str], digits: int = 4) -> str:
    return ", ".join(f"round(sum({c}), {digits}) as {c}_sum, round(min({c}), {digits}) as {c}_min, round(max({c}), {digits}) as {c}_max, round(sum({c} * {c}), {digits}) as {c}_ss" for c in cols)


def fitted(stage, spark, d, cols=NUM, **kw) -> Dataset:
    return stage.fit_transform(Dataset.of(lineitem(spark, d, *cols), **kw))


# cleaning


@query(" union all ".join(f"select '{c}' as feature, case when bool_and({c} = floor({c})) then 'discrete' else 'numerical' end as kind from lineitem" for c in ("l_orderkey", "l_quantity", "l_discount", "l_tax"))
       + " union all select 'l_returnflag', case when count(*) filter (try_cast(l_returnflag as double) is not null) <= 0.05 * count(*) then 'categorical' else 'numerical' end from lineitem")
def infer_types(spark, d):
    kinds = K.infer_kinds(table(spark, d, "lineitem"), ["l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_tax"])
    return spark.createDataFrame([(f, k) for f, (k, _) in kinds.items()], "feature string, kind string")


@query("select bool_and(l_quantity = floor(l_quantity)) as quantity, bool_and(l_discount = floor(l_discount)) as discount from lineitem")
def is_discrete(spark, d):
    return table(spark, d, "lineitem").agg(K.is_discrete(F.col("l_quantity")).alias("quantity"), K.is_discrete(F.col("l_discount")).alias("discount"))


@query("select count(distinct l_returnflag) / count(*) < 0.001 as flag, count(distinct l_orderkey) / count(*) < 0.001 as key from lineitem")
def detect_categorical(spark, d):
    return table(spark, d, "lineitem").agg(K.looks_categorical(F.col("l_returnflag")).alias("flag"), K.looks_categorical(F.col("l_orderkey")).alias("key"))


def _abnormal(df):
    """A number column as text, with words in one row of 50."""
    return df.select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 3, "broken").otherwise(F.col("o_totalprice").cast("string")).alias("v"))


@query("select count(*) as n, count(*) filter (o_orderkey % 50 <> 3) as kept, round(sum(case when o_orderkey % 50 <> 3 then o_totalprice end), 2) as total from orders")
def detect_abnormal(spark, d):
    df = _abnormal(table(spark, d, "orders"))
    fixed = K.typed(df, K.infer_kinds(df))
    return fixed.agg(F.count("*").alias("n"), F.count("v").alias("kept"), F.round(F.sum("v"), 2).alias("total"))


@query("select count(*) as n from node_rows where y is not null")
def drop_null_label(spark, d):
    ds = K.drop_null_labels(Dataset.of(table(spark, d, "node_rows"), ["x0"], "y"))
    return ds.df.agg(F.count("*").alias("n"))


@query("select count(*) as n from node_rows where x0 is not null or x1 is not null or x2 is not null")
def drop_all_null_rows(spark, d):
    return K.drop_empty_rows(table(spark, d, "node_rows").select("x0", "x1", "x2")).agg(F.count("*").alias("n"))


@query("select c_custkey, c_mktsegment from customer")
def drop_cols(spark, d):
    ds = Dataset.of(table(spark, d, "customer"), ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], keep=("c_custkey",))
    return K.DropColumns(["c_name", "c_nationkey", "c_acctbal"]).fit_transform(ds).df


@query("select sum(c_acctbal) as s, count(distinct c_mktsegment) as k, 2 as n_features from customer")
def remove_uninf_cols(spark, d):
    ds = K.DropUninformative().fit_transform(Dataset.of(table(spark, d, "customer").select("c_name", "c_mktsegment", "c_acctbal", F.lit(None).cast("double").alias("nothing"))))
    return ds.df.agg(F.sum("c_acctbal").alias("s"), F.count_distinct("c_mktsegment").alias("k")).withColumn("n_features", F.lit(len(ds.features)))


def _impute(strategy):
    def run(spark, d):
        ds = K.Impute(targets=["l_quantity"], strategy=strategy).fit_transform(Dataset.of(holes(lineitem(spark, d, "l_quantity", "l_partkey", "l_returnflag"))))
        return ds.df.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 4).alias("q"), F.count("l_quantity").alias("n"))

    return run


_FILL = "with h as (select case when l_partkey % 7 <> 0 then l_quantity end as q, l_returnflag from lineitem) select l_returnflag, round(sum(coalesce(q, (select {} from h))), 4) as q, count(*) as n from h group by 1"
for _s, _e in (("mean", "avg(q)"), ("median", "quantile_cont(q, 0.5)"), ("mode", "(select q from h where q is not null group by q order by count(*) desc, q limit 1)")):
    Q[f"impute_{_s}"] = _impute(_s)
    SQL[f"impute_{_s}"] = _FILL.format(_e) if _s != "mode" else _FILL.replace("(select {} from h)", _e)


@query("select l_orderkey, l_linenumber, l_partkey, (l_returnflag = 'A')::double as l_returnflag_A, (l_returnflag = 'N')::double as l_returnflag_N, (l_returnflag = 'R')::double as l_returnflag_R from lineitem")
def onehot(spark, d):
    ds = Dataset.of(lineitem(spark, d, "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), ["l_returnflag"], keep=("l_orderkey", "l_linenumber", "l_partkey"))
    return K.OneHot().fit_transform(ds).df


@query("select o_orderkey, (dense_rank() over (order by o_orderpriority) - 1)::int as code from orders")
def label_encode(spark, d):
    return K.encode_labels(table(spark, d, "orders"), "o_orderpriority", "code").select("o_orderkey", "code")


@query("select o_orderkey, case when o_orderstatus <> 'P' then (case o_orderstatus when 'F' then 0 else 1 end)::int end as code from orders")
def ordinal_nan(spark, d):
    df = table(spark, d, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return K.encode_labels(df, "o_orderstatus", "code").select("o_orderkey", "code")


_LN = ", ".join(f"sum((l_linenumber = {i})::int)::double as l_linenumber_{i}" for i in range(1, 8))


@query(f"select l_returnflag, {_LN} from lineitem group by 1")
def discrete_categorize(spark, d):
    ds = K.DiscreteCategories().fit_transform(Dataset.of(lineitem(spark, d, "l_linenumber", "l_orderkey", "l_returnflag"), ["l_linenumber", "l_orderkey"], keep=("l_returnflag",)))
    return ds.df.groupBy("l_returnflag").agg(*[F.sum(f"l_linenumber_{i}").alias(f"l_linenumber_{i}") for i in range(1, 8)])


@query("""with h as (select case when l_partkey % 7 <> 0 then l_quantity end as q, l_discount as x, l_returnflag as f, l_linestatus as y from lineitem),
m as (select coalesce(q, (select quantile_cont(q, 0.5) from h)) as q, x, f, (y = 'O')::int as y from h)
select y, round(sum(q), 4) as q, round(sum(x), 4) as x, sum((f = 'A')::int)::double as fa, sum((f = 'N')::int)::double as fn, sum((f = 'R')::int)::double as fr from m group by 1""")
def preprocess_pipeline(spark, d):
    df = holes(lineitem(spark, d, "l_quantity", "l_partkey", "l_discount", "l_returnflag", "l_linestatus")).drop("l_partkey").withColumn("one", F.lit(1.0))
    out, _ = K.preprocess(Dataset.of(df, label="l_linestatus"))
    return out.df.groupBy(F.col("l_linestatus").alias("y")).agg(F.round(F.sum("l_quantity"), 4).alias("q"), F.round(F.sum("l_discount"), 4).alias("x"), *[F.sum(f"l_returnflag_{v}").alias(f"f{v.lower()}") for v in "ANR"])


@query("select l_returnflag, count(*) as n from lineitem group by 1")
def empty(spark, d):
    return Chain().fit_transform(Dataset.of(lineitem(spark, d, "l_returnflag"))).df.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_totalprice, o_orderstatus from orders")
def merger(spark, d):
    o = table(spark, d, "orders")
    left, right = Dataset.of(o, ["o_totalprice"], keep=("o_orderkey",)), Dataset.of(o, ["o_orderstatus"], keep=("o_orderkey",))
    return K.merge_columns(left, right, "o_orderkey").df


@query("select count(*) as n, round(sum(l_quantity), 2) as q from (select l_quantity from lineitem union all select l_quantity from lineitem)")
def union_nodes(spark, d):
    ds = Dataset.of(lineitem(spark, d))
    return ds.union(ds).df.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


# scalar functions

_FN = {
    "log": ("ln(abs(x) + 1e-8)", "log"), "sqrt": ("sqrt(abs(x))", "sqrt"), "square": ("x * x", "square"), "round": ("round_even(x, 0)", "round"),
    "tanh": ("(1 - exp(-2 * x)) / (1 + exp(-2 * x))", "tanh"), "sigmoid": ("1 / (1 + exp(-x))", "sigmoid"),
}
for _n, (_sql, _f) in _FN.items():
    Q[f"fn_{_n}"] = lambda spark, d, f=_f: table(spark, d, "customer").select("c_custkey", F.round(S.UNARY[f]((F.col("c_acctbal") / 1000).cast("double")), 6).alias("v"))
    SQL[f"fn_{_n}"] = f"select c_custkey, round({_sql}, 6) as v from (select c_custkey, c_acctbal / 1000 as x from customer)"
for _n, _op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
    Q[f"fn_{_n}"] = lambda spark, d, f={"add": "add", "sub": "subtract", "mul": "multiply", "div": "divide"}[_n]: table(spark, d, "part").select("p_partkey", F.round(S.BINARY[f](F.col("p_retailprice"), F.col("p_size")), 6).alias("v"))
    SQL[f"fn_{_n}"] = f"select p_partkey, round(p_retailprice {_op} p_size, 6) as v from part"


@query("select c_custkey, round(count(*) over (partition by c_mktsegment) / count(*) over (), 9) as freq from customer")
def fn_freq(spark, d):
    return S.with_frequency(table(spark, d, "customer"), "c_mktsegment").select("c_custkey", F.round("freq", 9).alias("freq"))


@query("""select vec_id, round(exp(a - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) as p0, round(exp(b - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) as p1, round(exp(c - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) as p2
from (select *, greatest(a, b, c) as m from (select vec_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings))""")
def fn_softmax(spark, d):
    p = S.softmax([F.get("embedding", F.lit(i)).cast("double") for i in range(3)])
    return table(spark, d, "embeddings").select("vec_id", *[F.round(c, 6).alias(f"p{i}") for i, c in enumerate(p)])


_SEP = S.SEPARATORS.replace("'", "''").replace("\t", "").replace("\n", "")


@query(f"""select doc_id, coalesce(len(list_filter(string_split(translate(translate(lower(text), '{_SEP}', repeat(' ', {len(S.SEPARATORS) - 2})), chr(9) || chr(10), '  '), ' '), lambda w: w <> '')), -1)::int as n from documents""")
def fn_text_tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.size(S.text_tokens(F.col("text"))), F.lit(-1)).alias("n")).withColumn("n", F.when(F.col("n") < 0, -1).otherwise(F.col("n")))


@query("select event_id, round((value - (select min(value) from events)) / ((select max(value) from events) - (select min(value) from events)), 6) as v from events")
def norm_minmax(spark, d):
    ds = R.MinMax(targets=["value"]).fit_transform(Dataset.of(table(spark, d, "events"), ["value"], keep=("event_id",)))
    return ds.df.select("event_id", F.round("value", 6).alias("v"))


@query("select event_id, round((value - (select avg(value) from events)) / (select stddev_pop(value) from events), 6) as v from events")
def norm_zscore(spark, d):
    ds = R.Standard(targets=["value"]).fit_transform(Dataset.of(table(spark, d, "events"), ["value"], keep=("event_id",)))
    return ds.df.select("event_id", F.round("value", 6).alias("v"))


@query("select event_id, round(value, 6) as v from events")
def unnorm(spark, d):
    stage = R.Standard(targets=["value"])
    ds = stage.fit_transform(Dataset.of(table(spark, d, "events"), ["value"], keep=("event_id",)))
    return ds.df.select("event_id", F.round(R.unscaled(F.col("value"), stage, "value"), 6).alias("v"))


@query("select event_id, max(value) over (partition by user_id order by event_id rows unbounded preceding) as best from events")
def seq_cummax(spark, d):
    return S.with_running_max(table(spark, d, "events"), "value", F.col("event_id"), "event_id", "user_id").select("event_id", "best")


# rescalers and generators

_C = checks_sql(NUM)
_each = lambda e: ", ".join(f"{e.format(c=c)} as {c}" for c in NUM)


@query(f"select {_C} from (select {_each('({c} - (select min({c}) from lineitem)) / ((select max({c}) from lineitem) - (select min({c}) from lineitem))')} from lineitem)")
def minmax(spark, d):
    return checks(fitted(R.MinMax(), spark, d).df, NUM)


@query(f"select {checks_sql(NUM, 3)} from (select {_each('({c} - (select avg({c}) from lineitem)) / (select stddev_pop({c}) from lineitem)')} from lineitem)")
def standard(spark, d):
    return checks(fitted(R.Standard(), spark, d).df, NUM, 3)


@query(f"select {checks_sql(NUM, 3)} from (select {_each('({c} - (select quantile_cont({c}, 0.5) from lineitem)) / ((select quantile_cont({c}, 0.75) from lineitem) - (select quantile_cont({c}, 0.25) from lineitem))')} from lineitem)")
def robust(spark, d):
    return checks(fitted(R.Robust(), spark, d).df, NUM, 3)


_LEN = "sqrt(" + " + ".join(f"{c} * {c}" for c in NUM) + ")"


@query(f"select {_C} from (select {_each('{c} / ' + _LEN)} from lineitem)")
def normalizer(spark, d):
    return checks(fitted(R.Normalize(), spark, d).df, NUM)


_AT = "[" + ", ".join(repr(k / 99) for k in range(100)) + "]"


@query(f"""with q as (select unnest(quantile_cont(l_extendedprice, {_AT})) as v, unnest({_AT}) as pos from lineitem),
r as (select v, min(pos) as lo, max(pos) as hi from q group by v), s as (select *, lead(v) over (order by v) as nv, lead(lo) over (order by v) as nlo from r),
p as (select case when x.l_extendedprice = s.v then (case when s.lo = 0 then 0 when s.hi = 1 then 1 else (s.lo + s.hi) / 2 end) else s.hi + (x.l_extendedprice - s.v) / (s.nv - s.v) * (s.nlo - s.hi) end as p
      from lineitem x asof join s on x.l_extendedprice >= s.v)
select count(*) as n, round(sum(p), 3) as total, round(sum(p * p), 3) as ss, round(min(p), 6) as lo, round(max(p), 6) as hi from p""")
def quantile(spark, d):
    ds = fitted(R.Quantile(targets=["l_extendedprice"], n_quantiles=100), spark, d)
    c = F.col("l_extendedprice")
    return ds.df.agg(F.count("*").alias("n"), F.round(F.sum(c), 3).alias("total"), F.round(F.sum(c * c), 3).alias("ss"), F.round(F.min(c), 6).alias("lo"), F.round(F.max(c), 6).alias("hi"))


@query("select floor(least(4, greatest(0, floor((l_quantity - lo) / ((hi - lo) / 5.0)))))::double as bin, count(*) as n from lineitem, (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem) group by 1")
def kbins(spark, d):
    return fitted(R.Bins(targets=["l_quantity"]), spark, d).df.groupBy(F.col("l_quantity").alias("bin")).agg(F.count("*").alias("n"))


@query("select " + checks_sql(["arithmetic"]) + " from (select sqrt(abs(l_extendedprice)) as arithmetic from lineitem)")
def arithmetic(spark, d):
    ds = fitted(G.Arithmetic(targets=["l_extendedprice"]), spark, d)
    return checks(ds.df.withColumnRenamed("l_extendedprice", "arithmetic"), ["arithmetic"])


@query("select " + checks_sql(["s"]) + " from (select l_quantity + l_tax as s from lineitem)")
def binary(spark, d):
    ds = fitted(G.Pairwise(targets=["l_quantity", "l_tax"]), spark, d)
    return checks(ds.df.withColumnRenamed("l_quantity_add_l_tax", "s"), ["s"])


@query("""select sum((l_returnflag = 'A' and l_linestatus = 'F')::int)::double as af, sum((l_returnflag = 'R' and l_linestatus = 'O')::int)::double as ro,
(select 5 + count(*) from (select distinct l_returnflag, l_linestatus from lineitem)) as width from lineitem""")
def cross(spark, d):
    ds = Chain(K.OneHot(), G.Cross(takes=(DISCRETE,))).fit_transform(Dataset.of(lineitem(spark, d, "l_returnflag", "l_linestatus")))
    total = lambda c: F.sum(F.col(c) if c in ds.features else F.lit(0.0))
    return ds.df.agg(total("l_returnflag_A_x_l_linestatus_F").alias("af"), total("l_returnflag_R_x_l_linestatus_O").alias("ro")).withColumn("width", F.lit(len(ds.features)).cast("long"))


@query("select " + checks_sql(["aa", "ab", "bb"], 2) + " from (select l_quantity * l_quantity as aa, l_quantity * l_tax as ab, l_tax * l_tax as bb from lineitem)")
def poly_cls(spark, d):
    ds = fitted(G.Polynomial(targets=["l_quantity", "l_tax"]), spark, d)
    new = {"aa": "l_quantity*l_quantity", "ab": "l_quantity*l_tax", "bb": "l_tax*l_tax"}
    return checks(ds.df.select(*[F.col(f"`{o}`").alias(n) for n, o in new.items()]), list(new), 2)


@query("select " + checks_sql(["aa"], 2) + " from (select l_quantity * l_quantity as aa from lineitem)")
def poly_rgs(spark, d):
    """The column that a forest finds most important for a number label, squared."""
    df = lineitem(spark, d, "l_quantity", "l_tax").withColumn("y", 3 * F.col("l_quantity"))
    ds = G.Polynomial(top=1, classify=False).fit_transform(Dataset.of(df, label="y"))
    return checks(ds.df.select(F.col("`l_quantity*l_quantity`").alias("aa")), ["aa"], 2)


@query("select doc_id, coalesce(length(text), 0)::double as chars from documents")
def text_embed_hook(spark, d):
    """A model of one's own in the place of a large one: the length of a text as a vector of one number."""
    ds = Dataset.of(table(spark, d, "documents").select("doc_id", "text"), ["text"], keep=("doc_id",))
    out = G.Embed(embed=lambda cells: cells.str.len().map(lambda n: [float(n)])).fit_transform(ds)
    return out.df.select("doc_id", F.coalesce(F.get("text_vector", F.lit(0)), F.lit(0.0)).cast("double").alias("chars"))


@query("select round(sum(var_pop), 4) as total, true as ordered, 4 as k from (select unnest([var_pop(l_quantity), var_pop(l_tax), var_pop(l_discount), var_pop(l_linenumber)]) as var_pop from lineitem)")
def pca(spark, d):
    stage = G.PCA(keep=0.999999)
    ds = fitted(stage, spark, d, ["l_quantity", "l_tax", "l_discount", "l_linenumber"])
    v = [F.var_pop(f"pc{k}") for k in range(len(ds.features))]
    total = reduce(lambda a, b: a + b, v)
    return ds.df.agg(F.round(total, 4).alias("total"), (v[0] >= v[1]).alias("ordered")).withColumn("k", F.lit(len(ds.features)))


@query("""with g as (select avg(l_quantity * l_quantity) as a, avg(l_quantity * l_linenumber) as b, avg(l_linenumber * l_linenumber) as c from lineitem)
select round((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b), 4) as first from g""")
def svd(spark, d):
    ds = fitted(G.SVD(target_dim=1), spark, d, ["l_quantity", "l_linenumber"])
    return ds.df.agg(F.round(F.avg(F.col("sv0") * F.col("sv0")), 4).alias("first"))


@query()
def fast_ica(spark, d):
    ds = fitted(G.FastICA(n_components=2), spark, d, ["l_quantity", "l_tax", "l_discount"])
    return ds.df.agg(*[F.round(F.var_pop(f"ic{k}"), 4).alias(f"var{k}") for k in range(2)], F.round(F.corr("ic0", "ic1"), 4).alias("corr"))


@query("select " + checks_sql(["m"]) + " from (select (l_tax + l_discount) / 2 as m from lineitem)")
def feature_agg(spark, d):
    ds = fitted(G.FeatureAgglomeration(n_clusters=2), spark, d, ["l_tax", "l_discount", "l_quantity"])
    return checks(ds.df.withColumnRenamed("cluster0", "m"), ["m"])


@query()
def kernel_pca(spark, d):
    ds = fitted(Chain(R.Standard(), G.KernelPCA(n_axes=2)), spark, d, ["l_quantity", "l_tax"])
    return checks(ds.df, ["kp0", "kp1"])


@query()
def rff(spark, d):
    ds = fitted(Chain(R.Standard(), G.RandomFourier(n_components=8)), spark, d, ["l_quantity", "l_tax"])
    return checks(ds.df, ["rf0", "rf7"])


@query()
def nystroem(spark, d):
    ds = fitted(Chain(R.Standard(), G.Nystroem(n_components=8)), spark, d, ["l_quantity", "l_tax"])
    return checks(ds.df, ["ny0", "ny7"])


@query("select 4.0::double as least, 4.0::double as most, count(*) as n from lineitem")  # one leaf in each of four trees
def tree_embed(spark, d):
    ds = fitted(G.TreeEmbedding(n_trees=4, depth=2), spark, d, ["l_quantity", "l_tax"])
    rows = reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in ds.features])
    return ds.df.agg(F.min(rows).alias("least"), F.max(rows).alias("most"), F.count("*").alias("n"))


@query()
def text2vector(spark, d):
    v = G.TextVectors(size=16).embed(spread(table(spark, d, "documents")), "text")
    return v.select(F.size("vector").alias("size"), F.exists("vector", lambda x: x != 0).alias("known")).groupBy("size", "known").agg(F.count("*").alias("n"))


# selectors


@query("select count(*) as n, 3 as width from lineitem")
def var_threshold(spark, d):
    ds = L.Variance().fit_transform(Dataset.of(lineitem(spark, d, "l_quantity", "l_tax", "l_discount").withColumn("one", F.lit(1.0))))
    return ds.df.agg(F.count("*").alias("n")).withColumn("width", F.lit(len(ds.features)))


def _scores(rows: dict[str, tuple[float, float]], spark) -> DataFrame:
    return spark.createDataFrame([(c, round(float(s), 6)) for c, (s, _) in rows.items()], "feature string, score double")


_CHI = "select '{c}' as feature, round(sum(power(o - so * n / sn, 2) / (so * n / sn)), 6) as score from (select l_returnflag, sum({c}) as o, count(*) as n from lineitem group by 1) g, (select sum({c}) as so, count(*) as sn from lineitem) t"


@query(" union all ".join(_CHI.format(c=c) for c in NUM))
def chi2_scores(spark, d):
    return _scores(L.chi2_scores(lineitem(spark, d, *NUM, "l_returnflag"), NUM, "l_returnflag"), spark)


_ANOVA = "select '{c}' as feature, round((sum(n * power(m - mm, 2)) / (count(*) - 1)) / (sum(n * v) / (any_value(nn) - count(*))), 6) as score from (select l_returnflag, count(*) as n, avg({c}) as m, var_pop({c}) as v from lineitem group by 1) g, (select avg({c}) as mm, count(*) as nn from lineitem) t"


@query(" union all ".join(_ANOVA.format(c=c) for c in NUM))
def anova_scores(spark, d):
    return _scores(L.anova_scores(lineitem(spark, d, *NUM, "l_returnflag"), NUM, "l_returnflag"), spark)


@query(" union all ".join(f"select '{c}' as feature, round(power(corr({c}, l_extendedprice), 2) / (1 - power(corr({c}, l_extendedprice), 2)) * (count(*) - 2), 6) as score from lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def regression_scores(spark, d):
    return _scores(L.regression_scores(lineitem(spark, d), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), spark)


def _selected(stage, sql: str):
    """The features that a selector keeps, against the scores in SQL."""

    def run(spark, d):
        ds = Dataset.of(lineitem(spark, d, *NUM, "l_returnflag") if stage().score != "f_regression" else lineitem(spark, d), NUM, "l_returnflag" if stage().score != "f_regression" else "l_extendedprice")
        return spark.createDataFrame([(f,) for f in stage().fit_transform(ds).features], "feature string")

    return run, f"select feature from ({sql}) s {{}}"


# two degrees of freedom, so the chance of a larger chi2 is exp(-chi2 / 2)
_CHI_ALL, _ANOVA_ALL = " union all ".join(_CHI.format(c=c) for c in NUM), " union all ".join(_ANOVA.format(c=c) for c in NUM)
_REGRESSION_ALL = " union all ".join(f"select '{c}' as feature, round(power(corr({c}, l_extendedprice), 2) / (1 - power(corr({c}, l_extendedprice), 2)) * (count(*) - 2), 6) as score from lineitem" for c in NUM if c != "l_extendedprice")
for _n, _stage, _all, _where in (
    ("univariate", lambda: L.Univariate(score="chi2", alpha=0.05), _CHI_ALL, "where exp(-score / 2) < 0.05"),
    ("univariate_fdr", lambda: L.Univariate(score="chi2", mode_of_test="fdr", alpha=0.05), _CHI_ALL, f"qualify exp(-score / 2) <= max(case when exp(-score / 2) <= 0.05 * r / {len(NUM)} then exp(-score / 2) end) over ()"),
    ("univariate_fwe", lambda: L.Univariate(score="chi2", mode_of_test="fwe", alpha=0.05), _CHI_ALL, f"where exp(-score / 2) < 0.05 / {len(NUM)}"),
    ("percentile_cls", lambda: L.Percentile(score="f_classif", percentile=50), _ANOVA_ALL, f"order by score desc limit {max(1, len(NUM) // 2)}"),
):
    Q[_n], _text = _selected(_stage, f"select *, row_number() over (order by score desc) as r from ({_all}) a")
    SQL[_n] = _text.format(_where)


@query(f"select feature from ({_REGRESSION_ALL}) s order by score desc limit 1")
def percentile_rgs(spark, d):
    ds = Dataset.of(lineitem(spark, d), [c for c in NUM if c != "l_extendedprice"], "l_extendedprice")
    return spark.createDataFrame([(f,) for f in L.Percentile(score="f_regression", percentile=50).fit_transform(ds).features], "feature string")


def _labelled(spark, d) -> Dataset:
    return Dataset.of(lineitem(spark, d).select("*", (F.col("l_quantity") > 25).cast("int").alias("y")), label="y")


def _kept(stage):
    def run(spark, d):
        ds = stage().fit_transform(_labelled(spark, d))
        return spark.createDataFrame([(f,) for f in ds.features], "feature string")

    return run


Q["et_sel_cls"] = _kept(lambda: L.ForestSelector(trees=10))
Q["et_sel_rgs"] = _kept(lambda: L.ForestSelector(classify=False, trees=10))
Q["linsvc_sel"] = _kept(L.LinearSelector)
Q["rfecv"] = _kept(lambda: L.RecursiveElimination())
_MI = """select '{c}' as feature, round(sum(n / t * ln(n * t / (nx * ny))), 6) as score from (select n, sum(n) over () as t, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny
from (select least(15, floor(({c} - lo) / ((hi - lo) / 16.0))) as x, l_quantity > 25 as y, count(*)::double as n from lineitem, (select min({c}) as lo, max({c}) as hi from lineitem) group by 1, 2))"""


@query(" union all ".join(_MI.format(c=c) for c in NUM))
def mutual_info(spark, d):
    return _scores({c: (s, 0.0) for c, s in L.mutual_information(_labelled(spark, d).df, NUM, "y").items()}, spark)


# balancing and splitting


@query("select min(n) * 4 <= max(n) as imbalanced from (select count(*) as n from orders group by o_orderstatus)")
def is_imbalanced(spark, d):
    return B.is_imbalanced(table(spark, d, "orders"), "o_orderstatus")


@query("select o_orderstatus, count(*) as n, round(sum(count(*)) over () / (2.0 * count(*)), 9) as weight from orders group by 1")
def class_weights(spark, d):
    return B.class_weights(table(spark, d, "orders"), "o_orderstatus").withColumn("weight", F.round("weight", 9))


@query("select o_orderstatus, round(sum(w), 4) as total from (select o_orderstatus, count(*) over () / (3.0 * count(*) over (partition by o_orderstatus)) as w from orders) group by 1")
def weight_balancer(spark, d):
    ds = B.with_weights(Dataset.of(table(spark, d, "orders"), ["o_totalprice"], "o_orderstatus"))
    return ds.df.groupBy("o_orderstatus").agg(F.round(F.sum("_weight"), 4).alias("total"))


_SKEWED = "(select o_orderkey, case when o_orderkey % 20 = 0 then 'rare' when o_orderkey % 3 = 0 then 'some' else 'most' end as y from orders)"


def _skewed(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 20 == 0, "rare").when(F.col("o_orderkey") % 3 == 0, "some").otherwise("most").alias("y"))


@query(f"select y, case when n < goal then goal else n end as n from (select y, count(*) as n from {_SKEWED} group by 1), (select floor(0.6 * quantile_cont(n, 0.5))::bigint as goal from (select count(*) as n from {_SKEWED} group by y))")
def oversample(spark, d):
    return B.oversample(_skewed(spark, d), "y", "o_orderkey").groupBy("y").agg(F.count("*").alias("n"))


@query()
def smote(spark, d):
    df = table(spark, d, "orders").select((F.col("o_orderkey") % 10 == 0).cast("int").alias("y"), "o_totalprice", F.col("o_custkey").cast("double").alias("cust"))
    return B.smote(df, "y", ["o_totalprice", "cust"]).groupBy("label").agg(F.count("*").alias("n"))


_RANK = "row_number() over (partition by {} order by md5(o_orderkey::varchar), o_orderkey)"


@query(f"select o_orderkey, r <= floor(n * 0.33 + 0.5) as is_test from (select o_orderkey, {_RANK.format('o_orderstatus')} as r, count(*) over (partition by o_orderstatus) as n from orders)")
def split_holdout_strat(spark, d):
    return P.holdout(table(spark, d, "orders"), "o_orderkey", 0.33, "o_orderstatus").select("o_orderkey", "is_test")


@query(f"select o_orderkey, r <= floor(n * 0.33 + 0.5) as is_test from (select o_orderkey, {_RANK.format('1')} as r, count(*) over () as n from orders)")
def split_holdout(spark, d):
    return P.holdout(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "is_test")


@query(f"select o_orderkey, r <= floor(n * 0.2 + 0.5) as is_test from (select o_orderkey, {_RANK.format('o_orderstatus')} as r, count(*) over (partition by o_orderstatus) as n from orders)")
def split_train_test(spark, d):
    return P.holdout(table(spark, d, "orders"), "o_orderkey", 0.2, "o_orderstatus").select("o_orderkey", "is_test")


@query(f"select o_orderkey, (({_RANK.format('o_orderstatus')} - 1) % 5)::int as fold from orders")
def kfold_strat(spark, d):
    return P.folds(table(spark, d, "orders"), "o_orderkey", 5, "o_orderstatus").select("o_orderkey", "fold")


@query(f"select o_orderkey, (({_RANK.format('1')} - 1) % 5)::int as fold from orders")
def kfold(spark, d):
    return P.folds(table(spark, d, "orders"), "o_orderkey", 5).select("o_orderkey", "fold")


@query(f"select o_orderkey from (select o_orderkey, {_RANK.format('o_orderstatus')} as r, count(*) over (partition by o_orderstatus) as n from orders) where r <= ceil(n * 0.25)")
def subsample_fidelity(spark, d):
    return P.subsample(table(spark, d, "orders"), "o_orderkey", 0.25, "o_orderstatus").select("o_orderkey")


QUERIES = Q
