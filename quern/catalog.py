"""The registered queries of the feature-engineering operators, with DuckDB SQL that computes the same rows.

Every query runs over its whole table. Doubles are rounded on both sides, as sums differ in their last bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import quern as Q
from quern.functions.exprs import q
from quern.session import scratch
from quern.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = "l_orderkey * 10 + l_linenumber AS k"
SQL_KEY = KEY


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(q(f.name), digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else q(f.name) for f in df.schema.fields])


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def lineitem(spark, sf) -> DataFrame:
    return read_table(spark, sf, "lineitem").selectExpr(KEY, *NUM)


def gappy(spark, sf) -> DataFrame:
    """Line items whose zero discounts and taxes are missing."""
    t = read_table(spark, sf, "lineitem")
    return t.selectExpr(KEY, "l_quantity", "nullif(l_discount, 0D) AS d", "nullif(l_tax, 0D) AS t")


SQL_GAPPY = f"SELECT {SQL_KEY}, l_quantity, nullif(l_discount, 0.0) AS d, nullif(l_tax, 0.0) AS t FROM lineitem"


def events(spark, sf) -> DataFrame:
    return read_table(spark, sf, "events").select("event_id", "user_id", "ts", "value", "event_type")


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def _simple(make, frame=lineitem, digits: int = 6) -> Query:
    return lambda spark, sf: rounded(make().fit_transform(frame(spark, sf)), digits)


def _affine(stats: str, expr: str, cols=NUM) -> str:
    picks = ", ".join(stats.format(c=c) for c in cols)
    return f"WITH s AS (SELECT {picks} FROM lineitem) SELECT {SQL_KEY}, " + ", ".join(r(expr.format(c=c), c) for c in cols) + " FROM lineitem, s"


add("standard_scaler", _simple(Q.StandardScaler), _affine("avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}", "({c} - m_{c}) / s_{c}"))
add("minmax_scaler", _simple(lambda: Q.MinMaxScaler((-1.0, 1.0))), _affine("min({c}) AS a_{c}, max({c}) AS b_{c}", "({c} - a_{c}) / (b_{c} - a_{c}) * 2 - 1"))
add("robust_scaler", _simple(Q.RobustScaler), _affine("quantile_cont({c}, [0.25, 0.5, 0.75]) AS p_{c}", "({c} - p_{c}[2]) / (p_{c}[3] - p_{c}[1])"))
add("maxabs_scaler", _simple(Q.MaxAbsScaler), _affine("max(abs({c})) AS m_{c}", "{c} / m_{c}"))
add("winsorizer", _simple(lambda: Q.Winsorizer(quantiles=(0.05, 0.9))), _affine("quantile_cont({c}, [0.05, 0.9]) AS p_{c}", "least(greatest({c}, p_{c}[1]), p_{c}[2])"))
IQR = "quantile_cont({c}, [0.25, 0.75]) AS p_{c}"
add("outlier_clipper_iqr", _simple(lambda: Q.OutlierClipper(method=Q.ClipMethod("iqr", 0.25))), _affine(IQR, "least(greatest({c}, p_{c}[1] - 0.25 * (p_{c}[2] - p_{c}[1])), p_{c}[2] + 0.25 * (p_{c}[2] - p_{c}[1]))"))
add("outlier_clipper_zscore", _simple(lambda: Q.OutlierClipper(method=Q.ClipMethod("zscore", 1.0))), _affine("avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}", "least(greatest({c}, m_{c} - s_{c}), m_{c} + s_{c})"))
add(
    "outlier_clipper_mad",
    _simple(lambda: Q.OutlierClipper(method=Q.ClipMethod("mad", 0.5))),
    "WITH m AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in NUM) + " FROM lineitem), d AS (SELECT "
    + ", ".join(f"1.4826 * quantile_cont(abs({c} - m_{c}), 0.5) AS d_{c}" for c in NUM) + f" FROM lineitem, m) SELECT {SQL_KEY}, "
    + ", ".join(r(f"least(greatest({c}, m_{c} - 0.5 * d_{c}), m_{c} + 0.5 * d_{c})", c) for c in NUM) + " FROM lineitem, m, d",
)
for _norm, _size in (("l1", " + ".join(f"abs({c})" for c in NUM)), ("l2", "sqrt(" + " + ".join(f"{c} * {c}" for c in NUM) + ")"), ("max", "greatest(" + ", ".join(f"abs({c})" for c in NUM) + ")")):
    add(
        f"normalizer_{_norm}",
        lambda spark, sf, n=_norm: rounded(Q.Normalizer(n).fit_transform(read_table(spark, sf, "lineitem").select(*NUM)), 9),
        "SELECT " + ", ".join(r(f"{c} / ({_size})", c, 9) for c in NUM) + " FROM lineitem",
    )
add("binarizer", _simple(lambda: Q.Binarizer(0.05)), f"SELECT {SQL_KEY}, " + ", ".join(f"CASE WHEN {c} > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}" for c in NUM) + " FROM lineitem")
add("log_transformer", _simple(lambda: Q.LogTransformer(NUM)), f"SELECT {SQL_KEY}, " + ", ".join(r(f"ln(1 + {c})", c) for c in NUM) + " FROM lineitem")
add(
    "log_transformer_log2",
    lambda spark, sf: rounded(Q.LogTransformer(["l_quantity"], "log2").fit_transform(lineitem(spark, sf).select("k", "l_quantity"))),
    f"SELECT {SQL_KEY}, {r('log2(l_quantity)', 'l_quantity')} FROM lineitem",
)
add("power_transformer", lambda spark, sf: rounded(Q.PowerTransformer().fit_transform(lineitem(spark, sf).select("k", "l_quantity", "l_extendedprice")), 3))
add("power_transformer_boxcox", lambda spark, sf: rounded(Q.PowerTransformer("box-cox").fit_transform(lineitem(spark, sf).select("k", "l_quantity", "l_extendedprice")), 3))


def _inverse(spark, sf):
    df = lineitem(spark, sf)
    return rounded(Q.StandardScaler().fit(df).inverse_transform(Q.StandardScaler().fit_transform(df)), 4)


add("standard_scaler_inverse", _inverse, f"SELECT {SQL_KEY}, " + ", ".join(r(c, c, 4) for c in NUM) + " FROM lineitem")
_GRID = ", ".join(f"{i}/10.0" for i in range(11))
add(
    "quantile_transformer",
    lambda spark, sf: rounded(Q.QuantileTransformer(11).fit_transform(lineitem(spark, sf).select("k", "l_extendedprice"))),
    f"""WITH g AS (SELECT quantile_cont(l_extendedprice, [{_GRID}]) AS p FROM lineitem),
    w AS (SELECT {SQL_KEY}, l_extendedprice AS x, p, len(list_filter(p, lambda e: e < l_extendedprice)) AS i FROM lineitem, g)
    SELECT k, {r('CASE WHEN x <= p[1] THEN 0.0 WHEN x >= p[11] THEN 1.0 ELSE (i - 1 + (x - p[i]) / (p[i + 1] - p[i])) / 10.0 END', 'l_extendedprice')} FROM w""",
)
add("quantile_transformer_normal", lambda spark, sf: rounded(Q.QuantileTransformer(101, "normal").fit_transform(lineitem(spark, sf).select("k", "l_extendedprice"))))
add(
    "kbins_uniform",
    lambda spark, sf: Q.KBinsDiscretizer(5, "uniform").fit_transform(lineitem(spark, sf).select("k", "l_extendedprice")),
    f"""WITH s AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem)
    SELECT {SQL_KEY}, (CASE WHEN l_extendedprice >= a + (b - a) * 4 / 5 THEN 4 WHEN l_extendedprice >= a + (b - a) * 3 / 5 THEN 3
      WHEN l_extendedprice >= a + (b - a) * 2 / 5 THEN 2 WHEN l_extendedprice >= a + (b - a) * 1 / 5 THEN 1 ELSE 0 END)::DOUBLE AS l_extendedprice FROM lineitem, s""",
)
add(
    "kbins_quantile_onehot",
    lambda spark, sf: Q.KBinsDiscretizer(4, "quantile", "onehot").fit_transform(lineitem(spark, sf).select("k", "l_extendedprice")),
    f"""WITH s AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS p FROM lineitem),
    b AS (SELECT {SQL_KEY}, len(list_filter(p, lambda e: e <= l_extendedprice)) AS b FROM lineitem, s)
    SELECT k, """ + ", ".join(f"(b = {j})::INT::DOUBLE AS l_extendedprice_bin_{j}" for j in range(4)) + " FROM b",
)
add("kbins_kmeans", lambda spark, sf: Q.KBinsDiscretizer(4, "kmeans").fit_transform(lineitem(spark, sf).select("k", "l_quantity")))

# encoders
orders_flags = lambda spark, sf: read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _onehot(spark, sf):
    t = read_table(spark, sf, "orders").select("o_orderpriority")
    out = Q.OneHotEncoder().fit_transform(t)
    return out.groupBy(*[q(c) for c in out.columns]).agg(F.count("*").alias("n"))


def _onehot_sql() -> str:
    return (
        "SELECT " + ", ".join(f"""(o_orderpriority = '{v}')::INT::DOUBLE AS "o_orderpriority_{v}" """ for v in _PRIO)
        + ", count(*) AS n FROM orders GROUP BY o_orderpriority"
    )


add("onehot_encoder", _onehot, _onehot_sql())
add(
    "label_encoder",
    lambda spark, sf: Q.LabelEncoder().fit_transform(read_table(spark, sf, "part").select("p_brand")).groupBy("p_brand").agg(F.count("*").alias("n")),
    "WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i, count(*) AS n FROM part GROUP BY p_brand) SELECT i AS p_brand, n FROM c",
)
add(
    "ordinal_encoder",
    lambda spark, sf: Q.OrdinalEncoder().fit_transform(read_table(spark, sf, "part").select("p_brand", "p_type")).groupBy("p_brand", "p_type").agg(F.count("*").alias("n")),
    """SELECT a.i AS p_brand, b.i AS p_type, count(*) AS n FROM part
    JOIN (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM part GROUP BY p_brand) a USING (p_brand)
    JOIN (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS i FROM part GROUP BY p_type) b USING (p_type) GROUP BY ALL""",
)
add(
    "count_encoder",
    lambda spark, sf: Q.CountEncoder().fit_transform(read_table(spark, sf, "part").select("p_brand")),
    "SELECT count(*) OVER (PARTITION BY p_brand) AS p_brand FROM part",
)
add(
    "frequency_encoder",
    lambda spark, sf: rounded(Q.FrequencyEncoder().fit_transform(read_table(spark, sf, "part").select("p_brand")), 9),
    f"SELECT {r('count(*) OVER (PARTITION BY p_brand) / (SELECT count(*) FROM part)', 'p_brand', 9)} FROM part",
)
add(
    "binary_encoder",
    lambda spark, sf: Q.BinaryEncoder().fit_transform(read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")),
    "WITH c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS i FROM orders GROUP BY 1) SELECT o_orderkey, "
    + ", ".join(f"(i >> {j}) & 1 AS o_orderpriority_bit_{j}" for j in range(3)) + " FROM orders JOIN c USING (o_orderpriority)",
)


def _segments(spark, sf):
    return read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("y"))


add(
    "target_encoder",
    lambda spark, sf: rounded(Q.TargetEncoder(2.0).fit_transform(_segments(spark, sf), "y")),
    f"""WITH g AS (SELECT avg(c_acctbal) AS g FROM customer), c AS (SELECT c_mktsegment, sum(c_acctbal) AS s, count(*) AS n FROM customer GROUP BY 1)
    SELECT c_custkey, {r('(s + 2 * g) / (n + 2)', 'c_mktsegment')}, {r('c_acctbal', 'y')} FROM customer JOIN c USING (c_mktsegment), g""",
)
add(
    "leave_one_out_encoder",
    lambda spark, sf: rounded(Q.LeaveOneOutEncoder(1.0).fit_transform(_segments(spark, sf), "y"), 5),
    f"""WITH g AS (SELECT avg(c_acctbal) AS g FROM customer), c AS (SELECT c_mktsegment, sum(c_acctbal) AS s, count(*) AS n FROM customer GROUP BY 1)
    SELECT c_custkey, {r('CASE WHEN n > 1 THEN (n - 1) / n * ((s - c_acctbal) / (n - 1)) + 1 / n * g ELSE g END', 'c_mktsegment', 5)}, {r('c_acctbal', 'y', 5)}
    FROM customer JOIN c USING (c_mktsegment), g""",
)


def _unseen(spark, sf):
    est = Q.LeaveOneOutEncoder(1.0)
    est.fit(_segments(spark, sf), "y")
    return rounded(est.transform_unseen(_segments(spark, sf).drop("y")), 5)


add(
    "leave_one_out_unseen",
    _unseen,
    f"""WITH g AS (SELECT avg(c_acctbal) AS g FROM customer), c AS (SELECT c_mktsegment, avg(c_acctbal) AS m, count(*) AS n FROM customer GROUP BY 1)
    SELECT c_custkey, {r('n / (n + 1) * m + (1 - n / (n + 1)) * g', 'c_mktsegment', 5)} FROM customer JOIN c USING (c_mktsegment), g""",
)


def _hash_sql() -> str:
    def h(c, p=""):
        return f"('0x' || substr(md5('{p}' || {c}), 1, 8))::BIGINT"

    cells = []
    for i in range(8):
        cells.append(" + ".join(f"CASE WHEN {h(c)} % 8 = {i} THEN CASE WHEN {h(c, 'sign:')} % 2 = 0 THEN 1.0 ELSE -1.0 END ELSE 0.0 END" for c in ("p_brand", "p_type")))
    return "SELECT " + ", ".join(f"({x})::DOUBLE AS hashed_{i}" for i, x in enumerate(cells)) + " FROM part"


add("feature_hasher", lambda spark, sf: Q.FeatureHasher(["p_brand", "p_type"], 8).fit_transform(read_table(spark, sf, "part")), _hash_sql())
_BRANDS = ["p_brand", "p_type"]


def _hasher_wide(spark, sf):
    """1024 buckets of 100 columns. A Parquet row group is one task, which is long for so many cells: rows are dealt out first."""
    part = read_table(spark, sf, "part").select(*_BRANDS).repartition(2 * spark.sparkContext.defaultParallelism)
    wide = part.select(*[F.concat(F.col(_BRANDS[i % 2]), F.lit(f"/{i}")).alias(f"c{i}") for i in range(100)])
    return Q.FeatureHasher(wide.columns, 1024).fit_transform(wide)


def _hasher_wide_sql() -> str:
    cells = ", ".join(f"{_BRANDS[i % 2]} || '/{i}'" for i in range(100))
    bucket = "('0x' || substr(md5(v), 1, 8))::BIGINT % 1024"
    sign = "CASE WHEN ('0x' || substr(md5('sign:' || v), 1, 8))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END"
    sums = f"SELECT i, {bucket} AS b, sum({sign})::DOUBLE AS s FROM (SELECT i, unnest([{cells}]) AS v FROM (SELECT row_number() OVER () AS i, * FROM part)) GROUP BY 1, 2"
    return f"SELECT {', '.join(f'coalesce(m[{i}], 0.0)::DOUBLE AS hashed_{i}' for i in range(1024))} FROM (SELECT i, map(list(b), list(s)) AS m FROM ({sums}) GROUP BY i)"


add("feature_hasher_wide", _hasher_wide, _hasher_wide_sql())
add(
    "rare_category_grouper",
    lambda spark, sf: Q.RareCategoryGrouper(["p_type"], min_frequency=0.1667).fit_transform(read_table(spark, sf, "part").select("p_partkey", "p_type")),
    "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_type) / (SELECT count(*) FROM part) >= 0.1667 THEN p_type ELSE 'Other' END AS p_type FROM part",
)
add(
    "string_cleaner",
    lambda spark, sf: Q.StringCleaner(["p_name"], trim=True, collapse_internal_ws=True, case_style="upper", replacements=[("([AEIOU])", "<$1>")]).fit_transform(read_table(spark, sf, "part").select("p_partkey", "p_name")),
    r"SELECT p_partkey, regexp_replace(upper(regexp_replace(trim(p_name), '\s+', ' ', 'g')), '([AEIOU])', '<\1>', 'g') AS p_name FROM part",
)
add(
    "string_cleaner_title",
    lambda spark, sf: Q.StringCleaner(["p_name"], case_style="title").fit_transform(read_table(spark, sf, "part").select("p_partkey", "p_name")),
    r"SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(p_name, '\s+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS p_name FROM part",
)
add(
    "cyclical_encoder",
    lambda spark, sf: rounded(Q.CyclicalEncoder(["l_quantity"], 7.0).fit_transform(lineitem(spark, sf).select("k", "l_quantity"))),
    f"SELECT {SQL_KEY}, l_quantity, {r('sin(l_quantity * 2 * pi() / 7)', 'l_quantity_sin')}, {r('cos(l_quantity * 2 * pi() / 7)', 'l_quantity_cos')} FROM lineitem",
)

# missing values and column removal
for _how, _d, _t in (("mean", "avg(d)", "avg(t)"), ("median", "quantile_cont(d, 0.5)", "quantile_cont(t, 0.5)")):
    add(
        f"simple_imputer_{_how}",
        lambda spark, sf, h=_how: rounded(Q.SimpleImputer(h).fit_transform(gappy(spark, sf))),
        f"WITH x AS ({SQL_GAPPY}), s AS (SELECT {_d} AS fd, {_t} AS ft FROM x) SELECT k, l_quantity, {r('coalesce(d, fd)', 'd')}, {r('coalesce(t, ft)', 't')} FROM x, s",
    )
_MODE = "(SELECT {c} FROM x WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
add(
    "simple_imputer_most_frequent",
    lambda spark, sf: rounded(Q.SimpleImputer("most_frequent").fit_transform(gappy(spark, sf))),
    f"WITH x AS ({SQL_GAPPY}) SELECT k, l_quantity, {r('coalesce(d, ' + _MODE.format(c='d') + ')', 'd')}, {r('coalesce(t, ' + _MODE.format(c='t') + ')', 't')} FROM x",
)
add("simple_imputer_constant", lambda spark, sf: rounded(Q.SimpleImputer(-1.0).fit_transform(gappy(spark, sf))), f"WITH x AS ({SQL_GAPPY}) SELECT k, l_quantity, {r('coalesce(d, -1.0)', 'd')}, {r('coalesce(t, -1.0)', 't')} FROM x")
add("auto_imputer", lambda spark, sf: rounded(Q.AutoImputer().fit_transform(gappy(spark, sf))), f"WITH x AS ({SQL_GAPPY}), s AS (SELECT avg(d) AS fd, avg(t) AS ft FROM x) SELECT k, l_quantity, {r('coalesce(d, fd)', 'd')}, {r('coalesce(t, ft)', 't')} FROM x, s")
add("missing_indicator", lambda spark, sf: rounded(Q.MissingIndicator(["d", "t"]).fit_transform(gappy(spark, sf))), f"WITH x AS ({SQL_GAPPY}) SELECT k, l_quantity, {r('d', 'd')}, {r('t', 't')}, (d IS NULL)::INT::DOUBLE AS d_missing, (t IS NULL)::INT::DOUBLE AS t_missing FROM x")
add(
    "constant_column_remover",
    lambda spark, sf: Q.ConstantColumnRemover().fit_transform(read_table(spark, sf, "nation").select("n_nationkey", F.lit("x").alias("c"), "n_name")),
    "SELECT n_nationkey, n_name FROM nation",
)
add(
    "constant_column_remover_keeps_nulls",
    lambda spark, sf: Q.ConstantColumnRemover(ignore_nulls=False).fit_transform(
        read_table(spark, sf, "nation").select("n_nationkey", F.lit("x").alias("c"), F.lit(None).cast("double").alias("none"), F.when(F.col("n_nationkey") > 3, 1.0).alias("some"))
    ),
    "SELECT n_nationkey, CAST(NULL AS DOUBLE) AS none, CASE WHEN n_nationkey > 3 THEN 1.0::DOUBLE END AS some FROM nation",
)
add(
    "duplicate_column_remover",
    lambda spark, sf: Q.DuplicateColumnRemover().fit_transform(read_table(spark, sf, "nation").select("n_nationkey", F.col("n_nationkey").alias("again"), "n_name")),
    "SELECT n_nationkey, n_name FROM nation",
)
add("variance_threshold", lambda spark, sf: rounded(Q.VarianceThreshold(1.0).fit_transform(lineitem(spark, sf))), f"SELECT {r('l_quantity', 'l_quantity')}, {r('l_extendedprice', 'l_extendedprice')} FROM lineitem")

# generation
_P = ["l_quantity", "l_discount"]
_POLY = ", ".join([r("1.0", "bias"), r("l_discount", "l_discount"), r("l_quantity", "l_quantity"), r("l_discount * l_discount", '"l_discount^"'), r("l_quantity * l_discount", "l_quantity_l_discount_inter"), r("l_quantity * l_quantity", '"l_quantity^"')])
add("polynomial_features", lambda spark, sf: rounded(Q.PolynomialFeatures(2).fit_transform(lineitem(spark, sf).select("k", *_P))), f"SELECT {_POLY}, {SQL_KEY} FROM lineitem")
_I = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1 :]]
add("interaction_features", _simple(Q.InteractionFeatures, digits=4), f"SELECT {SQL_KEY}, " + ", ".join(r(c, c, 4) for c in NUM) + ", " + ", ".join(r(f"{a} * {b}", f"{a}_x_{b}", 4) for a, b in _I) + " FROM lineitem")
add(
    "ratio_features",
    lambda spark, sf: rounded(Q.RatioFeatures(["l_tax", "l_quantity"], epsilon=0.5).fit_transform(lineitem(spark, sf).select("k", "l_quantity", "l_tax"))),
    f"SELECT {SQL_KEY}, l_quantity, {r('l_tax', 'l_tax')}, {r('l_quantity / (l_tax + 0.5)', 'l_quantity_div_l_tax')} FROM lineitem",
)
orders_dates = lambda spark, sf: read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
_PARTS = ("year", "month", "day", "hour", "minute", "second", "weekday", "day_of_year", "week_of_year", "quarter", "is_weekend")
_DUCK = {"weekday": "isodow(o_orderdate) - 1", "day_of_year": "dayofyear(o_orderdate)", "week_of_year": "weekofyear(o_orderdate)", "is_weekend": "CASE WHEN isodow(o_orderdate) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"}
add(
    "datetime_features",
    lambda spark, sf: Q.DatetimeFeatures(["o_orderdate"], _PARTS).fit_transform(orders_dates(spark, sf)).drop("o_orderdate"),
    "SELECT o_orderkey, " + ", ".join(f"{_DUCK.get(p, f'{p}(o_orderdate)')} AS o_orderdate_{p}" for p in _PARTS) + " FROM orders",
)
add(
    "time_since",
    lambda spark, sf: rounded(Q.TimeSince(["o_orderdate"], "days", "min").fit_transform(orders_dates(spark, sf)).drop("o_orderdate")),
    f"SELECT o_orderkey, {r('(epoch_us(o_orderdate) - epoch_us(min(o_orderdate) OVER ())) / 86400000000.0', 'o_orderdate_since_days')} FROM orders",
)
_US = """(m = 1 AND d = 1) OR (m = 1 AND w = 1 AND d BETWEEN 15 AND 21) OR (m = 2 AND w = 1 AND d BETWEEN 15 AND 21) OR (m = 5 AND w = 1 AND d >= 25)
 OR (m = 6 AND d = 19 AND y >= 2021) OR (m = 7 AND d = 4) OR (m = 9 AND w = 1 AND d <= 7) OR (m = 10 AND w = 1 AND d BETWEEN 8 AND 14)
 OR (m = 11 AND d = 11) OR (m = 11 AND w = 4 AND d BETWEEN 22 AND 28) OR (m = 12 AND d = 25)"""
add(
    "holiday_encoder",
    lambda spark, sf: Q.HolidayEncoder(["o_orderdate"], "US").fit_transform(orders_dates(spark, sf)).drop("o_orderdate"),
    f"""WITH x AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, isodow(o_orderdate) AS w FROM orders)
    SELECT o_orderkey, CASE WHEN {_US} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o_orderdate_is_holiday FROM x""",
)

# time series
_BY = {"order_by": ["ts", "event_id"], "partition_by": "user_id"}
_W = "PARTITION BY user_id ORDER BY ts, event_id"


def _series(make, digits=6) -> Query:
    return lambda spark, sf: rounded(make().fit_transform(events(spark, sf)).drop("ts", "event_type", "value", "user_id"), digits)


add("lagger", _series(lambda: Q.Lagger("value", [1, -1], **_BY)), f"SELECT event_id, {r(f'lag(value, 1) OVER ({_W})', 'value_lag_1')}, {r(f'lead(value, 1) OVER ({_W})', '\"value_lag_-1\"')} FROM events")
add(
    "lagger_of_a_lag",
    lambda spark, sf: rounded(Q.Lagger(["value", "value_lag_1"], 1, **_BY).fit_transform(events(spark, sf).withColumn("value_lag_1", F.lit(0.0))).select("event_id", "value_lag_1", "value_lag_1_lag_1")),
    f"SELECT event_id, {r(f'lag(value, 1) OVER ({_W})', 'value_lag_1')}, {r(f'lag(value, 2) OVER ({_W})', 'value_lag_1_lag_1')} FROM events",
)
add("difference", _series(lambda: Q.Difference("value", 2, **_BY)), f"SELECT event_id, {r(f'value - lag(value, 2) OVER ({_W})', 'value_diff_2')} FROM events")
add("pct_change", _series(lambda: Q.Difference("value", 1, pct=True, **_BY), 4), f"WITH x AS (SELECT event_id, value, lag(value) OVER ({_W}) AS p FROM events) SELECT event_id, {r('CASE WHEN abs(p) > 2.220446049250313e-16 THEN (value - p) / p END', 'value_pct_1', 4)} FROM x")
_AGG = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max", "sum": "sum"}
for _fn, _f in _AGG.items():
    _frame = f"({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
    add(f"rolling_{_fn}", _series(lambda fn=_fn: Q.RollingAggregator("value", 4, function=fn, **_BY), 5), f"SELECT event_id, {r(f'CASE WHEN count(value) OVER {_frame} = 4 THEN {_f}(value) OVER {_frame} END', f'value_{_fn}_4', 5)} FROM events")
    _frame = f"({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    add(f"expanding_{_fn}", _series(lambda fn=_fn: Q.ExpandingAggregator("value", function=fn, min_periods=2, **_BY), 10 if _fn == "mean" else 5), f"SELECT event_id, {r(f'CASE WHEN count(value) OVER {_frame} >= 2 THEN {_f}(value) OVER {_frame} END', f'value_expanding_{_fn}', 10 if _fn == 'mean' else 5)} FROM events")
add(
    "ewma",
    _series(lambda: Q.ExponentiallyWeightedMovingAverage("value", alpha=0.5, **_BY)),
    f"""WITH x AS (SELECT event_id, list(value) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events),
    y AS (SELECT event_id, list_sum(list_transform(v, lambda e, i: e * pow(0.5, len(v) - i))) / list_sum(list_transform(v, lambda e, i: pow(0.5, len(v) - i))) AS m FROM x)
    SELECT event_id, {r('m', '"value_ewm_mean_0.5"')} FROM y""",
)
add("ewma_std", _series(lambda: Q.ExponentiallyWeightedMovingAverage("value", span=5, statistic="std", **_BY)))

# text
_NAMES = "WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS t FROM part)"


def _terms(make) -> Query:
    """The vectors as (row, term, weight), without zeros."""

    def run(spark, sf):
        part = read_table(spark, sf, "part").select("p_partkey", "p_name")
        model = make().fit(part)
        out = model.prepare(part)
        names = F.array(*[F.lit(t) for t in model.terms])
        cells = out.select("p_partkey", F.explode(F.arrays_zip(names.alias("term"), F.col("__counts").alias("n"))).alias("c"))
        return rounded(cells.select("p_partkey", "c.term", "c.n").where("n <> 0"))

    return run


_TOP = "e AS (SELECT p_partkey, unnest(t) AS term FROM w), c AS (SELECT p_partkey, term, count(*)::DOUBLE AS n FROM e GROUP BY ALL), v AS (SELECT term, count(*) AS df, sum(n) AS total FROM c GROUP BY term ORDER BY total DESC, term LIMIT 20)"
add("count_vectorizer", _terms(lambda: Q.CountVectorizer("p_name", max_features=20)), f"{_NAMES}, {_TOP} SELECT p_partkey, term, n FROM c WHERE term IN (SELECT term FROM v)")
add(
    "tfidf_vectorizer",
    _terms(lambda: Q.TFIDFVectorizer("p_name", max_features=20)),
    f"""{_NAMES}, {_TOP}, x AS (SELECT p_partkey, term, n * (ln((1.0 + (SELECT count(*) FROM part)) / (1.0 + df)) + 1) AS x FROM c JOIN v USING (term))
    SELECT p_partkey, term, {r('x / sqrt(sum(x * x) OVER (PARTITION BY p_partkey))', 'n')} FROM x""",
)
add(
    "char_ngram_vectorizer",
    _terms(lambda: Q.CharacterNGramVectorizer("p_name", ngram_range=(2, 2), max_features=20)),
    f"WITH e AS (SELECT p_partkey, substr(lower(p_name), i, 2) AS term FROM part, range(1, 200) g(i) WHERE i < length(p_name)), {_TOP[_TOP.index('c AS') :]} SELECT p_partkey, term, n FROM c WHERE term IN (SELECT term FROM v)",
)

# selection
classed = lambda spark, sf: read_table(spark, sf, "lineitem").select(*NUM, (F.col("l_returnflag") == "R").cast("double").alias("y"))


def _scores(make) -> Query:
    def run(spark, sf):
        model = make().fit(classed(spark, sf), "y")
        rows = ",".join(f"('{n}', CAST('{s!r}' AS DOUBLE), {int(n in model.columns)})" for n, s in model.scores)
        return rounded(spark.sql(f"SELECT * FROM VALUES {rows} AS t(feature, score, kept)").withColumn("kept", F.col("kept").cast("long")), 4)

    return run


_ANOVA = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS score
    FROM (SELECT l_returnflag = 'R' AS y, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY 1), (SELECT avg({c}) AS g FROM lineitem)"""
    for c in NUM
)
add("select_k_best_anova", _scores(lambda: Q.SelectKBest(2)), f"SELECT feature, {r('score', 'score', 4)}, (row_number() OVER (ORDER BY score DESC) <= 2)::BIGINT AS kept FROM ({_ANOVA})")
_REG = " UNION ALL ".join(f"SELECT '{c}' AS feature, pow(corr({c}, (l_returnflag = 'R')::INT), 2) / (1 - pow(corr({c}, (l_returnflag = 'R')::INT), 2)) * (count(*) - 2) AS score FROM lineitem" for c in NUM)
add("select_percentile_regression", _scores(lambda: Q.SelectPercentile(50.0, Q.f_regression)), f"SELECT feature, {r('score', 'score', 4)}, (row_number() OVER (ORDER BY score DESC) <= 2)::BIGINT AS kept FROM ({_REG})")


def _twins(spark, sf):
    return lineitem(spark, sf).withColumn("twice", F.col("l_quantity") * 2 + F.col("l_discount"))


add("correlation_threshold", lambda spark, sf: rounded(Q.CorrelationThreshold(0.95).fit_transform(_twins(spark, sf))), "SELECT " + ", ".join(r(c, c) for c in NUM) + " FROM lineitem")
add("correlation_threshold_spearman", lambda spark, sf: rounded(Q.CorrelationThreshold(0.95, "spearman").fit_transform(_twins(spark, sf))), "SELECT " + ", ".join(r(c, c) for c in NUM) + " FROM lineitem")
add("mutual_information", _scores(lambda: Q.MutualInformationSelector(2)))
add("mutual_information_regression", _scores(lambda: Q.MutualInformationSelector(2, "regression")))

# composition
_SCALED = "WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, min(l_discount) AS a, max(l_discount) AS b FROM lineitem)"
add(
    "pipeline_scale_poly",
    lambda spark, sf: rounded(Q.Pipeline([("scale", Q.StandardScaler()), ("poly", Q.PolynomialFeatures(2, include_bias=False))]).fit_transform(lineitem(spark, sf).select("k", *_P)), 5),
    f"""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem),
    x AS (SELECT {SQL_KEY}, (l_quantity - mq) / sq AS l_quantity, (l_discount - md) / sd AS l_discount FROM lineitem, s)
    SELECT {", ".join([r("l_discount", "l_discount", 5), r("l_quantity", "l_quantity", 5), r("l_discount * l_discount", '"l_discount^"', 5), r("l_quantity * l_discount", "l_quantity_l_discount_inter", 5), r("l_quantity * l_quantity", '"l_quantity^"', 5)])}, k FROM x""",
)
_CT = [("z", Q.StandardScaler(), ["l_quantity"]), ("m", Q.MinMaxScaler(), ["l_discount"])]
add(
    "column_transformer",
    lambda spark, sf: rounded(Q.ColumnTransformer(_CT, "passthrough").fit_transform(lineitem(spark, sf).select("k", "l_tax", "l_discount", "l_quantity"))),
    f"{_SCALED} SELECT {r('(l_quantity - mq) / sq', 'l_quantity')}, {r('(l_discount - a) / (b - a)', 'l_discount')}, {SQL_KEY}, {r('l_tax', 'l_tax')} FROM lineitem, s",
)
add(
    "feature_union",
    lambda spark, sf: rounded(Q.FeatureUnion([("keep", Q.VarianceThreshold(1.0)), ("poly", Q.ColumnTransformer([("x", Q.PolynomialFeatures(2, True, False), ["l_tax", "l_discount"])]))]).fit_transform(lineitem(spark, sf))),
    f"SELECT {r('l_quantity', 'l_quantity')}, {r('l_extendedprice', 'l_extendedprice')}, {r('l_tax', 'l_tax')}, {r('l_discount', 'l_discount')}, {r('l_tax * l_discount', 'l_tax_l_discount_inter')} FROM lineitem",
)


def _routed():
    from quern.plans.compose import is_string, name_matches

    return Q.ConditionalPipeline().rule(name_matches("acct"), Q.StandardScaler()).rule(is_string, Q.CountEncoder())


add(
    "conditional_pipeline",
    lambda spark, sf: rounded(_routed().fit_transform(read_table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"))),
    f"SELECT {r('(c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer)', 'c_acctbal')}, count(*) OVER (PARTITION BY c_mktsegment) AS c_mktsegment FROM customer",
)
add("cached_pipeline", lambda spark, sf: rounded(Q.CachedPipeline(Q.StandardScaler(), 4).fit_transform(lineitem(spark, sf))), SQL["standard_scaler"])

# automation
add("auto_scaler", lambda spark, sf: rounded(Q.AutoScaler().fit_transform(lineitem(spark, sf)), 4))
add(
    "auto_type_detector",
    lambda spark, sf: Q.AutoTypeDetector(hash_buckets=8).fit_transform(read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")),
    "SELECT (o_orderstatus = 'F')::INT::DOUBLE AS \"o_orderstatus_F\", (o_orderstatus = 'O')::INT::DOUBLE AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INT::DOUBLE AS \"o_orderstatus_P\", o_orderkey FROM orders",
)
add(
    "auto_pipeline",
    lambda spark, sf: rounded(Q.AutoPipeline.from_inferred_schema(c := read_table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")).fit_transform(c), 5),
)


def _report(spark, sf):
    rep = Q.DataQualityReport.from_dataframe(read_table(spark, sf, "customer"))
    rows = [(c.name, c.non_null_count, c.null_count, c.unique_count, c.cardinality) for c in rep.columns]
    values = ",".join(f"('{n}', {a}L, {b}L, {u}L, '{k}')" for n, a, b, u, k in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(name, non_null_count, null_count, unique_count, cardinality)")


add(
    "data_quality_report",
    _report,
    "WITH x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    + ") SELECT *, CASE WHEN unique_count < 20 THEN 'Low' WHEN unique_count < 1000 THEN 'Medium' ELSE 'High' END AS cardinality FROM x",
)


def _report_numbers(spark, sf):
    c = next(x for x in Q.DataQualityReport.from_dataframe(read_table(spark, sf, "part").select("p_retailprice")).columns)
    s, o = c.statistics, c.outliers
    return rounded(spark.sql(f"SELECT CAST('{s.mean!r}' AS DOUBLE) AS mean, CAST('{s.std!r}' AS DOUBLE) AS std, CAST('{s.skew!r}' AS DOUBLE) AS skew, CAST('{s.kurtosis!r}' AS DOUBLE) AS kurtosis, {o.iqr_outlier_count}L AS iqr, {o.zscore_outlier_count}L AS z"), 5)


add(
    "data_quality_numbers",
    _report_numbers,
    f"""WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS d, quantile_cont(p_retailprice, [0.25, 0.75]) AS q FROM part)
    SELECT {r('any_value(m)', 'mean', 5)}, {r('any_value(d)', 'std', 5)}, {r('avg(pow((p_retailprice - m) / d, 3))', 'skew', 5)}, {r('avg(pow((p_retailprice - m) / d, 4))', 'kurtosis', 5)},
    count(*) FILTER (WHERE p_retailprice < q[1] - 1.5 * (q[2] - q[1]) OR p_retailprice > q[2] + 1.5 * (q[2] - q[1])) AS iqr, count(*) FILTER (WHERE abs(p_retailprice - m) > 3 * d) AS z FROM part, s""",
)


def _stream(spark, sf):
    """A fitted scaler on a stream of files, brought to its end."""
    from quern.streaming.apply import read_parquet_stream, transform_stream

    batch = read_table(spark, sf, "events").select("event_id", "value")
    model = Q.StandardScaler().fit(batch)
    folder = f"{scratch(spark)}/quern-stream-{uuid.uuid4().hex}"
    stream = read_parquet_stream(spark, f"{sf.rstrip('/')}/events.parquet*", read_table(spark, sf, "events").schema).select("event_id", "value")
    out = transform_stream(model, stream)
    run = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return rounded(spark.read.schema(out.schema).parquet(f"{folder}/rows"))


add("streaming_standard_scaler", _stream, f"SELECT event_id, {r('(value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events)', 'value')} FROM events")
