import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import quern as Q
from quern.errors import Computation, InvalidInput, NotFitted
from quern.functions.stats import quantiles
from quern.plans.compose import is_float64, is_int, is_string, name_matches

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def numeric(spark):
    rows = zip([1, 2, 3, 4, 5, 6], [2, 1, 4, 3, 6, 5], [1, 3, 2, 5, 4, 6], strict=True)
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double")


@pytest.fixture(scope="module")
def colors(spark):
    return spark.createDataFrame([("red", "S"), ("blue", "M"), ("red", "L"), ("green", "S")], "color string, size string")


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")


def column(df, name="x", by="i"):
    return [r[name] for r in df.orderBy(by).collect()]


NUMERIC = [Q.StandardScaler(), Q.MinMaxScaler(), Q.RobustScaler(), Q.MaxAbsScaler(), Q.Winsorizer(), Q.OutlierClipper(), Q.KBinsDiscretizer(2, "uniform"), Q.PowerTransformer(), Q.QuantileTransformer(5), Q.AutoScaler(), Q.VarianceThreshold(0.1), Q.PolynomialFeatures(2), Q.InteractionFeatures(), Q.RatioFeatures(), Q.CorrelationThreshold(0.99), Q.LogTransformer(), Q.SimpleImputer(), Q.AutoImputer()]
NEED_VALUES = (Q.StandardScaler, Q.MinMaxScaler, Q.RobustScaler, Q.MaxAbsScaler, Q.Winsorizer, Q.OutlierClipper, Q.KBinsDiscretizer, Q.PowerTransformer, Q.QuantileTransformer, Q.LogTransformer, Q.SimpleImputer)


@pytest.mark.parametrize("est", NUMERIC, ids=lambda e: type(e).__name__)
def test_names_match_frames_and_errors(spark, numeric, est):
    model = est.fit(numeric)
    assert model.feature_names_out(numeric.schema) == model.transform(numeric).columns
    with pytest.raises(NotFitted):
        type(est)().transform(numeric) if type(est) is not Q.PolynomialFeatures else Q.PolynomialFeatures(2).transform(numeric)
    with pytest.raises(InvalidInput):
        est.fit(spark.createDataFrame([("x",)], "s string"))
    with pytest.raises(NotFitted):  # a failed fit forgets the earlier model
        est.transform(numeric)
    with pytest.raises(InvalidInput):
        est.fit(numeric.limit(0))
    if isinstance(est, NEED_VALUES):
        with pytest.raises(Computation):
            est.fit(spark.createDataFrame([(None,), (NAN,)], "x double"))


@pytest.mark.parametrize("est", [Q.StandardScaler(), Q.MinMaxScaler((-2, 3)), Q.RobustScaler(), Q.MaxAbsScaler(), Q.LogTransformer(), Q.LogTransformer(method=3.0), Q.PowerTransformer(), Q.PowerTransformer("box-cox"), Q.QuantileTransformer(6), Q.QuantileTransformer(6, "normal")], ids=str)
def test_inverse(numeric, est):
    model = est.fit(numeric)
    back = model.inverse_transform(model.transform(numeric))
    for a, b in zip(numeric.collect(), back.collect(), strict=True):
        assert all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip(a, b, strict=True))


def test_scalers_pass_missing_and_spread(spark):
    df = frame(spark, [1.0, 2.0, 3.0, None, NAN, INF])
    z = column(Q.StandardScaler().fit_transform(df))
    assert math.isclose(z[0], -math.sqrt(1.5)) and z[3] is None and math.isnan(z[4]) and z[5] == INF
    with pytest.raises(Computation):
        Q.StandardScaler().fit(frame(spark, [1.0, 1.0]))
    assert column(Q.MaxAbsScaler().fit_transform(frame(spark, [0.0, -0.0]))) == [0.0, 0.0]
    with pytest.raises(InvalidInput):
        Q.MinMaxScaler().fit(frame(spark, [1.0, INF]))


def test_partitioning_does_not_matter(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity")
    one, many = (Q.StandardScaler().fit(d).params["l_quantity"] for d in (df.repartition(1), df.repartition(7)))
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(one, many, strict=True))


def test_quantiles_are_exact_at_any_size(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 7 == 0, 3.0).otherwise((F.col("id") * 37 % 1009).cast("double")).alias("x"))
    probs = [0.0, 0.01, 0.33, 0.5, 0.95, 1.0]
    assert quantiles(df, ["x"], probs, small=10)["x"] == pytest.approx(quantiles(df, ["x"], probs)["x"], abs=1e-12)


def test_clip_and_bins(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 100.0, None, NAN])
    assert column(Q.OutlierClipper(method=Q.ClipMethod("iqr", 1.5)).fit_transform(df))[3] < 100
    flat = column(Q.OutlierClipper().fit_transform(frame(spark, [5.0, 5.0, 5.0, 5.0, 9.0])))
    assert flat[-1] == 9.0
    bins = column(Q.KBinsDiscretizer(3, "uniform").fit_transform(df))
    assert bins[:4] == [0, 0, 0, 2] and bins[4] is None and math.isnan(bins[5])
    hot = Q.KBinsDiscretizer(2, "uniform", "onehot").fit_transform(df).orderBy("i").collect()
    assert [tuple(r)[1:] for r in hot[4:]] == [(0.0, 0.0), (0.0, 0.0)]
    assert column(Q.KBinsDiscretizer(3, "kmeans").fit_transform(frame(spark, [1.0, 1.1, 5.0, 5.1, 9.0]))) == [0, 0, 1, 1, 2]


def test_normalizer_binarizer(spark):
    df = spark.createDataFrame([(3.0, 4.0), (0.0, 0.0), (None, 2.0), (NAN, 2.0)], "a double, b double")
    got = [tuple(r) for r in Q.Normalizer("l2").fit_transform(df).collect()]
    assert got[0] == (0.6, 0.8) and got[1] == (0.0, 0.0) and got[2] == (None, 1.0) and math.isnan(got[3][0])
    with pytest.raises(Exception, match="not finite"):
        Q.Normalizer("l1").fit_transform(spark.createDataFrame([(INF, 1.0)], "a double, b double")).collect()
    assert [r.a for r in Q.Binarizer(1.0).fit_transform(df).collect()] == [1.0, 0.0, None, None]


def test_log_ieee(spark):
    df = frame(spark, [0.0, -1.0, math.e, None, NAN, INF])
    got = column(Q.LogTransformer(["x"], "ln", check_positive=False).fit_transform(df))
    assert got[0] == -INF and math.isnan(got[1]) and got[2] == 1.0 and got[3] is None and math.isnan(got[4]) and got[5] == INF
    with pytest.raises(InvalidInput, match="not above 0"):
        Q.LogTransformer(["x"], "ln").fit(df)


def test_onehot(spark, colors):
    model = Q.OneHotEncoder().fit(colors)
    assert model.transform(colors).columns == ["color_blue", "color_green", "color_red", "size_L", "size_M", "size_S"]
    odd = spark.createDataFrame([("pink", "S"), (None, "S")], "color string, size string")
    with pytest.raises(InvalidInput, match="pink"):
        model.transform(odd)
    rows = Q.OneHotEncoder(handle_unknown="ignore").fit(colors).transform(odd).collect()
    assert [tuple(r)[:3] for r in rows] == [(0.0, 0.0, 0.0)] * 2


def test_lookup_encoders(spark, colors):
    odd = spark.createDataFrame([("red", None), ("pink", "S")], "color string, size string")
    assert [r.color for r in Q.CountEncoder().fit_transform(colors).collect()] == [2, 1, 2, 1]
    assert [tuple(r) for r in Q.CountEncoder().fit(colors).transform(odd).collect()] == [(2, None), (0, 2)]
    assert [tuple(r) for r in Q.OrdinalEncoder().fit(colors).transform(odd).collect()] == [(2, None), (None, 2)]
    assert [tuple(r) for r in Q.FrequencyEncoder().fit(colors).transform(odd).collect()] == [(0.5, None), (0.0, 0.5)]
    bits = Q.BinaryEncoder().fit_transform(colors)
    assert bits.columns == ["color_bit_0", "color_bit_1", "size_bit_0", "size_bit_1"]
    assert [tuple(r)[:2] for r in bits.collect()] == [(0, 1), (0, 0), (0, 1), (1, 0)]
    with pytest.raises(InvalidInput):
        Q.LabelEncoder().fit(colors)


def test_target_and_leave_one_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0), ("a", None)], "c string, y double")
    got = [r.c for r in Q.TargetEncoder(1.0).fit_transform(df, "y").collect()]
    assert got == pytest.approx([8 / 3, 8 / 3, 4.5, None, 8 / 3]) or got[3] is None
    est = Q.LeaveOneOutEncoder()
    loo = [r.c for r in est.fit_transform(df, "y").collect()]
    assert loo == [3.0, 1.0, 4.0, None, 2.0]
    with pytest.raises(InvalidInput, match="training frame"):
        est.transform(df.limit(2))
    unseen = spark.createDataFrame([("a",), ("z",)], "c string")
    assert [r.c for r in est.transform_unseen(unseen).collect()] == [2.0, 4.0]


def test_large_maps_are_joined(spark, monkeypatch, colors):
    import quern.operators.encoders as enc

    monkeypatch.setattr(enc, "LITERAL", 1)
    assert sorted(r.color for r in Q.CountEncoder().fit_transform(colors).collect()) == [1, 1, 2, 2]
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0), ("a", None)], "c string, y double")
    out = Q.LeaveOneOutEncoder().fit_transform(df, "y")
    assert out.columns == ["c", "y"]
    assert {(r.y, r.c) for r in out.collect()} == {(1.0, 3.0), (3.0, 1.0), (5.0, 4.0), (7.0, None), (None, 2.0)}


def test_rare_cleaner_cyclical_hash(spark, colors):
    assert [r.color for r in Q.RareCategoryGrouper(["color"], min_count=2).fit_transform(colors).collect()] == ["red", "Other", "red", "Other"]
    df = spark.createDataFrame([("　 ab\t cd ",), (None,)], "s string")
    assert Q.StringCleaner(trim=True, collapse_internal_ws=True, case_style="title").fit_transform(df).first()[0] == "Ab Cd"
    assert Q.StringCleaner(trim=True, case_style="camel").fit_transform(df).first()[0] == "AbCd"
    swap = Q.StringCleaner(trim=True, replacements=[(r"(\w+)\s+(?<b>\w+)", "$2-$1 $$${b}")])
    assert swap.fit_transform(df).first()[0] == "cd-ab $cd"
    with pytest.raises(InvalidInput):
        Q.StringCleaner(replacements=[("a", "$1")]).fit(df)
    hashed = Q.FeatureHasher(["color", "size"], 4).fit_transform(colors).collect()
    assert all(sum(map(abs, r)) in (0.0, 2.0) for r in hashed)


@pytest.mark.parametrize("fast", [False, True])
def test_wide_hash_is_linear_in_cells(spark, fast):
    import hashlib

    rows = [tuple(None if (i + j) % 7 == 0 else "" if (i + j) % 5 == 0 else f"é{(i * j) % 50}/{j}" for j in range(130)) for i in range(60)] + [(None,) * 130, ("same",) * 130]
    df = spark.createDataFrame(rows, ", ".join(f"`c.{j}` string" for j in range(130))).coalesce(1)
    out = Q.FeatureHasher(df.columns, 200, fast).fit_transform(df)
    assert [f.name for f in out.schema] == [f"hashed_{i}" for i in range(200)] and {f.dataType.simpleString() for f in out.schema} == {"double"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "try_element_at" not in plan  # neither a pass over all cells for each bucket nor for each column
    if fast:
        values = {v for r in rows for v in r if v is not None}
        hashes = spark.createDataFrame([(v,) for v in values], "v string").selectExpr("v", "pmod(xxhash64(v), 200L) b", "pmod(xxhash64('sign:' || v), 2L) s").collect()
        known = {r.v: (r.b, -1.0 if r.s else 1.0) for r in hashes}
    else:
        word = lambda v: int(hashlib.md5(v.encode()).hexdigest()[:8], 16)
        known = {v: (word(v) % 200, -1.0 if word("sign:" + v) % 2 else 1.0) for r in rows for v in r if v is not None}
    want = []
    for r in rows:
        sums = [0.0] * 200
        for b, s in (known[v] for v in r if v is not None):
            sums[b] += s
        want.append(tuple(sums))
    assert sorted(tuple(x) for x in out.collect()) == sorted(want) and max(max(map(abs, x)) for x in want) == 130.0


def test_imputers(spark):
    df = frame(spark, [1.0, 3.0, 3.0, None, NAN])
    assert column(Q.SimpleImputer("median").fit_transform(df))[3:] == [3.0, 3.0]
    assert column(Q.SimpleImputer("most_frequent").fit_transform(frame(spark, [2.0, 1.0, 1.0, 2.0, None])))[4] == 1.0
    assert column(Q.MissingIndicator(["x"]).fit_transform(df), "x_missing") == [0, 0, 0, 1, 0]
    empty = spark.createDataFrame([(1.0, None), (2.0, None), (None, None)], "a double, b double")
    assert Q.AutoImputer().fit_transform(empty).columns == ["a"]
    assert Q.AutoImputer(null_column_behavior="fill").fit_transform(empty).columns == ["a", "b"]
    with pytest.raises(InvalidInput):
        Q.AutoImputer(null_column_behavior="error").fit(empty)


def test_column_removal(spark):
    df = spark.createDataFrame([(1, 1, "x", None), (2, 2, "x", 5)], "a int, b int, c string, d int")
    assert Q.ConstantColumnRemover().fit_transform(df).columns == ["a", "b"]
    assert Q.ConstantColumnRemover(ignore_nulls=False).fit_transform(df).columns == ["a", "b", "d"]
    assert Q.DuplicateColumnRemover(True).fit_transform(df).columns == ["a", "c", "d"]


def test_polynomial_names(numeric, spark):
    ab = numeric.select("a", "b")
    assert Q.PolynomialFeatures(2).fit_transform(ab).columns == ["bias", "b", "a", "b^", "a_b_inter", "a^"]
    with pytest.raises(InvalidInput):
        Q.PolynomialFeatures(3).fit(ab)
    assert len(Q.PolynomialFeatures(3, True).fit_transform(numeric).columns) == 8
    zero = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, -0.0)], "a double, b double")
    got = [r.a_div_b for r in Q.RatioFeatures(epsilon=0.0).fit_transform(zero).collect()]
    assert got[0] == INF and math.isnan(got[1]) and got[2] == INF


def test_dates(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 3, 29),), (None,)], "d date")
    got = Q.DatetimeFeatures(["d"], ("weekday", "week_of_year", "hour", "is_weekend")).fit_transform(df).collect()
    assert tuple(got[0])[1:] == (0, 1, 0, 0.0) and tuple(got[2])[1:] == (None,) * 4
    assert [r.d_is_holiday for r in Q.HolidayEncoder(country="GB").fit_transform(df).collect()] == [1.0, 1.0, None]
    assert [r.d_since_days for r in Q.TimeSince().fit_transform(df).collect()] == [0.0, 88.0, None]


def test_easter(spark):
    from quern.operators.generate import easter_day

    known = {1961: (4, 2), 2000: (4, 23), 2008: (3, 23), 2011: (4, 24), 2038: (4, 25), 2285: (3, 22)}
    years = spark.createDataFrame([(y,) for y in known], "y int")
    assert {r.y: (r.m, r.d) for r in years.select("y", easter_day(F.col("y"))[0].alias("m"), easter_day(F.col("y"))[1].alias("d")).collect()} == known


def test_time_series(spark):
    df = frame(spark, [1.0, 2.0, None, 4.0, NAN, 6.0])
    assert column(Q.Lagger("x", [1, -1], "i").fit_transform(df), "x_lag_-1")[:2] == [2.0, None]
    low = column(Q.RollingAggregator("x", 2, "i", function="min").fit_transform(df), "x_min_2")
    assert low[:4] == [None, 1.0, None, None] and low[4] == 4.0 and low[5] == 6.0
    mean = column(Q.ExpandingAggregator("x", "i").fit_transform(df), "x_expanding_mean")
    assert mean[:4] == [1.0, 1.5, None, 7 / 3] and math.isnan(mean[5])
    ew = column(Q.ExponentiallyWeightedMovingAverage("x", "i", alpha=0.5).fit_transform(df), "x_ewm_mean_0.5")
    assert ew[0] == 1.0 and math.isclose(ew[1], 5 / 3) and ew[2:] == [None] * 4
    var = Q.ExponentiallyWeightedMovingAverage("x", "i", span=1, statistic="var", ignore_na=True).fit_transform(df)
    assert "x_ewm_var_1" in var.columns
    for bad in (lambda: Q.Lagger("x", [1, 1], "i"), lambda: Q.RollingAggregator("x", 1, "i"), lambda: Q.ExponentiallyWeightedMovingAverage("x", "i", alpha=2.0), lambda: Q.Difference("x", 1, [])):
        with pytest.raises(InvalidInput):
            bad().fit(df)


def test_text(spark):
    df = spark.createDataFrame([("the cat sat",), ("the dog sat",), ("a cat ran",), (None,)], "text string")
    counts = Q.CountVectorizer("text").fit_transform(df)
    assert counts.columns == ["cat", "sat", "the", "a", "dog", "ran"]
    assert tuple(counts.collect()[3]) == (0.0,) * 6
    assert Q.CountVectorizer("text", ngram_range=(2, 2), stop_words=["the", "a"]).fit_transform(df).columns == ["cat ran", "cat sat", "dog sat"]
    tf = Q.TFIDFVectorizer("text", norm=None).fit_transform(df).first()
    assert math.isclose(tf["cat"], math.log(5 / 3) + 1)
    wb = Q.CharacterNGramVectorizer("text", "char_wb", (2, 2)).fit(df)
    assert " c" in wb.terms and "t s" not in wb.terms
    assert Q.CountVectorizer("text", min_df=4).fit_transform(df).columns == []


def test_selection(spark, numeric):
    df = numeric.withColumn("y", (F.col("a") > 3).cast("double"))
    assert Q.SelectKBest(1).fit_transform(df, "y").columns == ["a"]
    r = Q.SelectPercentile(100, Q.f_regression).fit(df.withColumn("y", F.col("a") * 2), "y")
    assert dict(r.scores)["a"] == INF
    assert Q.CorrelationThreshold(0.9).fit_transform(numeric.withColumn("d", -F.col("a"))).columns == ["a", "b", "c"]
    assert Q.CorrelationThreshold(1.0, "spearman").fit_transform(numeric.select("a", F.exp("a").alias("e"))).columns == ["a"]
    with pytest.raises(InvalidInput):
        Q.SelectKBest(1).fit(df.where("y = 1"), "y")


def psi(n):
    return sum(1 / i for i in range(1, n)) - 0.5772156649015329


def test_rank_correlations_join_no_column_of_many_values(spark, monkeypatch):
    import numpy as np
    import pandas as pd
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    from quern.operators import selection

    rng = np.random.default_rng(3)
    n = 500
    t = pd.DataFrame({"many": rng.normal(size=n), "few": rng.integers(0, 5, n) + 0.0, "flat": np.ones(n)})
    t["near"] = (t["many"] + rng.normal(size=n)).round(1)
    t["gap.y"] = np.where(rng.random(n) < 0.1, np.nan, -t["many"])
    t.loc[3, "gap.y"] = np.inf
    joins, join = [], Frame.join
    monkeypatch.setattr(Frame, "join", lambda self, other, *a, **k: joins.append(other.count()) or join(self, other, *a, **k))
    pairs = [(a, b) for i, a in enumerate(t) for b in list(t)[i + 1 :]]
    found = selection.rank_correlations(spark.createDataFrame(t), list(t), pairs)
    assert sum(j > n / 2 for j in joins) == 1  # of the two columns of many values whose rows are their own
    ok = t.replace([np.inf, -np.inf], np.nan)
    for a, b in pairs:
        rows = ok[[a, b]].dropna().rank()
        want = 0.0 if rows[a].std() == 0 or rows[b].std() == 0 else np.corrcoef(rows[a], rows[b])[0, 1]
        assert found[a, b] == pytest.approx(want, abs=1e-12), (a, b)


def unit(x):
    return (x - x.min()) / (x.max() - x.min())


def ross(x, y, k):
    u, terms = unit(x), []
    for i in range(len(u)):
        same = sorted(abs(u[i] - u[j]) for j in range(len(u)) if j != i and y[j] == y[i])
        if same:
            kk = min(k, len(same))
            r = math.nextafter(same[kk - 1], 0) if same[kk - 1] > 0 else 0.0
            terms.append(psi(kk) - psi(len(same) + 1) - psi(sum(abs(u[i] - v) <= r for v in u)))
    return max(0.0, psi(len(terms)) + sum(terms) / len(terms))


def ksg(x, y, k):
    u, v, total = unit(x), unit(y), 0.0
    for i in range(len(u)):
        dx, dy = [abs(u[i] - a) for j, a in enumerate(u) if j != i], [abs(v[i] - a) for j, a in enumerate(v) if j != i]
        r = sorted(max(p) for p in zip(dx, dy, strict=True))[k - 1]
        total += psi(sum(d < r for d in dx) + 1) + psi(sum(d < r for d in dy) + 1)
    return max(0.0, psi(k) + psi(len(u)) - total / len(u))


@pytest.mark.parametrize("slab", [50_000, 37])
def test_mutual_information_against_definition(spark, monkeypatch, slab):
    import numpy as np

    from quern.functions import neighbours

    monkeypatch.setattr(neighbours, "SLAB", slab)
    rng = np.random.default_rng(0)
    a = rng.normal(size=300)
    cols = {"a": a, "tied": a.round(1), "few": rng.integers(0, 3, 300).astype(float), "flat": np.ones(300)}
    y = 0.8 * a + 0.6 * rng.normal(size=300)
    side = (y > 0).astype(float)
    side[0] = 7.0  # a class of one row
    rows = [tuple(float(v[i]) for v in (*cols.values(), y, side)) for i in range(300)]
    df = spark.createDataFrame([*rows, (None, float("inf"), float("nan"), 1.0, 0.5, 1.0)], "a double, tied double, few double, flat double, y double, side double")
    for task, target, by in (("classification", "side", lambda x: ross(x, side, 3)), ("regression", "y", lambda x: ksg(x, y, 3))):
        found = dict(Q.MutualInformationSelector(2, task).fit(df.select("a", "tied", "few", target), target).scores)
        assert found == {c: pytest.approx(by(cols[c]), abs=1e-9) for c in ("a", "tied", "few")}
        assert task == "classification" or found["a"] == pytest.approx(-0.5 * math.log(1 - 0.64), abs=0.2)


def test_mutual_information_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 1.0, None)], "flat double, side double, gone double")
    for task in ("classification", "regression"):
        assert dict(Q.MutualInformationSelector(1, task).fit(df, "side").scores) == {"flat": 0.0, "gone": 0.0}


def test_compositions(spark, numeric):
    mixed = numeric.withColumn("s", F.lit("q")).withColumn("n", F.lit(1))
    inner = Q.Pipeline([("z", Q.StandardScaler()), ("p", Q.PolynomialFeatures(2, include_bias=False))])
    ct = Q.ColumnTransformer([("num", inner, ["a", "b"]), ("one", Q.OneHotEncoder(), ["s"])], "passthrough")
    model = ct.fit(mixed)
    out = model.transform(mixed)
    assert out.columns == ["b", "a", "b^", "a_b_inter", "a^", "s_q", "c", "n"] == model.feature_names_out(mixed.schema)
    direct = [tuple(r) for r in inner.fit_transform(mixed.select("a", "b")).collect()]
    assert sorted(tuple(r)[:5] for r in out.collect()) == sorted(direct)
    union = Q.FeatureUnion([("a", Q.ColumnTransformer([("x", Q.MinMaxScaler(), ["a"])])), ("b", Q.ColumnTransformer([("x", Q.StandardScaler(), ["b"])]))])
    assert union.fit_transform(numeric).columns == ["a", "b"]
    with pytest.raises(InvalidInput):
        Q.FeatureUnion([("a", Q.StandardScaler()), ("b", Q.MinMaxScaler())]).fit(numeric)
    with pytest.raises(InvalidInput):
        Q.ColumnTransformer([("a", Q.StandardScaler(), ["a"]), ("b", Q.StandardScaler(), ["a"])]).fit(numeric)
    with pytest.raises(Computation, match="transformer 'a'"):
        Q.ColumnTransformer([("a", Q.StandardScaler(), ["s"])]).fit(mixed)
    with pytest.raises(InvalidInput, match="step 0 'x'"):
        Q.Pipeline([("x", Q.Binarizer(NAN))]).fit(numeric)
    cond = Q.ConditionalPipeline([(name_matches("^a$"), Q.MinMaxScaler()), (is_float64, Q.StandardScaler()), (is_string, Q.OneHotEncoder())])
    assert cond.fit_transform(mixed).columns == ["a", "b", "c", "s_q"] and cond.assignments() == {"a": 0, "b": 1, "c": 1, "s": 2}
    assert not is_int(None, T.StructField("x", T.StringType()))


def test_cached_pipeline(numeric):
    p = Q.CachedPipeline(Q.StandardScaler(), 1)
    p.fit(numeric)
    first = p.transform(numeric)
    assert p.transform(numeric) is first and p.cache_size() == 1
    p.transform(numeric.limit(3))
    assert p.cache_size() == 1
    p.fit(numeric)
    assert p.cache_size() == 0


def test_auto(spark):
    df = spark.createDataFrame([(31.0, "pune", 0), (None, "delhi", 1), (45.0, "pune", 0), (52.0, "mumbai", 1), (23.0, "delhi", 0), (38.0, "mumbai", 1)], "age double, city string, churned int")
    auto = Q.AutoPipeline.from_inferred_schema(df, target="churned")
    model = auto.fit(df)
    out = model.transform(df)
    assert out.columns == ["age", "city_delhi", "city_mumbai", "city_pune"]
    assert out.where("age is null").count() == 0 and [n for n, _ in auto.prepared_pipeline().steps] == ["column_transformers"]
    with pytest.raises(InvalidInput):
        model.transform(df.withColumn("extra", F.lit(1)))
    with pytest.raises(InvalidInput):
        model.transform(df.drop("age"))
    many = spark.range(60).select(F.concat(F.lit("id"), "id").alias("u"), (F.col("id") % 2).cast("int").alias("y"), F.lit(None).cast("double").alias("z"), F.lit("k").alias("c"), F.to_date(F.lit("2024-01-01")).alias("d"))
    auto = Q.AutoPipeline(Q.AutoPipelineConfig(target="y"))
    out = auto.fit_transform(many)
    assert [n for n, _ in auto.prepared_pipeline().steps] == ["drop_all_null", "remove_constant", "target_encode_high_cardinality"]
    assert out.columns == ["u"] and isinstance(out.schema["u"].dataType, T.DoubleType)
    kinds = Q.AutoTypeDetector()
    kinds.fit(spark.createDataFrame([("1e5", "2024-01-01", "1d"), ("-.5", "2024-02-02T10:00:00", "2f")], "a string, b string, c string"))
    assert kinds.column_types() == {"a": "NumericString", "b": "NumericString", "c": "Categorical"}


def test_auto_scaler_choices(spark):
    n = spark.range(400).select((F.col("id") / 400).alias("flat"), F.pow(F.lit(1.02), "id").alias("skewed"), F.when(F.col("id") < 300, 0.0).otherwise(1.0).alias("sparse"), F.when(F.col("id") == 0, 1e6).otherwise((F.col("id") % 5).cast("double")).alias("far"))
    est = Q.AutoScaler()
    est.fit(n)
    assert est.column_types() == {"flat": "MinMax", "skewed": "Power", "sparse": "MaxAbs", "far": "Robust"}


def test_report(spark):
    df = spark.createDataFrame([(1.0, "a", "k"), (2.0, "b", "k"), (NAN, "a", "k"), (None, "a", "k"), (1.0, "a", "k")], "x double, s string, c string")
    rep = Q.DataQualityReport.from_dataframe(df)
    x, s, _ = rep.columns
    assert (x.null_count, x.nan_count, x.unique_count) == (1, 1, 3) and s.string_stats.most_frequent == ("a", 4)
    assert rep.duplicated_rows == 2 and rep.constant_columns == ["c"]
    assert [r.kind for r in rep.recommendations][0] == "DropColumn" and "| x |" in rep.to_markdown()


def test_schema_spec(numeric):
    assert not Q.check_schema(numeric, Q.SchemaSpec.f64_columns(3))
    found = Q.check_schema(numeric, Q.SchemaSpec.exact([("a", T.StringType()), ("z", T.DoubleType())]))
    assert {v.rule for v in found} == {"dtype_mismatch", "missing_column"}
    with pytest.raises(InvalidInput):
        Q.validate_schema(numeric, Q.SchemaSpec.string_columns())


def test_dotted_names(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], ["a.b", "c`d"])
    assert Q.StandardScaler().fit_transform(df).columns == ["a.b", "c`d"]


def test_plan_is_one_projection(spark, sf_dir):
    """A fitted pipeline over Parquet stays one scan of the columns it needs, filters included."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    model = Q.Pipeline([("z", Q.ColumnTransformer([("s", Q.StandardScaler(), ["l_quantity"])], "passthrough")), ("b", Q.ColumnTransformer([("m", Q.Binarizer(0.0), ["l_tax"])], "passthrough"))]).fit(df)
    plan = model.transform(df).where("l_orderkey = 7").select("l_quantity")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,7)" in plan and "l_comment" not in plan and "Exchange" not in plan and plan.count("Project") == 1


def test_kmeans_of_many_values_is_that_of_few(spark):
    from quern.operators.nonlinear import kmeans_edges, lloyd

    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.normal(0, 1, 800), rng.normal(9, 2, 500), rng.normal(30, 1, 200)]), 2)
    df = frame(spark, [*x.tolist(), None])
    v, n = np.unique(x, return_counts=True)
    for k in (2, 3, 5):
        want = lloyd(list(zip(v.tolist(), n.tolist(), strict=True)), k)
        name = "x"
        assert kmeans_edges(df, name, k) == want
        assert kmeans_edges(df, name, k, most=10) == pytest.approx(want, abs=1e-9)


def test_lag_of_a_lag_and_back(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "i int, v double")
    got = Q.Lagger(["v", "v_lag_-1"], [-1, 1], "i").fit_transform(df.withColumn("v_lag_-1", F.lit(7.0))).orderBy("i").collect()
    assert [r["v_lag_-1"] for r in got] == [1.0, 2.0, 3.0, None]
    assert [r["v_lag_-1_lag_1"] for r in got] == [None, 1.0, 2.0, 3.0]
    assert [r["v_lag_-1_lag_-1"] for r in got] == [2.0, 3.0, None, None]
