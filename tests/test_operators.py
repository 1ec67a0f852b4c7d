import math
import time
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import staging
from tidemark.functions import formats as X
from tidemark.operators import anomaly, heal, multivariate, neighbours, ordered, profile, quantiles, report, score, semantic
from tidemark.plans import engine as plans
from tidemark.plans import expressions, model, planner

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
VALUES = st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float)), min_size=1, max_size=25)


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")


def column(df, name="x", key="i"):
    return [r[name] for r in df.orderBy(key).collect()]


@SLOW
@given(VALUES)
def test_fills_match_pandas(spark, values):
    df, s = frame(spark, values), pd.Series(values, dtype=float)
    for made, want in ((ordered.forward_fill(df, "x", "i", ranges=5), s.ffill()), (ordered.backward_fill(df, "x", "i", ranges=5), s.bfill()), (ordered.interpolate(df, "x", "i", ranges=5), s.interpolate())):
        assert [None if v is None else round(v, 9) for v in column(made)] == [None if v != v else round(v, 9) for v in want]


@SLOW
@given(st.lists(st.tuples(st.sampled_from([None, "a", "b", "c"]), st.one_of(st.none(), st.integers(-50, 50).map(float))), min_size=1, max_size=25), st.sampled_from([1, 2, 7]))
def test_fills_by_group_match_pandas(spark, rows, ranges):
    """Groups that lie in one range or several, keys that are texts, null groups."""
    df = spark.createDataFrame([(f"k{i:03}", g, v) for i, (g, v) in enumerate(rows)], "i string, g string, x double")
    s = pd.DataFrame({"g": [g or "null" for g, _ in rows], "x": pd.Series([v for _, v in rows], dtype=float)})
    by = s.groupby("g")["x"]
    for fill, want in ((ordered.forward_fill, by.ffill()), (ordered.backward_fill, by.bfill()), (ordered.interpolate, by.transform(lambda x: x.interpolate()))):
        made = column(fill(df, "x", "i", ["g"], ranges))
        assert [None if v is None else round(v, 9) for v in made] == [None if v != v else round(v, 9) for v in want]


def test_fills_of_several_columns_share_the_dealt_rows(spark):
    """Columns named like the fill's own, a group of nulls, one deal for all ways."""
    rows = [(i, None if i % 3 else "g", float(i) if i % 4 == 0 else None, None if i % 5 else i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "tm_i long, tm_range string, x double, tm_v long, tm__n long")
    made = ordered.fill(df, {"x": "interpolate", "tm_v": "backward"}, "tm_i", ["tm_range"], 3)
    assert made.columns == df.columns
    want = pd.DataFrame(rows, columns=df.columns).assign(g=lambda d: d["tm_range"].fillna("null"))
    want["x"], want["tm_v"] = want.groupby("g")["x"].transform(lambda x: x.interpolate()), want.groupby("g")["tm_v"].bfill()
    got = made.orderBy("tm_i").collect()
    assert [None if v != v else round(v, 9) for v in want["x"]] == [None if r["x"] is None else round(r["x"], 9) for r in got]
    assert [None if v != v else int(v) for v in want["tm_v"]] == [r["tm_v"] for r in got]
    assert [r["tm__n"] for r in got] == list(range(40))


def test_fills_are_linear_in_the_rows_of_a_range(spark):
    """Twice the rows of one range must not take four times as long; a frame to the last row took minutes for these."""
    took = []
    for n in (100_000, 100_000, 400_000):
        df = spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("x"))
        began = time.time()
        row = ordered.interpolate(df, "x", "i", ranges=1).agg(F.sum(F.abs(F.col("x") - F.least(F.col("i"), F.lit((n - 1) // 7 * 7)))).alias("off"), F.count("x").alias("n")).first()
        took.append(time.time() - began)
        assert row["off"] < 1e-3 and row["n"] == n
    assert took[2] < 8 * took[1] + 4


def test_fill_keeps_one_exchange_for_windows_and_carries(spark):
    plan = ordered.forward_fill(frame(spark, [1.0, None, 3.0]), "x", "i")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(tm_range") <= 2


@SLOW
@given(VALUES)
def test_moments_match_pandas(spark, values):
    df, s = frame(spark, values), pd.Series(values, dtype=float)
    r, q, m = profile.profile_numeric(df, ["x"]).first(), profile.profile_quartiles(df, ["x"]).first(), profile.profile_shape(df, ["x"]).first()
    close = lambda a, b: (a is None and (b != b or b is None)) or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    assert r["cnt"] == s.count()
    if s.count():
        assert close(r["mean"], s.mean()) and close(q["median"], s.median()) and close(q["q1"], s.quantile(0.25))
    if s.count() > 1:
        assert close(r["std"], s.std())
    if s.count() > 3 and s.nunique() > 1:
        assert close(m["skewness"], s.skew()) and close(m["kurtosis"], s.kurt())


@SLOW
@given(VALUES)
def test_histogram_matches_numpy(spark, values):
    some = [v for v in values if v is not None]
    got = [r["cnt"] for r in profile.profile_histogram(frame(spark, values), "x").orderBy("bin").collect()]
    assert got == ([] if len(some) < 2 else np.histogram(some, 20, (min(some) - 0.5, max(some) + 0.5) if min(some) == max(some) else None)[0].tolist())


@SLOW
@given(VALUES, st.sampled_from(["iqr", "zscore", "percentile"]))
def test_clamps_stay_in_bounds_and_keep_rows(spark, values, method):
    got = column(heal.clamp(frame(spark, values), method, ["x"]))
    s = pd.Series(values, dtype=float)
    assert len(got) == len(values) and [v is None for v in got] == [v is None for v in values]
    if method == "percentile" and s.count() >= 4:
        assert all(v is None or s.quantile(0.01) - 1e-9 <= v <= s.quantile(0.99) + 1e-9 for v in got)


def test_nan_and_infinity(spark):
    df = frame(spark, [1.0, float("nan"), float("inf"), 2.0, float("-inf"), None])
    assert profile.profile_nulls(df, ["x"]).first()["null_count"] == 2
    r = profile.profile_numeric(df, ["x"]).first()
    assert (r["cnt"], r["infinite"], r["mean"]) == (2, 2, 1.5)
    assert score.schema_consistency(df).first()["issue_count"] == 1
    assert score.format_validity(df).first()["issue_count"] == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "i long, x double, s string")
    assert [r["null_pct"] for r in profile.profile_nulls(df).collect()] == [0.0] * 3
    assert profile.profile_histogram(df, "x").count() == 0
    assert anomaly.anomaly_missing(df).count() == 0
    assert score.quality_breakdown(df).count() == 5
    assert ordered.forward_fill(df, "x", "i").count() == 0


@pytest.mark.parametrize(
    ("fix", "raw", "want"),
    [
        (X.fix_email, "  User@EXAMPLE.COM ", "user@example.com"), (X.fix_phone, "(555) 123-4567", "+15551234567"), (X.fix_phone, "1-555-123-4567", "+15551234567"), (X.fix_phone, "12", "12"),
        (X.fix_date, "01/15/2024", "2024-01-15"), (X.fix_date, "03/04/2024", "2024-04-03"), (X.fix_date, "never", "never"), (X.fix_currency, "$1,200.00", "1200.0"), (X.fix_currency, "12 USD", "12 USD"),
        (X.fix_percentage, "45.5%", "45.5"), (X.fix_zipcode, "1001", "01001"), (X.fix_zipcode, "12", "12"), (X.fix_url, " HTTP://Ex.COM/A?b ", "http://ex.com/A?b"), (X.title_case, "o'neil smith", "O'Neil Smith"),
        (X.fix_datetime, "2024-01-02 03:04:05", "2024-01-02T03:04:05"), (X.fix_email, None, None),
    ],
)
def test_fixers(spark, fix, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(fix(F.col("s")).alias("s")).first()["s"] == want


def test_number_and_truth(spark):
    df = spark.createDataFrame([("1e3",), ("+5",), (".5",), ("1,200",), ("0x10",), ("1.5d",), ("inf",), (None,)], "s string")
    assert [r[0] for r in df.select(X.to_number(F.col("s"))).collect()] == [1000.0, 5.0, 0.5, None, None, None, float("inf"), None]
    df = spark.createDataFrame([(" YES",), ("off",), ("maybe",)], "s string")
    assert [r[0] for r in df.select(X.to_boolean(F.col("s"))).collect()] == [True, False, None]


@pytest.mark.parametrize(
    ("values", "want"),
    [
        (["a@b.com"] * 9 + ["x"], "email"), (["550e8400-e29b-41d4-a716-446655440000"] * 5, "uuid"), (["https://a.b/c"] * 5, "url"), (["10.0.0.1"] * 5, "ip_address"), (["12%", "45.5%"], "percentage"), (["$1,200.00", "€350.00"], "currency"),
        (["yes", "NO"], "boolean"), (["2024-01-05", "2024-02-06"], "date"), (['{"a": 1}', "[1]"], "json_string"), (["red", "blue"] * 20, "categorical"), ([f"some words {i} here" for i in range(40)], "text"), ([str(10**6 * 97 + i * 7919) for i in range(40)], "numeric_id"),
    ],
)
def test_semantic_types(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert semantic.detected(df) == {"s": want}
    assert semantic.tagged(df, {"s": want}).schema["s"].metadata == {"semantic_type": want}


def test_grades(spark):
    df = spark.createDataFrame([(v,) for v in (100.0, 90.0, 89.99, 80.0, 65.0, 64.9, 50.0, 49.9, 0.0)], "v double")
    assert "".join(r[0] for r in df.select(score.grade(F.col("v"))).collect()) == "AABBCDDFF"


def test_dedup_is_idempotent_and_ordered(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 2), (2, "b", None), (4, "b", None), (5, None, 3)], "i int, k string, v int")
    first = ordered.deduplicate(df, "i", ["k"])
    assert sorted(r["i"] for r in first.collect()) == [1, 2, 5]
    assert sorted(r["i"] for r in ordered.deduplicate(df, "i", ["k"], "last").collect()) == [3, 4, 5]
    assert [r["i"] for r in ordered.deduplicate(df, "i", ["k"], False).collect()] == [5]
    assert ordered.deduplicate(first, "i", ["k"]).count() == 3


def test_timeliness_counts_nulls_as_old(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2020, 1, 1),), (None,)], "updated_at timestamp")
    assert score.timeliness(df, datetime(2024, 6, 1)).first()[0] == 0.333333


def test_multivariate_finds_planted_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(1000 + i, 12.0 + i, -12.0 - i) for i in range(5)]
    df = spark.createDataFrame(rows, "i long, a double, b double")
    out = multivariate.multivariate_outliers(df, ["a", "b"])
    assert {1000, 1001, 1002, 1003, 1004} <= {r["i"] for r in out.where("tm_outlier").collect()}
    assert multivariate.anomaly_multivariate(df, columns=["a", "b"]).first()["severity"] == "medium"


@pytest.mark.parametrize("visits", [0, 2, 6])  # border points ask many cells at once, or visit them one by one
def test_outlier_factors_match_brute_force(spark, monkeypatch, visits):
    """Over all rows: a dense small cluster, far rows, copies; one cell and many."""
    monkeypatch.setattr(neighbours, "VISITS", visits)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(1500, 3)), rng.normal(size=(300, 3)) * 0.01 + 5, rng.normal(size=(60, 3)) * 20])
    copies = np.concatenate([np.ones(1850, int), np.full(9, 3), [40]])
    rows = np.repeat(x, copies, axis=0)
    df = spark.createDataFrame([(list(map(float, r)),) for r in rows], "x array<double>").repartition(3)
    want = dict(zip(map(tuple, rows), neighbours.brute_factors(rows, 20), strict=True))
    points = neighbours.weighted_points(df, "x")
    at = {r["id"]: tuple(r["x"]) for r in points.collect()}
    for cell_points in (10_000, 400)[: 1 + (visits != 2)]:
        got = {at[r["id"]]: r["factor"] for r in neighbours.outlier_factors(points, 3, 20, cell_points=cell_points).collect()}
        assert len(got) == len(x) and max(abs(got[p] / want[p] - 1) for p in got) < 1e-9
    dense = [want[tuple(r)] for r in x[1500:1800]]
    assert np.median(dense) < 1.5  # with neighbours among a sample these had none near


def test_neighbours_are_no_more_than_a_points_copies_leave_open(spark):
    """Copies of all rows: points of many copies ask nothing, others keep the neighbours that fill their places; factors as from all pairs."""
    rng = np.random.default_rng(7)
    x, copies = rng.normal(size=(300, 2)), np.where(np.arange(300) % 3 == 0, 30, 6)
    df = spark.createDataFrame([(list(map(float, r)),) for r in np.repeat(x, copies, axis=0)], "x array<double>").repartition(3)
    points = neighbours.weighted_points(df, "x")
    for cell_points in (10_000, 60):
        near = neighbours.nearest_neighbours(points, 2, 20, cell_points=cell_points).collect()
        assert len(near) == 300
        for r in near:
            w = np.minimum(np.frombuffer(bytes(r["found"]), neighbours.NEIGHBOUR)["w"], 20)
            left = 20 - min(r["w"] - 1, 20)
            assert w.sum() >= left and w[:-1].sum() < max(left, 1) and bool(len(w)) == (left > 0)
    at = {r["id"]: tuple(r["x"]) for r in points.collect()}
    got = {at[r["id"]]: r["factor"] for r in neighbours.outlier_factors(points, 2, 20, cell_points=60).collect()}
    few = [k for k in range(300) if copies[k] == 6]  # without copies, each of the six has five others at distance 0
    dist = np.sqrt(neighbours.distances(x, x))
    far, mean = np.zeros(300), np.zeros(300)
    lists = []
    for k in range(300):
        take, left = [(k, min(copies[k] - 1, 20))], 20 - min(copies[k] - 1, 20)
        for j in np.argsort(dist[k])[1:]:
            if left > 0:
                take.append((j, min(copies[j], left)))
                far[k], left = dist[k, j], left - min(copies[j], left)
        lists.append(take)
    for k, take in enumerate(lists):
        mean[k] = sum(n * max(dist[k, j], far[j]) for j, n in take) / 20
    density = 1 / (mean + neighbours.TINY)
    for k in few:
        assert abs(got[tuple(x[k])] / (sum(n * density[j] for j, n in lists[k]) / 20 / density[k]) - 1) < 1e-9


def test_scores_of_outliers_alone_are_broadcast(spark, monkeypatch):
    """The scores of all points are too many, those of the outliers are not: then no row is shuffled to meet them."""
    rng = np.random.default_rng(5)
    rows = [(i, float(a) if i % 9 else None, float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))] + [(1000 + i, 12.0 + i, -12.0 - i) for i in range(5)]
    df = spark.createDataFrame(rows, "i long, a double, b double")
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 4000)
    whole = multivariate.multivariate_outliers(df, ["a", "b"])
    only = multivariate.multivariate_outliers(df, ["a", "b"], only=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans_ = [x._jdf.queryExecution().sparkPlan().toString() for x in (whole, only)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ["BroadcastHashJoin" in x for x in plans_] == [False, True]
    want = sorted(whole.where("tm_outlier").collect())
    assert sorted(only.collect()) == want and len(want) >= 5 and whole.count() == 605
    assert multivariate.anomaly_multivariate(df, columns=["a", "b"]).first()["affected_rows"] == len(want)
    assert multivariate.multivariate_outliers(df.limit(2), ["a", "b"], only=True).count() == 0


def test_factors_of_few_rows(spark):
    for rows in ([[1.0, 2.0]], [[1.0, 2.0]] * 5, [[1.0, 2.0], [3.0, 4.0]]):
        points = neighbours.weighted_points(spark.createDataFrame([(r,) for r in rows], "x array<double>"), "x")
        assert all(abs(r["factor"] - 1) < 1e-9 for r in neighbours.outlier_factors(points, 2, 3).collect())


def test_trees_are_drawn_from_all_rows(spark):
    df = spark.createDataFrame([([float(i // 50), 0.0],) for i in range(2000)] + [([9e9, 0.0],)] * 1000, "x array<double>")
    points = neighbours.weighted_points(df, "x")
    got = multivariate.drawn(points, 3000, 600, 1)
    assert 540 <= len(got) <= 660 and 190 <= (got[:, 0] == 9e9).sum() <= 210  # copies come as often as they should
    assert len(multivariate.drawn(points, 3000, 5000, 1)) == 3000


@pytest.mark.parametrize(("together", "small"), [(20_000, 1_000_000), (20_000, 0), (5, 0)])
def test_exact_quantiles_match_percentile(spark, monkeypatch, together, small):
    """Ties, infinities away, few rows, no rows; ranges narrowed step by step; weights as repeated rows."""
    monkeypatch.setattr(quantiles, "TOGETHER", together)
    monkeypatch.setattr(quantiles, "SMALL_ROWS", small)
    rng = np.random.default_rng(4)
    rows = [(float(a) if i % 7 else None, int(b), float(10.0 ** c), 1 + i % 4) for i, (a, b, c) in enumerate(zip(rng.normal(size=3000), rng.integers(0, 4, 3000), rng.uniform(-200, 200, 3000), strict=True))]
    df = spark.createDataFrame(rows, "a double, b int, c double, w int").repartition(3)
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    values = {c: F.col(c) for c in "abc"} | {"none": F.lit(None).cast("double")}
    want = df.agg(*(F.percentile(c, F.array(*map(F.lit, ps))).alias(c) for c in "abc")).first()
    got = quantiles.exact_quantiles(df, values, dict.fromkeys(values, ps))
    assert got["none"] == [None] * 7
    for c in "abc":
        assert got[c] == pytest.approx(want[c], rel=1e-12)
    want = df.agg(F.percentile("a", F.array(*map(F.lit, ps)), F.col("w")).alias("a")).first()["a"]
    assert quantiles.exact_quantiles(df, {"a": F.col("a")}, {"a": ps}, F.col("w"))["a"] == pytest.approx(want, rel=1e-12)
    assert quantiles.exact_quantiles(df.limit(0), {"a": F.col("a")}, {"a": ps})["a"] == [None] * 7


@pytest.mark.parametrize("tracked", [16, 64, 10_000])
def test_frequent_values_are_exact_or_not_claimed(spark, tracked):
    """Skewed, flat, unique and empty columns; what is proven equals a full count, and top values do whatever is proven."""
    rng = np.random.default_rng(8)
    rows = [(f"z{int(a)}", f"u{i}", f"f{i % 90}", None, "") for i, a in enumerate(np.minimum(rng.zipf(1.6, 3000), 500))]
    df = spark.createDataFrame(rows, "skewed string, unique string, flat string, none string, blank string").repartition(4)
    proven, rest, n = profile.frequent_values(df, df.columns, 5, tracked=tracked)
    assert n == 3000 and set(proven) | set(rest) == set(df.columns) and proven["none"] == [] and proven["blank"] == [("", 3000)] and ("skewed" in proven or tracked < 100)
    for c, top in proven.items():
        counts = pd.Series([r[df.columns.index(c)] for r in rows]).value_counts()
        want = sorted(((v, int(k)) for v, k in counts.items()), key=lambda x: (-x[1], x[0]))[:5]
        assert top == want
    got = {(r["column"], r["rank"]): (r["value"], r["cnt"]) for r in profile.profile_top_values(df).collect()}
    assert got["unique", 1] == ("u0", 1) and got["flat", 1] == ("f0", 34) and got["blank", 1] == ("", 3000) and ("none", 1) not in got


@pytest.mark.parametrize("text", ["__import__('os').system('x')", "x.__class__", "[c for c in (1,)]", "lambda: 1", "gone + 1", "eval('1')", "x if", "trim(x, y)", "f'{x}'", "x @ y", "a" * 2000, "(" * 500 + "x" + ")" * 500, "round(x, y)", "x(1)", "x[0]", "1 < x < 3"])
def test_expressions_that_are_refused(spark, text):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    with pytest.raises(expressions.Refused):
        expressions.column_of(text, df)


def test_column_fixes_are_carried_out(spark):
    df = spark.createDataFrame([(1, " A ", None, "5", 2.0), (2, "b", 3.0, "x", 0.0), (3, None, 5.0, "7", 1000.0), (4, "b", 7.0, "8", 1.0), (5, "b", 9.0, "9", 3.0)], "id long, s string, x double, n string, v double")
    fixes = [
        {"column": "x", "detected_issue": "nulls", "fix_type": "impute", "parameters": {"strategy": "mean"}}, {"column": "n", "fix_type": "cast", "target_dtype": "float64"},
        {"column": "s", "fix_type": "normalize"}, {"column": "v", "fix_type": "cap", "parameters": {"factor": 1.0}}, {"column": "gone", "fix_type": "drop"},
        {"column": "id", "fix_type": "expression", "parameters": {"expression": "id * 10 if s == 'b' else coalesce(-id, 0)"}}, {"column": "v", "fix_type": "expression", "parameters": {"expression": "open('x')"}},
        {"column": "x", "fix_type": "teleport"}, {"column": "x", "fix_type": "impute", "parameters": {"strategy": "guess"}},
    ]
    answer = {"healing_plan": [{"step_id": "s1", "title": "t", "strategy": "deduplication"}], "transformation_order": ["deduplicate"], "confidence_score": 1, "column_fixes": fixes, "value_corrections": [{"column": "s", "original_value": "b", "corrected_value": "B"}]}
    out = plans.Engine().run_ai(df, model.AgentResponse.parse(answer))
    rows = {r["x"]: r for r in out.frame.collect()}
    assert sorted(rows) == [3.0, 5.0, 6.0, 7.0, 9.0] and rows[6.0]["s"] == "a" and rows[6.0]["id"] == -1 and rows[7.0]["id"] == 40 and rows[7.0]["s"] == "B"
    assert rows[3.0]["n"] is None and rows[7.0]["n"] == 8.0 and max(r["v"] for r in rows.values()) < 1000
    by = {}
    for e in out.log.entries:
        by.setdefault(e.status.value, []).append((e.column, e.message))
    assert ("v", "no function open of 1 arguments") in by["ERROR"] and ("gone", "no column gone") in by["SKIPPED"] and by["SKIPPED"].count(("x", "unknown strategy")) == 2


def jobs_of(spark, run):
    """How many Spark jobs a call starts."""
    group = f"g{time.time()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("n", [1, 6, 12])
def test_statistics_of_repairs_share_one_aggregate(spark, n):
    df = spark.range(50).select(*(F.when(F.col("id") % (k + 2) > 0, F.col("id") * (k + 1.0)).alias(f"c{k}") for k in range(12)))
    plan = model.Plan(tuple(model.Action(model.Strategy.MEAN_IMPUTATION, f"c{k}", priority=k + 1) for k in range(n)))
    quiet = plans.Config(False, False, False, False, False, False)
    _, one = jobs_of(spark, lambda: plans.Engine(config=quiet).run(df, model.Plan((model.Action(model.Strategy.MEAN_IMPUTATION, "c0"),))))
    result, jobs = jobs_of(spark, lambda: plans.Engine(config=quiet).run(df, plan))
    assert jobs == one and len(result.fitted) == 1 and result.fitted[0].passes == 1
    assert result.frame.select(*(F.count_if(F.col(f"c{k}").isNull()).alias(f"c{k}") for k in range(n))).first() == tuple([0] * n)


def test_dependent_repairs_wait_for_each_other(spark):
    """Fused and one by one give the same: the second repair of a column sees the first one's values."""
    rows = [(float(i % 9) if i % 4 else None, float(i) if i % 5 else 1e6, " A b " if i % 3 else None, i) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, s string, i long")
    steps = [
        heal.Repair("impute", ("x",), {"strategy": "mean"}), heal.Repair("normalise", ("s",), {"case": "upper"}), heal.Repair("clamp", ("y",), {"method": "iqr"}),
        heal.Repair("impute", ("s",), {"strategy": "mode"}), heal.Repair("scale", ("x", "y"), {"method": "zscore"}), heal.Repair("clamp", ("x",), {"method": "percentile", "lower_pct": 10}),
    ]
    assert heal.levels(df, steps) == [[0, 1, 2, 3], [4], [5]]
    alone = df
    for step in steps:
        alone = heal.repaired(alone, [step])
    fused = heal.fit(df, steps).apply(df)
    for a, b in zip(alone.orderBy("i").collect(), fused.orderBy("i").collect(), strict=True):
        assert a["s"] == b["s"] and (a["x"], a["y"]) == pytest.approx((b["x"], b["y"]))


def test_fitted_repairs_heal_a_stream(spark, tmp_path):
    """Bounds taken once on a table, saved, applied to a stream of other rows: as to a table of them."""
    df = spark.createDataFrame([(i, float(i % 20) if i % 6 else None, 5.0 * i, datetime(2024, 1, 1 + i % 9) if i % 7 else None) for i in range(1, 80)], "i long, x double, y double, t timestamp")
    steps = [heal.Repair("impute", ("x",), {"strategy": "median"}), heal.Repair("clamp", ("y",), {"method": "iqr", "factor": 0.1}), heal.Repair("scale", ("x",)), heal.Repair("impute", ("t",), {"strategy": "mode"})]
    saved = heal.fit(df, steps).to_json()
    new = df.select(F.col("i") + 1000, *df.columns[1:]).toDF(*df.columns).withColumn("y", F.col("y") * 3)
    source = str(tmp_path / "in")
    new.repartition(3).write.parquet(source)
    stream = heal.Fitted.from_json(saved).apply(spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(source))
    query = stream.writeStream.format("memory").queryName("healed_rows").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = heal.Fitted.from_json(saved).apply(new).orderBy("i").collect()
    assert spark.table("healed_rows").orderBy("i").collect() == want and len(want) == 79


def test_engine_logs_and_goes_on(spark):
    df = spark.createDataFrame([(1, 1.0, " A ", "U@X.com"), (1, 1.0, " A ", "U@X.com"), (2, None, "b", "v@y.com"), (3, 900.0, "b", None)], "id long, v double, cat string, email string")
    plan = model.Plan((
        model.Action(model.Strategy.DEDUPLICATION), model.Action(model.Strategy.MEDIAN_IMPUTATION, "v", priority=2), model.Action(model.Strategy.MEAN_IMPUTATION, "cat", priority=2),
        model.Action(model.Strategy.IQR_CLAMP, "gone", priority=3), model.Action(model.Strategy.CUSTOM, "v", priority=4), model.Action(model.Strategy.FORMAT_STANDARDIZE, "email", {"semantic_type": "email"}, 5),
    ))
    out = plans.Engine(types={"email": "email"}).run(df, plan)
    rows = {r["id"]: r for r in out.frame.collect()}
    assert len(rows) == 3 and rows[2]["v"] == 450.5 and rows[1]["email"] == "u@x.com" and rows[1]["cat"] == "a"
    assert out.log.summary()["skipped"] == 3 and out.log.summary()["errors"] == 0


def test_agent_response_and_order(spark):
    answer = 'Sure:\n```json\n{"healing_plan": [{"step_id": "s1", "title": "t", "strategy": "mean_imputation", "target_columns": ["v"], "priority": 1, "estimated_impact": 7}], "transformation_order": ["impute", "magic"], "confidence_score": -1}\n```'
    response = planner.LLMPlanner(lambda _: answer).respond(spark.createDataFrame([(1.0,)], "v double"), [], {})
    assert response.confidence_score == 0 and response.healing_plan[0].estimated_impact == 1
    out = plans.Engine().run_ai(spark.createDataFrame([(1.0,), (None,)], "v double"), response)
    assert sorted(r["v"] for r in out.frame.collect()) == [1.0, 1.0]
    assert [e.status.value for e in out.log.entries] == ["APPLIED", "SKIPPED", "VALIDATION"]
    for bad in ("{}", "no", '{"healing_plan": [], "transformation_order": [], "confidence_score": 1}'):
        with pytest.raises(model.PlanError):
            model.AgentResponse.parse(model.salvage_json(bad))


def test_retry_gives_up_on_keys():
    calls = []

    def call(status):
        calls.append(status)
        raise planner.Refused(status)

    with pytest.raises(planner.Refused):
        planner.Retry()(lambda: call(401), sleep=lambda _: None)
    assert len(calls) == 1
    with pytest.raises(planner.Refused):
        planner.Retry(times=2)(lambda: call(500), sleep=lambda _: None)
    assert len(calls) == 4


def test_value_corrections_and_counts(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, s string")
    out = plans.value_corrections(df, [{"column": "s", "original_value": "x", "corrected_value": "y"}, {"column": "s", "original_value": None, "corrected_value": "z"}, {"column": "no"}])
    assert [r["s"] for r in out.orderBy("id").collect()] == ["y", "z"]
    assert plans.count_corrections(df, out, "id") == {"s": 2}


def test_custom_healer(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    out = plans.Engine(healers={"missing": lambda d, _: d.withColumn("v", F.lit(9.0)), "types": lambda d, _: 1 / 0}).run(df, model.Plan(()))
    assert out.frame.first()["v"] == 9.0 and out.log.summary()["errors"] == 1


def test_diff_pages(spark):
    b = spark.createDataFrame([(i, "a") for i in range(10)], "k long, s string")
    d = report.diff_keyed(b, b.withColumn("s", F.when(F.col("k") > 3, "b").otherwise("a")), "k")
    assert [r["row"] for r in report.diff_page(d, "S", 1, 4).collect()] == [8, 9]
    assert report.diff_cells(d, per_column=3).count() == 3


def test_sql_functions(spark):
    X.register_sql(spark)
    assert spark.sql("SELECT tm_fix_email(' A@B.C '), tm_fix_zipcode('101')").first()[:] == ("a@b.c", "00101")


@pytest.mark.parametrize("n", [1, 6, 12])
def test_repairs_in_a_row_read_the_table_once(spark, tmp_path, n):
    """Statistics are taken once, so plans grow with the number of repairs and do not double."""
    spark.range(50).select("id", *(F.when(F.col("id") % (k + 2) > 0, F.col("id").cast("double")).alias(f"x{k}") for k in range(n))).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for k in range(n):
        df = heal.impute(df, ["mean", "median", "mode"][k % 3], [f"x{k}"])
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert df.where(" or ".join(f"x{k} is null" for k in range(n))).count() == 0


def test_mode_of_times_is_kept(spark):
    df = spark.sql("select cast(t as timestamp_ntz) t, cast(t as timestamp) z, cast(t as date) d from values ('2024-03-10 02:30:00.123456'), ('2024-03-10 02:30:00.123456'), (null), ('2020-01-01 00:00:00') as v(t)")
    got = heal.impute(df, "mode", ["t", "z", "d"])
    assert got.dtypes == df.dtypes and got.where("t is null or z is null or d is null").count() == 0
    assert got.where("t = timestamp_ntz '2024-03-10 02:30:00.123456' and d = date '2024-03-10' and z = timestamp '2024-03-10 02:30:00.123456'").count() == 3
