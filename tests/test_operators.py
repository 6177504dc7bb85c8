import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from refinery.functions import columns as X
from refinery.functions import quantiles as QT
from refinery.operators import companions, duplicates, features, intake, missing, outliers, steps
from refinery.operators.format import date_format, label_map, resolve_formats, snake_case, snake_names
from refinery.operators.profile import CONSTANT, IDENTIFIER, NEARLY_EMPTY, frame, histogram, profile, summary_card
from refinery.plans.cards import Card, Kind, Log, Pattern, Stage, Status, Thresholds


def one(spark, values, kind="string", name="x"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_rid long, {name} {kind}")


def column(df, name="x"):
    return [r[name] for r in df.orderBy("_rid").collect()]


# names, text, numbers, dates


@pytest.mark.parametrize(
    "name, want",
    [("Subject ID", "subject_id"), ("BMI (kg/m^2)", "bmi_kg_m_2"), ("camelCaseField", "camel_case_field"), ("PascalCase", "pascal_case"), ("  spaced out  ", "spaced_out"), ("ALL_CAPS", "all_caps"), ("9-Lives", "_9_lives"), ("---", "_")],
)
def test_snake_case(name, want):
    assert snake_case(name) == want


def test_name_collisions():
    assert snake_names(["A b", "a_b", "a-B", "c"]) == ["a_b", "a_b_1", "a_b_2", "c"]


def test_strip_unicode(spark):
    df = one(spark, [" A", "B ", "  A  ", " B \t\n", "", None])
    assert column(steps.run(df, {"op": "strip", "column": "x"})) == ["A", "B", "A", "B", "", None]


def test_numbers(spark):
    df = one(spark, ["1d", "1f", "1,000", " 1 ", "+5", "5.", "-.5", "inf", "-Infinity", "nan", "", "1e3", None])
    got = column(df.withColumn("x", X.to_number(F.col("x"))))
    assert got == [None, None, None, 1.0, 5.0, 5.0, -0.5, math.inf, -math.inf, None, None, 1000.0, None]


def test_booleans(spark):
    text = one(spark, ["Yes", " no", "T", "0", "1.0", None])
    assert column(steps.run(text, {"op": "to_boolean", "column": "x"})) == [True, False, True, False, None, None]
    df = one(spark, [1.0, 0.0, None, 2.0], "double")
    assert column(df.withColumn("x", X.to_boolean(F.col("x"), df.schema["x"].dataType))) == [True, False, None, None]


@pytest.mark.parametrize(
    "value, want",
    [("2024-03-15", "yyyy-MM-dd"), ("03/04/2024", "M/d/yyyy"), ("15/03/2024", "d/M/yyyy"), ("20240315", "yyyyMMdd"), ("2024-03-15 10:11:12", "yyyy-MM-dd HH:mm:ss"), ("1.2.24", "M.d.yy"), ("March", None), (None, None)],
)
def test_date_formats(value, want):
    assert date_format(value) == want


def test_first_date_sets_the_format(spark):
    df, cards, _ = resolve_formats(one(spark, ["03/04/2024", "25/04/2024", "12/31/2023", "1/1/2024", "2/2/2024"]))
    got = column(df)
    assert (got[0].month, got[0].day, got[1], got[2].day) == (3, 4, None, 31)
    assert cards[0].card_id == "format_coerce_datetime__x" and cards[0].metadata["n_unparseable_to_nat"] == 1


def test_format_cases(spark):
    numbers = [str(i) for i in range(1, 8)] + ["oops", "9", "10"]
    df, cards, _ = resolve_formats(one(spark, numbers, name="v"))
    assert column(df, "v") == [1, 2, 3, 4, 5, 6, 7, None, 9, 10] and cards[0].metadata["n_unparseable_to_nan"] == 1
    df, _, _ = resolve_formats(one(spark, ["72.4", "85.1", "61.0"], name="w"))
    assert column(df, "w") == [72.4, 85.1, 61.0]
    df, _, _ = resolve_formats(one(spark, ["yes", "no", "Yes", "NO"], name="a"))
    assert column(df, "a") == [True, False, True, False]
    df, _, _ = resolve_formats(one(spark, [0, 1, 0, 1], "long", "flag"))
    assert column(df, "flag") == [False, True, False, True]
    df, _, _ = resolve_formats(one(spark, ["A", "a", "A", "B", "b", "A", "A"] * 2, name="arm"))
    assert set(column(df, "arm")) == {"A", "B"}
    assert label_map(one(spark, ["A", "B", "C"] * 3), "x") == {}


def test_format_is_idempotent_and_tokens(spark):
    df = spark.createDataFrame([(0, " ?", 1.5), (1, "n/a", 2.5), (2, "none", 3.5), (3, "x", 4.5), (4, "x", 0.5), (5, "none", 1.0)], "_rid long, `A B` string, y double")
    out, cards, done = resolve_formats(df)
    assert column(out, "a_b") == [None, None, "none", "x", "x", "none"]
    token = next(c for c in cards if c.card_id.startswith("format_missing_tokens"))
    assert token.metadata["tokens"] == ["?", "n/a"] and all(c.status == Status.AGENT_AUTO for c in cards)
    assert resolve_formats(out)[1] == []
    again = df
    for s in done:
        again = steps.run(again, s)
    assert again.collect() == out.collect()


def test_missing_codes(spark):
    df = spark.createDataFrame([(0, -99, " NA9 ", -99.0), (1, 5, "b", 1.0)], "_rid long, a long, b string, c double")
    got = steps.run(df, {"op": "missing_codes", "codes": ["-99", "na9"]}).orderBy("_rid").collect()
    assert tuple(got[0])[1:] == (None, None, -99.0) and tuple(got[1])[1:] == (5, "b", 1.0)


# profile


def test_types_and_flags(spark):
    rows = [(i, f"S{i:04d}", "US", None if i else "x", "ABC"[i % 3], 20 + i, i / 3, i % 2, f"row-{i}-note", None) for i in range(100)]
    df = spark.createDataFrame(rows, "_rid long, sid string, country string, sparse string, arm string, age long, ratio double, bit int, note string, nothing string")
    p = profile(df)
    assert [p[c].kind for c in ("sid", "arm", "age", "ratio", "bit", "note", "nothing")] == [Kind.STRING, Kind.CATEGORICAL, Kind.INTEGER, Kind.NUMERIC, Kind.INTEGER, Kind.STRING, Kind.UNKNOWN]
    assert IDENTIFIER in p["sid"].flags and CONSTANT in p["country"].flags and NEARLY_EMPTY in p["sparse"].flags and "entirely missing" in p["nothing"].flags
    assert IDENTIFIER in p["age"].flags and p["arm"].top_values[0] == ("A", 34) and p["bit"].flags == ["0/1 encoded — may be boolean"]
    assert p["age"].numbers.median == 69.5 and summary_card(p).metadata["n_with_missing"] == 2
    assert frame(spark, p).count() == 9


def test_missing_counts_and_nan(spark):
    p = profile(one(spark, [25.0, None, 30.0, float("nan"), 45.0], "double", "age"))["age"]
    assert (p.n_missing, p.missing_rate, p.n_unique) == (2, 0.4, 3)


def test_empty_table(spark):
    p = profile(spark.createDataFrame([], "a long, b string"))
    assert p["a"].kind == Kind.UNKNOWN and p["a"].n_total == 0
    assert resolve_formats(spark.createDataFrame([], "a long, b string"))[0].count() == 0


def test_quantiles_by_nested_histograms(spark, monkeypatch):
    monkeypatch.setattr(QT, "CELLS", 7)
    monkeypatch.setattr(QT, "LAST", 5)
    rng = np.random.default_rng(0)
    for values in (rng.normal(0, 1, 500), np.repeat([1.0, 2.0, 7.0], 100), np.array([3.0]), rng.exponential(1, 301) ** 8):
        df = one(spark, values.tolist() + [None], "double")
        probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
        assert QT.quantiles(df, "x", probs, one_buffer=0) == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12)
    assert QT.quantiles(one(spark, [None], "double"), "x", [0.5]) is None


def test_histogram(spark):
    got = {r["bin"]: (r.n, r.n_inf) for r in histogram(one(spark, [0.0, 1.0, 15.0, 14.9, None, math.inf], "double"), "x").collect()}
    assert got == {0: (1, 1), 1: (1, 1), 14: (2, 1)}


def test_skewness_is_corrected(spark):
    df = one(spark, [1.0, 2.0, 2.0, 9.0], "double")
    x = np.array([1.0, 2.0, 2.0, 9.0])
    g1 = ((x - x.mean()) ** 3).mean() / x.std() ** 3
    assert df.agg(X.sample_skewness(F.col("x"))).first()[0] == pytest.approx(g1 * math.sqrt(12) / 2)
    assert one(spark, [3.0] * 4, "double").agg(X.sample_skewness(F.col("x"))).first()[0] == 0.0


# duplicates


def dup_frame(spark):
    rows = [(0, 1, "a", None), (1, 2, "a", None), (2, 3, "b", 1.5), (3, 4, "a", None), (4, 5, "b", 2.5)]
    return spark.createDataFrame(rows, "_rid long, row_id long, t string, n double")


def test_exact_duplicates(spark):
    df = dup_frame(spark)
    cards = duplicates.detect(df, profile(df))
    exact = cards[0]
    assert (exact.metadata["n_duplicate_rows"], exact.metadata["n_groups"], exact.metadata["n_to_remove"]) == (3, 1, 2)
    assert exact.metadata["excluded_columns"] == ["row_id"] and cards[1].card_id == "duplicates_near_clear"
    kept = duplicates.apply(df, exact.resolve())
    assert sorted(r.row_id for r in kept.collect()) == [1, 3, 5] and kept.columns == df.columns
    assert sorted(r.row_id for r in duplicates.apply(df, exact.resolve("drop_all_duplicate_rows")).collect()) == [3, 5]
    assert duplicates.apply(df, exact.resolve("keep_all_duplicates")).count() == 5
    exact.action_taken = "no such"
    with pytest.raises(ValueError):
        duplicates.fit(df, exact)


def test_entity_clusters(spark):
    rows = [(i, k, f"v{i}") for i, k in enumerate([1, 1, 2, 3, 4, 5, None, None])]
    df = spark.createDataFrame(rows, "_rid long, subject_id long, v string")
    card = next(c for c in duplicates.detect(df, profile(df)) if c.card_id == "duplicates_near_001")
    assert (card.metadata["value"], card.metadata["size"], card.metadata["differing_columns"], card.default_action) == (1, 2, ["v"], "inspect")
    assert column(duplicates.apply(df, card.resolve("merge_keep_last")), "v") == ["v1", "v2", "v3", "v4", "v5", "v6", "v7"]
    assert column(duplicates.apply(df, card.resolve("merge_keep_first")), "v")[0] == "v0"
    panel = spark.createDataFrame([(i, i // 2) for i in range(8)], "_rid long, paid long")
    assert duplicates.detect(panel, profile(panel))[-1].card_id == "duplicates_near_panel_key"
    many = spark.createDataFrame([(i, i // 2 if i < 120 else i) for i in range(400)], "_rid long, k_id long")
    cards = duplicates.detect(many, profile(many))
    assert cards[-1].card_id == "duplicates_near_overflow" and cards[-1].metadata["n_more"] == 10


# missing values


def test_patterns(spark):
    rng = np.random.default_rng(1)
    age = rng.normal(60, 10, 400)
    gone = rng.random(400) < 1 / (1 + np.exp(-(age - 60) / 5))
    rows = [(i, float(a), None if g else 25.0 + i % 7, None if i % 10 == 0 else float(i % 13)) for i, (a, g) in enumerate(zip(age, gone))]
    df = spark.createDataFrame(rows, "_rid long, age double, bmi double, weight double")
    p = profile(df)
    pattern, evidence = missing.classify(df, "bmi", p)
    assert pattern == Pattern.MAR and evidence[0][0] == "age"
    assert missing.classify(df, "age", p) == (Pattern.UNKNOWN, [])
    assert missing.classify(df.select("_rid", "weight"), "weight", {"weight": p["weight"]})[0] == Pattern.MCAR


def test_recommendations(spark):
    df = spark.createDataFrame([(i, float(i) if i % 2 else None, "ab"[i % 2] if i % 3 else None, None if i % 50 else 1.0) for i in range(100)], "_rid long, half double, arm string, sparse double")
    p = profile(df)
    p["half"].n_missing, p["sparse"].n_missing = 8, 60
    assert missing.recommend(p["half"], Pattern.MCAR)[0] == "median_impute" and missing.recommend(p["half"], Pattern.MAR)[0] == "regression_impute"
    p["half"].n_missing = 1
    assert missing.recommend(p["half"], Pattern.MCAR)[0] == "drop_rows" and missing.recommend(p["sparse"], Pattern.MCAR)[0] == "drop_variable"
    assert missing.recommend(p["arm"], Pattern.MCAR)[0] == "mode_impute"


def test_chained_regressions_against_all_rows(spark):
    """One scan's sums by pattern give the same ten rounds as going over all rows in each."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 4)) @ rng.normal(0, 1, (4, 4)) * [1, 10, 100, 1] + [5, -3, 1000, 0]
    holes = rng.random((400, 4)) < [0.1, 0.25, 0.2, 0]
    names = ["p", "q", "r", "s"]
    df = spark.createDataFrame([tuple(None if h else float(v) for v, h in zip(a, b)) for a, b in zip(x, holes)], ", ".join(f"{n} double" for n in names))
    v = np.where(holes, np.nan, x)
    v = np.where(holes, np.nanmean(v, axis=0), v)
    for _ in range(10):
        for k in sorted(range(3), key=lambda k: holes[:, k].sum()):
            others, seen = [i for i in range(4) if i != k], ~holes[:, k]
            a, y = v[seen][:, others], v[seen, k]
            d, e = a - a.mean(axis=0), y - y.mean()
            w = missing.ridge(d.T @ d, d.T @ e, float(e @ e), len(y))
            v[holes[:, k], k] = y.mean() + (v[holes[:, k]][:, others] - a.mean(axis=0)) @ w
    fitted = missing.fit_chain(df, "p", Thresholds(mice_fill_all=True))
    assert len(fitted["rounds"]) == 30
    got = np.array([list(r) for r in steps.run(df, fitted).collect()])
    assert np.allclose(np.sort(got, axis=0), np.sort(v, axis=0), rtol=1e-5, atol=1e-5)


def test_fills(spark):
    df = spark.createDataFrame([(0, 1.0, "A", 10), (1, None, "B", 20), (2, 3.0, "A", 30), (3, None, None, None)], "_rid long, x double, arm string, y long")

    def done(variable, action):
        return missing.apply(df, Card(f"missing__{variable}", Stage.MISSINGNESS, variable, "", "", default_action=action).resolve())

    assert column(done("x", "median_impute")) == [1.0, 2.0, 3.0, 2.0] and column(done("arm", "mode_impute"), "arm") == ["A", "B", "A", "A"]
    assert column(done("y", "median_impute"), "y") == [10, 20, 30, 20] and column(done("x", "mean_impute")) == [1.0, 2.0, 3.0, 2.0]
    assert done("x", "drop_rows").count() == 2 and "x" not in done("x", "drop_variable").columns and done("x", "leave_as_is").collect() == df.collect()
    assert column(done("x", "flag_missing_indicator"), "x_was_missing") == [False, True, False, True]
    assert column(done("arm", "regression_impute"), "arm") == ["A", "B", "A", "A"]
    with pytest.raises(ValueError):
        done("x", "no such")


def test_chained_regressions(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, 600)
    b = 2 * a + 1 + rng.normal(0, 0.1, 600)
    gone = rng.random(600) < 1 / (1 + np.exp(-2 * a))
    df = spark.createDataFrame([(i, float(x), None if g else float(y), float(z)) for i, (x, y, g, z) in enumerate(zip(a, b, gone, rng.normal(0, 1, 600)))], "_rid long, a double, b double, c double")
    fitted = missing.fit_chain(df, "b")
    got = column(steps.run(df, fitted), "b")
    assert None not in got and all(abs(g - y) < 1e-12 for g, y, m in zip(got, b, gone) if not m)
    error = math.sqrt(np.mean([(g - y) ** 2 for g, y, m in zip(got, b, gone) if m]))
    mean = np.mean([(b[~gone].mean() - y) ** 2 for y, m in zip(b, gone) if m]) ** 0.5
    assert error < 0.2 and error < 0.2 * mean and missing.fit_chain(df, "b") == fitted


# outliers


def test_outliers(spark):
    values = [50.0 + (i % 5) for i in range(20)] + [500.0, -5.0, None]
    df = one(spark, values, "double")
    f = outliers.fit_fences(df, "x")
    assert f.severity == "implausible" and f.n_flagged == 2 and f.n_negative == 1
    card = outliers.detect(df, profile(df))[0]
    assert card.default_action == "treat_as_missing" and sorted(card.metadata["values"]) == [-5.0, 500.0]
    assert column(outliers.apply(df, card.resolve()))[-3:] == [None, None, None]
    assert outliers.apply(df, card.resolve("drop_rows")).count() == 21
    clipped = column(outliers.apply(df, card.resolve("winsorize")))
    assert clipped[-1] is None and clipped[-3:-1] == [f.high, f.low]
    assert outliers.apply(df, card.resolve("inspect")).collect() == df.collect()
    assert outliers.fit_fences(one(spark, [1.0] * 9, "double"), "x") is None and outliers.fit_fences(one(spark, ["a"] * 20), "x") is None


# features


def test_binning(spark):
    df = one(spark, [0.0, 1.0, 2.0, 3.0, 4.0, None], "double")
    out = features.bin_column(df, "x", "equal_width", 4)
    assert column(out, "x_bin") == ["≤1", "≤1", "1–2", "2–3", ">3", None] and out.schema["x_bin"].metadata["labels"] == ["≤1", "1–2", "2–3", ">3"]
    assert set(column(features.bin_column(one(spark, [0.0] * 9 + [5.0], "double"), "x", "quantile"), "x_bin")) == {"all"}
    assert column(features.bin_column(one(spark, [2.0, 2.0], "double"), "x", "equal_width"), "x_bin") == ["all", "all"]
    assert column(features.bin_column(df, "x", bins=[1.0, 2.0, 3.0]), "x_bin") == [None, "≤2", "≤2", ">2", None, None]
    with pytest.raises(KeyError):
        features.bin_column(df, "nope")


def test_natural_breaks_are_optimal():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(10):
        x = sorted(rng.integers(0, 40, 9).tolist())
        edges = features.natural_breaks([float(v) for v in x], 3)
        cost = lambda g: sum((v - np.mean(g)) ** 2 for v in g)
        groups = [[v for v in x if (i == 0 or v > edges[i]) and v <= edges[i + 1]] for i in range(len(edges) - 1)]
        best = min(cost(x[:i]) + cost(x[i:j]) + cost(x[j:]) for i, j in itertools.combinations(range(1, 9), 2))
        assert sum(cost(g) for g in groups if g) <= best + 1e-9


def test_labels():
    assert features.bin_labels([0, 1, 2]) == ["≤1", ">1"] and features.bin_labels([0, 1.25, 1.5, 3]) == ["≤1", "1–2", ">2"] and features.bin_labels([0, 1.1, 1.3, 3]) == ["≤1.1", "1.1–1.3", ">1.3"] and features.bin_labels([0, 1]) == ["all"]


def test_scaling(spark):
    df = one(spark, [1.0, 2.0, 3.0, None], "double")
    assert column(features.scale_column(df, "x", "standard"), "x_scaled") == [-1.0, 0.0, 1.0, None]
    assert column(features.scale_column(df, "x", "minmax", inplace=True)) == [0.0, 0.5, 1.0, None]
    assert column(features.scale_column(df, "x", "robust"), "x_scaled") == [-1.0, 0.0, 1.0, None]
    assert column(features.scale_column(one(spark, [-1.0, 0.0, None], "double"), "x", "log"), "x_scaled") == [0.0, 0.0, None]
    assert column(features.scale_column(one(spark, [4.0, 4.0], "double"), "x", "standard"), "x_scaled") == [0.0, 0.0]


def test_assessments(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.exponential(1) ** 4 * 100), float(i % 40), f"v{i % 30}") for i in range(300)]
    df = spark.createDataFrame(rows, "_rid long, heavy double, even double, code string")
    p = profile(df)
    assert [c.variable for c in features.assess_binning(df, p)] == ["heavy"] and features.assess_binning(df, p)[0].default_action == "quantile_bin"
    assert {c.variable: c.default_action for c in features.assess_scaling(df, p)}["heavy"] == "log_scale"
    assert [c.variable for c in features.assess_encoding(df, p)] == ["code"]


def test_encoding(spark):
    df = one(spark, ["a", "a", "b", None])
    assert column(features.frequency_encode(df, "x"), "x_freq") == pytest.approx([2 / 3, 2 / 3, 1 / 3, 0.0])
    fitted = features.frequency_step(df, "x")
    assert column(steps.run(one(spark, ["b", "z"]), fitted), "x_freq") == pytest.approx([1 / 3, 0.0])
    dates = one(spark, ["2024-03-16 05:00:00", None]).withColumn("x", F.to_timestamp_ntz("x"))
    got = features.datetime_decompose(dates, "x").orderBy("_rid").collect()
    assert tuple(got[0])[2:] == (2024, 3, 16, 5, 5, 1) and tuple(got[1])[2:] == (None,) * 6


# companions and intake


def test_companions(spark, tmp_path):
    for n in ("s_1.png", "s_2.png", "s_9.txt"):
        (tmp_path / n).write_bytes(b"x")
    files = companions.list_files(spark, str(tmp_path))
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, None)], "_rid long, sid long")
    card = companions.detect(df, "s_{sid}", files)
    assert (card.metadata["n_matched"], card.metadata["unmatched"], card.metadata["orphans"]) == (2, ["s_", "s_3"], ["s_9"]) and card.default_action == "keep_rows"
    assert companions.apply(df, card.resolve("drop_rows"), files).count() == 2
    assert column(companions.apply(df, card.resolve("add_indicator"), files), "has_file") == [True, True, False, False]
    assert companions.dominant_extension(files) == ".png" and companions.template_columns("a_{x}-{y}") == ["x", "y"]
    assert companions.detect(df, None, None).status == Status.SKIPPED
    with pytest.raises(ValueError):
        companions.detect(df, "{nope}", files)


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k long, v string")
    right = spark.createDataFrame([(1, 10), (None, 20), (1, 11), (5, 50)], "k long, w long")
    assert sorted(map(tuple, intake.left_join(left, right, ["k"]).collect()), key=str) == sorted([(1, "a", 10), (1, "a", 11), (None, "b", 20), (2, "c", None)], key=str)
    assert len(intake.outer_merge([left, right], "k").collect()) == 5
    other = spark.createDataFrame([(1,), (2,), (3,)], "z long")
    both, note = intake.join_right(left, other, "o")
    assert both.count() == 3 and "position" in note
    assert "left out" in intake.join_right(left, other.limit(1), "o")[1] and "stacked" in intake.join_right(left, left, "o")[1]
    mapped, _ = intake.join_right(left, right.withColumnRenamed("k", "key"), "r", None, {"key": "k"})
    assert "w" in mapped.columns
    assert intake.join_keys(" a, b ,") == ["a", "b"] and intake.join_keys(None) == []


def test_intake(spark):
    t = {"train": spark.createDataFrame([(1, -9, "x"), (2, 5, "y"), (3, 6, "z")], "id long, a long, b string"), "labels": spark.createDataFrame([(1, 0), (2, 1)], "id long, y int"), "test": spark.createDataFrame([(7, -9, "q")], "id long, a long, b string")}
    p = intake.propose(t)
    assert p.roles == {"train": "primary_data", "labels": "target", "test": "hold_out"}
    p.na_values = ["-9"]
    got = intake.confirm(t, p)
    assert got.table.columns == ["id", "a", "b", "y"] and got.hold_out.first().a is None and got.table.filter("a is null").count() == 1
    with pytest.raises(ValueError):
        intake.confirm(t, intake.Proposal({n: intake.Role.TEMPLATE for n in t}))


# cards


def test_cards_and_log(tmp_path):
    log = Log()
    a, b = Card("a", Stage.OUTLIER, "x", "i", "r", default_action="inspect", alternatives=["drop_rows"]), Card("b", Stage.FORMAT, None, "i", "r").auto("renamed")
    log.extend([a, b])
    assert log.pending() == [a] and log.by_stage(Stage.FORMAT) == [b] and log.by_id("a") is a
    a.resolve("drop_rows")
    assert a.status == Status.OVERRIDDEN and log.overrides() == [a] and log.counts() == {"total": 2, "automated": 1, "judged": 1, "overridden": 1}
    assert log.to_dict()["n_entries"] == 2 and a.options()[0]["recommended"]
    log.write(str(tmp_path / "log.json"))
    with pytest.raises(ValueError):
        a.resolve("no such")
    assert Thresholds(bins=5).bins == 5
