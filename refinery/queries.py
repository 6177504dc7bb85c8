"""Queries of the cleaning operators over the test tables, each with the SQL that an oracle can run.

The test tables are clean, so views put the same dirt into them in Spark and
in the oracle: missing cells, blanks, case variants, tokens, coded values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as X
from .functions.quantiles import quantiles
from .operators import companions, duplicates, features, intake, missing, outliers, steps
from .operators import profile as P
from .operators.format import label_map, resolve_formats, snake_names
from .plans import pipeline
from .plans.plan import Plan, replay, verify
from .sources import writers
from .streaming.monitor import quality

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LINEITEM_DIRTY = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus,
  CASE WHEN l_orderkey % 20 = 0 THEN NULL ELSE l_quantity END AS qty,
  CASE WHEN l_linestatus = 'F' AND l_orderkey % 3 = 0 THEN NULL ELSE l_extendedprice END AS price,
  CASE WHEN l_partkey % 7 = 0 THEN concat('  ', l_returnflag, ' ') WHEN l_partkey % 11 = 0 THEN lower(l_returnflag)
       WHEN l_partkey % 13 = 0 THEN '?' ELSE l_returnflag END AS flag_txt,
  CASE WHEN l_suppkey % 50 = 0 THEN 'oops' ELSE CAST(l_linenumber AS STRING) END AS num_txt,
  CASE WHEN l_linenumber % 2 = 0 THEN 'yes' ELSE 'No' END AS bool_txt,
  concat(CAST(1990 + l_partkey % 30 AS STRING), '-', CAST(10 + l_suppkey % 3 AS STRING), '-', CAST(10 + l_linenumber AS STRING)) AS date_txt,
  CASE WHEN l_suppkey % 25 = 0 THEN NULL ELSE l_suppkey END AS supp_key
FROM lineitem"""
EVENTS_DIRTY = """
SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 97 = 0 THEN -99.0 ELSE value END AS value,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS etype
FROM events"""
WITH = f"WITH lineitem_dirty AS ({LINEITEM_DIRTY}), events_dirty AS ({EVENTS_DIRTY})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A dirty view, by the SQL that the oracle runs too."""
    base, sql = ("lineitem", LINEITEM_DIRTY) if name == "lineitem_dirty" else ("events", EVENTS_DIRTY)
    sql = sql.replace("-99.0", "-99.0D").replace(f"FROM {base}", "FROM {source}")
    return spark.sql(sql, source=table(spark, sf_dir, base))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def one_row(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


# profiling


@query("SELECT 'lineitem' AS t, count(*) AS n, CAST(count(*) - count(l_extendedprice) AS BIGINT) AS n_missing, count(DISTINCT l_extendedprice) AS n_unique, round(avg(l_extendedprice), 6) AS mean, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(stddev_samp(l_extendedprice), 6) AS std, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75 FROM lineitem")
def pr_numeric_profile(spark, sf_dir):
    p = P.profile(table(spark, sf_dir, "lineitem").select("l_extendedprice"))["l_extendedprice"]
    s = p.numbers
    row = one_row(spark, "t string, n long, n_missing long, n_unique long, mean double, median double, std double, low double, high double, q25 double, q75 double", "lineitem", p.n_total, p.n_missing, p.n_unique, s.mean, s.median, s.std, s.min, s.max, s.q25, s.q75)
    return rounded(row, "mean", "median", "std", "q25", "q75")


@query(f"{WITH} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n_total, CAST(count(*) - count({c}) AS BIGINT) AS n_missing, count(DISTINCT {c}) AS n_unique, round((count(*) - count({c})) / count(*), 6) AS missing_rate FROM lineitem_dirty" for c in ("l_partkey", "qty", "price", "flag_txt", "num_txt", "bool_txt", "supp_key")))
def pr_column_counts(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem_dirty").select("l_partkey", "qty", "price", "flag_txt", "num_txt", "bool_txt", "supp_key")
    return P.frame(spark, P.profile(df)).select("name", "n_total", "n_missing", "n_unique", F.round("missing_rate", 6).alias("missing_rate"))


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def pr_topk_values(spark, sf_dir):
    return spark.createDataFrame(P.top_values(table(spark, sf_dir, "orders"), "o_orderpriority", 10), "value string, n long")


@query(rf"{WITH} SELECT round(count(*) FILTER (regexp_matches(num_txt, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')) / count(*), 6) AS number_rate, round(count(*) FILTER (regexp_matches(date_txt, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}')) / count(*), 6) AS date_rate, round(count(*) FILTER (lower(bool_txt) IN ('yes','no')) / count(*), 6) AS boolean_rate FROM lineitem_dirty")
def pr_type_rates(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem_dirty")
    s = P.statistics(df, ["num_txt", "date_txt", "bool_txt"])
    row = df.agg(s["0_n"].alias("n"), s["0_number"].alias("a"), s["1_date"].alias("b"), s["2_bool"].alias("c"))
    return row.select(F.round(F.col("a") / F.col("n"), 6).alias("number_rate"), F.round(F.col("b") / F.col("n"), 6).alias("date_rate"), F.round(F.col("c") / F.col("n"), 6).alias("boolean_rate"))


@query("SELECT * FROM (VALUES ('qty','integer'), ('price','numeric'), ('flag_txt','categorical'), ('num_txt','integer'), ('bool_txt','boolean'), ('date_txt','datetime'), ('l_partkey','integer')) t(name, detected_type)")
def pr_types(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem_dirty").select("qty", "price", "flag_txt", "num_txt", "bool_txt", "date_txt", "l_partkey")
    return P.frame(spark, P.profile(df)).select("name", "detected_type")


@query("SELECT count(DISTINCT c_custkey) = count(*) AS all_unique, max(c_custkey) - min(c_custkey) + 1 = count(*) AS consecutive, true AS identifier FROM customer")
def pr_identifier(spark, sf_dir):
    p = P.profile(table(spark, sf_dir, "customer").select("c_custkey"))["c_custkey"]
    return one_row(spark, "all_unique boolean, consecutive boolean, identifier boolean", p.n_unique == p.n_total, p.numbers.max - p.numbers.min + 1 == p.n_total, P.IDENTIFIER in p.flags)


@query("SELECT round(skewness(value), 6) AS skewness FROM events")
def pr_g1_skew(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.round(X.sample_skewness(F.col("value")), 6).alias("skewness"))


@query("WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 15)), 14) AS INTEGER) AS bin, count(*) AS n FROM events, m GROUP BY 1")
def pr_histogram15(spark, sf_dir):
    return P.histogram(table(spark, sf_dir, "events"), "value").select("bin", "n")


@query("SELECT round(quantile_cont(l_extendedprice, 0.01), 6) AS q01, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.99), 6) AS q99 FROM lineitem")
def pr_large_quantiles(spark, sf_dir):
    """The way for columns that no single buffer can hold, taken here at any size."""
    found = quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.01, 0.5, 0.99], one_buffer=0)
    return rounded(one_row(spark, "q01 double, q50 double, q99 double", *found), "q01", "q50", "q99")


@query("SELECT * FROM (VALUES ('integer', 7), ('numeric', 1), ('categorical', 2), ('boolean', 1), ('datetime', 1)) t(detected_type, n)")
def pr_summary(spark, sf_dir):
    card = P.summary_card(P.profile(dirty(spark, sf_dir, "lineitem_dirty")))
    return spark.createDataFrame(list(card.metadata["type_counts"].items()), "detected_type string, n long")


# format


@query(f"{WITH} SELECT l_orderkey, l_linenumber, l_partkey, trim(flag_txt) AS flag_txt FROM lineitem_dirty")
def fm_strip(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem_dirty").select("l_orderkey", "l_linenumber", "l_partkey", "flag_txt")
    return steps.run(df, {"op": "strip", "column": "flag_txt"})


@query("SELECT * FROM (VALUES (0,'subject_id'),(1,'bmi_kg_m_2'),(2,'camel_case_field'),(3,'pascal_case'),(4,'spaced_out'),(5,'all_caps'),(6,'_9_lives'),(7,'_'),(8,'all_caps_1')) t(position, name)")
def fm_snake_names(spark, sf_dir):
    names = ["Subject ID", "BMI (kg/m^2)", "camelCaseField", "PascalCase", "  spaced out  ", "ALL_CAPS", "9-Lives", "---", "All Caps"]
    return spark.createDataFrame(list(enumerate(snake_names(names))), "position int, name string")


@query(f"{WITH} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN lower(trim(flag_txt)) IN ('?','na','n/a','n.a.','nan','null','nil','#n/a','<na>') THEN NULL ELSE flag_txt END AS flag_txt FROM lineitem_dirty")
def fm_missing_tokens(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem_dirty").select("l_orderkey", "l_linenumber", "l_partkey", "flag_txt")
    return steps.run(df, {"op": "missing_tokens", "column": "flag_txt", "tokens": X.MISSING_TOKENS})


@query(f"{WITH} SELECT l_orderkey, l_partkey, TRY_CAST(num_txt AS BIGINT) AS num_txt FROM lineitem_dirty")
def fm_to_number(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem_dirty").select("l_orderkey", "l_partkey", "num_txt")
    return steps.run(df, {"op": "to_number", "column": "num_txt", "integer": True})


@query(f"{WITH} SELECT l_orderkey, l_partkey, CASE lower(bool_txt) WHEN 'yes' THEN true WHEN 'no' THEN false END AS bool_txt FROM lineitem_dirty")
def fm_to_boolean(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem_dirty").select("l_orderkey", "l_partkey", "bool_txt")
    return steps.run(df, {"op": "to_boolean", "column": "bool_txt"})


@query(f"{WITH} SELECT l_orderkey, l_partkey, CAST(year(d) AS BIGINT) AS y, CAST(month(d) AS BIGINT) AS m, CAST(day(d) AS BIGINT) AS d FROM (SELECT l_orderkey, l_partkey, try_strptime(date_txt, '%Y-%m-%d') AS d FROM lineitem_dirty)")
def fm_to_datetime(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem_dirty").select("l_orderkey", "l_partkey", "date_txt")
    out = steps.run(df, {"op": "to_datetime", "column": "date_txt", "format": "yyyy-MM-dd"})
    return out.select("l_orderkey", "l_partkey", *(f("date_txt").cast("long").alias(n) for n, f in (("y", F.year), ("m", F.month), ("d", F.dayofmonth))))


@query(f"{WITH}, c AS (SELECT flag_txt, lower(trim(flag_txt)) AS low, count(*) AS n FROM lineitem_dirty GROUP BY 1, 2), b AS (SELECT low, flag_txt AS best, row_number() OVER (PARTITION BY low ORDER BY n DESC, flag_txt) AS r FROM c) SELECT b.best AS flag_txt, count(*) AS n FROM lineitem_dirty d JOIN b ON lower(trim(d.flag_txt)) = b.low AND b.r = 1 GROUP BY 1")
def fm_label_normalise(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem_dirty").select("flag_txt")
    out = steps.run(df, {"op": "map_labels", "column": "flag_txt", "mapping": label_map(df, "flag_txt")})
    return out.groupBy("flag_txt").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT event_id, CASE WHEN value = -99.0 THEN NULL ELSE value END AS value FROM events_dirty")
def fm_na_codes(spark, sf_dir):
    df = dirty(spark, sf_dir, "events_dirty").select("event_id", "value")
    return steps.run(df, {"op": "missing_codes", "codes": ["-99.0"]})


@query(f"{WITH} SELECT l_orderkey, l_linenumber, l_partkey, nullif(upper(trim(flag_txt)), '?') AS flag_txt, TRY_CAST(num_txt AS BIGINT) AS num_txt, lower(bool_txt) = 'yes' AS bool_txt FROM lineitem_dirty")
def fm_resolve(spark, sf_dir):
    """The whole format stage; in this view the most frequent spelling of every label is the capital."""
    df = dirty(spark, sf_dir, "lineitem_dirty").select("l_orderkey", "l_linenumber", "l_partkey", "flag_txt", "num_txt", "bool_txt")
    out, _, _ = resolve_formats(df)
    return out


# duplicates


@query("WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups, CAST(sum(n) - count(*) AS BIGINT) AS n_to_remove FROM g")
def du_exact_stats(spark, sf_dir):
    return one_row(spark, "n_rows long, n_groups long, n_to_remove long", *duplicates.exact_counts(table(spark, sf_dir, "documents"), ["text"]))


@query("SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def du_keep_first(spark, sf_dir):
    return steps.run(table(spark, sf_dir, "documents"), {"op": "keep_first", "keys": ["text"], "order": ["doc_id"]}).drop("text")


@query("SELECT doc_id, lang, source, n_chars FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n = 1")
def du_drop_all(spark, sf_dir):
    return steps.run(table(spark, sf_dir, "documents"), {"op": "drop_copies", "keys": ["text"]}).drop("text")


@query("SELECT user_id AS key, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def du_key_collisions(spark, sf_dir):
    return duplicates.collisions(table(spark, sf_dir, "events"), "user_id")


@query("SELECT round((SELECT count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 1)) / count(DISTINCT user_id), 6) AS rate, 'duplicates_near_panel_key' AS card_id FROM events")
def du_panel_rate(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_type")
    card = next(c for c in duplicates.detect(df, P.profile(df)) if c.card_id.startswith("duplicates_near"))
    return rounded(one_row(spark, "rate double, card_id string", card.metadata["collision_rate"], card.card_id), "rate")


@query("SELECT l_orderkey AS key, count(*) AS n, count(DISTINCT l_returnflag) > 1 AS flag_differs, count(DISTINCT l_linestatus) > 1 AS status_differs FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def du_diff_columns(spark, sf_dir):
    found = duplicates.differing_columns(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])
    return found.select("key", "n", F.array_contains("differ", "l_returnflag").alias("flag_differs"), F.array_contains("differ", "l_linestatus").alias("status_differs"))


@query("SELECT event_id, user_id FROM events WHERE user_id <> 7 OR event_id = (SELECT max(event_id) FROM events WHERE user_id = 7)")
def du_merge_last(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id")
    return steps.run(df, {"op": "keep_one", "column": "user_id", "value": 7, "last": True, "order": ["event_id"]})


# missing values


_EDGES = "SELECT quantile_cont(l_partkey, 0) AS e0, quantile_cont(l_partkey, 0.25) AS e1, quantile_cont(l_partkey, 0.5) AS e2, quantile_cont(l_partkey, 0.75) AS e3 FROM lineitem"


@query(f"{WITH}, e AS ({_EDGES}), r AS (SELECT CASE WHEN l_partkey <= e1 THEN 0 WHEN l_partkey <= e2 THEN 1 WHEN l_partkey <= e3 THEN 2 ELSE 3 END AS b, avg(CASE WHEN price IS NULL THEN 1 ELSE 0 END) AS rate FROM lineitem_dirty, e GROUP BY 1) SELECT CASE WHEN max(rate) - min(rate) >= 0.1 THEN 'MAR' ELSE 'MCAR' END AS pattern FROM r")
def ms_pattern_numeric(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem_dirty").select("price", "l_partkey")
    return one_row(spark, "pattern string", str(missing.classify(df, "price", P.profile(df))[0]))


@query(f"{WITH}, r AS (SELECT l_linestatus AS level, avg(CASE WHEN price IS NULL THEN 1 ELSE 0 END) AS rate FROM lineitem_dirty GROUP BY 1) SELECT CASE WHEN max(rate) - min(rate) >= 0.1 THEN 'MAR' ELSE 'MCAR' END AS pattern, 'l_linestatus' AS predictor, round(max(rate) - min(rate), 3) AS spread FROM r")
def ms_pattern_text(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem_dirty").select("price", "l_linestatus")
    pattern, evidence = missing.classify(df, "price", P.profile(df))
    return one_row(spark, "pattern string, predictor string, spread double", str(pattern), *evidence[0])


@query(f"{WITH}, r AS (SELECT l_linestatus, avg(CASE WHEN price IS NULL THEN 1 ELSE 0 END) AS p, avg(CASE WHEN qty IS NULL THEN 1 ELSE 0 END) AS q FROM lineitem_dirty GROUP BY 1) SELECT 'price' AS name, CASE WHEN max(p) - min(p) >= 0.1 THEN 'regression_impute' ELSE 'median_impute' END AS action FROM r UNION ALL SELECT 'qty', CASE WHEN max(q) - min(q) >= 0.1 THEN 'regression_impute' ELSE 'median_impute' END FROM r")
def ms_recommend(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem_dirty").select("qty", "price", "l_linestatus")
    cards = missing.detect(df, P.profile(df))
    return spark.createDataFrame([(c.variable, c.default_action) for c in cards], "name string, action string")


@query(f"{WITH} SELECT l_orderkey, l_partkey, coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM lineitem_dirty)) AS qty FROM lineitem_dirty")
def ms_median(spark, sf_dir):
    return _filled(spark, sf_dir, "qty", "median")


@query(f"{WITH} SELECT l_orderkey, l_partkey, round(coalesce(price, (SELECT avg(price) FROM lineitem_dirty)), 4) AS price FROM lineitem_dirty")
def ms_mean(spark, sf_dir):
    return rounded(_filled(spark, sf_dir, "price", "mean"), "price", digits=4)


@query(f"{WITH} SELECT event_id, coalesce(etype, (SELECT etype FROM events_dirty WHERE etype IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS etype FROM events_dirty")
def ms_mode(spark, sf_dir):
    df = dirty(spark, sf_dir, "events_dirty").select("event_id", "etype")
    return steps.run(df, {"op": "fill", "column": "etype", "value": missing.fill_value(df, "etype", "mode")})


def _filled(spark, sf_dir, column, method):
    df = dirty(spark, sf_dir, "lineitem_dirty").select("l_orderkey", "l_partkey", column)
    return steps.run(df, {"op": "fill", "column": column, "value": missing.fill_value(df, column, method)})


@query(f"{WITH} SELECT l_orderkey, l_partkey, qty FROM lineitem_dirty WHERE qty IS NOT NULL")
def ms_drop_rows(spark, sf_dir):
    return steps.run(dirty(spark, sf_dir, "lineitem_dirty").select("l_orderkey", "l_partkey", "qty"), {"op": "drop_null_rows", "column": "qty"})


@query(f"{WITH} SELECT l_orderkey, l_partkey, qty, qty IS NULL AS qty_was_missing FROM lineitem_dirty")
def ms_indicator(spark, sf_dir):
    return steps.run(dirty(spark, sf_dir, "lineitem_dirty").select("l_orderkey", "l_partkey", "qty"), {"op": "indicator", "column": "qty", "new": "qty_was_missing"})


@query(f"{WITH} SELECT l_orderkey, l_partkey FROM lineitem_dirty")
def ms_drop_variable(spark, sf_dir):
    return steps.run(dirty(spark, sf_dir, "lineitem_dirty").select("l_orderkey", "l_partkey", "qty"), {"op": "drop_column", "column": "qty"})


@query()
def ms_mice(spark, sf_dir):
    df = dirty(spark, sf_dir, "lineitem_dirty").select("l_orderkey", "l_partkey", "qty", "price")
    return steps.run(df, missing.fit_chain(df, "price"))


# outliers


def _fences(name: str, x: str) -> str:
    return f"WITH f AS (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3, avg({x}) AS m, stddev_samp({x}) AS s FROM {name}), o AS (SELECT t.*, {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1) AS iqr, abs(({x} - m) / s) AS z, {x} < 0 AND q1 > 0 AS neg, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM {name} t, f)"


@query(f"{_fences('events', 'value')} SELECT count(*) FILTER (iqr) AS n_iqr, count(*) FILTER (z > 3) AS n_z, count(*) FILTER (z > 5) AS n_extreme, count(*) FILTER (iqr OR z > 3 OR neg) AS n_flagged, 'extreme' AS severity FROM o")
def ou_iqr_events(spark, sf_dir):
    f = outliers.fit_fences(table(spark, sf_dir, "events"), "value")
    return one_row(spark, "n_iqr long, n_z long, n_extreme long, n_flagged long, severity string", f.n_fence, f.n_z, f.n_extreme, f.n_flagged, f.severity)


@query(f"{_fences('customer', 'c_acctbal')} SELECT count(*) FILTER (neg) AS n_implausible, count(*) FILTER (iqr OR z > 3 OR neg) AS n_flagged, CASE WHEN bool_or(neg) THEN 'implausible' WHEN bool_or(z > 5) THEN 'extreme' WHEN bool_or(iqr OR z > 3) THEN 'mild' ELSE 'none' END AS severity FROM o")
def ou_severity(spark, sf_dir):
    f = outliers.fit_fences(table(spark, sf_dir, "customer"), "c_acctbal")
    return one_row(spark, "n_implausible long, n_flagged long, severity string", f.n_negative, f.n_flagged, f.severity)


def _outlier_query(op: str) -> Query:
    def run(spark, sf_dir):
        df = table(spark, sf_dir, "events").select("event_id", "value")
        f = outliers.fit_fences(df, "value")
        params = {"low": f.low, "high": f.high} if op == "clip" else f.predicate()
        return rounded(steps.run(df, {"op": op, "column": "value", **params}), "value")

    return run


for _name, _op, _sql in (
    ("ou_null_flagged", "null_outliers", "SELECT event_id, round(CASE WHEN iqr OR z > 3 OR neg THEN NULL ELSE value END, 6) AS value FROM o"),
    ("ou_drop", "drop_outliers", "SELECT event_id, round(value, 6) AS value FROM o WHERE NOT (iqr OR z > 3 OR neg)"),
    ("ou_winsorize", "clip", "SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value FROM o"),
):
    QUERIES[_name], ORACLE_SQL[_name] = _outlier_query(_op), f"{_fences('events', 'value')} {_sql}"


# binning, scaling, encoding


def _bin_sql(edges: str) -> str:
    return f"WITH e AS ({edges}) SELECT CAST(CASE WHEN n_chars <= e1 THEN 0 WHEN n_chars <= e2 THEN 1 WHEN n_chars <= e3 THEN 2 ELSE 3 END AS INTEGER) AS bin, count(*) AS n FROM documents, e GROUP BY 1"


def _binned(spark, sf_dir, method):
    df = table(spark, sf_dir, "documents").select("n_chars")
    one = features.bin_step(df, "n_chars", method)
    out = steps.run(df, one | {"labels": [str(i) for i in range(len(one["labels"]))]})
    return out.groupBy(F.col("n_chars_bin").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(_bin_sql("SELECT quantile_cont(n_chars, 0.25) AS e1, quantile_cont(n_chars, 0.5) AS e2, quantile_cont(n_chars, 0.75) AS e3 FROM documents"))
def bn_quantile(spark, sf_dir):
    return _binned(spark, sf_dir, "quantile")


@query(_bin_sql("SELECT min(n_chars) + (max(n_chars) - min(n_chars)) * 0.25 AS e1, min(n_chars) + (max(n_chars) - min(n_chars)) * 0.5 AS e2, min(n_chars) + (max(n_chars) - min(n_chars)) * 0.75 AS e3 FROM documents"))
def bn_equal_width(spark, sf_dir):
    return _binned(spark, sf_dir, "equal_width")


@query()
def bn_natural_breaks(spark, sf_dir):
    return features.bin_column(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "natural_breaks")


def _scale_query(method: str) -> Query:
    return lambda spark, sf_dir: rounded(features.scale_column(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", method), "o_totalprice_scaled")


for _name, _method, _x in (
    ("sc_standard", "standard", "(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders)"),
    ("sc_minmax", "minmax", "(o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders)"),
    ("sc_robust", "robust", "(o_totalprice - (SELECT quantile_cont(o_totalprice, 0.5) FROM orders)) / (SELECT quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) FROM orders)"),
    ("sc_log", "log", "ln(1 + greatest(o_totalprice, 0))"),
):
    QUERIES[_name], ORACLE_SQL[_name] = _scale_query(_method), f"SELECT o_orderkey, o_totalprice, round({_x}, 6) AS o_totalprice_scaled FROM orders"


@query("SELECT doc_id, source, round(count(*) OVER (PARTITION BY source) / count(*) OVER (), 6) AS source_freq FROM documents")
def en_frequency(spark, sf_dir):
    return rounded(features.frequency_encode(table(spark, sf_dir, "documents").select("doc_id", "source"), "source"), "source_freq")


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month, CAST(day(ts) AS INTEGER) AS ts_day, CAST(isodow(ts) - 1 AS INTEGER) AS ts_dayofweek, CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS TINYINT) AS ts_is_weekend FROM events")
def en_datetime(spark, sf_dir):
    return features.datetime_decompose(table(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")


@query("SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label FROM documents")
def sk_label_codes(spark, sf_dir):
    return writers.label_codes(table(spark, sf_dir, "documents"), "lang").select("doc_id", "label")


# intake and companions


@query(f"{WITH}, s AS (SELECT CASE WHEN s_suppkey % 25 = 0 THEN NULL ELSE s_suppkey END AS supp_key, s_acctbal FROM supplier) SELECT l.k AS supp_key, s.s_acctbal FROM (SELECT DISTINCT supp_key AS k FROM lineitem_dirty) l LEFT JOIN s ON l.k IS NOT DISTINCT FROM s.supp_key")
def in_left_join(spark, sf_dir):
    left = dirty(spark, sf_dir, "lineitem_dirty").select("supp_key").distinct()
    right = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 25 != 0, F.col("s_suppkey")).alias("supp_key"), "s_acctbal")
    return intake.join_right(left, right, "supplier", "supp_key")[0]


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, l.quality FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN (SELECT doc_id, quality FROM labels) l ON d.doc_id = l.doc_id")
def in_outer_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").filter("doc_id % 3 != 0")
    return intake.outer_merge([docs, table(spark, sf_dir, "labels").select("doc_id", "quality")], "doc_id")


@query("SELECT c_custkey AS id, c_name AS name, 'customer' AS source_file FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def in_stack(spark, sf_dir):
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name")
    b = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name")
    return intake.stack_tagged({"customer": a, "supplier": b})


@query("SELECT a.event_id, a.value, b.o_orderkey FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS p FROM events) a JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders) b ON a.p = b.p")
def in_positional(spark, sf_dir):
    a, b = table(spark, sf_dir, "events").select("event_id", "value"), table(spark, sf_dir, "orders").select("o_orderkey")
    return intake.positional_join(a, b, ["event_id"], ["o_orderkey"])


@query("SELECT * FROM (VALUES ('customer','primary_data'), ('labels','target'), ('sample_submission','template'), ('nation','target')) t(name, role)")
def in_roles(spark, sf_dir):
    t = {"customer": table(spark, sf_dir, "customer"), "labels": table(spark, sf_dir, "labels"), "sample_submission": table(spark, sf_dir, "region"), "nation": table(spark, sf_dir, "nation")}
    return spark.createDataFrame([(n, str(r)) for n, r in intake.propose(t).roles.items()], "name string, role string")


def _companion(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("subject"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang"), ids


@query("SELECT count(l.doc_id) AS n_matched, CAST(count(*) - count(l.doc_id) AS BIGINT) AS n_unmatched, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_orphans FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def co_match_stats(spark, sf_dir):
    docs, ids = _companion(spark, sf_dir)
    m = companions.detect(docs, "doc_{doc_id}", ids).metadata
    return one_row(spark, "n_matched long, n_unmatched long, n_orphans long", m["n_matched"], m["n_unmatched"], m["n_orphans"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def co_semi(spark, sf_dir):
    docs, ids = _companion(spark, sf_dir)
    return companions.drop_unmatched(docs, "doc_{doc_id}", ids)


@query("SELECT concat('doc_', doc_id) AS subject FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def co_unmatched(spark, sf_dir):
    docs, ids = _companion(spark, sf_dir)
    return companions.match(docs, "doc_{doc_id}", ids)["unmatched"]


@query("SELECT concat('doc_', doc_id) AS subject FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def co_orphans(spark, sf_dir):
    docs, ids = _companion(spark, sf_dir)
    return companions.match(docs.filter("lang = 'en'"), "doc_{doc_id}", ids)["orphans"]


@query("SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM labels) AS has_file FROM documents")
def co_indicator(spark, sf_dir):
    docs, ids = _companion(spark, sf_dir)
    return companions.add_files(docs, "doc_{doc_id}", ids.withColumn("path", F.lit("x")), path=False)


# whole runs


#: What the default decisions come to on the dirty events of scale 0.01: fill by mode, flagged values missing, event_id scaled.
_CLEAN_SQL = f"""{WITH}, f AS (
  SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_samp(value) AS s, avg(event_id) AS im, stddev_samp(event_id) AS ds FROM events_dirty),
k AS (SELECT etype AS mode FROM events_dirty WHERE etype IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT event_id, user_id, event_type, ts, coalesce(etype, mode) AS etype,
  round(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) OR abs((value - m) / s) > 3 OR (value < 0 AND q1 > 0) THEN NULL ELSE value END, 6) AS value,
  round((event_id - im) / ds, 6) AS event_id_scaled
FROM events_dirty, f, k"""


def _presented(df: DataFrame) -> DataFrame:
    return rounded(df.drop(steps.ROW), *(c for c, kind in df.dtypes if kind == "double"))


@query(_CLEAN_SQL)
def pl_clean_default(spark, sf_dir):
    """The flagship: a dirty table through all stages with default decisions."""
    return _presented(pipeline.run_pipeline(spark, dirty(spark, sf_dir, "events_dirty")).df)


@query("WITH t AS (SELECT quantile_cont(l_extendedprice, 0.5) AS med, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem WHERE l_orderkey % 2 = 0) SELECT l_orderkey, l_partkey, round((l_extendedprice - med) / iqr, 6) AS l_extendedprice_scaled FROM lineitem, t WHERE l_orderkey % 2 = 1")
def pl_holdout_apply(spark, sf_dir):
    """Fitted on one half, applied to the other."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    plan = Plan()
    plan.add(features.scale_step(df.filter("l_orderkey % 2 = 0"), "l_extendedprice", "robust", "l_extendedprice_scaled"))
    return rounded(plan.apply(df.filter("l_orderkey % 2 = 1"), rows=False).drop("l_extendedprice"), "l_extendedprice_scaled")


@query(_CLEAN_SQL)
def pl_replay(spark, sf_dir):
    """A run's plan through JSON, and the clean table again from the source: the oracle's rows, and the run's."""
    source = dirty(spark, sf_dir, "events_dirty")
    state = pipeline.run_pipeline(spark, source)
    again = replay(spark, Plan.from_json(state.plan.to_json()), source)
    if not verify(state.df, again)["equal"]:
        raise AssertionError("the replayed table differs from the run's")
    return _presented(again)


@query(f"{WITH} SELECT date_trunc('hour', ts) AS start, count(*) AS rows, CAST(count(*) - count(etype) AS BIGINT) AS missing_etype FROM events_dirty GROUP BY 1")
def st_quality(spark, sf_dir):
    return quality(dirty(spark, sf_dir, "events_dirty"), "ts", ["etype"]).select("start", "rows", "missing_etype")
