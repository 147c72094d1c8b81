"""The registered analyses: name -> (Spark plan, oracle SQL or None).

Each Spark plan takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole supplied tables; the SQL computes the same columns in DuckDB.  SQL is
generated per column from the same parameters the Spark side uses."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import charts as C
from tessera.operators import profile as P
from tessera.operators import quality as Q
from tessera.operators import sampling as SM
from tessera.operators import split as SP
from tessera.operators import stats as S
from tessera.functions.columns import rnd
from tessera.plans.views import duck_sql, load
from tessera.session import checkpoint_dir
from tessera.sources.readers import read_table
from tessera.sources.writers import write_csv

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def src(name: str) -> str:
    """FROM-clause text for a table or derived view in the oracle."""
    from tessera.plans.views import VIEWS
    return f"({duck_sql(name)}) AS {name}" if name in VIEWS else name


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]
LI_NULLS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_quantity", "double"),
            ("l_discount", "double"), ("l_extendedprice", "double"), ("l_tax", "double"),
            ("l_returnflag", "string"), ("l_linestatus", "string")]

# ---------------------------------------------------------------- profile
register("profile_lineitem_nulls", union([
    f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, "
    f"count(*) - count({c}) AS nulls, round(CAST((count(*) - count({c})) AS DOUBLE) * 100 / count(*), 2) "
    f"AS null_pct, count(DISTINCT {c}) AS n_distinct FROM {src('lineitem_nulls')}"
    for i, (c, t) in enumerate(LI_NULLS)]))(
    lambda spark, d: P.profile(load(spark, d, "lineitem_nulls")))

register("sample_values_part", union([
    f"SELECT '{c}' AS \"column\", min({c}) AS sample_value FROM part"
    for c in ("p_name", "p_brand", "p_type")]))(
    lambda spark, d: P.sample_values(load(spark, d, "part"), ["p_name", "p_brand", "p_type"]))

register("dtype_counts_lineitem", """
SELECT CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
       WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS dtype,
       count(*) AS n_columns
FROM information_schema.columns WHERE table_name = 'lineitem' GROUP BY 1""")(
    lambda spark, d: P.dtype_counts(load(spark, d, "lineitem")))

register("column_bytes_orders", """
SELECT "column", bytes, round(bytes / 1024.0, 2) AS kb FROM (
  SELECT 'o_orderkey' AS "column", count(*) * 8 AS bytes FROM orders UNION ALL
  SELECT 'o_custkey', count(*) * 8 FROM orders UNION ALL
  SELECT 'o_orderstatus', coalesce(sum(strlen(o_orderstatus)), 0) FROM orders UNION ALL
  SELECT 'o_totalprice', count(*) * 8 FROM orders UNION ALL
  SELECT 'o_orderdate', count(*) * 8 FROM orders UNION ALL
  SELECT 'o_orderpriority', coalesce(sum(strlen(o_orderpriority)), 0) FROM orders)""")(
    lambda spark, d: P.column_bytes(load(spark, d, "orders")))

register("target_events",
         "SELECT 'event_type' AS target, count(DISTINCT event_type) AS n_classes FROM events")(
    lambda spark, d: P.target_summary(load(spark, d, "events")))

register("target_part",
         "SELECT 'p_type' AS target, count(DISTINCT p_type) AS n_classes FROM part")(
    lambda spark, d: P.target_summary(load(spark, d, "part")))

register("class_counts_events_nulls", f"""
SELECT event_type, count(*) AS count FROM {src('events_nulls')} WHERE event_type IS NOT NULL
GROUP BY event_type ORDER BY count DESC, event_type LIMIT 15""")(
    lambda spark, d: P.class_counts(load(spark, d, "events_nulls"), "event_type"))

register("class_values_part",
         "SELECT DISTINCT p_type FROM part ORDER BY p_type NULLS LAST LIMIT 10")(
    lambda spark, d: P.class_values(load(spark, d, "part"), "p_type"))

# ---------------------------------------------------------------- quality
_DN = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]
_miss = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in _DN)
register("quality_summary_dups_nulls", f"""
WITH g AS (SELECT {', '.join(_DN)}, count(*) AS cnt FROM {src('lineitem_dups_nulls')} GROUP BY ALL),
m AS (SELECT cnt, {_miss} AS miss FROM g)
SELECT sum(cnt) AS rows, {len(_DN)} AS cols, sum(cnt * miss) AS total_missing,
       round(CAST(sum(cnt * miss) AS DOUBLE) * 100 / (sum(cnt) * {len(_DN)}), 2) AS missing_pct,
       sum(cnt - 1) AS duplicate_rows, sum(CASE WHEN miss = 0 THEN cnt END) AS complete_rows FROM m""")(
    lambda spark, d: Q.quality_summary(load(spark, d, "lineitem_dups_nulls")))

_ON = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
       ("o_totalprice", "double"), ("o_orderpriority", "string")]
register("missing_by_column_orders_nulls", "SELECT * FROM (" + union([
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
    f"round(CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*), 2) AS missing_pct, '{t}' AS dtype "
    f"FROM {src('orders_nulls')}" for c, t in _ON]) + ") WHERE missing > 0")(
    lambda spark, d: Q.missing_by_column(load(spark, d, "orders_nulls")))

register("missing_matrix_orders_nulls", f"""
SELECT o_orderkey, CAST(o_totalprice IS NULL AS INTEGER) AS o_totalprice_missing
FROM {src('orders_nulls')} ORDER BY o_orderkey LIMIT 100""")(
    lambda spark, d: Q.missing_matrix(load(spark, d, "orders_nulls"), ["o_orderkey"], 100))

register("duplicate_count_lineitem", f"""
SELECT coalesce(sum(cnt - 1), 0) AS duplicate_rows FROM
(SELECT count(*) AS cnt FROM {src('lineitem_dups')} GROUP BY l_returnflag, l_linestatus, l_quantity)""")(
    lambda spark, d: Q.duplicate_count(load(spark, d, "lineitem_dups")))

register("duplicate_rows_lineitem", f"""
SELECT l_returnflag, l_linestatus, l_quantity FROM (
  SELECT *, count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity) AS cnt
  FROM {src('lineitem_dups')}) WHERE cnt > 1
ORDER BY l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_quantity NULLS FIRST LIMIT 30""")(
    lambda spark, d: Q.duplicate_rows(load(spark, d, "lineitem_dups"), 30))

register("drop_duplicates_lineitem",
         f"SELECT DISTINCT * FROM {src('lineitem_dups_nulls')}")(
    lambda spark, d: Q.drop_duplicates(load(spark, d, "lineitem_dups_nulls")))


def _iqr_sql(table: str, cols: list[str], k: float = 1.5) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", round(q1, 3) AS q1, round(q3, 3) AS q3,
  round(q3 - q1, 3) AS iqr, o AS outliers, round(CAST(o AS DOUBLE) / n * 100, 2) AS outlier_pct FROM (
  SELECT q1, q3, n, (SELECT count(*) FROM {src(table)} WHERE {c} < q1 - {k} * (q3 - q1)
                       OR {c} > q3 + {k} * (q3 - q1)) AS o FROM (
    SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, count({c}) AS n
    FROM {src(table)}))""")
    return union(parts)


register("iqr_outliers_lineitem", _iqr_sql("lineitem", LI_NUM))(
    lambda spark, d: Q.iqr_outliers(load(spark, d, "lineitem"), LI_NUM))

register("top_outlier_columns_events", "SELECT * FROM (" + _iqr_sql("events_cubed", ["event_id", "user_id", "value", "value3"]) +
         ") WHERE outliers > 0 ORDER BY outlier_pct DESC LIMIT 6")(
    lambda spark, d: Q.top_outlier_columns(load(spark, d, "events_cubed"), 6))

_CUST = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
         ("c_mktsegment", "string")]
register("cardinality_customer", union([
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"unique\", "
    f"round(CAST(count(DISTINCT {c}) AS DOUBLE) * 100 / count(*), 2) AS cardinality_pct, '{t}' AS dtype, "
    f"round(CAST(count(DISTINCT {c}) AS DOUBLE) * 100 / count(*), 2) > 50 AS high FROM customer"
    for c, t in _CUST]))(
    lambda spark, d: Q.cardinality(load(spark, d, "customer")))

# ---------------------------------------------------------------- statistics


def _mode_sql(table: str, c: str) -> str:
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS k FROM {src(table)} WHERE {c} IS NOT NULL "
            f"GROUP BY {c}) ORDER BY k DESC, v LIMIT 1)")


def _describe_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", CAST(count({c}) AS DOUBLE) AS count, round(avg({x}), 4) AS mean,
  round(stddev_samp({x}), 4) AS std, round(min({x}), 4) AS min, round(quantile_cont({x}, 0.25), 4) AS q1,
  round(quantile_cont({x}, 0.5), 4) AS median, round(quantile_cont({x}, 0.75), 4) AS q3,
  round(max({x}), 4) AS max, round(var_samp({x}), 4) AS variance, round(skewness({x}), 4) AS skewness,
  round(kurtosis({x}), 4) AS kurtosis, round(CAST({_mode_sql(table, c)} AS DOUBLE), 4) AS mode
  FROM {src(table)}""")
    return union(parts)


register("describe_lineitem", _describe_sql("lineitem", LI_NUM))(
    lambda spark, d: S.describe(load(spark, d, "lineitem"), LI_NUM))

register("inspect_column_lineitem_nulls", f"""
SELECT 'l_discount' AS "column", round(avg(l_discount), 4) AS mean,
  round(quantile_cont(l_discount, 0.5), 4) AS median, round(stddev_samp(l_discount), 4) AS std,
  round(var_samp(l_discount), 4) AS variance, round(skewness(l_discount), 4) AS skewness,
  round(kurtosis(l_discount), 4) AS kurtosis FROM {src('lineitem_nulls')}""")(
    lambda spark, d: S.inspect_column(load(spark, d, "lineitem_nulls"), "l_discount"))

register("skew_ranking_events", union([
    f"SELECT '{c}' AS \"column\", round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis "
    f"FROM {src('events_cubed')}" for c in ("event_id", "user_id", "value", "value3")]))(
    lambda spark, d: S.skew_ranking(load(spark, d, "events_cubed"), ["event_id", "user_id", "value", "value3"])
    .select("column", F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis")))

register("value_counts_part_brand", """
SELECT p_brand AS value, count(*) AS count FROM part WHERE p_brand IS NOT NULL
GROUP BY p_brand ORDER BY count DESC, value LIMIT 20""")(
    lambda spark, d: S.value_counts(load(spark, d, "part"), "p_brand", 20))

_GS = ["l_quantity", "l_extendedprice", "l_discount"]
register("grouped_stats_lineitem", "SELECT l_returnflag, " + ", ".join(
    f"round(avg({c}), 3) AS {c}_mean, round(stddev_samp({c}), 3) AS {c}_std, "
    f"round(quantile_cont({c}, 0.5), 3) AS {c}_median" for c in _GS) +
    " FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag")(
    lambda spark, d: S.grouped_stats(load(spark, d, "lineitem"), "l_returnflag", _GS))

register("grouped_mean_orders_month", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS o_orderdate, round(avg(o_totalprice), 4)
  AS o_totalprice_mean FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY 1""")(
    lambda spark, d: S.grouped_mean(load(spark, d, "orders"), "o_orderdate", "o_totalprice", "month", 4))

register("count_by_lineitem", """
SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem
WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2""")(
    lambda spark, d: S.count_by(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))

register("crosstab_orders", """
WITH a AS (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL),
b AS (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL),
c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT a.o_orderstatus, b.o_orderpriority, coalesce(c.n, 0) AS count FROM a CROSS JOIN b
LEFT JOIN c ON a.o_orderstatus = c.o_orderstatus AND b.o_orderpriority = c.o_orderpriority""")(
    lambda spark, d: S.crosstab(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))

_NET = ["l_quantity", "l_extendedprice", "net", "l_discount", "l_tax"]


def _corr_sql(table: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            r = (f"CASE WHEN count({a}) >= 2 AND var_pop({a}) > 0 THEN CAST(1.0 AS DOUBLE) END" if i == j
                 else f"round(corr({a}, {b}), 4)")
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {r} AS r FROM {src(table)}")
    return union(parts)


register("corr_matrix_lineitem_net", _corr_sql("lineitem_net", _NET))(
    lambda spark, d: S.corr_matrix(load(spark, d, "lineitem_net"), _NET, digits=4).select("a", "b", "r"))


def _pairs_sql(table: str, cols: list[str], digits: int, where: str = "", limit: str = "") -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i < j:
                parts.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS feature_a, '{b}' AS feature_b, "
                             f"corr({a}, {b}) AS r FROM {src(table)}")
    return (f"SELECT feature_a, feature_b, round(r, {digits}) AS correlation, round(abs(r), {digits}) AS abs_corr "
            f"FROM ({union(parts)}) WHERE r IS NOT NULL {where} ORDER BY abs(r) DESC, i, j {limit}")


register("corr_pairs_lineitem", _pairs_sql("lineitem", LI_NUM, 4, limit="LIMIT 10"))(
    lambda spark, d: S.corr_pairs(load(spark, d, "lineitem"), LI_NUM, 10))

register("strong_corr_lineitem_net", _pairs_sql("lineitem_net", _NET, 4, "AND abs(r) > 0.7", "LIMIT 15"))(
    lambda spark, d: S.corr_pairs(load(spark, d, "lineitem_net"), _NET, 15, min_abs=0.7))

register("high_corr_lineitem_net", _pairs_sql("lineitem_net", _NET, 3, "AND abs(r) > 0.8"))(
    lambda spark, d: S.high_corr(load(spark, d, "lineitem_net"), 0.8, _NET))

register("class_imbalance_events_rare", f"""
SELECT count(*) AS n_classes, max(n) AS max_count, min(n) AS min_count,
  round(CAST(max(n) AS DOUBLE) / min(n), 4) AS ratio,
  CASE WHEN CAST(max(n) AS DOUBLE) / min(n) > 5 THEN 'severe' WHEN CAST(max(n) AS DOUBLE) / min(n) > 2
  THEN 'moderate' ELSE 'balanced' END AS level
FROM (SELECT kind, count(*) AS n FROM {src('events_rare')} WHERE kind IS NOT NULL GROUP BY kind)""")(
    lambda spark, d: S.class_imbalance(load(spark, d, "events_rare"), "kind"))

register("zero_share_lineitem_discount", """
SELECT 'l_discount' AS "column", round(CAST(count_if(l_discount = 0) AS DOUBLE) * 100 / count(l_discount), 1)
  AS zero_pct, round(CAST(count_if(l_discount = 0) AS DOUBLE) * 100 / count(l_discount), 1) > 60 AS dry
FROM lineitem""")(
    lambda spark, d: S.zero_share(load(spark, d, "lineitem"), "l_discount"))

# ---------------------------------------------------------------- sampling / charts
register("sample_orders", """
SELECT * FROM orders ORDER BY md5(concat_ws('-', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey LIMIT 100""")(
    lambda spark, d: SM.sample_n(load(spark, d, "orders"), 100, ["o_orderkey"], 42))


def _hist_sql(table: str, c: str, bins: int, by: str | None = None) -> str:
    k = f", {by}" if by else ""
    return f"""WITH r AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {src(table)}),
b AS (SELECT least(CAST(floor(({c} - lo) * CAST({bins} AS DOUBLE) / (hi - lo)) AS INTEGER), {bins - 1}) AS bin{k}
      FROM {src(table)}, r WHERE {c} IS NOT NULL)
SELECT bin, round(lo + bin * ((hi - lo) / {bins}), 6) AS bin_lo, round(lo + (bin + 1) * ((hi - lo) / {bins}), 6)
  AS bin_hi{k}, n FROM (SELECT bin{k}, count(*) AS n FROM b GROUP BY ALL), r"""


register("histogram_lineitem_quantity", _hist_sql("lineitem", "l_quantity", 40))(
    lambda spark, d: C.histogram(load(spark, d, "lineitem"), "l_quantity", 40))

register("histogram_events_value_by_type", _hist_sql("events", "value", 30, "event_type"))(
    lambda spark, d: C.histogram(load(spark, d, "events"), "value", 30, "event_type"))

register("mean_marker_orders", "SELECT avg(o_totalprice) AS mean FROM orders")(
    lambda spark, d: C.mean_marker(load(spark, d, "orders"), "o_totalprice"))


def _box_sql(table: str, c: str, by: str | None, k: float = 1.5) -> str:
    kc = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    join = f"JOIN q USING ({by})" if by else ", q"
    return f"""WITH q AS (SELECT {kc}count({c}) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
  quantile_cont({c}, 0.75) AS q3 FROM {src(table)} {"WHERE " + by + " IS NOT NULL" if by else ""} {grp}),
f AS (SELECT *, q1 - {k} * (q3 - q1) AS lf, q3 + {k} * (q3 - q1) AS uf FROM q),
w AS (SELECT {kc}min(CASE WHEN {c} >= lf AND {c} <= uf THEN {c} END) AS whisker_lo,
  max(CASE WHEN {c} >= lf AND {c} <= uf THEN {c} END) AS whisker_hi,
  count_if({c} IS NOT NULL AND NOT ({c} >= lf AND {c} <= uf)) AS n_outliers
  FROM {src(table)} {join.replace('q', 'f', 1) if by else ', f'} {grp})
SELECT {kc}n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(lf, 6) AS lower_fence,
  round(uf, 6) AS upper_fence, round(whisker_lo, 6) AS whisker_lo, round(whisker_hi, 6) AS whisker_hi, n_outliers
FROM f {"JOIN w USING (" + by + ")" if by else ", w"}"""


register("box_lineitem_price_by_flag", _box_sql("lineitem", "l_extendedprice", "l_returnflag"))(
    lambda spark, d: C.box_stats(load(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"))

register("box_events_value3", _box_sql("events_cubed", "value3", None))(
    lambda spark, d: C.box_stats(load(spark, d, "events_cubed"), "value3"))

register("violin_lineitem_discount", f"""
WITH h AS ({_hist_sql('lineitem', 'l_discount', 20, 'l_linestatus')})
SELECT h.*, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY l_linestatus), 6) AS share FROM h""")(
    lambda spark, d: C.violin_stats(load(spark, d, "lineitem"), "l_discount", "l_linestatus", 20))

register("scatter_sample_orders", """
SELECT o_totalprice, o_custkey, o_orderstatus FROM orders
ORDER BY md5(concat_ws('-', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey LIMIT 500""")(
    lambda spark, d: C.scatter_sample(load(spark, d, "orders"), "o_totalprice", "o_custkey", "o_orderstatus",
                                      500, ["o_orderkey"]))

register("scatter_matrix_events", """
SELECT value, user_id, event_id, event_type FROM events
ORDER BY md5(concat_ws('-', CAST(event_id AS VARCHAR), '42')), event_id LIMIT 300""")(
    lambda spark, d: C.scatter_matrix(load(spark, d, "events"), ["value", "user_id", "event_id"], "event_type",
                                      300, ["event_id"]))

register("chart_line_customer_segment", """
SELECT c_mktsegment, avg(c_acctbal) AS c_acctbal_mean FROM customer WHERE c_mktsegment IS NOT NULL
GROUP BY 1 ORDER BY 1""")(
    lambda spark, d: C.chart_data(load(spark, d, "customer"), "line", "c_mktsegment", "c_acctbal"))

register("normalized_profile_lineitem", """
WITH p AS (SELECT l_returnflag, avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount FROM lineitem GROUP BY 1)
SELECT l_returnflag,
  round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER () + 1e-8), 4) AS l_quantity,
  round((l_discount - min(l_discount) OVER ()) / (max(l_discount) OVER () - min(l_discount) OVER () + 1e-8), 4) AS l_discount
FROM p""")(
    lambda spark, d: C.normalized_profile(
        load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("l_quantity"),
                                                               F.avg("l_discount").alias("l_discount")),
        "l_returnflag", ["l_quantity", "l_discount"]))

# ---------------------------------------------------------------- split


def _split_sql(table: str, key: str, strat: str | None, p: float, seed: int, cols: str) -> str:
    h = f"('0x' || substr(md5(concat_ws('-', CAST({key} AS VARCHAR), '{seed}')), 1, 13))::BIGINT"
    s = f"coalesce(CAST({strat} AS VARCHAR), chr(0))" if strat else "''"
    return f"""WITH b AS (SELECT *, {h} AS h, {s} AS s FROM {src(table)}),
c AS (SELECT s, count(*) AS n_c FROM b GROUP BY s),
t AS (SELECT sum(n_c) AS n, ceil(CAST({p} AS DOUBLE) * sum(n_c)) AS k FROM c),
q AS (SELECT s, n_c * k / n AS quota, floor(n_c * k / n) AS base, k FROM c, t),
r AS (SELECT s, base + CASE WHEN row_number() OVER (ORDER BY quota - base DESC, s)
        <= (SELECT max(k) - sum(base) FROM q) THEN 1 ELSE 0 END AS want FROM q)
SELECT {cols}, CASE WHEN row_number() OVER (PARTITION BY b.s ORDER BY h, {key}) <= want THEN 'test'
  ELSE 'train' END AS split FROM b JOIN r ON b.s = r.s"""


register("split_orders_stratified", _split_sql("orders", "o_orderkey", "o_orderpriority", 0.2, 42,
                                               "o_orderkey, o_orderpriority"))(
    lambda spark, d: SP.train_test_split(load(spark, d, "orders").select("o_orderkey", "o_orderpriority"),
                                         0.2, 42, key=["o_orderkey"], stratify="o_orderpriority"))

register("split_events_plain", _split_sql("events", "event_id", None, 0.25, 7, "event_id, event_type"))(
    lambda spark, d: SP.train_test_split(load(spark, d, "events").select("event_id", "event_type"),
                                         0.25, 7, key=["event_id"]))

register("split_summary_customer", f"""
SELECT split, count(*) AS rows, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM customer), 4) AS ratio
FROM ({_split_sql('customer', 'c_custkey', None, 0.3, 42, 'c_custkey')}) GROUP BY split""")(
    lambda spark, d: SP.split_summary(SP.train_test_split(load(spark, d, "customer").select("c_custkey"),
                                                          0.3, 42, key=["c_custkey"])))


def queries() -> dict:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


# ---------------------------------------------------------------- preprocessing
from tessera.operators import metrics as M  # noqa: E402
from tessera.operators import preprocess as R  # noqa: E402

_LN = ["l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_extendedprice", "l_tax", "l_returnflag",
       "l_linestatus"]


def _fill_sql(table: str, c: str, value_sql: str, cols: list[str]) -> str:
    sel = ", ".join(f"coalesce({x}, ({value_sql})) AS {x}" if x == c else x for x in cols)
    return f"SELECT {sel} FROM {src(table)}"


register("impute_mean_lineitem_nulls",
         _fill_sql("lineitem_nulls", "l_discount", f"SELECT avg(l_discount) FROM {src('lineitem_nulls')}", _LN))(
    lambda spark, d: R.impute(load(spark, d, "lineitem_nulls"), ["l_discount"], "mean"))

_ONC = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
register("impute_median_orders_nulls",
         _fill_sql("orders_nulls", "o_totalprice",
                   f"SELECT quantile_cont(o_totalprice, 0.5) FROM {src('orders_nulls')}", _ONC))(
    lambda spark, d: R.impute(load(spark, d, "orders_nulls"), ["o_totalprice"], "median"))

register("impute_mode_events_nulls",
         _fill_sql("events_nulls", "event_type", _mode_sql("events_nulls", "event_type"),
                   ["event_id", "user_id", "value", "event_type"]))(
    lambda spark, d: R.impute(load(spark, d, "events_nulls"), ["event_type"], "most_frequent"))

register("impute_constant_events_nulls",
         _fill_sql("events_nulls", "event_type", "SELECT 'missing'", ["event_id", "user_id", "value", "event_type"]))(
    lambda spark, d: R.impute(load(spark, d, "events_nulls"), ["event_type"], "constant"))

register("standard_scale_lineitem", "SELECT " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 "
    f"ELSE stddev_pop({c}) END FROM lineitem), 6) AS {c}" for c in ["l_quantity", "l_extendedprice", "l_discount"]) +
    ", l_returnflag FROM lineitem")(
    lambda spark, d: (lambda df: df.select(*[rnd(F.col(c), 6).alias(c) for c in
                                             ["l_quantity", "l_extendedprice", "l_discount"]], "l_returnflag"))(
        R.standard_scale(load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount",
                                                           "l_returnflag"))))

register("one_hot_orders", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS o_orderstatus_F,
  CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END AS o_orderstatus_O,
  CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END AS o_orderstatus_P FROM orders""")(
    lambda spark, d: R.one_hot(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"]))

register("drop_constant_lineitem_net",
         f"SELECT l_quantity, l_extendedprice, net, l_discount, l_tax FROM {src('lineitem_net')}")(
    lambda spark, d: R.drop_constant(load(spark, d, "lineitem_net")))

_FC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _fclassif_sql(table: str, feats: list[str], target: str) -> str:
    parts = []
    for c in feats:
        parts.append(f"""SELECT '{c}' AS feature, round(((sxx - n * (sx / n) * (sx / n)) / (k - 1)) / (ssw / (n - k)), 3)
  AS score FROM (SELECT sum(nc) AS n, sum(nc * mc) AS sx, sum(nc * mc * mc) AS sxx, sum(w) AS ssw,
  count_if(nc > 0) AS k FROM (SELECT count({c}) AS nc, avg({c}) AS mc, var_pop({c}) * count({c}) AS w
  FROM {src(table)} WHERE {target} IS NOT NULL GROUP BY {target}))""")
    return union(parts)


register("f_classif_lineitem", _fclassif_sql("lineitem", _FC, "l_returnflag"))(
    lambda spark, d: R.f_classif(load(spark, d, "lineitem"), _FC, "l_returnflag").drop("__pos"))

register("f_regression_lineitem", union([
    f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice) * corr({c}, l_extendedprice) / "
    f"(1 - corr({c}, l_extendedprice) * corr({c}, l_extendedprice)) * "
    f"(count_if({c} IS NOT NULL AND l_extendedprice IS NOT NULL) - 2), 3) AS score FROM lineitem"
    for c in ["l_quantity", "l_discount", "l_tax"]]))(
    lambda spark, d: R.feature_scores(load(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"],
                                      "l_extendedprice").drop("__pos"))

# a feature that separates the classes perfectly scores infinity and comes first; close scores keep their order
register("select_k_best_perfect", """
SELECT 'code' AS feature, 'Infinity'::DOUBLE AS score""")(
    lambda spark, d: R.select_k_best(load(spark, d, "lineitem").selectExpr(
        "l_returnflag", "cast(ascii(l_returnflag) as double) AS code", "l_quantity"), ["l_quantity", "code"], "l_returnflag", 1)[1])

register("split_orders_unshuffled", """
WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS d FROM orders),
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY d DESC NULLS LAST, o_orderkey DESC) AS i, count(*) OVER () AS n FROM b)
SELECT o_orderkey, CASE WHEN i <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM r""")(
    lambda spark, d: SP.train_test_split(load(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS d"), 0.2, key=["o_orderkey"],
        shuffle=False, order_by="d").select("o_orderkey", "split"))

register("split_events_by_text", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_type DESC, event_id DESC) AS i, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN i <= ceil(0.3::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM r""")(
    lambda spark, d: SP.train_test_split(load(spark, d, "events").select("event_id", "event_type"), 0.3, key=["event_id"],
                                         shuffle=False, order_by="event_type").select("event_id", "split"))

register("grouped_stats_by_orderkey", """
SELECT l_orderkey, round(avg(l_quantity), 3) AS l_quantity_mean, round(stddev_samp(l_quantity), 3) AS l_quantity_std,
       round(quantile_cont(l_quantity, 0.5), 3) AS l_quantity_median FROM lineitem GROUP BY 1""")(
    lambda spark, d: S.grouped_stats(load(spark, d, "lineitem"), "l_orderkey", ["l_quantity"]))

register("scatter_bins_lineitem", """
WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS e FROM lineitem),
g AS (SELECT least(floor((l_quantity - a) / ((b - a) / 40)), 39)::INT AS x_bin,
             least(floor((l_extendedprice - c) / ((e - c) / 40)), 39)::INT AS y_bin, l_returnflag, a, b, c, e FROM lineitem, r)
SELECT x_bin, y_bin, a + x_bin * ((b - a) / 40) AS x_lo, c + y_bin * ((e - c) / 40) AS y_lo, l_returnflag, count(*) AS n FROM g GROUP BY ALL""")(
    lambda spark, d: C.chart_data(load(spark, d, "lineitem"), "Scatter", "l_quantity", "l_extendedprice", "l_returnflag"))

register("violin_outliers_events_cubed", """
WITH q AS (SELECT event_type, quantile_cont(value3, 0.25) AS q1, quantile_cont(value3, 0.75) AS q3
           FROM {t} WHERE event_type IS NOT NULL GROUP BY 1)
SELECT event_type, round(value3, 3) AS value, count(*) AS n FROM {t} JOIN q USING (event_type)
WHERE value3 < q1 - 1.5 * (q3 - q1) OR value3 > q3 + 1.5 * (q3 - q1) GROUP BY ALL""".replace("{t}", src("events_cubed")))(
    lambda spark, d: C.violin_outliers(load(spark, d, "events_cubed"), "value3", "event_type")
    .select("event_type", F.round("value", 3).alias("value"), "n"))

register("select_k_best_lineitem", "SELECT * FROM (" + _fclassif_sql("lineitem", _FC, "l_returnflag") +
         ") ORDER BY score DESC LIMIT 2")(
    lambda spark, d: R.select_k_best(load(spark, d, "lineitem"), _FC, "l_returnflag", 2)[1])

_SCALED = [("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey"), ("o_totalprice", "coalesce(o_totalprice, avg(o_totalprice) OVER ())")]
register("preprocess_orders_nulls", f"""
WITH i AS (SELECT o_orderstatus, o_orderpriority, {', '.join(f'({x})::DOUBLE AS {c}' for c, x in _SCALED)} FROM {src("orders_nulls")})
SELECT {', '.join(f'round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}' for c, _ in _SCALED)},
  {', '.join(f"CASE WHEN o_orderstatus = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS o_orderstatus_{v}" for v in "FOP")}, o_orderpriority FROM i""")(
    lambda spark, d: R.preprocess(load(spark, d, "orders_nulls"), target="o_orderpriority").select(
        *[F.round(c, 6).alias(c) for c, _ in _SCALED], *[F.col(f"o_orderstatus_{v}") for v in "FOP"], "o_orderpriority"))
register("preprocess_customer_nation", None)(
    lambda spark, d: R.preprocess(load(spark, d, "customer_nation"), target="r_name", feat_select=True, k_best=6))

# ---------------------------------------------------------------- evaluation
_CNT = f"(SELECT actual, predicted, count(*) AS n FROM {src('orders_rule')} GROUP BY 1, 2)"
_PC = f"""(WITH c AS {_CNT},
cls AS (SELECT actual AS cls FROM c UNION SELECT predicted FROM c),
pc AS (SELECT cls, coalesce((SELECT sum(n) FROM c WHERE actual = cls AND predicted = cls), 0) AS tp,
  coalesce((SELECT sum(n) FROM c WHERE actual = cls), 0) AS support,
  coalesce((SELECT sum(n) FROM c WHERE predicted = cls), 0) AS pred FROM cls)
SELECT cls, tp, support, CASE WHEN pred = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / pred END AS p,
  CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS r FROM pc)"""
_PCF = f"(SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM {_PC})"

register("confusion_orders_rule", f"""
WITH c AS {_CNT}, cls AS (SELECT actual AS cls FROM c UNION SELECT predicted FROM c)
SELECT a.cls AS actual, b.cls AS predicted, coalesce(c.n, 0) AS n FROM cls a CROSS JOIN cls b
LEFT JOIN c ON c.actual = a.cls AND c.predicted = b.cls""")(
    lambda spark, d: M.confusion(load(spark, d, "orders_rule"), "actual", "predicted"))

register("class_report_orders_rule", f"""
SELECT cls AS class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1_score, support FROM {_PCF}
UNION ALL SELECT 'accuracy', round(CAST(sum(tp) AS DOUBLE) / sum(support), 4),
  round(CAST(sum(tp) AS DOUBLE) / sum(support), 4), round(CAST(sum(tp) AS DOUBLE) / sum(support), 4), sum(support)
  FROM {_PCF}
UNION ALL SELECT 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), sum(support) FROM {_PCF}
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 4), round(sum(r * support) / sum(support), 4),
  round(sum(f * support) / sum(support), 4), sum(support) FROM {_PCF}""")(
    lambda spark, d: M.class_report(load(spark, d, "orders_rule"), "actual", "predicted"))

register("metrics_orders_rule", f"""
SELECT round(CAST(sum(tp) AS DOUBLE) / sum(support), 4) AS accuracy, round(avg(p), 4) AS precision_macro,
  round(avg(r), 4) AS recall_macro, round(avg(f), 4) AS f1_macro FROM {_PCF}""")(
    lambda spark, d: M.metrics(load(spark, d, "orders_rule"), "actual", "predicted"))

register("accuracy_by_split_orders_rule", f"""
SELECT split, round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM
({_split_sql('orders_rule', 'o_orderkey', 'actual', 0.2, 42, 'o_orderkey, actual, predicted')}) GROUP BY split""")(
    lambda spark, d: M.accuracy_by_split(SP.train_test_split(load(spark, d, "orders_rule"), 0.2, 42,
                                                             key=["o_orderkey"], stratify="actual"),
                                         "actual", "predicted"))


# ---------------------------------------------------------------- matrix analyses (no SQL oracle:
# eigen-decompositions and iterative fits; checked against numpy in tests/)
from tessera.operators import cluster as K  # noqa: E402
from tessera.operators import discriminant as D  # noqa: E402
from tessera.operators import factor as FA  # noqa: E402
from tessera.operators import insights as I  # noqa: E402
from tessera.operators import kernel as KE  # noqa: E402
from tessera.operators import models as MO  # noqa: E402
from tessera.operators import normality as N  # noqa: E402
from tessera.operators import reduce as RD  # noqa: E402
from tessera.operators import wide_onehot as W  # noqa: E402
from tessera.operators import wide_pca as WP  # noqa: E402

_PCA = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"]


def embedding_table(spark, d, dims: int = 64):
    """embeddings with the vector spread into columns e0..e63 (+ label)."""
    e = load(spark, d, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)],
                    F.col("label").cast("string").alias("label"))


def _normality_sql(table: str, cols: list[str]) -> str:
    """Jarque-Bera from central moments."""
    return union([f"""SELECT '{c}' AS "column", n, round(jb, 4) AS jb, round(exp(-jb / 2), 6) AS p_value, coalesce(exp(-jb / 2) > 0.05, false) AS normal
FROM (SELECT n, n / 6.0 * (m3 * m3 / (m2 * m2 * m2) + (m4 / (m2 * m2) - 3) * (m4 / (m2 * m2) - 3) / 4) AS jb
  FROM (SELECT count(x) AS n, avg((x - m) * (x - m)) AS m2, avg((x - m) ** 3) AS m3, avg((x - m) ** 4) AS m4
    FROM (SELECT {c}::DOUBLE AS x, avg({c}::DOUBLE) OVER () AS m FROM {src(table)})))""" for c in cols])


register("normality_lineitem", _normality_sql("lineitem", LI_NUM))(lambda spark, d: N.normality(load(spark, d, "lineitem"), LI_NUM))
register("normality_events_cubed", _normality_sql("events_cubed", ["value", "value3"]))(
    lambda spark, d: N.normality(load(spark, d, "events_cubed"), ["value", "value3"]))
register("scree_lineitem", None)(lambda spark, d: RD.scree(load(spark, d, "lineitem"), _PCA))
register("pca_variance_lineitem", None)(lambda spark, d: RD.pca_variance(load(spark, d, "lineitem"), _PCA, 5))


def _corr_wide(spark, d):
    """All pairs of 64 columns with missing values: beyond the pairs of one plain aggregate."""
    t = embedding_table(spark, d)
    gaps = t.select(*[F.when(F.col("vec_id") % (i + 5) != 0, F.col(f"e{i}")).alias(f"e{i}") for i in range(64)])
    return S.corr_matrix(gaps, digits=4).where("i < j").select("i", "j", "r")


register("corr_wide_embeddings", """
WITH t AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
g AS (SELECT vec_id, i, v FROM t WHERE vec_id % (i + 5) <> 0)
SELECT a.i::INT AS i, b.i::INT AS j, round(corr(a.v, b.v), 4) + 0.0 AS r FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i""")(_corr_wide)


register("compare_models_boosting_customer", None)(
    lambda spark, d: MO.compare_models(load(spark, d, "customer"), "c_mktsegment", ["c_nationkey", "c_acctbal"], ["gradient_boosting"], key=["c_custkey"])[0])


def _score_sql(p: str) -> str:
    """The normal distribution's inverse at p, as in the operator."""
    def ratio(of, x):
        num, den = (functools.reduce(lambda acc, c: f"({acc} * {x} + {c!r}::DOUBLE)", [f"{part[-1]!r}::DOUBLE", *part[-2::-1]]) for part in of)
        return f"{num} / {den}"
    q, r = f"({p} - 0.5::DOUBLE)", f"sqrt(-ln(least({p}, 1 - {p})))"
    return (f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(N._CENTRE, f'(0.180625::DOUBLE - {q} * {q})')} WHEN {r} <= 5 THEN "
            f"sign({q}) * {ratio(N._MIDDLE, f'({r} - 1.6::DOUBLE)')} ELSE sign({q}) * {ratio(N._TAIL, f'({r} - 5)')} END")


def _francia_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        p = "((i - 0.375::DOUBLE) / (n + 0.25::DOUBLE))"
        parts.append(f"""SELECT '{c}' AS column, n, round(w, 6) AS w, round((ln(1 - w) - (1.0521::DOUBLE * (ln(ln(n)) - ln(n)) - 1.2725::DOUBLE))
 / (1.0308::DOUBLE - 0.26758::DOUBLE * (ln(ln(n)) + 2 / ln(n))), 4) AS z FROM (
SELECT count(*) AS n, pow(sum((x - mean) * m), 2) / (sum((x - mean) * (x - mean)) * sum(m * m)) AS w FROM (
SELECT x, mean, {_score_sql(p)} AS m FROM (SELECT {c}::DOUBLE AS x, row_number() OVER (ORDER BY {c}) AS i, count(*) OVER () AS n, avg({c}) OVER () AS mean
FROM {src(table)} WHERE {c} IS NOT NULL)))""")
    return union(parts)


register("normality_ranks_events", _francia_sql("events_cubed", ["value", "value3"]))(
    lambda spark, d: N.shapiro_francia(load(spark, d, "events_cubed"), ["value", "value3"]).select("column", "n", "w", "z"))
register("normality_ranks_orders", _francia_sql("orders", ["o_totalprice", "o_custkey"]))(
    lambda spark, d: N.shapiro_francia(load(spark, d, "orders"), ["o_totalprice", "o_custkey"]).select("column", "n", "w", "z"))


def _pca_rebuilt(spark, d):
    """The correlation matrix from all components: sum over k of eigenvalue * loading_a * loading_b."""
    t = load(spark, d, "lineitem")
    n = t.count()
    m = RD.fit_pca(t, _PCA, len(_PCA), True)
    v, e = m.components, m.explained_variance * (n - 1) / n
    return spark.createDataFrame([(a, b, round(float(sum(e[k] * v[i, k] * v[j, k] for k in range(len(e)))), 6))
                                  for i, a in enumerate(_PCA) for j, b in enumerate(_PCA) if i <= j], "a string, b string, r double")


register("pca_rebuilt_correlations", union([
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem"
    for i, a in enumerate(_PCA) for j, b in enumerate(_PCA) if i <= j]))(_pca_rebuilt)
register("pca_loadings_lineitem", None)(lambda spark, d: RD.pca_loadings(load(spark, d, "lineitem"), _PCA, 5))
register("pca_scores_embeddings", None)(
    lambda spark, d: RD.pca_scores(embedding_table(spark, d), [f"e{i}" for i in range(64)], 10, True, "label"))
register("lda_variance_embeddings", None)(
    lambda spark, d: D.lda_analysis(embedding_table(spark, d), "label", [f"e{i}" for i in range(64)],
                                    key=["vec_id"])["variance"])
register("lda_report_embeddings", None)(
    lambda spark, d: D.lda_analysis(embedding_table(spark, d), "label", [f"e{i}" for i in range(64)],
                                    key=["vec_id"])["report"])
register("fa_loadings_lineitem", None)(
    lambda spark, d: FA.fa_tables(load(spark, d, "lineitem"), _PCA, 3, "varimax")["loadings"])
register("fa_communalities_lineitem", None)(
    lambda spark, d: FA.fa_tables(load(spark, d, "lineitem"), _PCA, 3, "quartimax")["communalities"])
register("fa_variance_embeddings", None)(
    lambda spark, d: FA.fa_tables(embedding_table(spark, d), [f"e{i}" for i in range(64)], 4, None)["variance"])


def _spread(df):
    """Deal the rows of a file with fewer splits than there are cores out for iterative fits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _kmeans_sizes(spark, d):
    t = _spread(embedding_table(spark, d))
    feats = [f"e{i}" for i in range(64)]
    res = K.fit_kmeans(t, feats, 10)
    return K.cluster_sizes(res.assign(t))


def _kmeans_vs_label(spark, d):
    t = _spread(embedding_table(spark, d))
    feats = [f"e{i}" for i in range(64)]
    res = K.fit_kmeans(t, feats, 10)
    return S.crosstab(res.assign(t), "KMeans_Cluster", "label")


def _kmeans_profile(spark, d):
    t = _spread(load(spark, d, "lineitem"))
    res = K.fit_kmeans(t, _PCA, 4)
    prof = K.cluster_profile(res.assign(t), _PCA)
    return C.normalized_profile(prof, "KMeans_Cluster", _PCA)


register("kmeans_sizes_embeddings", None)(_kmeans_sizes)
register("kmeans_vs_label_embeddings", None)(_kmeans_vs_label)
register("kmeans_profile_lineitem", None)(_kmeans_profile)
register("kmeans_scan_lineitem", None)(
    lambda spark, d: K.kmeans_scan(_spread(load(spark, d, "lineitem")), _PCA))


def _kmeans_metrics(spark, d):
    t = _spread(load(spark, d, "lineitem"))
    res = K.fit_kmeans(t, _PCA, 4)
    return K.cluster_metrics(res.assign(t, []), res)


def _clustered_dataset(spark, d):
    t = load(spark, d, "customer")
    res = K.fit_kmeans(t, ["c_nationkey", "c_acctbal"], 3)
    return res.assign(t).select(*t.columns, "KMeans_Cluster")


register("kmeans_metrics_lineitem", None)(_kmeans_metrics)


def _kmeans_check(spark, d):
    """Each row has the nearest centre, each centre is its members' mean (as far as the fit's tolerance), sizes add up."""
    t = _spread(load(spark, d, "lineitem").select(*_PCA))
    res = K.fit_kmeans(t, _PCA, 4)
    a = res.assign(t, []).persist()
    z = [f"__z{i}" for i in range(len(_PCA))]
    means = {r["cluster"]: r for r in a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in z]).collect()}
    far = max(abs(means[k][c] - float(res.centers[k][i])) for k in means for i, c in enumerate(z))
    dist = [F.round(sum(((F.col(c) - F.lit(float(res.centers[k][i]))) ** 2 for i, c in enumerate(z)), F.lit(0.0)), 9) for k in range(len(res.centers))]
    own = F.element_at(F.array(*dist), F.col("cluster") + 1)
    wrong = a.where(own > F.least(*dist)).count()
    order = [means[k]["n"] for k in sorted(means)]
    a.unpersist()
    return spark.createDataFrame([(sum(order), len(means), wrong, far < 0.01, order == sorted(order, reverse=True))],
                                 "rows long, clusters long, not_nearest long, centres_are_means boolean, largest_first boolean")


register("kmeans_check_lineitem", """
SELECT count(*) AS rows, 4 AS clusters, 0 AS not_nearest, true AS centres_are_means, true AS largest_first FROM lineitem""")(_kmeans_check)


#: Starting centres of the checked fit, in standardised space.
_START = [[-1.0, -1.0, 0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 1.0, -1.0, 0.0, 0.0], [1.0, 1.0, 0.0, 1.0, 0.0, 1.0]]


def _kmeans_fixed_start(spark, d):
    """Four iterations from given centres: sizes, cost and centres."""
    res = K.fit_kmeans(load(spark, d, "lineitem"), _PCA, 3, max_iter=4, init=np.array(_START))
    return spark.createDataFrame([(j, int(res.sizes[j]), round(res.cost, 3), *(round(float(x), 5) + 0.0 for x in c)) for j, c in enumerate(res.centers)],
                                 "cluster int, n long, cost double, " + ", ".join(f"z{i} double" for i in range(len(_PCA))))


def _kmeans_sql() -> str:
    zs = [f"z{i}" for i in range(len(_PCA))]
    dist = " + ".join(f"(r.{z} - c.{z}) * (r.{z} - c.{z})" for z in zs)
    ctes = ["r AS (SELECT row_number() OVER () AS id, " + ", ".join(
        f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{i}" for i, c in enumerate(_PCA)) + " FROM lineitem)",
        "c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, {', '.join(f'{x}::DOUBLE' for x in c)})" for j, c in enumerate(_START)) + f") t(j, {', '.join(zs)}))"]
    for step in range(5):
        ctes.append(f"a{step} AS (SELECT id, min_by(j, d) AS j, min(d) AS d FROM (SELECT r.id, c.j, {dist} AS d FROM r, c{step} c) GROUP BY id)")
        if step < 4:
            ctes.append(f"c{step + 1} AS (SELECT j, " + ", ".join(f"avg({z}) AS {z}" for z in zs) + f" FROM r JOIN a{step} USING (id) GROUP BY j)")
    return ("WITH " + ", ".join(ctes) + ", n AS (SELECT j, count(*) AS n FROM a4 GROUP BY j) SELECT (row_number() OVER (ORDER BY n DESC, "
            + ", ".join(zs) + "))::INT - 1 AS cluster, n, round((SELECT sum(d) FROM a4), 3) AS cost, " + ", ".join(f"round({z}, 5) + 0.0 AS {z}" for z in zs)
            + " FROM n JOIN c4 USING (j)")


register("kmeans_fixed_start_lineitem", _kmeans_sql())(_kmeans_fixed_start)


def _lda_check(spark, d):
    """Scatter of the discriminant scores within classes, over all train rows: the identity; and n - classes as its weight."""
    got = D.lda_analysis(embedding_table(spark, d), "label", [f"e{i}" for i in range(64)], key=["vec_id"])["scores"].where("split = 'train'")
    axes = [c for c in got.columns if c.startswith("LD")][:3]
    n, k = got.count(), got.select("label").distinct().count()
    centred = got.join(got.groupBy("label").agg(*[F.avg(c).alias(f"m{c}") for c in axes]), "label")
    aggs = [(F.sum((F.col(a) - F.col(f"m{a}")) * (F.col(b) - F.col(f"m{b}"))) / (n - k)).alias(f"{a}_{b}") for a in axes for b in axes]
    row = centred.agg(*aggs).first()
    return spark.createDataFrame([(a, b, abs(round(row[f"{a}_{b}"], 5))) for a in axes for b in axes], "a string, b string, within double")


register("lda_check_embeddings", """
SELECT 'LD' || a AS a, 'LD' || b AS b, CASE WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE AS within
FROM range(1, 4) x(a), range(1, 4) y(b) WHERE (SELECT count(DISTINCT label) FROM embeddings) > 3""")(_lda_check)


def _fa_check(spark, d):
    """Communality plus uniqueness is a standardised variable's variance."""
    m = FA.fit_fa(load(spark, d, "lineitem"), _PCA, 3, "varimax")
    return spark.createDataFrame([(f, round(float((m.loadings[i] ** 2).sum() + m.psi[i]), 2)) for i, f in enumerate(_PCA)],
                                 "variable string, variance double")


register("fa_check_lineitem", union([
    f"SELECT '{c}' AS variable, round(var_pop(z), 2) AS variance FROM (SELECT ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z FROM lineitem)"
    for c in _PCA]))(_fa_check)
register("clustered_dataset_customer", None)(_clustered_dataset)
register("compare_models_embeddings", None)(
    lambda spark, d: MO.compare_models(embedding_table(spark, d), "label", [f"e{i}" for i in range(64)],
                                       ["logistic", "random_forest"], key=["vec_id"])[0])


#: The findings as the oracle has them, written out apart from the library's rules:
#: section, code, measure, mode, threshold on |value|, upper end, most rows.
_FINDINGS = [
    ("observations", "size", "rows", "first", -1, None, 1),
    ("warnings", "missing", "null_pct", "some", 0, None, 1),
    ("warnings", "missing_high", "null_pct", "some", 30, None, 1),
    ("recommendations", "missing_drop", "null_pct_worst", "first", 30, None, 1),
    ("recommendations", "missing_median", "null_pct_worst", "first", 0, 30, 1),
    ("observations", "missing_none", "null_pct", "none", 0, None, 1),
    ("warnings", "duplicates", "duplicate_rows", "first", 0, None, 1),
    ("observations", "duplicates_none", "duplicate_rows", "none", 0, None, 1),
    ("observations", "target", "classes", "first", 0, None, 1),
    ("warnings", "imbalance_severe", "class_ratio", "first", 5, None, 1),
    ("warnings", "imbalance_moderate", "class_ratio", "first", 2, 5, 1),
    ("observations", "balanced", "class_ratio", "first", 0, 2, 1),
    ("warnings", "high_corr", "abs_r", "some", 0.8, None, 1),
    ("warnings", "high_corr_pair", "abs_r", "each", 0.8, None, 5),
    ("recommendations", "merge_corr", "abs_r", "first", 0.8, None, 1),
    ("warnings", "outliers", "outlier_pct", "some", 5, None, 1),
    ("recommendations", "robust", "outlier_pct", "first", 5, None, 1),
    ("observations", "outliers_ok", "outlier_pct", "none", 5, None, 1),
    ("observations", "skewed", "skewness", "some", 1, None, 1),
    ("recommendations", "transform", "skewness", "first", 1, None, 1),
    ("recommendations", "dimensionality", "columns", "first", 30, None, 1),
    ("recommendations", "models", "classes", "first", 0, None, 1),
    ("recommendations", "analyses", "classes", "first", 0, None, 1),
]


def _insight_sql(table: str, nums: list[str], others: list[str], target: str) -> str:
    """Measures as rows (m, pos, v); each rule as a SELECT over them."""
    t, cols = src(table), [*nums, *others]
    quart = lambda c: (f"(SELECT quantile_cont({c}, 0.25) FROM {t})", f"(SELECT quantile_cont({c}, 0.75) FROM {t})")
    facts = [f"SELECT 'rows' AS m, 0 AS pos, count(*)::DOUBLE AS v FROM {t}", f"SELECT 'columns', 0, {len(cols)}",
             f"SELECT 'duplicate_rows', 0, sum(n - 1) FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(cols)})",
             f"SELECT 'classes', 0, count(DISTINCT {target}) FROM {t}",
             f"SELECT 'class_ratio', 0, max(n) / min(n) FROM (SELECT count(*) AS n FROM {t} WHERE {target} IS NOT NULL GROUP BY {target})"]
    facts += [f"SELECT 'null_pct', {i}, 100.0 * (count(*) - count({c})) / count(*) FROM {t}" for i, c in enumerate(cols)]
    facts += [f"SELECT 'abs_r', 0, corr({a}, {b}) FROM {t}" for i, a in enumerate(nums) for b in nums[i + 1:]]
    for i, c in enumerate(nums):
        lo, hi = quart(c)
        facts += [f"SELECT 'outlier_pct', {i}, 100.0 * count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c}) "
                  f"FROM (SELECT *, {lo} AS q1, {hi} AS q3 FROM {t})", f"SELECT 'skewness', {i}, skewness({c}) FROM {t}"]
    rules = []
    for n, (section, code, measure, mode, above, upto, most) in enumerate(_FINDINGS):
        m = "null_pct" if measure == "null_pct_worst" else measure
        order = "abs(v) DESC" if measure in ("null_pct_worst", "abs_r") else "pos"
        hits = f"FROM f WHERE m = '{m}' AND abs(v) > {above}" + ("" if upto is None else f" AND abs(v) <= {upto}")
        if measure == "null_pct_worst" and upto:  # the worst column itself must be in range
            hits += f" AND v = (SELECT max(v) FROM f WHERE m = '{m}')"
        head = f"SELECT '{section}' AS section, {n} AS n, '{code}' AS code"
        if mode == "some":
            rules.append(f"{head}, 0 AS i, count(*)::DOUBLE AS value {hits} HAVING count(*) > 0")
        elif mode == "none":
            rules.append(f"{head}, 0 AS i, NULL::DOUBLE AS value WHERE NOT EXISTS (SELECT 1 {hits})")
        else:
            rules.append(f"SELECT * FROM ({head}, row_number() OVER (ORDER BY {order}) AS i, v AS value {hits}) WHERE i <= {most}")
    return (f"WITH f AS ({union(facts)}), r AS ({union(rules)})\nSELECT section, row_number() OVER (PARTITION BY section ORDER BY n, i) AS rank, "
            "code, round(value, 4) AS value FROM r")


register("insight_codes_events", _insight_sql("events_cubed", ["event_id", "user_id", "value", "value3"], ["event_type"], "event_type"))(
    lambda spark, d: I.insights(load(spark, d, "events_cubed")).select("section", "rank", "code", "value"))
register("insight_codes_lineitem_nulls", _insight_sql(
    "lineitem_nulls", [c for c, t in LI_NULLS if t != "string"], ["l_returnflag", "l_linestatus"], "l_returnflag"))(
    lambda spark, d: I.insights(load(spark, d, "lineitem_nulls"), "l_returnflag").select("section", "rank", "code", "value"))
register("insights_events", None)(lambda spark, d: I.insights(load(spark, d, "events_cubed")))
register("insights_text_lineitem_nulls", None)(
    lambda spark, d: I.insights_text(I.insights(load(spark, d, "lineitem_nulls"), "l_returnflag")))


def _pca_classifier(spark, d):
    t = embedding_table(spark, d)
    feats = [f"e{i}" for i in range(64)]
    m = RD.fit_pca(t, feats, 8, True, "label")
    sc = m.transform(t, ["vec_id", "label"], 8)
    return MO.classify_components(sc, [f"PC{j + 1}" for j in range(8)], "label", "logistic", key=["vec_id"])["report"]


def _fa_classifier(spark, d):
    t = load(spark, d, "lineitem")
    m = FA.fit_fa(t, _PCA, 3, "varimax")
    sc = m.transform(t, ["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return MO.classify_components(sc, [f"Factor_{j + 1}" for j in range(3)], "l_returnflag", "logistic",
                                  key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])["accuracy"]


def _cluster_projection(spark, d):
    t = _spread(load(spark, d, "lineitem"))
    res = K.fit_kmeans(t, _PCA, 4)
    return K.cluster_projection(res.assign(t), res)


register("pca_classifier_embeddings", None)(_pca_classifier)
register("fa_classifier_lineitem", None)(_fa_classifier)
register("kmeans_projection_lineitem", None)(_cluster_projection)
register("stratify_guard_orders", """
SELECT min(n) >= 2 AS can_stratify FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")(
    lambda spark, d: SP.stratify_check(load(spark, d, "orders"), "o_orderpriority"))

# exact k-nearest-neighbour classifier (no SQL oracle: checked against a brute force in tests/)
register("compare_models_knn_embeddings", None)(
    lambda spark, d: MO.compare_models(embedding_table(spark, d), "label", [f"e{i}" for i in range(64)],
                                       ["knn"], key=["vec_id"])[0])
register("compare_models_knn_lineitem", None)(
    lambda spark, d: MO.compare_models(load(spark, d, "lineitem"), "l_returnflag",
                                       ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["knn"],
                                       key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])[0])


def _knn_embeddings_sql(k: int = 5, dims: int = 64) -> str:
    """Brute-force oracle for the kNN comparison on embeddings: mean
    imputation, population-std scaling over rows with a target, the exact
    stratified split, all-pairs distances (affordable only on this small
    table), k nearest by (distance, label), vote (smallest label on ties)."""
    e = [f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(dims)]
    imp = ", ".join(f"coalesce({x}, (SELECT avg({x}) FROM embeddings)) - (SELECT avg({x}) FROM embeddings) AS i{i}"
                    for i, x in enumerate(e))
    z = ", ".join(f"(i{i} - avg(i{i}) OVER ()) / coalesce(nullif(stddev_pop(i{i}) OVER (), 0), 1)" for i in range(dims))
    split = _split_sql("zt", "vec_id", "target", 0.2, 42, "vec_id, target, v")
    return f"""WITH it AS (SELECT vec_id, CAST(label AS VARCHAR) AS target, {imp} FROM embeddings),
zt AS (SELECT vec_id, target, list_value({z}) AS v FROM it WHERE target IS NOT NULL),
pts AS ({split}),
tr AS (SELECT target AS tl, v AS tv FROM pts WHERE split = 'train'),
qs AS (SELECT DISTINCT v FROM pts),
pr AS (SELECT qs.v, tr.tl, list_distance(qs.v, tr.tv) AS dist FROM qs CROSS JOIN tr),
top AS (SELECT v, tl FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY dist, tl) AS rn FROM pr)
        WHERE rn <= {k}),
vote AS (SELECT v, tl, count(*) AS c FROM top GROUP BY v, tl),
pred AS (SELECT v, tl AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY c DESC, tl) AS rn
         FROM vote) WHERE rn = 1),
scored AS (SELECT pts.split, pts.target AS actual, pred.predicted FROM pts JOIN pred ON pts.v = pred.v),
cnt AS (SELECT actual, predicted, count(*) AS n FROM scored WHERE split = 'test' GROUP BY 1, 2),
cls AS (SELECT actual AS cls FROM cnt UNION SELECT predicted FROM cnt),
pc AS (SELECT cls, coalesce((SELECT sum(n) FROM cnt WHERE actual = cls AND predicted = cls), 0) AS tp,
  coalesce((SELECT sum(n) FROM cnt WHERE actual = cls), 0) AS support,
  coalesce((SELECT sum(n) FROM cnt WHERE predicted = cls), 0) AS npred FROM cls),
pr2 AS (SELECT tp, support, CASE WHEN npred = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / npred END AS p,
  CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS r FROM pc),
prf AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM pr2)
SELECT 'K-Nearest Neighbors' AS model,
  (SELECT round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 4) FROM scored WHERE split = 'train')
    AS train_accuracy,
  (SELECT round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 4) FROM scored WHERE split = 'test')
    AS test_accuracy,
  round(avg(p), 4) AS precision_macro, round(avg(r), 4) AS recall_macro, round(avg(f), 4) AS f1_macro FROM prf"""


REGISTRY["compare_models_knn_embeddings"] = (REGISTRY["compare_models_knn_embeddings"][0], _knn_embeddings_sql())

# the other kinds of the chart dispatcher, with the SQL of the operators they stand for
for _name, _like, _args in (
        ("chart_histogram_events", "histogram_events_value_by_type", ("events", "Histogram", "value", None, "event_type", {"bins": 30})),
        ("chart_box_lineitem", "box_lineitem_price_by_flag", ("lineitem", "Box", None, "l_extendedprice", "l_returnflag", {})),
        ("chart_violin_lineitem", "violin_lineitem_discount", ("lineitem", "Violin", None, "l_discount", "l_linestatus", {"bins": 20}))):
    register(_name, REGISTRY[_like][1])(
        lambda spark, d, a=_args: C.chart_data(load(spark, d, a[0]), a[1], a[2], a[3], a[4], **a[5]))

# the best model's test predictions, row by row
register("knn_predictions_embeddings", _knn_embeddings_sql().split("cnt AS (SELECT actual")[0].rstrip().rstrip(",")
         + "\nSELECT actual, predicted FROM scored WHERE split = 'test'")(
    lambda spark, d: MO.compare_models(embedding_table(spark, d), "label", [f"e{i}" for i in range(64)], ["knn"], key=["vec_id"])[2])

# mean kernels of the market segments; the oracle takes all pairs of customers
register("kernel_means_customer", """
WITH z AS (SELECT c_mktsegment AS g, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x,
  (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS y FROM customer),
v AS (SELECT 1 / (2 * (var_pop(x) + var_pop(y)) / 2) AS gamma FROM z)
SELECT p.g AS a, q.g AS b, round(avg(exp(-(SELECT gamma FROM v) * ((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)))), 3) AS mean_kernel
FROM z p JOIN z q ON p.g <= q.g GROUP BY 1, 2""")(
    lambda spark, d: KE.kernel_means(load(spark, d, "customer"), ["c_acctbal", "c_nationkey"], "c_mktsegment")
    .withColumn("mean_kernel", rnd(F.col("mean_kernel"), 3)))

register("compare_models_svm_lineitem", None)(
    lambda spark, d: MO.compare_models(load(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"], ["svm"],
                                       key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])[0])

# codes of a column with a level a row beside a narrow one: the places of each row's ones
register("one_hot_wide_customer", """
SELECT c_custkey, [n, m + s - 1] AS onehot, s + w AS size FROM (
  SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS n, dense_rank() OVER (ORDER BY c_mktsegment) AS m,
    (SELECT count(DISTINCT c_name) FROM customer) AS s, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS w FROM customer)""")(
    lambda spark, d: (lambda t: (lambda m: m.places(t).withColumn("size", F.lit(m.size).cast("long")))(
        W.fit_wide_onehot(t, ["c_name", "c_mktsegment"])))(load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")))


def _pca_wide_rebuilt(spark, d):
    """Correlations of all pairs of embedding elements, rebuilt from all components."""
    m = WP.fit_wide_pca(load(spark, d, "embeddings"), "embedding", 64)
    c = m.components * m.explained_variance @ m.components.T * (m.n - 1) / m.n
    return spark.createDataFrame([(i, j, float(c[i, j])) for i in range(len(c)) for j in range(i, len(c))], "i int, j int, r double").withColumn(
        "r", rnd(F.col("r"), 4))


register("pca_wide_rebuilt_embeddings", """
WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
z AS (SELECT vec_id, i, coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0) AS z FROM e WINDOW w AS (PARTITION BY i))
SELECT a.i::INT AS i, b.i::INT AS j, round(avg(a.z * b.z), 4) AS r FROM z a JOIN z b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2""")(_pca_wide_rebuilt)


def _csv_split(spark, d):
    """Customers with line breaks, quotes and commas in a field, written as CSV and read back from splits."""
    t = load(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('",\n\n'), F.col("c_nationkey").cast("string")).alias("note"), "c_nationkey")
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    write_csv(t, path)
    return read_table(spark, path, fmt="csv", multi_line="split").select("c_custkey", F.md5("note").alias("note_md5"), F.length("note").alias("n_chars"), "c_nationkey")


register("csv_split_customer", """
SELECT c_custkey, md5(note) AS note_md5, length(note) AS n_chars, c_nationkey
FROM (SELECT *, c_name || chr(10) || '"' || c_mktsegment || '",' || chr(10) || chr(10) || c_nationkey AS note FROM customer)""")(_csv_split)


def _jacobi_sql(table: str, cols: list[str], sweeps: int = 8) -> str:
    """CTE ``eig`` (k from 1 by descending eigenvalue, lam, v: vector with its largest entry
    positive) of the correlation matrix, by cyclic plane rotations."""
    d = len(cols)
    pairs = [(a, b) for a in range(d) for b in range(a + 1, d)]
    corr = ", ".join("1.0::DOUBLE" if a == b else f"corr({cols[a]}, {cols[b]})" for a in range(d) for b in range(d))
    unit = ", ".join("1.0::DOUBLE" if a == b else "0.0::DOUBLE" for a in range(d) for b in range(d))
    columns = lambda m: (f"[CASE WHEN e % {d} = p THEN c * {m}[e + 1] - s * {m}[e - p + q + 1] WHEN e % {d} = q "  # noqa: E731
                         f"THEN s * {m}[e - q + p + 1] + c * {m}[e + 1] ELSE {m}[e + 1] END for e in range({d * d})]")
    rows = (f"[CASE WHEN e // {d} = p THEN c * b[e + 1] - s * b[e + (q - p) * {d} + 1] WHEN e // {d} = q "
            f"THEN s * b[e - (q - p) * {d} + 1] + c * b[e + 1] ELSE b[e + 1] END for e in range({d * d})]")
    return f"""WITH RECURSIVE turn(step, a, v) AS (
  SELECT 0, [{corr}], [{unit}] FROM {table}
  UNION ALL
  SELECT step + 1, {rows}, v FROM (
    SELECT step, p, q, c, s, {columns('a')} AS b, {columns('v')} AS v FROM (
      SELECT *, t / sqrt(1 + t * t) AS s, 1 / sqrt(1 + t * t) AS c FROM (
        SELECT *, CASE WHEN off = 0 THEN 0 ELSE (CASE WHEN tau < 0 THEN -1 ELSE 1 END) / (abs(tau) + sqrt(1 + tau * tau)) END AS t FROM (
          SELECT *, CASE WHEN off = 0 THEN 0 ELSE (a[q * {d + 1} + 1] - a[p * {d + 1} + 1]) / (2 * off) END AS tau FROM (
            SELECT *, a[p * {d} + q + 1] AS off FROM (
              SELECT *, {[a for a, _ in pairs]}[step % {len(pairs)} + 1] AS p, {[b for _, b in pairs]}[step % {len(pairs)} + 1] AS q
              FROM turn WHERE step < {sweeps * len(pairs)}))))))),
raw AS (SELECT a[k * {d + 1} + 1] AS lam, [v[i * {d} + k + 1] for i in range({d})] AS v FROM turn, range({d}) t(k) WHERE step = {sweeps * len(pairs)}),
eig AS (SELECT row_number() OVER (ORDER BY lam DESC) AS k, lam,
  [x * CASE WHEN abs(list_max(v)) >= abs(list_min(v)) THEN 1 ELSE -1 END for x in v] AS v FROM raw)
"""


REGISTRY["scree_lineitem"] = (REGISTRY["scree_lineitem"][0], _jacobi_sql("lineitem", _PCA) +
                              "SELECT 'F' || k AS factor, round(lam, 4) AS eigenvalue, lam > 1 AS kaiser FROM eig WHERE lam > 0")
REGISTRY["pca_variance_lineitem"] = (REGISTRY["pca_variance_lineitem"][0], _jacobi_sql("lineitem", _PCA) + f"""
SELECT 'PC' || k AS component, round(100 * lam / {len(_PCA)}, 2) AS explained_variance_pct,
  round(100 * (SELECT sum(lam) FROM eig f WHERE f.k <= eig.k) / {len(_PCA)}, 2) AS cumulative_pct,
  round(lam * (SELECT count(*) / (count(*) - 1) FROM lineitem), 4) AS eigenvalue FROM eig WHERE k <= 5""")
REGISTRY["pca_loadings_lineitem"] = (REGISTRY["pca_loadings_lineitem"][0], _jacobi_sql("lineitem", _PCA) +
                                     "SELECT " + repr(_PCA) + "[i] AS feature, " + ", ".join(
    f"round((SELECT v[i] FROM eig WHERE k = {j}), 4) + 0.0 AS PC{j}" for j in range(1, 6)) + f" FROM range(1, {len(_PCA) + 1}) t(i)")
