"""Table loading and the derived analysis views (written once in SQL and
run by both Spark and the oracle, so both sides see identical inputs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Derived views: name -> SQL over the base tables.
VIEWS = {
    # missing values in numeric and class columns
    "lineitem_nulls": ("SELECT l_orderkey, l_partkey, l_quantity, nullif(l_discount, 0) AS l_discount, "
                       "l_extendedprice, l_tax, l_returnflag, l_linestatus FROM lineitem"),
    "orders_nulls": ("SELECT o_orderkey, o_custkey, o_orderstatus, "
                     "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, "
                     "o_orderpriority FROM orders"),
    "events_nulls": ("SELECT event_id, user_id, value, "
                     "CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_type END AS event_type FROM events"),
    # duplicate rows
    "lineitem_dups": "SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem",
    "lineitem_dups_nulls": ("SELECT l_returnflag, l_linestatus, l_quantity, nullif(l_discount, 0) AS l_discount "
                            "FROM lineitem"),
    # a constant column and a strongly correlated pair
    "lineitem_net": ("SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net, "
                     "l_discount, l_tax, 1.0D AS const FROM lineitem"),
    # class imbalance above 5
    "events_rare": ("SELECT event_id, value, CASE WHEN event_id % 20 = 0 THEN 'rare' ELSE 'common' END AS kind "
                    "FROM events"),
    # outliers / skew
    "events_cubed": "SELECT event_id, user_id, value, power(value, 3) AS value3, event_type FROM events",
    # a fixed rule standing in for a classifier (exercises the evaluation ops)
    "orders_rule": ("SELECT o_orderkey, o_orderstatus AS actual, CASE WHEN o_totalprice < 100000 THEN 'F' "
                    "WHEN o_totalprice < 250000 THEN 'O' ELSE 'P' END AS predicted FROM orders"),
    # an analysis table joined over the star schema
    "customer_nation": ("SELECT c.c_custkey, c.c_acctbal, c.c_mktsegment, n.n_name, r.r_name "
                        "FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey "
                        "JOIN region r ON n.n_regionkey = r.r_regionkey"),
}


def duck_sql(view: str) -> str:
    """The view's SQL for DuckDB (Spark's ``1.0D`` double literal spelled out)."""
    return VIEWS[view].replace("1.0D", "CAST(1.0 AS DOUBLE)")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view over the parquet files in ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    refs = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in sql}
    text = sql
    for t in refs:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **refs)
