"""The star schema seen as a code graph, so that every operator runs over the given tables.

Customers call their orders, orders the parts in them, parts their suppliers; suppliers and customers lie
in nations and those in regions, as symbols lie in files and files in folders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import traverse


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: str):
    return F.concat(F.lit(kind + "/"), F.col(key).cast("string"))


#: Table, both ends (kind and key) and class of the edges.
_PAIRS = [
    ("orders", ("customer", "o_custkey"), ("order", "o_orderkey"), "executable"),
    ("lineitem", ("order", "l_orderkey"), ("part", "l_partkey"), "executable"),
    ("lineitem", ("part", "l_partkey"), ("supplier", "l_suppkey"), "executable"),
    ("supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "structural"),
    ("customer", ("customer", "c_custkey"), ("nation", "c_nationkey"), "structural"),
    ("nation", ("nation", "n_nationkey"), ("region", "n_regionkey"), "structural"),
]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, edge_class; each edge once."""
    return counted_edges(spark, sf_dir)[0]


def counted_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The edges, and a number no smaller than theirs, from the tables' numbers of rows.

    Keys are made distinct before they become names, in tasks of a bounded number of rows.
    """
    counts = [table(spark, sf_dir, name).agg(F.lit(name), F.count(F.lit(1))) for name in dict.fromkeys(name for name, *_ in _PAIRS)]
    rows = {name: n for name, n in reduce(DataFrame.union, counts).collect()}
    out = None
    for name, a, b, kind in _PAIRS:
        keys = [a[1], b[1]]
        own = traverse.dealt(table(spark, sf_dir, name).select(*keys), rows[name], *keys).distinct()
        one = own.select(node(*a).alias("src"), node(*b).alias("dst"), F.lit(kind).alias("edge_class"))
        out = one if out is None else out.unionByName(one)
    return out, sum(rows[name] for name, *_ in _PAIRS)


EDGES_SQL = """
  edges AS (
    SELECT DISTINCT 'customer/' || o_custkey AS src, 'order/' || o_orderkey AS dst, 'executable' AS edge_class FROM orders
    UNION ALL SELECT DISTINCT 'order/' || l_orderkey, 'part/' || l_partkey, 'executable' FROM lineitem
    UNION ALL SELECT DISTINCT 'part/' || l_partkey, 'supplier/' || l_suppkey, 'executable' FROM lineitem
    UNION ALL SELECT DISTINCT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'structural' FROM supplier
    UNION ALL SELECT DISTINCT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'structural' FROM customer
    UNION ALL SELECT DISTINCT 'nation/' || n_nationkey, 'region/' || n_regionkey, 'structural' FROM nation)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, name, balance of every customer: region/nation/segment/customer."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    both = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return both.select(F.concat_ws("/", "r_name", "n_name", "c_mktsegment", "c_name").alias("path"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))


PATHS_SQL = """
  paths AS (
    SELECT r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name AS path, c_name AS name, c_custkey AS id
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def url_path(url):
    """The path of a URL: without scheme, host, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^https?://[^/?#]+", ""), r"[?#].*$", "")


URL_PATH_SQL = r"regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '[?#].*$', '')"
