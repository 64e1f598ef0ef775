"""Queries over the star-schema tables: each applies one operator of the engine, with its SQL beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import columns as C
from loomgraph.operators import changes, intervals, resolve, rollup, traverse
from loomgraph import storage
from loomgraph.operators.adjacency import Adjacency
from loomgraph.operators.urls import best_routes, named_answers
from loomgraph.plans.code_graph import Graph, facts, nodes_of
from loomgraph.plans.questions import CodeStructure, kept
from loomgraph.plans.star_graph import EDGES_SQL, PATHS_SQL, URL_PATH_SQL, counted_edges, edges, node, paths, table, url_path
from loomgraph.sources.frameworks import signals
from loomgraph.streaming.debounce import debounced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _seed(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(name,)], "node string")


def _bfs_sql(seed: str, depth: int, callers: bool, body: str) -> str:
    a, b = ("dst", "src") if callers else ("src", "dst")
    return f"""
    WITH RECURSIVE {EDGES_SQL},
      walk AS (
        SELECT '{seed}' AS node, 0 AS hop
        UNION
        SELECT e.{b}, hop + 1 FROM walk JOIN edges e ON e.{a} = walk.node AND edge_class = 'executable' WHERE hop < {depth}),
      reached AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node HAVING min(hop) > 0)
    {body}"""


# -- walks ---------------------------------------------------------------------------------------


@query(_bfs_sql("supplier/1", 3, True, "SELECT node, hop FROM reached"))
def impact_callers_d3(spark, sf_dir):
    return traverse.bfs(edges(spark, sf_dir), _seed(spark, "supplier/1"), 3, "callers")


@query(_bfs_sql("customer/1", 2, False, "SELECT node, hop FROM reached"))
def impact_callees_d2(spark, sf_dir):
    return traverse.bfs(edges(spark, sf_dir), _seed(spark, "customer/1"), 2, "callees")


@query("""
    WITH RECURSIVE steps AS (
        SELECT DISTINCT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
      walk AS (
        SELECT 'click' AS node, 0 AS hop
        UNION SELECT b, hop + 1 FROM walk JOIN steps ON a = node AND b IS NOT NULL WHERE hop < 10)
    SELECT node, min(hop) AS hop FROM walk GROUP BY node HAVING min(hop) > 0""")
def impact_cycle_terminates(spark, sf_dir):
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), after.alias("dst"), F.lit("executable").alias("edge_class")).filter("dst IS NOT NULL")
    return traverse.bfs(steps, _seed(spark, "click"), 0, "callees")


@query(_bfs_sql("supplier/1", 3, True, "SELECT split_part(node, '/', 1) AS kind, hop, count(*) AS nodes, min(node) AS first FROM reached GROUP BY ALL"))
def impact_by_file_summary(spark, sf_dir):
    reached = traverse.bfs(edges(spark, sf_dir), _seed(spark, "supplier/1"), 3, "callers")
    return reached.groupBy(F.split_part("node", F.lit("/"), F.lit(1)).alias("kind"), "hop").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("first"))


@query(f"""
    WITH {EDGES_SQL},
      e AS (SELECT dst AS here, src AS next FROM edges WHERE edge_class = 'executable'),
      a AS (SELECT next AS node, row_number() OVER (ORDER BY next) AS nth FROM (SELECT DISTINCT next FROM e WHERE here = 'supplier/1' AND next <> 'supplier/1')),
      b AS (SELECT node, row_number() OVER (ORDER BY up, node) AS nth FROM (
        SELECT next AS node, min(nth) AS up FROM a JOIN e ON here = node WHERE next <> 'supplier/1' AND next NOT IN (SELECT node FROM a) GROUP BY 1)),
      c AS (SELECT node, row_number() OVER (ORDER BY up, node) AS nth FROM (
        SELECT next AS node, min(nth) AS up FROM b JOIN e ON here = node
        WHERE next <> 'supplier/1' AND next NOT IN (SELECT node FROM a) AND next NOT IN (SELECT node FROM b) GROUP BY 1)),
      w AS (SELECT node, 1 AS hop, nth FROM a UNION ALL SELECT node, 2, nth FROM b UNION ALL SELECT node, 3, nth FROM c),
      n AS (SELECT *, row_number() OVER (ORDER BY hop, nth) AS place, count(*) OVER () AS total FROM w)
    SELECT node, hop, place::INT AS place, total > 300 AS truncated FROM n WHERE place <= 300""")
def impact_truncated_topn(spark, sf_dir):
    """The first 300 nodes in the order of the walk, which ends in the level in which they are passed."""
    own = edges(spark, sf_dir).withColumn("seq", F.lit(0))
    found, more = traverse.first_reached(own, "supplier/1", 3, 300)
    return spark.createDataFrame([(n, hop, k + 1, more) for k, (n, hop) in enumerate(found)], "node string, hop int, place int, truncated boolean")


@query(_bfs_sql("supplier/1", 1, True, """SELECT count(DISTINCT e.src) AS beyond, count(DISTINCT e.src) > 0 AS more
    FROM reached JOIN edges e ON e.dst = reached.node AND edge_class = 'executable'
    WHERE hop = 1 AND e.src NOT IN (SELECT node FROM reached) AND e.src <> 'supplier/1'"""))
def more_beyond_depth(spark, sf_dir):
    own, seed = edges(spark, sf_dir), _seed(spark, "supplier/1")
    more = traverse.beyond(own, traverse.bfs(own, seed, 1, "callers"), seed, 1, "callers")
    return more.agg(F.count(F.lit(1)).alias("beyond")).select("beyond", (F.col("beyond") > 0).alias("more"))


@query("""
    WITH w AS (SELECT lower(replace(p_name, ' ', '_')) || '_' || p_partkey AS w FROM part)
    SELECT method, '/' || w AS call, 'm.py:' || verb || w AS target, 95 + 2 * length(w) AS score
    FROM w, (VALUES ('GET', 'get_'), ('POST', 'create_'), ('DELETE', 'delete_')) AS v(method, verb)""")
def named_answers_parts(spark, sf_dir):
    """Calls that no URL fits, against five functions for each part: of all names that hold the word, the verb and the whole tail decide."""
    w = table(spark, sf_dir, "part").select(F.lower(F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"))).alias("w"))
    name = F.explode(F.transform(F.array(*map(F.lit, ("get_", "create_", "update_", "delete_", "parse_"))), lambda v: F.concat(v, F.col("w"))))
    names = w.select(name.alias("name")).select(F.concat(F.lit("m.py:"), "name").alias("target"), "name", F.lit("m.py").alias("file"), F.lit("Function").alias("kind"))
    calls = w.select(F.explode(F.array(*map(F.lit, ("GET", "POST", "DELETE")))).alias("method"), F.concat(F.lit("/"), "w").alias("call"))
    return named_answers(calls, names, spark.createDataFrame([], "target string, method string"))


@query(f"""
    WITH RECURSIVE {EDGES_SQL},
      up AS (SELECT src, dst FROM edges WHERE edge_class = 'structural'),
      walk AS (SELECT src AS node, dst AS ancestor, 1 AS distance FROM up UNION ALL SELECT w.node, up.dst, distance + 1 FROM walk w JOIN up ON up.src = w.ancestor)
    SELECT w.node, w.ancestor, w.distance FROM walk w UNION ALL
    SELECT 'order/' || o_orderkey, 'customer/' || o_custkey, 1 FROM orders UNION ALL
    SELECT 'order/' || o_orderkey, w.ancestor, w.distance + 1 FROM orders JOIN walk w ON w.node = 'customer/' || o_custkey""")
def interval_labels(spark, sf_dir):
    """Orders in customers, these and suppliers in nations and regions: which of the asked pairs are of a node and what is above it, told by two labels."""
    up = edges(spark, sf_dir).filter("edge_class = 'structural'").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    orders = table(spark, sf_dir, "orders")
    up = up.union(orders.select(node("order", "o_orderkey"), node("customer", "o_custkey")))
    own = intervals.labels(up)
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    ends = nation.select("n_nationkey", F.explode(F.array(node("nation", "n_nationkey"), node("region", "n_regionkey"))).alias("ancestor"))
    held = customer.select(node("customer", "c_custkey").alias("node"), F.col("c_nationkey").alias("n_nationkey"))
    held = held.union(supplier.select(node("supplier", "s_suppkey"), "s_nationkey"))
    held = held.union(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(node("order", "o_orderkey"), "c_nationkey"))
    held = held.union(orders.select(node("order", "o_orderkey"), (F.col("o_orderkey") % 25).cast("int")))  # most of these are not above it
    asked = held.join(ends, "n_nationkey").select("node", "ancestor")
    return intervals.above(asked.union(up.toDF("node", "ancestor")), own)


#: Orders call the return flags of their lines, customers their orders; each flag has a large part of all edges.
_FLAGS_SQL = """
    calls AS (SELECT DISTINCT 'order/' || l_orderkey AS src, 'flag/' || l_returnflag AS dst FROM lineitem
      UNION SELECT 'customer/' || o_custkey, 'order/' || o_orderkey FROM orders)"""


def _flag_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = lines.select(node("order", "l_orderkey").alias("src"), node("flag", "l_returnflag").alias("dst")).distinct()
    rows = rows.union(orders.select(node("customer", "o_custkey"), node("order", "o_orderkey")))
    return rows.select("src", "dst", F.lit("executable").alias("edge_class"), F.lit(0).cast("long").alias("seq"))


@query(f"""
    WITH {_FLAGS_SQL},
      one AS (SELECT DISTINCT src AS node FROM calls WHERE dst = 'flag/R')
    SELECT node, 1 AS hop FROM one UNION ALL SELECT DISTINCT src, 2 FROM calls WHERE dst IN (SELECT node FROM one) AND src NOT IN (SELECT node FROM one)""")
def hub_callers_on_disk(spark, sf_dir):
    """The same walk over adjacency on disk, in which the hub that it starts from is split into chunks."""
    folder = f"{storage.shared_folder(spark)}/adjacency-{uuid.uuid4().hex}"
    storage.at_end(spark, folder)
    return traverse.bfs(Adjacency.write(_flag_calls(spark, sf_dir), folder), _seed(spark, "flag/R"), 2, "callers")


@query(f"""
    WITH {_FLAGS_SQL}, n AS (SELECT dst AS target, count(*) AS direct FROM calls WHERE dst LIKE 'flag/%' OR dst IN (SELECT 'order/' || min(o_orderkey) FROM orders) GROUP BY dst)
    SELECT target, direct, least(direct, 300) AS total, direct > 300 AS truncated FROM n""")
def impact_fan_in(spark, sf_dir):
    """Numbers of the impact answer for targets with more direct callers than an answer shows, and for one with fewer."""
    calls = storage.cut(_flag_calls(spark, sf_dir))
    ids = calls.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    name = F.col("id").alias
    nodes = nodes_of(facts(spark.createDataFrame([], "path string, content binary"))).withColumn("full_url", F.lit(None).cast("string"))
    nodes = nodes.unionByName(ids.select("id", F.lit("Function").alias("kind"), name("name"), name("qualified"), name("file")), allowMissingColumns=True)
    s = CodeStructure(kept(Graph(storage.cut(nodes), calls, nodes.limit(0))))
    first = table(spark, sf_dir, "orders").agg(F.min("o_orderkey").alias("k")).select(node("order", "k").alias("target"))
    targets = [r["target"] for r in calls.filter("dst LIKE 'flag/%'").select(F.col("dst").alias("target")).distinct().union(first).collect()]
    found = [(t, s.impact(t, 1)["meta"]) for t in targets]
    return spark.createDataFrame([(t, m["direct"], m["total"], m["truncated"]) for t, m in found], "target string, direct long, total long, truncated boolean")


@query(f"WITH {EDGES_SQL} SELECT DISTINCT src AS node FROM edges WHERE dst = 'part/7' AND edge_class = 'executable'")
def direct_callers(spark, sf_dir):
    return traverse.neighbours(edges(spark, sf_dir), "part/7", "callers")


@query(f"WITH {EDGES_SQL} SELECT DISTINCT dst AS node FROM edges WHERE src = 'part/7' AND edge_class = 'executable'")
def direct_callees(spark, sf_dir):
    return traverse.neighbours(edges(spark, sf_dir), "part/7", "callees")


@query(f"WITH {EDGES_SQL} SELECT DISTINCT src AS node FROM edges WHERE dst = 'nation/3'")
def dependents_all_classes(spark, sf_dir):
    return traverse.neighbours(edges(spark, sf_dir), "nation/3", "callers", None)


@query(f"WITH {EDGES_SQL} SELECT DISTINCT dst AS node FROM edges WHERE src = 'supplier/1'")
def dependencies_all_classes(spark, sf_dir):
    return traverse.neighbours(edges(spark, sf_dir), "supplier/1", "callees", None)


@query(f"WITH {EDGES_SQL} SELECT edge_class, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY 1")
def graph_stats(spark, sf_dir):
    return traverse.stats(*counted_edges(spark, sf_dir))


@query(f"""
    WITH RECURSIVE {EDGES_SQL},
      up AS (
        SELECT src AS node, dst AS ancestor, 1 AS distance FROM edges WHERE edge_class = 'structural'
        UNION SELECT up.node, e.dst, distance + 1 FROM up JOIN edges e ON e.src = up.ancestor AND edge_class = 'structural')
    SELECT node, ancestor, min(distance) AS distance FROM up GROUP BY ALL""")
def ancestor_closure_nearest(spark, sf_dir):
    own = edges(spark, sf_dir).filter("edge_class = 'structural'").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    return traverse.closure(own)


# -- outlines ------------------------------------------------------------------------------------


@query(f"""
    WITH {PATHS_SQL}, parts AS (SELECT string_split(path, '/') AS p FROM paths),
      rows AS (SELECT array_to_string(p[1:n], '/') AS folder, n AS level FROM parts, unnest(range(1, len(p))) AS t(n))
    SELECT folder, level::INT AS level, count(*) AS files FROM rows GROUP BY ALL""")
def code_map_rollup(spark, sf_dir):
    return rollup.by_folder(paths(spark, sf_dir))


@query(f"""
    WITH {PATHS_SQL}, t AS (SELECT split_part(path, '/', 2) AS folder, name, row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY name) AS nth FROM paths)
    SELECT folder, string_agg(name, ',' ORDER BY nth) FILTER (nth <= 8) AS preview, greatest(count(*) - 8, 0) AS omitted FROM t GROUP BY folder""")
def code_map_topk_preview(spark, sf_dir):
    return rollup.preview(paths(spark, sf_dir).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("folder"), "name"), "folder", "name", ["name"], 8)


@query(f"""
    WITH {EDGES_SQL} SELECT dst AS parent, src AS child, row_number() OVER (PARTITION BY dst ORDER BY src)::INT AS nth
    FROM edges WHERE edge_class = 'structural' AND starts_with(dst, 'region/')""")
def members_tree(spark, sf_dir):
    own = edges(spark, sf_dir).filter((F.col("edge_class") == "structural") & F.startswith("dst", F.lit("region/")))
    return traverse.members(own.select(F.col("src").alias("id"), F.col("dst").alias("parent")), None, ["id"]).select("parent", F.col("id").alias("child"), "nth")


@query("""
    SELECT o_orderkey, concat_ws(' ', o_orderpriority, '[' || o_orderstatus || ']',
             'L' || CASE WHEN o_custkey = o_orderkey THEN o_custkey::VARCHAR ELSE o_custkey || '-' || o_orderkey END, 'depth=' || (o_orderkey % 5)) AS entry,
           CASE WHEN length(o_orderpriority) > 8 THEN left(o_orderpriority, 5) || '...' ELSE o_orderpriority END AS short
    FROM orders""")
def compact_entry_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    entry = C.compact_entry(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderkey") % 5)
    return o.select("o_orderkey", entry.alias("entry"), C.truncated(F.col("o_orderpriority"), 8).alias("short"))


# -- lookups -------------------------------------------------------------------------------------

_ASKED = ["Customer#000000007", "customer#000000008", "red widget", "no such thing", "EUROPE", "Supplier#000000003"]
_NAMES_SQL = """
  names AS (
    SELECT 'customer/' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, s_name FROM supplier
    UNION ALL SELECT 'part/' || p_partkey, p_name FROM part UNION ALL SELECT 'region/' || r_regionkey, r_name FROM region),
  asked AS (SELECT unnest([%s]) AS wanted)""" % ", ".join(f"'{a}'" for a in _ASKED)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, kind, key, label in (("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name"), ("region", "region", "r_regionkey", "r_name")):
        one = table(spark, sf_dir, name).select(node(kind, key).alias("id"), F.col(label).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a,) for a in _ASKED], "wanted string")


@query(f"""
    WITH {_NAMES_SQL}, m AS (SELECT wanted, count(DISTINCT id) AS matches, min(id) AS one FROM asked JOIN names ON name = wanted GROUP BY 1)
    SELECT wanted, CASE WHEN matches IS NULL THEN 'not_found' WHEN matches = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
           CASE WHEN matches = 1 THEN one END AS id, coalesce(matches, 0) AS matches FROM asked LEFT JOIN m USING (wanted)""")
def lookup_status(spark, sf_dir):
    asked = _asked(spark)
    return resolve.statuses(asked, asked.join(_names(spark, sf_dir), F.col("name") == F.col("wanted")), ["wanted"], "id")


@query(f"""
    WITH {_NAMES_SQL}, hits AS (SELECT wanted, id, CASE WHEN name = wanted THEN 0 ELSE 1 END AS tier FROM asked JOIN names ON lower(name) = lower(wanted)),
      best AS (SELECT wanted, min(tier) AS tier FROM hits GROUP BY 1)
    SELECT wanted, id, tier FROM hits JOIN best USING (wanted, tier)""")
def lookup_case_insensitive(spark, sf_dir):
    hits = _asked(spark).join(_names(spark, sf_dir), F.lower("name") == F.lower("wanted"))
    return resolve.lowest_tier(hits.select("wanted", "id", resolve.unless(F.col("name") == F.col("wanted")).alias("tier")), ["wanted"], "tier").select("wanted", "id", "tier")


@query(f"""
    WITH {PATHS_SQL}, asked AS (SELECT DISTINCT array_to_string(string_split(path, '/')[3:4], '/') AS wanted FROM paths)
    SELECT wanted, path AS file, path = wanted AS exact FROM asked JOIN paths ON path = wanted OR ends_with(path, '/' || wanted)""")
def lookup_suffix_match(spark, sf_dir):
    own = paths(spark, sf_dir)
    asked = own.select(F.array_join(F.slice(F.split("path", "/"), 3, 2), "/").alias("wanted")).distinct()
    return resolve.suffix_match(asked, "wanted", own, "path").select("wanted", "file", "exact")


@query(f"WITH {PATHS_SQL} SELECT path, id FROM paths WHERE path = 'ASIA' OR starts_with(path, 'ASIA/') OR path = '.'")
def scope_filter(spark, sf_dir):
    return paths(spark, sf_dir).filter(C.is_under(F.col("path"), "ASIA")).select("path", "id")


@query(f"WITH {_NAMES_SQL} SELECT name, count(*) AS n, min(id) AS id FROM names GROUP BY name HAVING count(DISTINCT id) = 1")
def unique_target_only(spark, sf_dir):
    names = _names(spark, sf_dir)
    return resolve.unique_target(names, ["name"], "id").withColumn("n", F.lit(1).cast("long"))


@query(r"""
    WITH t AS (SELECT page_id, replace(trim(split_part(url, '://', 2)), '\', '/') AS p FROM pages),
      u AS (SELECT page_id, regexp_replace(regexp_replace(p, '^(\./)+', ''), '/+$', '') AS p FROM t)
    SELECT page_id, CASE WHEN p = '' THEN '.' ELSE p END AS path FROM u""")
def normalize_path_expr(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.normalize_path(F.split_part("url", F.lit("://"), F.lit(2))).alias("path"))


def _url_sql(u: str, fold: bool) -> str:
    x = f"regexp_replace(trim({u}), '/+$', '')"
    x = f"(CASE WHEN starts_with({x}, '/') THEN {x} ELSE '/' || {x} END)"
    x = f"regexp_replace({x}, '^/api(/|$)', '\\1')"
    for pattern in ("<[^>]+>", ":[A-Za-z_][A-Za-z0-9_]*", r"\{[^}]*\}"):
        x = f"regexp_replace({x}, '{pattern}', '{{id}}', 'g')"
    if fold:
        x = f"array_to_string(list_transform(string_split({x}, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '{{id}}' ELSE s END), '/')"
    return f"(CASE WHEN {x} = '' THEN '/' ELSE {x} END)"


@query(f"SELECT page_id, {_url_sql(URL_PATH_SQL, False)} AS plain, {_url_sql(URL_PATH_SQL, True)} AS folded FROM pages")
def normalize_url_expr(spark, sf_dir):
    path = url_path(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", C.normalize_url(path).alias("plain"), C.normalize_url(path, True).alias("folded"))


# -- scored and unique matches -------------------------------------------------------------------


_HREF_SQL = r"""regexp_extract_all(html, '(?i)\bhref\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)')"""
_VALUE_SQL = r"""regexp_replace(regexp_replace(h, '(?i)^href\s*=\s*', ''), '^["'']|["'']$', '', 'g')"""


@query(f"""
    WITH urls AS (
        SELECT page_id, true AS own, url FROM pages WHERE url IS NOT NULL
        UNION ALL SELECT page_id, false, {_VALUE_SQL} FROM (SELECT page_id, unnest({_HREF_SQL}) AS h FROM pages)),
      p AS (SELECT page_id, own, {URL_PATH_SQL} AS path FROM urls),
      calls AS (SELECT DISTINCT page_id, own, {_url_sql('path', False)} AS call, {_url_sql('path', True)} AS folded FROM p),
      routes AS (SELECT folded AS route FROM calls WHERE own UNION SELECT call FROM calls WHERE own),
      scored AS (
        SELECT DISTINCT call, folded, route, CASE WHEN call = route THEN 100 WHEN contains(route, '{{id}}') AND folded = route THEN 95
          WHEN call = '/' OR route = '/' THEN NULL WHEN starts_with(call || '/', route || '/') THEN 50 WHEN starts_with(route || '/', call || '/') THEN 40
          WHEN ends_with(call, route) THEN 35 WHEN ends_with(route, call) THEN 30 END AS score FROM calls, routes),
      top AS (SELECT call, folded, max(score) AS score FROM scored WHERE score IS NOT NULL GROUP BY ALL),
      best AS (SELECT call, folded, CASE WHEN count(DISTINCT route) = 1 THEN min(route) END AS route, any_value(score)::INT AS score FROM scored JOIN top USING (call, folded, score) GROUP BY call, folded)
    SELECT DISTINCT page_id, call, route, score FROM calls JOIN best USING (call, folded)""")
def url_match_scored(spark, sf_dir):
    """page_id, call, route, score for the URL of every page and every href in it; calls that no route fits have no row."""
    pages = table(spark, sf_dir, "pages")
    hrefs = C.href_values(F.col("html"))
    urls = pages.select("page_id", F.lit(True).alias("own"), "url").union(pages.select("page_id", F.lit(False), F.explode(hrefs))).filter("url IS NOT NULL")
    path = url_path(F.col("url"))
    calls = urls.select("page_id", "own", C.normalize_url(path).alias("call"), C.normalize_url(path, True).alias("folded"))
    own = calls.filter("own")
    routes = own.select(F.col("folded").alias("route")).union(own.select("call")).distinct()
    return calls.select("page_id", "call", "folded").distinct().join(best_routes(calls, routes), ["call", "folded"]).select("page_id", "call", "route", "score")


#: Lines that a task joins and scores.
LINES = 1 << 19


@query("""
    WITH c AS (
      SELECT l_orderkey AS src, l_suppkey AS target, CASE WHEN s_nationkey = c_nationkey THEN 10 ELSE 0 END + CASE WHEN l_quantity > 25 THEN 4 ELSE 0 END AS score
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
      best AS (SELECT src, target, max(score) AS score FROM c GROUP BY ALL), top AS (SELECT src, max(score) AS score FROM best GROUP BY 1)
    SELECT src, CASE WHEN count(DISTINCT target) = 1 AND any_value(score) > 0 THEN min(target)::VARCHAR END AS target, any_value(score)::INT AS score
    FROM best JOIN top USING (src, score) GROUP BY src""")
def pick_named_scored(spark, sf_dir):
    l, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    parts = max(-(-l.count() // LINES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    home = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_nationkey")
    both = l.repartition(parts, "l_orderkey").join(home, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    score = F.when(F.col("s_nationkey") == F.col("c_nationkey"), 10).otherwise(0) + F.when(F.col("l_quantity") > 25, 4).otherwise(0)
    return resolve.best_scored(both.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("target"), score.alias("score")), ["src"], "score", "target").withColumn("target", F.col("target").cast("string"))


@query(f"""
    WITH {PATHS_SQL}, wanted AS (SELECT DISTINCT array_to_string(string_split(path, '/')[2:3], '/') AS module FROM paths),
      folders AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:3], '/') AS folder FROM paths),
      hits AS (SELECT module, folder FROM wanted JOIN folders ON folder = module OR ends_with(folder, '/' || module))
    SELECT module, min(folder) AS file FROM hits GROUP BY 1 HAVING count(DISTINCT folder) = 1""")
def suffix_module_join(spark, sf_dir):
    own = paths(spark, sf_dir)
    part = lambda i, n: F.array_join(F.slice(F.split("path", "/"), i, n), "/")
    wanted, folders = own.select(part(2, 2).alias("module")).distinct(), own.select(part(1, 3).alias("folder")).distinct()
    return resolve.unique_target(resolve.suffix_match(wanted, "module", folders, "folder"), ["module"], "file")


@query("""
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
      spans AS (SELECT user_id, event_type AS span, min(nth) AS a, max(nth) AS b FROM e GROUP BY ALL)
    SELECT event_id, span FROM e JOIN spans USING (user_id) WHERE nth BETWEEN a AND b""")
def interval_assign(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    spans = e.groupBy("user_id", F.col("event_type").alias("span")).agg(F.min("nth").alias("a"), F.max("nth").alias("b"))
    return resolve.in_intervals(e, spans, ["user_id"], "nth", "a", "b").select("event_id", "span")


@query("""
    SELECT o_orderkey, count(*) AS calls FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3) GROUP BY 1""")
def possible_callers_anti(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    confirmed = l.filter("l_suppkey = 3").select("l_orderkey")
    maybe = resolve.possible_callers(l, confirmed, "l_orderkey")
    return maybe.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey")), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("calls"))


@query(r"""
    WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS call FROM documents),
      known AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS call FROM benchmark)
    SELECT doc_id, count(*) AS unresolved, min(call) AS first FROM w
    WHERE call NOT IN (SELECT call FROM known) AND lower(call) NOT IN ('the', 'of', 'and', 'de', 'la', 'der', 'und') GROUP BY 1""")
def unresolved_calls_anti(spark, sf_dir):
    words = lambda t, *keep: table(spark, sf_dir, t).select(*keep, F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("call")).distinct()
    noise = F.lower("call").isin("the", "of", "and", "de", "la", "der", "und")
    left = resolve.unresolved_calls(words("documents", "doc_id"), words("benchmark"), "call", noise)
    return left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("unresolved"), F.min("call").alias("first"))


@query(f"""
    WITH {EDGES_SQL}
    (SELECT src AS node FROM edges WHERE dst IN ('nation/3', 'nation/5') UNION SELECT dst FROM edges WHERE src IN ('nation/3', 'nation/5'))
    EXCEPT SELECT src FROM edges WHERE starts_with(src, 'customer/') AND dst = 'nation/5'""")
def related_difference(spark, sf_dir):
    own, two = edges(spark, sf_dir), ("nation/3", "nation/5")
    known = own.filter(F.startswith("src", F.lit("customer/")) & (F.col("dst") == "nation/5")).select(F.col("src").alias("node"))
    return traverse.related(own, spark.createDataFrame([(n,) for n in two], "node string"), known)


@query("""
    SELECT l_partkey, CASE WHEN count(DISTINCT l_returnflag) = 1 AND count(l_returnflag) = count(*) THEN min(l_returnflag) END AS flag FROM lineitem GROUP BY 1""")
def conflict_to_null(spark, sf_dir):
    return resolve.conflict_to_null(table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("flag")), ["l_partkey"], "flag")


@query("SELECT user_id, event_type, min(event_id) AS seq FROM events GROUP BY ALL")
def ordered_dedupe(spark, sf_dir):
    return resolve.first_seen(table(spark, sf_dir, "events").withColumnRenamed("event_id", "seq"), ["user_id", "event_type"], "seq")


@query("""
    WITH v AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p FROM orders),
      a AS (SELECT * FROM v WHERE k % 3 <> 0), b AS (SELECT k, c, CASE WHEN k % 5 = 0 THEN p + 1 ELSE p END AS p FROM v WHERE k % 4 <> 0 OR k % 3 = 0)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.c <> b.c OR a.p <> b.p""")
def manifest_diff(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p"))
    after = v.filter("k % 4 <> 0 OR k % 3 = 0").withColumn("p", F.when(F.col("k") % 5 == 0, F.col("p") + 1).otherwise(F.col("p")))
    return changes.manifest_diff(v.filter("k % 3 <> 0"), after, "k", ["c", "p"])


@query("""
    WITH old AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
      new AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
    SELECT k, v FROM new UNION ALL SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new)""")
def incremental_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    old = o.filter("v % 2 = 0").groupBy("k").agg(F.max("v").alias("v"))
    return changes.upserted(old, o.filter("v % 2 = 1"), "k", ["v"])


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def invalidate_files(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return changes.without_files(table(spark, sf_dir, "lineitem"), gone, "l_orderkey").select("l_orderkey", "l_partkey", "l_linenumber")


@query("""
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
    SELECT user_id AS path, arg_max(event_type, ts) AS action, max(ts) AS ts, count(*) AS events FROM s GROUP BY user_id, run""")
def debounce_last_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("action"), "ts")
    return debounced(e, gap="6 hours")


@query("SELECT date_trunc('day', ts) AS batch, bool_or(event_type = 'purchase' AND value > 45) AS relink, count(*) AS events FROM events GROUP BY 1")
def change_feed_relink_flag(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("batch", F.date_trunc("day", "ts"))
    return changes.relink_flags(e, "batch", (F.col("event_type") == "purchase") & (F.col("value") > 45))


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS methods, count(*) AS handlers FROM lineitem GROUP BY 1")
def route_grouping(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.array("l_returnflag").alias("methods"), F.col("l_returnflag").alias("nth"))
    one = rollup.merged(l, ["l_orderkey"], "nth", ["methods"], [F.count(F.lit(1)).alias("handlers")])
    return one.select("l_orderkey", F.array_join("methods", ",").alias("methods"), "handlers")


@query(f"""
    WITH {PATHS_SQL}, t AS (SELECT id, string_split(path, '/') AS a, CASE WHEN id % 2 = 0 THEN string_split(path, '/')[3:4] ELSE [name] END AS b FROM paths),
      u AS (SELECT id, a[1:3] AS a, b FROM t)
    SELECT id, '/' || array_to_string(CASE WHEN a[3:3] = b[1:1] THEN list_concat(a, b[2:]) ELSE list_concat(a, b) END, '/') AS full_url FROM u""")
def mount_prefix_combine(spark, sf_dir):
    parts = F.split("path", "/")
    prefix = F.array_join(F.slice(parts, 1, 3), "/")
    url = F.when(F.col("id") % 2 == 0, F.array_join(F.slice(parts, 3, 2), "/")).otherwise(F.col("name"))
    return paths(spark, sf_dir).select("id", C.joined_url(prefix, url).alias("full_url"))


@query("""
    WITH m AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 'app' ELSE 'v' || s_suppkey % 100 END AS var FROM supplier),
      c AS (SELECT c_custkey AS route, c_nationkey, 'v' || c_custkey % 100 AS var FROM customer),
      hit AS (SELECT s_suppkey, route FROM m JOIN c ON c_nationkey = s_nationkey AND c.var = m.var)
    SELECT * FROM hit
    UNION ALL SELECT s_suppkey, route FROM m JOIN c ON c_nationkey = s_nationkey WHERE m.var = 'app' AND s_suppkey NOT IN (SELECT s_suppkey FROM hit)""")
def middleware_fallback_join(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("file"), F.when(F.col("s_suppkey") % 3 == 0, "app").otherwise(F.concat(F.lit("v"), F.col("s_suppkey") % 100)).alias("var"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("route"), F.col("c_nationkey").alias("file"), F.concat(F.lit("v"), F.col("c_custkey") % 100).alias("var"))
    return resolve.or_fallback(m, c, ["file"], "var", F.col("var") == "app").select("s_suppkey", "route")


_SIGNALS = [("mail", "@"), ("list", "\n- "), ("link", "http"), ("table", " | "), ("code", "{")]


@query("""
    WITH s(name, sign) AS (VALUES ('mail', '@'), ('list', chr(10) || '- '), ('link', 'http'), ('table', ' | '), ('code', '{'))
    SELECT doc_id, string_agg(name, ',' ORDER BY name) AS frameworks FROM documents JOIN s ON contains(text, sign) GROUP BY 1""")
def framework_signals(spark, sf_dir):
    found = signals(F.col("text"), {name: [sign] for name, sign in _SIGNALS})
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("frameworks")).filter("frameworks <> ''")


@query(f"""
    WITH t AS (SELECT page_id, list_transform({_HREF_SQL}, lambda h: {_VALUE_SQL}) AS calls FROM pages)
    SELECT page_id, len(calls) AS calls, len(list_distinct(calls)) AS distinct_calls, array_to_string(calls[1:5], ' ') AS first_calls FROM t""")
def regex_extract_calls(spark, sf_dir):
    calls = table(spark, sf_dir, "pages").select("page_id", C.href_values(F.col("html")).alias("c"))
    return calls.select("page_id", F.size("c").cast("long").alias("calls"), F.size(F.array_distinct("c")).cast("long").alias("distinct_calls"), F.array_join(F.slice("c", 1, 5), " ").alias("first_calls"))


_PROBE = "small rnig"


@query()
def fuzzy_suggestions(spark, sf_dir):
    """The five part names most like a mistyped one, by the ratio of matching blocks."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("text")).distinct()
    return resolve.most_alike(names, "text", _PROBE, 0.6, 5).select(F.col("text").alias("name"), F.col("like").alias("ratio"))


@query("SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'widget' THEN 0 ELSE 1 END AS rank FROM part WHERE contains(lower(p_name), 'widget')")
def keyword_search(spark, sf_dir):
    hits = resolve.with_keyword(table(spark, sf_dir, "part"), "p_name", "widget")
    return hits.select("p_partkey", "p_name", "rank")
