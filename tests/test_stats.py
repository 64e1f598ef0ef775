import random

from loomgraph.operators import traverse
from loomgraph.plans import star_graph, star_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def told(rows):
    known = {}
    for src, dst, kind in rows:
        n, sources, targets = known.setdefault(kind, (0, set(), set()))
        known[kind] = (n + 1, sources | {src} - {None}, targets | {dst} - {None})
    return {k: (n, len(a), len(b)) for k, (n, a, b) in known.items()}


def found(df):
    return {r["edge_class"]: (r["edges"], r["sources"], r["targets"]) for r in df.collect()}


def test_stats_equal_plain_counts_however_they_are_dealt_out(spark, monkeypatch):
    """tasks grow in number with the edges, whatever the session's number of partitions; nulls are no nodes, but their edges count."""
    rnd = random.Random(19)
    end = lambda: rnd.choice([None, "hub", "hub", *(f"n{i}" for i in range(60))])
    rows = [(end(), end(), rnd.choice(["executable", "structural", None])) for _ in range(500)] + [(None, None, "bare")]
    edges = spark.createDataFrame(rows, "src string, dst string, edge_class string")
    assert found(traverse.stats(edges)) == told(rows)
    monkeypatch.setattr(traverse, "EDGES", 50)
    assert "id#" in (p := plan(own := traverse.stats(edges))) and ", 11), REPARTITION_BY_NUM" in p
    assert found(own) == told(rows) and ", 20), REPARTITION_BY_NUM" in plan(traverse.stats(edges, 1000))
    assert own.columns == ["edge_class", "edges", "sources", "targets"] and traverse.stats(edges.limit(0)).count() == 0


def test_edges_are_made_distinct_by_key_in_tasks_of_a_bounded_size(spark, monkeypatch):
    """the edges of the tables, and graph_stats over them."""
    rows = set()
    for name, (a, k), (b, l), kind in star_graph._PAIRS:
        rows |= {(f"{a}/{r[k]}", f"{b}/{r[l]}", kind) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(k, l).collect()}
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(traverse, "EDGES", 500)
    own, most = star_graph.counted_edges(spark, SF)
    assert most >= len(rows) and sorted(map(tuple, own.collect())) == sorted(rows)
    p = plan(own)
    for keys in ("l_orderkey", "l_partkey"), ("l_partkey", "l_suppkey"):
        assert any(f"hashpartitioning({keys[0]}#" in x and f", {keys[1]}#" in x and f", {-(-lines // 500)}), REPARTITION_BY_NUM" in x for x in p.splitlines())
    stats = star_queries.graph_stats(spark, SF)
    assert found(stats) == told(rows) and f", {-(-most // 500)}), REPARTITION_BY_NUM" in plan(stats)
