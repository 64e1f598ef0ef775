import random
from collections import deque

import pytest

from loomgraph.operators import traverse
from loomgraph.operators.adjacency import Adjacency, Steps
from loomgraph.plans.code_graph import build_from
from loomgraph.plans.questions import CodeStructure


def graph(spark, n=3000, hub=400, seed=1):
    rnd = random.Random(seed)
    rows = {(f"n{rnd.randrange(900)}", f"n{rnd.randrange(900)}", rnd.choice(["executable", "generated", "structural"])) for _ in range(n)}
    rows |= {(f"n{i}", "hub", "executable") for i in range(hub)}
    return sorted(rows), spark.createDataFrame([(*r, i % 5) for i, r in enumerate(sorted(rows))], "src string, dst string, edge_class string, seq long")


def plain(rows, seed, depth, direction):
    steps = {}
    for a, b, kind in rows:
        if kind != "structural":
            x, y = (a, b) if direction == "callees" else (b, a)
            steps.setdefault(x, []).append(y)
    hops, queue = {seed: 0}, deque([seed])
    while queue:
        at = queue.popleft()
        for b in steps.get(at, ()):
            if b not in hops and (not depth or hops[at] < depth):
                hops[b] = hops[at] + 1
                queue.append(b)
    return {k: v for k, v in hops.items() if v}


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    rows, edges = graph(spark)
    return rows, edges, Adjacency.write(edges, "file://" + str(tmp_path_factory.mktemp("adjacency")), chunk=16, bucket=200)


@pytest.mark.parametrize("direction", ["callers", "callees"])
@pytest.mark.parametrize("few", [5, 400])
def test_walks_over_kept_steps_equal_plain_ones(spark, kept, monkeypatch, direction, few):
    monkeypatch.setattr("loomgraph.operators.adjacency.FEW", few)
    rows, edges, steps = kept
    for seed in ("hub", "n1"):
        got = traverse.bfs(steps, spark.createDataFrame([(seed,)], "node string"), 2, direction)
        assert {r["node"]: r["hop"] for r in got.collect()} == plain(rows, seed, 2, direction)
        assert traverse.first_reached(steps, seed, 2, 50, direction) == traverse.first_reached(edges, seed, 2, 50, direction)
    assert traverse.shortest_path(steps, "n3", "hub") == traverse.shortest_path(edges, "n3", "hub")


def test_a_walk_moves_no_edges_and_reads_few_buckets(spark, kept):
    _, edges, steps = kept
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = steps.after(spark.range(2000).selectExpr("concat('n', id) AS node"), 2000, "callers")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = plan[plan.index("SortMergeJoin") :].split("Scan parquet")
    tables = [i for i, part in enumerate(side[1:], 1) if "adjacency" in part.split("ReadSchema")[0] and "key:string" in part]
    assert tables and all("Exchange" not in side[i - 1].rsplit("Join", 1)[-1] for i in tables[:1])
    assert f"SelectedBucketsCount: {steps.meta['buckets']} out of" in plan or "Bucketed: true" in plan
    one = steps.of(["n5"], "callees")._jdf.queryExecution().executedPlan().toString()
    assert f"SelectedBucketsCount: 1 out of {steps.meta['buckets']}" in one or "Bucketed: false (disabled by query planner)" in one


def test_a_hub_is_dealt_out_to_many_buckets(spark, kept):
    _, _, steps = kept
    assert {r["node"] for r in steps.hubs["callers"].collect()} >= {"hub"}
    sizes = [r["count"] for r in steps.tables["callers"].groupBy("key").count().collect()]
    assert max(sizes) <= 3 * 16
    of_file = steps.tables["callers"].selectExpr("input_file_name() AS f").groupBy("f").count().collect()
    counts = sorted(r["count"] for r in of_file)
    assert counts[-1] <= 3 * counts[len(counts) // 2]


def test_no_steps(spark, tmp_path):
    none = spark.createDataFrame([], "src string, dst string, edge_class string, seq long")
    for steps in (Steps(none), Adjacency.write(none, f"file://{tmp_path}/none")):
        assert traverse.bfs(steps, spark.createDataFrame([("a",)], "node string"), 0).collect() == []
        assert traverse.first_reached(steps, "a", 2, 5) == ([], False) and traverse.shortest_path(steps, "a", "b") == []


def test_direct_neighbours_are_counted_beyond_the_limit(spark):
    """300 callers are shown whole; of 350, 300 are, but all are counted."""
    for n in (300, 350):
        source = "def target():\n    return 1\n\n" + "".join(f"def f{i}():\n    return target()\n\n" for i in range(n))
        meta = CodeStructure(build_from(spark, {"a.py": source})).impact("target")["meta"]
        assert (meta["direct"], meta["total"], meta["truncated"]) == (n, 300, n > 300)


def test_mounts_of_any_length_and_on_cycles(spark):
    long = "/" + "x" * 5000
    sources = {
        "main.py": f"from fastapi import FastAPI\nfrom a import router as ra\nfrom b import router as rb\napp = FastAPI()\napp.include_router(ra, prefix='{long}')\napp.include_router(rb, prefix='/b')\n",
        "a.py": "from fastapi import APIRouter\nfrom deep import router as rd\nrouter = APIRouter()\nrouter.include_router(rd, prefix='/deep')\n@router.get('/one')\ndef one():\n    pass\n",
        "deep.py": "from fastapi import APIRouter\nrouter = APIRouter()\n@router.get('/two')\ndef two():\n    pass\n",
        "b.py": "from fastapi import APIRouter\nfrom c import router as rc\nrouter = APIRouter()\nrouter.include_router(rc, prefix='/c')\n@router.get('/three')\ndef three():\n    pass\n",
        "c.py": "from fastapi import APIRouter\nfrom b import router as rb\nfrom d import router as rd\nrouter = APIRouter()\nrouter.include_router(rb, prefix='/again')\nrouter.include_router(rd, prefix='/d')\n",
        "d.py": "from fastapi import APIRouter\nrouter = APIRouter()\n@router.get('/four')\ndef four():\n    pass\n",
    }
    got = {r["name"]: r["full_url"] for r in build_from(spark, sources).nodes.filter("kind = 'Route'").collect()}
    assert got["/one"] == long + "/one" and got["/two"] == long + "/deep/two"
    assert got["/three"] is None and got["/four"] is None  # each turn of the cycle makes a prefix longer, so there are several
