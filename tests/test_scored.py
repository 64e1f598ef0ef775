import random

from loomgraph.operators import resolve
from loomgraph.plans import star_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_scored_in_one_pass(spark):
    """candidates are grouped once, not joined with their own best; nulls count where nothing else has the top score."""
    rnd = random.Random(5)
    rows = [(k, rnd.choice([None, 1, 2, 3]), rnd.choice([None, -1, 0, 4, 10])) for k in range(200) for _ in range(rnd.randrange(1, 5))]
    known = {}
    for k in {k for k, _, s in rows if s is not None}:
        top = max(s for key, _, s in rows if key == k and s is not None)
        best = {t for key, t, s in rows if key == k and s == top and t is not None}
        known[k] = (best.pop() if len(best) == 1 and top > 0 else None, top)
    found = resolve.best_scored(spark.createDataFrame(rows, "k int, t int, s int"), ["k"], "s", "t")
    assert {r["k"]: (r["t"], r["s"]) for r in found.collect()} == known
    assert "Join" not in plan(found)


def test_lines_are_dealt_out_by_their_number(spark, monkeypatch):
    """what a task holds doesn't grow with the table."""
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(star_queries, "LINES", 500)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert f"hashpartitioning(l_orderkey#" in (p := plan(star_queries.pick_named_scored(spark, sf))) and f", {-(-lines // 500)}), REPARTITION_BY_NUM" in p
