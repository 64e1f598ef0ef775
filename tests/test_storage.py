from pyspark.sql import functions as F

from loomgraph import storage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_that_only_look_small_are_not_sent_through_the_driver(spark):
    """files of some hundred KB can hold rows of many MB, as texts that repeat take little room."""
    rows = storage.cut(spark.range(200_000).select(F.concat(F.lit("src/suppliers/s"), F.col("id"), F.lit(".py:make")).alias("id"), F.repeat(F.lit("def make"), 50).alias("text")))
    size = storage.signature(spark, rows.inputFiles()[0].rpartition("/")[0])[1]
    assert storage.SMALL < size < 10 << 20
    met = spark.range(1_000_000).select(F.col("id").cast("string").alias("id")).join(rows.filter("text LIKE 'def%'"), "id", "left")
    assert "BroadcastExchange" not in plan(met)
    few = storage.cut(spark.range(10).select(F.col("id").cast("string").alias("id")))
    assert "BroadcastExchange" in plan(spark.range(1_000_000).select(F.col("id").cast("string").alias("id")).join(few, "id"))
    assert met.filter("text IS NOT NULL").count() == 0 and rows.count() == 200_000


def test_questions_read_nodes_that_are_written_once(spark):
    """F18, F13, F16: no question works out anew which nodes and edges are without inline callbacks."""
    from loomgraph.plans.code_graph import build_from
    from loomgraph.plans.questions import CodeStructure, kept

    graph = build_from(spark, {"a.py": "def f():\n    return g()\n\n\ndef g():\n    return 1\n"})
    plain, own = CodeStructure(graph), CodeStructure(kept(graph))
    assert "Aggregate" in plan(plain.nodes) and "Aggregate" not in plan(own.nodes) + plan(own.edges)
    assert sorted(map(str, plain.nodes.collect())) == sorted(map(str, own.nodes.collect()))
    assert plain.impact("g", 1) == own.impact("g", 1)
