import pytest

from loomgraph.operators import traverse
from loomgraph.plans import query_language
from loomgraph.plans.code_graph import build_from
from loomgraph.plans.query_language import QueryError, glob_regex, run
from loomgraph.plans.questions import CodeStructure

SOURCES = {
    "a/x.py": "import os\nfrom b.y import help_me as h\n\ndef one(shop):\n    Item.objects.all()\n    return h()\n\ndef two():\n    Item.objects.get()\n    return one(1)\n",
    "b/y.py": "def help_me():\n    return deep()\n\ndef deep():\n    return help_me()\n",
}


@pytest.fixture(scope="module")
def s(spark):
    return CodeStructure(build_from(spark, SOURCES))


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize(
    "pattern,fits,not_",
    [("src/**/*.py", ["src/a.py", "src/a/b.py"], ["src/a.ts", "a/src/a.py"]), ("*.{py,ts}", ["a.py", "a.ts"], ["a/b.py", "a.js"]), ("[ab]?.md", ["a1.md"], ["c1.md", "a.md"]), ("**", ["a", "a/b"], [])],
)
def test_globs(pattern, fits, not_):
    import re

    assert all(re.match(glob_regex(pattern), f) for f in fits) and not any(re.match(glob_regex(pattern), f) for f in not_)


def test_statements(s):
    assert ids(run(s, "GET id functions WHERE name != 'one' AND NOT (name == two) ORDER BY name DESC")) == ["b/y.py:help_me", "b/y.py:deep"]
    assert ids(run(s, 'SEARCH "HELP" IN symbols')) == ["b/y.py:help_me"]
    got = {r["name"]: r["callers"] for r in run(s, "GET name functions WITH callers, callees").collect()}
    assert got == {"one": ["a/x.py:two"], "two": [], "help_me": ["b/y.py:deep", "a/x.py:one"], "deep": ["b/y.py:help_me"]}
    assert ids(run(s, "AUDIT TENANT 'shop' IN 'a'")) == ["a/x.py:two"]
    assert [(r["depth"], r["node"]) for r in run(s, "FLOW FOR 'a/x.py:two' DEPTH 9").orderBy("nth").collect()] == [(0, "a/x.py:two"), (1, "a/x.py:one"), (2, "b/y.py:help_me"), (3, "b/y.py:deep")]
    assert [r["node"] for r in run(s, "PATH FROM 'a/x.py:two' TO 'b/y.py:deep'").orderBy("nth").collect()] == ["a/x.py:two", "a/x.py:one", "b/y.py:help_me", "b/y.py:deep"]
    assert run(s, "PATH FROM 'b/y.py:deep' TO 'a/x.py:two'").count() == 0
    assert run(s, "GET DISTINCT file functions LIMIT 1").count() == 1


@pytest.mark.parametrize("text", ["", "GET", "GET things", "GET functions WHERE", "GET functions WHERE colour == 'x'", "IMPACT 'a'", "GET functions LIMIT", "ENFORCE 'a MAY b'", "STATS FOR 'a' b", "GET functions WHERE name ?? 3"])
def test_faults_are_query_errors(s, text):
    with pytest.raises(QueryError):
        run(s, text)


def test_long_chains_are_followed(spark):
    pairs = [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)]
    got = {r["ancestor"]: r["distance"] for r in traverse.closure(spark.createDataFrame(pairs, "child string, parent string")).filter("node = 'c00'").collect()}
    assert got == {f"c{i:02}": i for i in range(1, 41)}


def test_walks_stop_in_the_order_of_their_edges(spark):
    rows = [("s", f"n{i:03}", "executable", i % 7) for i in range(350)] + [("n349", "far", "executable", 0)]
    edges = spark.createDataFrame(rows, "src string, dst string, edge_class string, seq int")
    found, more = traverse.first_reached(edges, "s", 3, 300, "callees")
    assert more and [n for n, _ in found] == [n for _, n in sorted((i % 7, f"n{i:03}") for i in range(350))][:300]
    found, more = traverse.first_reached(edges, "s", 3, 351, "callees")
    assert not more and found[-1] == ("far", 2) and len(found) == 351


def test_long_ways_and_deep_flows(spark):
    rows = [(f"n{i:03}", f"n{i + 1:03}", "executable", 0) for i in range(110)] + [("n110", "n100", "executable", 0)]
    edges = spark.createDataFrame(rows, "src string, dst string, edge_class string, seq int")
    assert traverse.shortest_path(edges, "n003", "n108") == [f"n{i:03}" for i in range(3, 109)]
    assert traverse.shortest_path(edges, "n108", "n003") == []
    assert [r["node"] for r in query_language.flow(edges, "n080", 15).orderBy("nth").collect()] == [f"n{i:03}" for i in range(80, 96)]
    assert query_language.flow(edges, "n108", 50).count() == 11  # the way back to n100 ends before n108 comes again
