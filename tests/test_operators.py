import os
import random
from collections import deque

from pyspark.sql import functions as F

from loomgraph.functions import columns as C
from loomgraph.operators import changes, resolve, rollup, traverse
from loomgraph.sources.workspace import listing, read_changes, read_workspace
from loomgraph.streaming.debounce import debounced


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_columns(spark):
    lit = F.lit
    assert one(spark, *[C.normalize_path(lit(p), "/ws") for p in ("./a//", "/ws/a/b", "/ws", "a\\b", "", "./././x")]) == ["a", "a/b", ".", "a/b", ".", "x"]
    assert one(spark, *[C.is_under(lit(p), "src") for p in ("src", "src/a", "srcx", "a/src")]) == [True, True, False, False]
    assert one(spark, C.ancestors(lit("a/b/c")), C.ancestors(lit("a")), C.suffixes(lit("a/b"))) == [["a", "a/b"], [], ["a/b", "b"]]
    assert one(spark, C.qualified_name(lit("f.py:A.b"), lit("f.py")), C.display_name(lit("App.callback_L1_C2.go"))) == ["A.b", "App.go"]
    assert one(spark, C.truncated(lit("abcdefgh"), 6), C.lines_span(lit(3), lit(9)), C.lines_span(lit(3), lit(3))) == ["abc...", "3-9", "3"]
    urls = ("/api/users/:id/", "users/<int:pk>", "/apix/7", "/", "/a/{x}/b")
    assert one(spark, *[C.normalize_url(lit(u)) for u in urls]) == ["/users/{id}", "/users/{id}", "/apix/7", "/", "/a/{id}/b"]
    pairs = [("/a", "/a"), ("/a/1", "/a/{id}"), ("/a/b/c", "/a/b"), ("/a", "/a/b"), ("/x/a", "/a"), ("/a", "/x/a"), ("/", "/a"), ("/ab", "/a")]
    assert one(spark, *[C.url_score(lit(a), C.normalize_url(lit(a), True), lit(b)) for a, b in pairs]) == [100, 95, 50, 40, 35, 30, None, None]


def test_bfs_equals_a_plain_search(spark):
    rnd = random.Random(3)
    pairs = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(50)]
    edges = spark.createDataFrame([(a, b, "executable") for a, b in pairs] + [("n0", "far", "structural")], "src string, dst string, edge_class string")
    for depth in (0, 2):
        hops, queue = {"n0": 0}, deque(["n0"])
        while queue:
            at = queue.popleft()
            for a, b in pairs:
                if a == at and b not in hops and (not depth or hops[at] < depth):
                    hops[b] = hops[at] + 1
                    queue.append(b)
        got = {r["node"]: r["hop"] for r in traverse.bfs(edges, spark.createDataFrame([("n0",)], "node string"), depth, "callees").collect()}
        assert got == {k: v for k, v in hops.items() if v}


def test_closure_ends_on_cycles(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("x", "c")], "child string, parent string")
    got = {(r["node"], r["ancestor"]): r["distance"] for r in traverse.closure(parents).collect()}
    assert got[("x", "c")] == 1 and got[("x", "b")] == 2 and got[("a", "c")] == 2 and ("a", "a") not in got


def test_ties_stay_open(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (2, "a", 5), (2, "b", 4), (3, "a", 0)], "k int, target string, score int")
    assert {r["k"]: r["target"] for r in resolve.best_scored(rows, ["k"], "score", "target").collect()} == {1: None, 2: "a", 3: None}
    assert [r["k"] for r in resolve.unique_target(rows, ["k"], "target").collect()] == [3]
    types = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, None), (3, "a"), (3, "b")], "k int, t string")
    assert {r["k"]: r["t"] for r in resolve.conflict_to_null(types, ["k"], "t").collect()} == {1: "a", 2: None, 3: None}


def test_most_alike_equals_comparing_all(spark):
    import difflib

    rnd = random.Random(11)
    names = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 14))) for _ in range(200)]
    got = [(r["text"], round(r["like"], 9)) for r in resolve.most_alike(spark.createDataFrame([(n,) for n in sorted(set(names))], "text string"), "text", "abc dab", 0.6, 5).collect()]
    want = sorted(((difflib.SequenceMatcher(None, n, "abc dab").ratio(), n) for n in set(names)), reverse=True)
    assert got == [(n, round(x, 9)) for x, n in want if x >= 0.6][:5] and got


def test_rollup_and_changes(spark):
    files = spark.createDataFrame([("a/b/x",), ("a/y",), ("z",)], "path string")
    assert {r["folder"]: r["files"] for r in rollup.by_folder(files).collect()} == {"a": 2, "a/b": 1}
    old = spark.createDataFrame([("a.ts", 1), ("a.tsx", 1), ("b.ts", 1)], "file_path string, v int")
    gone = spark.createDataFrame([("a.ts",)], "file_path string")
    assert {r["file_path"] for r in changes.without_files(old, gone).collect()} == {"a.tsx", "b.ts"}
    new = spark.createDataFrame([("b.ts", 2), ("c.ts", 1)], "file_path string, v int")
    assert {r["file_path"]: r["change"] for r in changes.manifest_diff(old, new, "file_path", ["v"]).collect()} == {"a.ts": "removed", "a.tsx": "removed", "b.ts": "changed", "c.ts": "added"}


def test_workspace_source_and_changes(spark, tmp_path):
    for name, text in {"a.py": "x = 1\n", "pkg/__init__.py": "", "node_modules/n.js": "", "env/ok.py": "", "venv/pyvenv.cfg": "", "venv/no.py": "", "t.d.ts": "", "data.csv": "", ".hid/h.py": "", "mine/m.py": ""}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    root = str(tmp_path)
    assert list(listing(root, ("mine",))) == ["a.py", "env/ok.py", "pkg/__init__.py"]
    got = {r["path"]: r for r in read_workspace(spark, root, ("mine",)).collect()}
    assert bytes(got["a.py"]["content"]) == b"x = 1\n" and got["a.py"]["mtime_ns"] == os.stat(tmp_path / "a.py").st_mtime_ns and not got["a.py"]["torn"]

    seen, where = [], tmp_path / ".check"

    def drain():
        q = read_changes(spark, root).writeStream.foreachBatch(lambda df, _: seen.append({tuple(r) for r in df.collect()})).option("checkpointLocation", str(where)).trigger(availableNow=True).start()
        q.awaitTermination()

    drain()
    assert ("a.py", "update") in set().union(*seen)
    seen.clear()
    (tmp_path / "a.py").write_text("x = 22\n")
    (tmp_path / "env/ok.py").unlink()
    drain()
    assert set().union(*seen) == {("a.py", "update"), ("env/ok.py", "delete")}


def test_debounce_keeps_the_last_event(spark):
    rows = [("a", "update", 0.0), ("a", "update", 0.3), ("a", "delete", 0.6), ("a", "update", 2.0), ("b", "delete", 0.1)]
    events = spark.createDataFrame(rows, "path string, action string, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r["path"], r["action"], r["events"]) for r in debounced(events).collect()) == [("a", "delete", 3), ("a", "update", 1), ("b", "delete", 1)]


def test_names_that_hold_words_are_found_alike_by_automaton_and_by_parts(spark):
    from loomgraph.operators.urls import named_answers

    rnd = random.Random(5)
    words = ["get", "user", "users", "order_item", "city", "cities", "a", "go", "box", "boxes", "x-ray", "ü"]
    verbs = ["get_", "list_", "create_", "delete_", "", "fetch_all_"]
    names = [(f"{rnd.choice(['a.py', 'modules/user/b.py', 'tests/c.ts', 'models.py'])}:{n}", n, rnd.choice(["a.py", "modules/user/b.py", "tests/c.ts", "models.py"]), rnd.choice(["Function", "Class"])) for n in {rnd.choice(verbs) + rnd.choice(words).replace("-", "_") + rnd.choice(["", "s", "_by_id"]) for _ in range(60)}]
    calls = [(rnd.choice(["GET", "POST", "DELETE"]), "/" + "/".join(rnd.choice([*words, "{id}", "api", "Users"]) for _ in range(rnd.randint(1, 3)))) for _ in range(80)] + [("GET", "/"), ("GET", "/{id}")]
    c = spark.createDataFrame(calls, "method string, call string")
    n = spark.createDataFrame(names, "target string, name string, file string, kind string")
    e = spark.createDataFrame([(names[0][0], "get"), (names[1][0], "POST")], "target string, method string")
    one, two = ({tuple(r) for r in named_answers(c, n, e, most).select("method", "call", "target", "score").collect()} for most in (1000, 3))
    assert one == two and len(one) > 5
    assert named_answers(c.limit(0), n, e).collect() == [] and named_answers(c, n.limit(0), e).collect() == []


def test_large_groups_are_dealt_out_to_many_tasks(spark):
    left = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 1), ("c", 2), (None, 3)], "k string, x int")
    right = spark.createDataFrame([("a", i) for i in range(90)] + [("b", i) for i in range(5)] + [(None, 1)], "k string, y int")
    got = resolve.all_pairs(left, right, ["k"], 32)
    want = {("a", i, j) for i in range(300) for j in range(90)} | {("b", 1, j) for j in range(5)}
    assert got.count() == len(want) and {tuple(r) for r in got.select("k", "x", "y").collect()} == want
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < got.count() / 4
    m = spark.createDataFrame([(i, "f", "app" if i < 90 else "v") for i in range(100)], "id int, file string, var string")
    c = spark.createDataFrame([(i, "f", "v" if i < 5 else "w") for i in range(80)], "route int, file string, var string")
    found = {tuple(r) for r in resolve.or_fallback(m, c, ["file"], "var", F.col("var") == "app").select("id", "route").collect()}
    assert found == {(i, j) for i in range(90) for j in range(80)} | {(i, j) for i in range(90, 100) for j in range(5)}


def test_many_words_make_no_row_for_each_part_of_a_name(spark):
    from loomgraph.operators import urls

    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghé_") for _ in range(rnd.randint(1, 12)))
    words = sorted({word() for _ in range(150)})
    names = sorted({word() + rnd.choice(words) + word() for _ in range(300)} | set(words[:20]))
    got = urls._held_words(spark.createDataFrame([(n,) for n in names], "lower string"), spark.createDataFrame([(w,) for w in words], "variant string"), 10)
    rows = [tuple(r) for r in got.collect()]
    want = {(n, w) for n in names for w in words if w in n and (len(w) > 2 or w == n)}
    assert len(rows) == len(set(rows)) and want <= set(rows) and len(want) > 300
    assert len(rows) < 0.2 * sum(len(n) * (len(n) + 1) // 2 for n in names)


def test_workers_started_elsewhere_find_the_package(tmp_path):
    """with many words the functions that run in workers are this package's, which lies on the driver's path only."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from loomgraph.operators.urls import named_answers
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {"file://" + str(tmp_path)!r}).getOrCreate()
names = spark.createDataFrame([(f"a.py:get_{{w}}", f"get_{{w}}", "a.py", "Function") for w in ("box", "city", "order")], "target string, name string, file string, kind string")
calls = spark.createDataFrame([("GET", f"/{{w}}") for w in ("box", "city", "order")], "method string, call string")
print(sorted(r["target"] for r in named_answers(calls, names, spark.createDataFrame([], "target string, method string"), 2).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.strip() == "['a.py:get_box', 'a.py:get_city', 'a.py:get_order']", done.stderr[-2000:]
