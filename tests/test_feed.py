import os
import time

from loomgraph.plans.index import WorkspaceIndex
from loomgraph.sources.feed import ChangeFeed
from loomgraph.sources.listing import listing_table
from loomgraph.sources.workspace import listing


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_listing_by_tasks_equals_a_walk(spark, tmp_path):
    for name in ["a.py", "pkg/__init__.py", "node_modules/n.js", "env/ok.py", "venv/pyvenv.cfg", "venv/no.py", "t.d.ts", "x.csv", ".hid/h.py", "mine/m.py", "d/e/f/g.ts", "d/e/h.md", "d/i.lang", "u ü/ö.py"]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    want = {(p, *s) for p, s in listing(str(tmp_path), ("mine",)).items()}
    for at_once in (1, 4, 10_000):
        assert rows(listing_table(spark, str(tmp_path), ("mine",), at_once=at_once)) == want and want
    assert rows(listing_table(spark, f"file://{tmp_path}", ("mine",))) == want
    assert {r[0] for r in rows(listing_table(spark, str(tmp_path), endings=(".lang",)))} >= {"d/i.lang"}
    assert rows(listing_table(spark, str(tmp_path / "none"))) == set()


def test_feed_has_moves_and_small_offsets(spark, tmp_path):
    root, folder = tmp_path / "ws", tmp_path / "feed"
    root.mkdir()
    for i in range(300):
        (root / f"file_with_a_long_name_{i:04}.py").write_text("x = 1\n")
    feed = ChangeFeed(spark, str(root), str(folder))
    assert feed.poll() == 300 and feed.poll() == 0 and feed.version == 1
    os.rename(root / "file_with_a_long_name_0007.py", root / "moved.py")
    assert feed.poll() == 2
    seen = []
    q = feed.stream().writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.select("path", "action", "poll").collect()))).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 302 and {x[:2] for x in seen if x[2] == 2} == {("file_with_a_long_name_0007.py", "delete"), ("moved.py", "update")}
    assert max(p.stat().st_size for p in (tmp_path / "at" / "offsets").iterdir()) < 1500


def test_bursts_retries_and_a_restart(spark, tmp_path):
    root = tmp_path / "ws"
    root.mkdir()
    (root / "a.py").write_text("def work():\n    return 1\n")
    index = WorkspaceIndex(spark, str(root), str(tmp_path / "index"))
    index.refresh()
    feed, got = index.feed(str(tmp_path / "feed")), []
    feed.poll()

    def run(until, most=300):
        q = index.follow(feed, str(tmp_path / "at"), gap=3.0, retry=1.0, done=got.append)
        end = time.time() + most
        try:
            while not until() and time.time() < end:
                time.sleep(1.5)
                q.exception() and q.awaitTermination()
        finally:
            q.stop()
        return until()

    assert run(lambda: got), "the first listing settles"
    assert {g["mode"] for g in got} == {"warm"}
    got.clear()
    for i in range(3):  # a burst: three events, of which the last one counts
        (root / "a.py").write_text(f"def work():\n    return {'1' * (i + 2)}\n")
        feed.poll()
    (root / "b.py").write_bytes(b"x = '\xff'\n")
    feed.poll()
    assert run(lambda: any(g["mode"] == "incremental" for g in got))
    assert sum(g["mode"] == "incremental" for g in got) <= 2
    (root / "b.py").write_text("def other():\n    return 2\n")  # no event tells of it: the retry finds it mended
    assert run(lambda: any(g["parsed"] and not g["failed"] for g in got) and index.structure().contains("b.py:other"))
    assert index.warnings() == ()
