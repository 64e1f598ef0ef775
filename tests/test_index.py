import json

from loomgraph.plans.index import WorkspaceIndex
from loomgraph.sources.workspace import read_changes


def test_index_through_its_life(spark, tmp_path):
    root, folder = tmp_path / "ws", tmp_path / "index"
    root.mkdir()
    (root / "a.py").write_text("def work():\n    return 1\n")
    (root / "use.py").write_text("from a import work\n\ndef main():\n    return work()\n")
    index = WorkspaceIndex(spark, str(root), str(folder))
    assert index.meta() is None and not index.is_stale()
    assert index.refresh() == {"mode": "cold", "parsed": 2, "removed": 0, "failed": []}
    assert index.structure().impact("work")["affected"] == {"use.py": ["main [Function] L3-4 depth=1"]}
    assert WorkspaceIndex(spark, str(root), str(folder)).refresh()["mode"] == "warm"

    (root / "pkg").mkdir()
    (root / "pkg/a.py").write_text("def work():\n    return 2\n")
    (root / "use.py").write_text("from pkg.a import work\n\n\ndef main():\n    return work()\n")
    assert index.drain(read_changes(spark, str(root)), str(tmp_path / "at")) == [{"mode": "incremental", "parsed": 2, "removed": 0, "failed": []}]
    assert index.structure().impact("pkg/a.py:work")["affected"] == {"use.py": ["main [Function] L4-5 depth=1"]}
    assert index.structure().impact("a.py:work")["meta"]["total"] == 0

    (root / "pkg/a.py").write_bytes(b"def work():\n    return '\xff'\n")
    (root / "a.py").unlink()
    got = index.refresh()
    assert got["failed"] == ["pkg/a.py"] and got["removed"] == 1
    answer = index.structure().impact("work")
    assert answer["meta"]["total"] == 1 and "keep their last good state" in answer["meta"]["warnings"][0]
    (root / "pkg/a.py").write_text("def work():\n    return 3\n")
    assert index.refresh()["failed"] == [] and index.warnings() == ()

    meta = json.loads((folder / "index.json").read_text())
    (folder / "index.json").write_text(json.dumps(meta | {"dirty": True}))
    assert index.is_stale() and index.refresh()["mode"] == "cold" and not index.is_stale()
    (folder / "index.json").write_text("[")
    assert index.is_stale() and index.refresh()["mode"] == "cold"


def test_answers_by_kept_keys_equal_those_by_all_nodes(spark, tmp_path):
    root = tmp_path / "ws"
    (root / "pkg/sub").mkdir(parents=True)
    (root / "pkg/a.py").write_text("class Tool:\n    def Run(self):\n        def inner():\n            return 1\n        return inner()\n\ndef run():\n    return 2\n")
    (root / "pkg/sub/a.py").write_text("class Tool:\n    def stop(self):\n        return 1\n\ndef Run():\n    return 2\n")
    (root / "pkg/api.py").write_text("from fastapi import FastAPI\napp = FastAPI()\n@app.get('/things/')\ndef things():\n    return []\n")
    index = WorkspaceIndex(spark, str(root), str(tmp_path / "index"))
    index.refresh()
    kept = index.structure()
    plain = index.structure()
    plain.keys = None
    for text in ("run", "Run", "RUN", "Tool", "Tool.Run", "tool.run", "inner", "Run.inner", "Tool.Run.inner", "a.py", "sub/a.py", "pkg", "pkg/", "sub", "pkg/a.py", "a.py:run", "pkg/a.py:Tool.Run", "sub/a.py:tool", "a.py:Tool", "/things/", "things", "nothing", "", ":", "a.py:", "./pkg/a.py:run"):
        for path in (None, "pkg/sub"):
            ids = [sorted(r["id"] for r in s.matches(text, path).collect()) for s in (kept, plain)]
            assert ids[0] == ids[1], (text, path)
    plan = kept.keys.filter("key = 'nrun'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,nrun)]" in plan


def test_a_damaged_state_gives_way_to_the_one_before(spark, tmp_path):
    root, folder = tmp_path / "ws", tmp_path / "index"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    return 1\n")
    index = WorkspaceIndex(spark, str(root), str(folder))
    index.refresh()
    first = index.meta()["state"]
    (root / "a.py").write_text("def two():\n    return 2\n")
    index.refresh()
    assert index.damage(index.meta()["state"], deep=True) == [] and index.structure().contains("a.py:two")
    hurt = max((folder / index.meta()["state"] / "nodes").glob("*.parquet"), key=lambda p: p.stat().st_size)
    whole = hurt.read_bytes()
    hurt.write_bytes(whole[:-1] + b"X")
    assert index.damage(index.meta()["state"]) == [] and index.damage(index.meta()["state"], deep=True) == [f"nodes/{hurt.name}"]
    hurt.write_bytes(whole[: len(whole) // 2])
    s = index.structure()
    assert s.contains("a.py:one") and "is damaged (nodes/" in s._meta()["warnings"][0]
    assert index.refresh()["mode"] == "cold" and index.structure().contains("a.py:two")
    assert (folder / first).exists()  # someone may still read it
