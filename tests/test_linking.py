"""An index that follows changes equals one that is built from nothing, and links what a change touches only."""

import random

import pytest

from loomgraph.plans.index import WorkspaceIndex


class Life:
    def __init__(self, spark, tmp_path, sources):
        self.spark, self.tmp, self.root, self.n = spark, tmp_path, tmp_path / "ws", 0
        self.root.mkdir()
        self.index = WorkspaceIndex(spark, str(self.root), str(tmp_path / "index"))
        self.write(sources)
        assert self.index.refresh()["mode"] == "cold"

    def write(self, sources):
        for name, text in sources.items():
            path = self.root / name
            if text is None:
                path.unlink()
            else:
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_text(text)

    def change(self, sources, compare=True):
        """After a change: the edges equal those of a cold build; how many files were linked again."""
        self.write(sources)
        assert self.index.refresh()["mode"] == "incremental"
        self.n += 1
        if not compare:
            return self.index.linked
        cold = WorkspaceIndex(self.spark, str(self.root), str(self.tmp / f"cold{self.n}"))
        cold.refresh()
        for table, columns in (("edges", ["src", "dst", "edge_class", "seq"]), ("nodes", ["id", "kind", "name", "parent", "start", "full_url"])):
            a, b = (sorted(map(tuple, getattr(x.graph(), table).select(*columns).collect()), key=repr) for x in (self.index, cold))
            assert a == b, (sources, [x for x in a if x not in b], [x for x in b if x not in a])
        return self.index.linked

    def edges(self):
        return {(r["src"], r["dst"]) for r in self.index.graph().edges.filter("edge_class <> 'structural'").collect()}


PYTHON = {
    "base.py": "class Base:\n    def go(self):\n        return 1\n",
    "mid.py": "from base import Base\n\nclass Mid(Base):\n    pass\n",
    "use.py": "from mid import Mid\n\ndef run(m: Mid):\n    return m.go()\n",
    "pkg/__init__.py": "from pkg.inner import helper\n",
    "pkg/inner.py": "def helper():\n    return 2\n",
    "far.py": "from pkg import helper\n\ndef far():\n    return helper()\n",
    "alone.py": "def alone():\n    return other()\n\ndef other():\n    return 3\n",
}


def test_changes_touch_their_dependents_only(spark, tmp_path):
    life = Life(spark, tmp_path, PYTHON)
    assert ("use.py:run", "base.py:Base.go") in life.edges() and ("far.py:far", "pkg/inner.py:helper") in life.edges()
    assert life.change({"alone.py": "def alone():\n    return 4\n"}, False) == 1
    assert life.change({"base.py": "class Base:\n    def stop(self):\n        return 1\n"}) <= 3  # itself, and use.py through the method that is gone
    assert ("use.py:run", "base.py:Base.go") not in life.edges()
    assert life.change({"mid.py": "class Mid:\n    def go(self):\n        return 1\n"}, False) <= 3
    assert ("use.py:run", "mid.py:Mid.go") in life.edges()
    assert life.change({"pkg/inner.py": "def helped():\n    return 2\n"}, False) <= 3
    assert ("far.py:far", "pkg/inner.py:helper") not in life.edges()
    assert life.change({"pkg/inner.py": "def helper():\n    return 2\n"}) <= 3
    assert ("far.py:far", "pkg/inner.py:helper") in life.edges()


def test_an_ambiguity_comes_and_goes(spark, tmp_path):
    life = Life(spark, tmp_path, {"a/util.py": "def work():\n    return 1\n", "use.py": "from util import work\n\ndef main():\n    return work()\n", "alone.py": "x = 1\n"})
    assert ("use.py:main", "a/util.py:work") in life.edges()
    assert life.change({"b/util.py": "def work():\n    return 2\n"}, False) == 2  # the new file and use.py, which hasn't changed
    assert not {e for e in life.edges() if e[0] == "use.py:main"}
    assert life.change({"b/util.py": None}) == 2
    assert ("use.py:main", "a/util.py:work") in life.edges()


def test_names_that_rest_on_each_other_are_forgotten(spark, tmp_path):
    """x and y pass a name to each other; when its source is gone, neither keeps it alive."""
    life = Life(spark, tmp_path, {"z.ts": "export function go() {}\n", "x.ts": "export * from './y';\nexport * from './z';\n", "y.ts": "export * from './x';\n", "main.ts": "import { go } from './y';\nexport function main() { go(); }\n"})
    assert ("main.ts:main", "z.ts:go") in life.edges()
    life.change({"z.ts": "export function stop() {}\n"}, False)
    assert not life.edges()
    life.change({"z.ts": "export function go() {}\n", "y.ts": "export * from './x';\nexport function stop() {}\n"})
    assert ("main.ts:main", "z.ts:go") in life.edges()


def test_routes_and_their_callers(spark, tmp_path):
    life = Life(
        spark,
        tmp_path,
        {
            "api.py": "from fastapi import FastAPI\nfrom users import router\napp = FastAPI()\napp.include_router(router, prefix='/v9')\n",
            "users.py": "from fastapi import APIRouter\nrouter = APIRouter()\n@router.get('/users')\ndef users():\n    return []\n",
            "page.ts": "export function load() { return fetch('/v9/users'); }\n",
            "other.ts": "export function save() { return fetch('/things/save'); }\n",
        },
    )
    assert ("page.ts:load", "users.py:/users") in life.edges()
    life.change({"api.py": "from fastapi import FastAPI\nfrom users import router\napp = FastAPI()\napp.include_router(router, prefix='/v10/members')\n"}, False)
    life.change({"users.py": "from fastapi import APIRouter\nrouter = APIRouter()\n@router.get('/people')\ndef people():\n    return []\n"}, False)
    life.change({"more.py": "def save_things():\n    return 1\n"})


@pytest.mark.parametrize("seed", [4])
def test_random_changes_equal_cold_builds(spark, tmp_path, seed):
    rnd = random.Random(seed)
    names = ["a", "b", "p/a", "p/c", "q/c"]

    def source():
        out = [f"from {rnd.choice(names).replace('/', '.')} import {rnd.choice(['f', 'g', 'K'])}{rnd.choice(['', ' as h'])}" for _ in range(rnd.randint(0, 2))]
        if rnd.random() < 0.6:
            out += [f"class {rnd.choice(['K', 'L'])}({rnd.choice(['K', 'h', ''])}):", f"    def {rnd.choice(['m', 'n'])}(self):", f"        return self.{rnd.choice(['m', 'n'])}()"]
        out += [f"def {rnd.choice(['f', 'g'])}(k: K):", f"    return {rnd.choice(['f', 'g', 'h', 'k.m', 'k.n'])}()"]
        return "\n".join(out) + "\n"

    life = Life(spark, tmp_path, {f"{n}.py": source() for n in names})
    for i in range(4):
        path = f"{rnd.choice(names)}.py"
        life.change({path: None if (life.root / path).exists() and rnd.random() < 0.3 else source()}, i == 3)


def test_imported_files_outside_the_workspace_have_a_bare_node(spark, tmp_path):
    life = Life(spark, tmp_path, {"a.py": "import os\nfrom migrations.m1 import x\nfrom migrations import m2\n", "migrations/m1.py": "x = 1\n", "migrations/__init__.py": ""})
    nodes = lambda: {(r["id"], r["kind"], r["name"]) for r in life.index.graph().nodes.filter("id like 'migrations%'").collect()}
    assert nodes() == {("migrations/m1.py", "File", "m1.py"), ("migrations/__init__.py", "File", "__init__.py")}
    of_file = life.index.structure().lookup_symbol("a.py")["relationships"]
    assert of_file["imports"] == ["migrations/__init__.py", "migrations/m1.py"]
    life.write({"a.py": "import os\n"})
    life.index.refresh()
    assert nodes() == set()
