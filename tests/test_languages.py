import pytest

from loomgraph.plans.code_graph import build
from loomgraph.plans.questions import CodeStructure
from loomgraph.sources import languages
from loomgraph.sources.python_facts import parse_file


def read_ini(path, text):
    """A reader of section names, for the test."""
    names = [line.strip("[]") for line in text.splitlines() if line.startswith("[")]
    fact = dict(kind="Class", parent=None, start=1, end=1, signature=None, docstring=None, decorators=[], base_classes=[], calls=[], returns=[], preview=None, is_async=False, is_generator=False, is_exported=True, param_count=None)
    return {"definitions": [fact | {"qualified": n, "name": n} for n in names]}


def test_settings_are_checked_key_by_key(tmp_path):
    (tmp_path / "a.yaml").write_text("name: ini\nextensions: [.ini]\n")
    for name, text in {"b.yml": "name: [broken\n", "c.txt": "name: no\n", "d.yml": "name: x\nextensions: [.x]\nfeatures: {a: true}\n", "e.yml": "name: y\n", "f.yml": "- 1\n", "g.yml": "name: z\nextensions: .z\n"}.items():
        (tmp_path / name).write_text(text)
    assert languages.discover(str(tmp_path)) == [{"name": "ini", "extensions": (".ini",), "reader": ""}]
    assert languages.discover(str(tmp_path / "none")) == []
    with pytest.raises(languages.SettingsError, match="unknown keys: features"):
        languages.load(str(tmp_path / "d.yml"))


def test_a_missing_reader_switches_off_its_language_only(spark):
    further = ({"name": "ini", "extensions": [".ini"], "reader": "tests.test_languages:read_ini"}, {"name": "gone", "extensions": [".gone"], "reader": "no.such.module:read"})
    assert languages.Languages(further).reader("x.gone") is None
    files = spark.createDataFrame([("a.ini", bytearray(b"[one]\nx=1\n[two]\n")), ("b.gone", bytearray(b"x")), ("c.py", bytearray(b"def f(): return 1\n"))], "path string, content binary")
    g = build(files, further)
    assert {r["id"] for r in g.nodes.filter("kind IN ('Class', 'Function')").collect()} == {"a.ini:one", "a.ini:two", "c.py:f"}
    assert "ok: false" in CodeStructure(g).answer("impact", "f", "x") and "ok: true" in CodeStructure(g).answer("code_map")
    assert "error" in CodeStructure(g).answer("nothing")


def test_single_files(tmp_path):
    (tmp_path / "a.py").write_text("def f(): pass\n")
    assert parse_file(str(tmp_path / "a.py"))["definitions"][0]["name"] == "f"
    (tmp_path / "a.csv").write_text("x")
    with pytest.raises(ValueError, match="Unsupported"):
        parse_file(str(tmp_path / "a.csv"))
    with pytest.raises(FileNotFoundError):
        parse_file(str(tmp_path / "b.py"))


def test_callbacks_of_a_definition(spark):
    source = b"export function App() {\n  items.map((x) => x.each((y) => go(y)));\n  function named() { a(() => 1); }\n}\n"
    s = CodeStructure(build(spark.createDataFrame([("a.ts", bytearray(source))], "path string, content binary")))
    under = [r["id"] for r in s.callbacks_under("a.ts:App").collect()]
    assert len(under) == 2 and all("named" not in x for x in under)
    assert s.symbols_in_file("a.ts").count() == s.symbols_in_file("a.ts", False).count() + 3
    assert s.code_map("a.ts")["meta"]["inline_callbacks"] == 3


def test_an_index_takes_further_languages(spark, tmp_path):
    from loomgraph.plans.index import WorkspaceIndex

    (tmp_path / "a.ini").write_text("[one]\nx=1\n")
    (tmp_path / "b.ini2").write_text("[two]\n")
    ini = {"name": "ini", "extensions": [".ini"], "reader": "tests.test_languages:read_ini"}
    index = WorkspaceIndex(spark, str(tmp_path), str(tmp_path / "index"), languages=[ini])
    assert index.refresh()["parsed"] == 1 and index.structure().contains("a.ini:one")
