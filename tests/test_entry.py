import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("loomgraph.llm", "corpus_pipeline")):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
print(len(names))
"""


def test_entry_works_without_the_training_data_package():
    out = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 40


def test_nothing_else_imports_that_package():
    own = {ROOT / "__spark_entry__.py", ROOT / "corpus_pipeline.py"}
    for path in [*ROOT.glob("*.py"), *(ROOT / "loomgraph").rglob("*.py")]:
        if path not in own and "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import)\s+(loomgraph\.llm|corpus_pipeline)", path.read_text(), re.M), path


def test_queries_have_their_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["node", "hop"] and df.count() > 0
