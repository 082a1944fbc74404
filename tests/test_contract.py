import subprocess
import sys

import __spark_entry__ as entry


def test_entry_gives_canonical_quotes(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "quote_id" and df.count() == df.select("quote_id").distinct().count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_training_data_operators(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {sys.path[0]!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("cordon.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names, names
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], check=True)
