"""The driver's contract, with and without the training-data subpackage."""

import re
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["band", "lots", "least", "most"] and df.count() > 0
    names = entry.queries()
    assert all(callable(f) for f in names.values()) and set(entry.oracle_sql()) <= set(names)


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['lotwright.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and all(k[0] in 'qs' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=HERE, check=True)


def test_nothing_else_imports_the_subpackage():
    for f in (HERE / "lotwright").rglob("*.py"):
        if "llm" not in f.relative_to(HERE / "lotwright").parts:
            assert not re.search(r"lotwright\.llm|from \.+llm", f.read_text()), f
