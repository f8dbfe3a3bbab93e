"""What the driver calls, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    out = entry.entry(spark)
    assert out.columns == ["d_year", "c_nation", "profit"] and out.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    """Neither ``llm`` nor the pipeline is there; everything else is."""
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    (tmp_path / "quarryline").mkdir()
    for p in (ROOT / "quarryline").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "quarryline" / p.name).symlink_to(p)
    code = "import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, cwd=tmp_path)
    n, any_llm = out.stdout.split()
    assert int(n) >= 39 and any_llm == "False", out.stderr
