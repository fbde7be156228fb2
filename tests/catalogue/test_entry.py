import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_imports_without_a_session():
    """Names can be listed before any Spark session exists, with and without the training-data subpackage."""
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 40; {}"
    subprocess.run([sys.executable, "-c", code.format("")], cwd=ROOT, check=True)
    hidden = "import sys; sys.modules['tramline.llm'] = sys.modules['corpus_pipeline'] = None; "
    subprocess.run([sys.executable, "-c", hidden + code.format("assert not any(n.startswith('op') or n == 'pipeline' for n in q) and sys.modules['tramline.llm'] is None")], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tramline").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tramline.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["rule_id", "item_id", "reason", "checks_made", "last_failed"] and df.count() > 0
