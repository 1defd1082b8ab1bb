import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_core_does_not_need_the_optional_subpackage():
    code = "import sys; sys.modules['loomqa.llm'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'p4_found' in q and 'p1_found' not in q and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_outside_imports_it():
    for p in ROOT.glob("loomqa/**/*.py"):
        if "llm" not in p.parts:
            assert "loomqa.llm" not in p.read_text(), p


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
