import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_entry_does_without_the_optional_modules():
    """The training-data folder and the pipeline may be taken out; everything else must still be registered."""
    code = "import sys; sys.modules['quire.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert out.stdout.split()[-2:] == ["161", "157"]
