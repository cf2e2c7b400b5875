"""The driver's entry without the text operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

BLOCKED = """
import sys
sys.modules["{name}"] = None
import __spark_entry__ as e
import millrace.queries as core
assert set(core.queries()) <= set(e.queries())
assert set(core.oracle_sql()) <= set(e.oracle_sql()) <= set(e.queries())
if {alone}:
    assert set(e.queries()) <= set(core.queries()) | {{"pipeline"}}
    assert set(e.oracle_sql()) == set(core.oracle_sql())
"""


def test_core_queries_stay_where_something_of_the_text_operators_is_missing():
    """Without the subpackage the core is alone; a missing vocabulary package costs no other query."""
    for name, alone in (("millrace.llm", True), ("public_tokenizers", False)):
        done = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name, alone=alone)], cwd=ROOT, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
