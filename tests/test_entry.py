"""The entry module with and without what the corpus operators need."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), any(n.startswith('op1_') for n in q), 'pipeline' in q, set(s) <= set(q))"


def counted(blocked: str) -> list[str]:
    """Counts of the entry module in a fresh interpreter in which some modules cannot be imported."""
    block = f"import sys\nfor name in {blocked.split()!r}: sys.modules[name] = None\n"
    run = subprocess.run([sys.executable, "-c", block + COUNT], cwd=REPO, capture_output=True, text=True, check=True, timeout=120)
    return run.stdout.split()


def test_what_cannot_be_imported_is_left_out():
    rest = counted("recollect.llm")
    assert rest[2:] == ["False", "False", "True"] and int(rest[0]) > 280
    assert counted("public_tokenizers") == rest  # an import that fails inside
    assert counted("corpus_pipeline")[3] == "False"
