"""The entry points without the training-data operators or a library of theirs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)


@pytest.mark.parametrize("missing", ["corpus_pipeline", "loomline.llm", "public_tokenizers", "tokenizers"])
def test_the_other_queries_stay(missing):
    code = f"""
import sys, warnings
sys.modules[{missing!r}] = None
import __spark_entry__ as e
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    names = set(e.queries())
    assert set(e.oracle_sql()) == names - {{n for n in names if n.startswith('op')}}, names
    assert len(names) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in names) and said
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
