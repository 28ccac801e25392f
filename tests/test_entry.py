"""The registered queries without the training-data operators or a package that they need."""

import subprocess
import sys
from pathlib import Path

import pytest

from testbed.queries import queries

BLOCKED = """
import sys
sys.modules[{name!r}] = None
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()))
"""


@pytest.mark.parametrize("name", ["callsheet.llm", "corpus_pipeline", "xxhash", "public_tokenizers", "tokenizers_missing"])
def test_the_other_queries_need_none_of_them(name):
    root = Path(__file__).resolve().parents[1]
    run = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], cwd=root, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    n, twins = map(int, run.stdout.split()[-2:])
    if name == "tokenizers_missing":
        assert n >= len(queries())
    else:
        assert n == twins == len(queries())
