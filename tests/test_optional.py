"""The entry module without what the training-data operators need."""

import subprocess
import sys

import pytest
from conftest import ROOT

PROGRAM = """
import sys
for name in {missing!r}:
    sys.modules[name] = None  # an import of it fails
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
names = set(entry.queries())
print("plain", "extract_messages" in names, "numbered", any(n.startswith("op") and n[2:3].isdigit() for n in names), len(entry.oracle_sql()) > 100)
"""


@pytest.mark.parametrize("missing", [["xxhash"], ["public_tokenizers"], ["mailrisk.llm"], ["corpus_pipeline"]])
def test_the_rest_works_whatever_is_missing(missing):
    run = subprocess.run([sys.executable, "-c", PROGRAM.format(missing=missing, root=ROOT)], capture_output=True, text=True, timeout=120)
    assert "plain True numbered False True" in run.stdout, run.stderr[-1000:]
