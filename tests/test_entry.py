"""The entry point without the text part, or without a library that only it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
BLOCKED = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {0!r} or name == {0!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Missing())
sys.path.insert(0, {1!r})
import __spark_entry__ as contract
names, checks = contract.queries(), contract.oracle_sql()
assert set(checks) <= set(names) and "split_scale_summary" in names
assert not any(name.startswith("op") and name[2:3].isdigit() or name == "pipeline" for name in names), sorted(names)
"""


@pytest.mark.parametrize("module", ["corpus_pipeline", "flowsieve.llm", "sentencepiece", "xxhash", "public_tokenizers", "ahocorasick"])
def test_other_queries_load_without(module):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(module, str(ROOT))], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
