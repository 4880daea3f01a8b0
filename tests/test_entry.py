"""The entry module loads whatever is missing for the corpus operators."""

import subprocess
import sys

import pytest

from tests.conftest import ROOT

BLOCK = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == BLOCKED or name == BLOCKED:
            raise ModuleNotFoundError("no module named " + name, name=name)
BLOCKED = sys.argv[1]
sys.meta_path.insert(0, Absent())
import __spark_entry__
from voxsieve.plans import registry
assert __spark_entry__.queries().keys() == registry.QUERIES.keys(), sorted(__spark_entry__.queries())
assert __spark_entry__.oracle_sql().keys() == registry.ORACLES.keys()
"""


@pytest.mark.parametrize("missing", ["ahocorasick", "xxhash", "tiktoken", "regex", "public_tokenizers", "corpus_pipeline", "voxsieve.llm"])
def test_engine_queries_load_without(missing):
    subprocess.run([sys.executable, "-W", "ignore", "-c", BLOCK, missing], cwd=ROOT, check=True)
