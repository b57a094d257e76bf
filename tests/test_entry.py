"""The entry without the training-data part, or without something that part needs."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {name!r} or name == {name!r}:
            raise ModuleNotFoundError("No module named " + name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
from skyledger.registry.oracle import all_oracles
from skyledger.registry.queries import all_queries
assert set(all_queries()) <= set(entry.queries()) and set(all_oracles()) <= set(entry.oracle_sql())
print("QUERIES", len(entry.queries()) - len(all_queries()))
"""


def _others(name):
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert "QUERIES" in done.stdout, done.stderr[-2000:]
    return int(done.stdout.split()[-1]), done.stderr


def test_core_queries_stand_without_the_part():
    assert _others("skyledger.llm")[0] == 0


def test_core_queries_stand_without_what_the_part_needs():
    left, said = _others("xxhash")
    assert left == 0 and "xxhash" in said
