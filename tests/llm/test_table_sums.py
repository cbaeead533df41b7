"""Memory of the sums that a task holds: it counts beside the executor's heap, and workers outlive their tasks."""
import os
import pathlib
import subprocess
import sys

import clientele

CHILD = """
import numpy as np, pyarrow as pa
from clientele.llm.wordcodes import TableSums

def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096

def rows(i, n=1 << 15):
    term = pa.array(np.arange(i * n // 2, i * n // 2 + n)).cast(pa.string())
    return pa.table({"lang": pa.array(["en"] * n), "source": pa.array(["web"] * n), "term": term, "n": pa.array(np.ones(n, np.int64))})

pa.set_cpu_count(8)
rows(0).group_by("lang", use_threads=False).aggregate([("n", "sum")])
before, given = resident(), 0
held = TableSums(["lang", "source", "term"], ["n"], limit=1 << 30)
for i in range(24):
    table = rows(i)
    given += table.nbytes
    held.add(table)
del table
out = held.take()
assert out.num_rows == 25 << 14 and sum(out.column("n").to_numpy()) == 24 << 15
print(given, pa.default_memory_pool().max_memory(), resident() - before)
"""


def test_sums_hold_one_table_of_keys_and_give_memory_back():
    env = os.environ | {"PYTHONPATH": str(pathlib.Path(clientele.__file__).parents[1])}
    said = subprocess.run([sys.executable, "-c", CHILD], env=env, check=True, capture_output=True, text=True).stdout
    given, peak, left = map(int, said.split())
    assert peak < 4 * given  # a table of keys per core took 4.8 times the rows
    assert left < 3 * given  # 6.7 times
