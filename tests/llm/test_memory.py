"""What a worker has freed must not stay with it."""

import subprocess
import sys

import pytest

PROGRAM = """
import ctypes, re, sys
import numpy as np
import pyarrow as pa
from tidemark.llm.common import slices

def held():
    return int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024

def fill():
    some = [np.ones(8192) for _ in range(2000)]  # 125 MB in pieces of 64 KB
    return some[-1]  # the last one keeps the top of the heap

if not hasattr(ctypes.CDLL(None), "malloc_trim"):
    sys.exit(0)
batch = pa.record_batch({"x": pa.array(range(6))})
start = held()
before = fill()  # what an earlier stage left
parts = slices(iter([batch]), 2)
next(parts)
print(held() - start)
within = fill()
next(parts)
print(held() - start)
after = fill()
assert [p.num_rows for p in parts] == [2]
print(held() - start)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_slices_give_freed_memory_back():
    run = subprocess.run([sys.executable, "-c", PROGRAM], capture_output=True, text=True, check=True, timeout=60)
    assert all(int(mb) < 40 for mb in run.stdout.split()), run.stdout


def test_slices_keep_every_row():
    import pyarrow as pa

    from tidemark.llm.common import slices

    batches = [pa.record_batch({"x": pa.array(range(n), pa.int64())}) for n in (0, 1, 5, 4)]
    got = [p.column(0).to_pylist() for p in slices(iter(batches), 2)]
    assert got == [[0], [0, 1], [2, 3], [4], [0, 1], [2, 3]]
    assert list(slices(iter([]))) == []
