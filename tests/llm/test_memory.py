"""What a step of a worker takes, and what it keeps."""

import os
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tierflow.llm import suffix
from tierflow.llm.columnar import freed


def texts(size, seed=0):
    """Bytes of documents of 2,000 letters, and their bounds."""
    data = np.random.default_rng(seed).integers(97, 123, size).astype(np.uint8)
    return data, np.append(np.arange(0, size, 2000), size)


def most_of(step):
    """Bytes that numpy and Python took at once during a step, and its result."""
    tracemalloc.start()
    try:
        result = step()
        return tracemalloc.get_traced_memory()[1], result
    finally:
        tracemalloc.stop()


def test_anchors_take_little_beside_the_text():
    data, offsets = texts(8 << 20)
    most, (at, h) = most_of(lambda: suffix.anchors(data, offsets))
    # The anchors themselves are 16 bytes for each, and stand there twice when joined.
    assert most - 2 * (at.nbytes + h.nbytes) < 8 * len(data)


@pytest.mark.parametrize("hashed", [1, 7, 1000])
@pytest.mark.parametrize("size", [0, 23, 49, 50, 51, 3999, 4049])
def test_anchors_do_not_hang_on_stretches(monkeypatch, hashed, size):
    data, offsets = texts(size)
    for some in (data, data % 2, data % 1):
        at, h = suffix.anchors(some, offsets)
        with monkeypatch.context() as patch:
            patch.setattr(suffix, "HASHED", hashed)
            again, h_again = suffix.anchors(some, offsets)
        assert again.tolist() == at.tolist()
        assert h_again.tolist() == h.tolist()


def test_marks_are_counted_in_little_memory():
    marks = np.arange(4 << 20) % 3 == 0
    bounds = np.array([0, 0, 1, 4, 1000, len(marks)])
    most, found = most_of(lambda: suffix.counted(marks, bounds))
    assert found.tolist() == [int(marks[:b].sum()) for b in bounds]
    assert most < 6 * len(marks)


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory cannot be read")
def test_a_worker_keeps_nothing_of_a_step():
    def held():
        with open("/proc/self/smaps_rollup") as lines:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", lines.read())[1]) << 10

    def step():
        """Allocates 100 MB in small arrays, one in a hundred of which stays."""
        return [np.ones(1000, np.uint8) for _ in range(100_000)][::100]

    before = held()
    stays = step()
    result = freed(pa.table({"n": [len(stays)]}))
    assert result.column("n").to_pylist() == [1000]
    assert held() - before < 50 << 20
