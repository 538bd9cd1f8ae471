from __future__ import annotations

import random
import tracemalloc

from lodestrata.llm.recompression import RecompressionUnits


def test_names_of_a_block_take_little_beside_its_symbols():
    n, draw = 270_000, random.Random(1)
    units = RecompressionUnits([" ".join(draw.choices([f"w{i}" for i in range(5000)], k=n)).encode()], 13)
    tracemalloc.start()
    runs = units.runs()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert int((runs.last - runs.first + 1).sum()) == n - 12 and peak < 120 * n
