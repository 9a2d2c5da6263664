"""What one shard of repeated passages holds."""

import tracemalloc

import numpy as np

from ardoise.llm import passages


def test_a_shard_takes_little_memory():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, passages.SHARD + 400).astype(np.uint8).tobytes()
    pieces = [text[i : i + 176] for i in range(0, passages.SHARD, 176)]
    # The last piece repeats the first, which stands earlier.
    pieces.append(pieces[0])
    n = len(pieces)
    tracemalloc.start()
    piece, first, last = passages.repeated(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), pieces, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (piece.tolist(), first.tolist(), last.tolist()) == ([n - 1], [0], [76])
    # An executor has 3,000 MB for its JVM and all Python workers of its tasks.
    assert peak < 200 << 20, peak >> 20
