"""Places that a repeated passage has in common, chosen by its bytes alone."""

from __future__ import annotations

import numpy as np

from ardoise.llm.textdedup import ODD, POWERS, U, mix

#: Bytes of the gram an anchor stands on.
GRAM = 24
PLACE = 22


class Hashes:
    """Hashes of all substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = POWERS.of(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + U(1)) * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * ODD)

    def grams(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window: of two parts, one up to a block's end and one from the next block's start."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    from_start = np.minimum.accumulate(grid, 1).reshape(-1)
    to_end = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(to_end[: n - width + 1], from_start[width - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int = GRAM) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the data, anchors, the texts they lie in, and their grams.

    ``data`` holds texts that end at ``ends``.  Every string of ``length`` bytes inside a text has an anchor: the
    gram of the smallest hash in it, the first of several.  Equal strings have it in the same place.
    """
    hashes = Hashes(data)
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return hashes, none, none, np.zeros(0, np.uint64)
    grams = hashes.grams(gram)
    low = U((1 << PLACE) - 1)
    ordered = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    if len(data) > 1 << PLACE:
        raise ValueError("more than 4 MB at once")
    least = window_minima(ordered, length - gram + 1)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.ones(len(least) + 1, bool)
    for k in range(len(ends)):  # windows that reach beyond their text
        inside[max(starts[k], ends[k] - length + 1) : min(ends[k], len(least))] = False
    least = least[inside[: len(least)]]
    place = (least & low).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
    return hashes, place, np.searchsorted(ends, place, "right"), grams[place]
