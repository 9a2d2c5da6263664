"""Suffix arrays by induced sorting, as whole-array steps of NumPy."""

from __future__ import annotations

import numpy as np

from ardoise.llm.anchors import Hashes

#: Common prefixes are measured up to this length.
LONGEST = 512


def _radix(keys: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers below 2**32, by halves."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    if len(keys) and keys.max() > 0xFFFF:
        order = order[np.argsort((keys[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one."""
    n = len(text)
    step = np.full(n, -1, np.int8)
    np.sign(text[1:].astype(np.int16) - text[:-1], out=step[:-1], casting="unsafe")
    decided = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(decided[::-1])[::-1]] > 0


class _Induced:
    """Buckets of one text; ``order`` sorts all suffixes from sorted leftmost-smaller ones."""

    def __init__(self, text: np.ndarray, small: np.ndarray):
        self.text, self.small = text, small
        self.size = int(text.max()) + 1
        count, smaller = np.bincount(text, minlength=self.size), np.bincount(text[small], minlength=self.size)
        self.end = np.cumsum(count)
        self.start, self.middle = self.end - count, self.end - smaller
        self.used = np.flatnonzero(count)

    def _place(self, array: np.ndarray, at: np.ndarray, edge: np.ndarray, down: bool) -> None:
        """Append suffixes to their buckets in the given order, upwards or downwards."""
        c = self.text[at]
        order = np.argsort(c, kind="stable")
        at, c = at[order], c[order]
        count = np.bincount(c, minlength=self.size)
        rank = np.arange(len(at)) - (np.cumsum(count) - count)[c]
        if down:
            array[edge[c] - 1 - rank] = at
            edge -= count
        else:
            array[edge[c] + rank] = at
            edge += count

    def order(self, leftmost: np.ndarray) -> np.ndarray:
        text, small = self.text, self.small
        array = np.empty(len(text), np.int64)
        by_first = leftmost[np.argsort(text[leftmost], kind="stable")]
        cuts = np.searchsorted(text[by_first], np.arange(self.size + 1))
        # Larger suffixes, from small first letters up; each round takes what the last one put into the bucket.
        edge = self.start.copy()
        self._place(array, np.array([len(text) - 1]), edge, False)
        for c in self.used:
            done = self.start[c]
            while done < edge[c]:
                batch, done = array[done : edge[c]] - 1, edge[c]
                batch = batch[batch >= 0]
                batch = batch[~small[batch]]
                if len(batch):
                    self._place(array, batch, edge, False)
            if cuts[c] < cuts[c + 1]:
                self._place(array, by_first[cuts[c] : cuts[c + 1]] - 1, edge, False)
        # Smaller suffixes, from large first letters down.
        edge = self.end.copy()
        for c in self.used[::-1]:
            done = self.end[c]
            while done > edge[c]:
                batch, done = array[edge[c] : done][::-1] - 1, edge[c]
                batch = batch[batch >= 0]
                batch = batch[small[batch]]
                if len(batch):
                    self._place(array, batch, edge, True)
            batch = array[self.start[c] : self.middle[c]][::-1] - 1
            batch = batch[batch >= 0]
            batch = batch[small[batch]]
            if len(batch):
                self._place(array, batch, edge, True)
        return array


def _ranked(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by their first ``depth`` names at least."""
    n, rank, step = len(names), names.astype(np.int64), 1
    order = _radix(rank)
    while step < depth:
        # By the second half, which is known, then by the first.
        moved = order[order >= step] - step
        second = np.concatenate([np.arange(max(0, n - step), n), moved])
        order = second[_radix(rank[second])]
        after = np.where(order + step < n, rank[np.minimum(order + step, n - 1)], -1)
        first = rank[order]
        new = np.concatenate([[0], np.cumsum((first[1:] != first[:-1]) | (after[1:] != after[:-1]))])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


def suffix_array(text: np.ndarray, hashes: Hashes, depth: int = 1 << 40) -> np.ndarray:
    """The suffix array of some bytes; exact for prefixes of ``depth`` bytes.

    Suffixes are classified, the substrings between leftmost smaller ones are sorted by inducing and named,
    their suffixes are ranked by names, and the rest is induced from them.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = _types(text)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sorter = _Induced(text, small)
    if len(leftmost) > 1:
        is_leftmost = np.zeros(n, bool)
        is_leftmost[leftmost] = True
        array = sorter.order(leftmost)
        found = array[is_leftmost[array]]
        until = np.empty(n, np.int64)
        until[leftmost] = np.concatenate([leftmost[1:] + 1, [n]])
        key = hashes.of(found, until[found])
        length = until[found] - found
        # The last one ends with the text and equals no other.
        new = (key[1:] != key[:-1]) | (length[1:] != length[:-1]) | (found[1:] == leftmost[-1]) | (found[:-1] == leftmost[-1])
        name = np.empty(n, np.int64)
        name[found] = np.concatenate([[0], np.cumsum(new)])
        leftmost = leftmost[_ranked(name[leftmost], min(depth, len(leftmost)))]
    return sorter.order(leftmost)


def common_prefixes(text: np.ndarray, array: np.ndarray, hashes: Hashes, restart: np.ndarray) -> np.ndarray:
    """For each place of ``array`` the length of the prefix shared with the place before, up to ``LONGEST``.

    In text order a prefix is one shorter than the one before it unless the letters before both suffixes
    differ; those, and the places in ``restart``, are measured, all others follow.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[array[1:]], before[array[0]] = array[:-1], -1
    place = np.arange(n)
    measured = (before <= 0) | (place == 0)
    measured[1:] |= text[:-1] != text[np.maximum(before[1:], 1) - 1]
    measured[restart] = True
    at = np.flatnonzero(measured & (before >= 0))
    other = before[at]
    low, high = np.zeros(len(at), np.int64), np.minimum(np.minimum(n - at, n - other), LONGEST)
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        same = hashes.of(at, at + middle) == hashes.of(other, other + middle)
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)
    value = np.zeros(n, np.int64)
    value[at] = low
    last = np.maximum.accumulate(np.where(measured, place, 0))
    return np.maximum(value[last] - (place - last), 0)[array]
