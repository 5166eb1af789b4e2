"""Suffix sorting by induction in bulk, with common prefixes, queues that spill to disk, and recursion."""

from __future__ import annotations

import tempfile

import numpy as np

#: Numbers a queue keeps in memory before it writes them to disk.
IN_MEMORY = 1 << 20
#: Reduced strings with more symbols than a fraction of their length are sorted by doubling, the base of the recursion.
DENSE = 32


class Queue:
    """First in, first out: tuples (suffix, common prefix with the tuple before), in memory up to a bound and then on disk.

    Induction visits suffixes in sorted order and each suffix puts the one before it into the queue of its
    symbol, so every queue is filled in sorted order and a priority queue keyed by symbol needs no heap.
    """

    def __init__(self, limit: int):
        self.limit, self.held, self.size, self.parts, self.file, self.read = limit, 0, 0, [], None, 0

    def push(self, suffix: np.ndarray, common: np.ndarray) -> None:
        self.parts.append(np.stack([suffix, common]))
        self.held += len(suffix)
        self.size += len(suffix)
        if self.held > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            np.concatenate(self.parts, axis=1).astype(np.int64).T.tofile(self.file)
            self.parts, self.held = [], 0

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        whole = [np.zeros((2, 0), np.int64)]
        if self.file is not None:
            self.file.seek(0)
            whole.append(np.fromfile(self.file, np.int64).reshape(-1, 2).T)
        out = np.concatenate([*whole, *self.parts], axis=1)
        return out[0], out[1]

    def since(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Tuples from the n-th on."""
        on_disk = self.size - self.held
        if n >= on_disk:
            out = np.concatenate([np.zeros((2, 0), np.int64), *self.parts], axis=1)[:, n - on_disk :]
            return out[0], out[1]
        a, b = self.all()
        return a[n:], b[n:]


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last, a unique least symbol, counts as smaller."""
    n = len(text)
    step = np.ones(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    nearest = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    return step[nearest] > 0


def _runs(text: np.ndarray) -> np.ndarray:
    """How often the first symbol of each suffix stands in a row at its start."""
    n = len(text)
    change = np.append(text[1:] != text[:-1], True)
    end = np.minimum.accumulate(np.where(change, np.arange(n), n)[::-1])[::-1]
    return end - np.arange(n) + 1


class _Wave:
    """Puts the suffixes before a sorted run of suffixes into the queues of their symbols."""

    def __init__(self, text, small, symbols: int, want_small: bool, limit: int):
        self.text, self.small, self.want = text, small, want_small
        self.queues = [Queue(limit) for _ in range(symbols)]
        # The least common prefix among suffixes visited since the last push to a queue; -1 before the first.
        self.low = np.full(symbols, -1, np.int64)

    def visit(self, suffix: np.ndarray, common: np.ndarray) -> None:
        if len(suffix) == 0:
            return
        ok = suffix > 0
        before = suffix - 1
        ok &= self.small[before] == self.want
        at = np.flatnonzero(ok)
        symbol = self.text[before[at]].astype(np.int64)
        by = np.argsort(symbol, kind="stable")
        cuts = np.flatnonzero(np.diff(symbol[by])) + 1
        seen = np.minimum(self.low, common.min())
        for group in np.split(by, cuts) if len(by) else []:
            x, places = int(symbol[group[0]]), at[group]
            last = places[-1] + 1
            least = np.minimum.reduceat(common, np.append(0, places + 1) if last < len(common) else np.append(0, places[:-1] + 1))
            first = min(int(least[0]), int(self.low[x])) if self.low[x] < np.iinfo(np.int64).max else int(least[0])
            values = least[: len(places)].copy()
            values[0] = first
            self.queues[x].push(before[places], values + 1)
            seen[x] = least[-1] if last < len(common) else np.iinfo(np.int64).max
        self.low = seen


def _induce(text, small, symbols: int, seeds: list[tuple[np.ndarray, np.ndarray]], run: np.ndarray, limit: int):
    """The order of all suffixes, and common prefixes with the one before, from sorted seeds for each symbol."""
    down = _Wave(text, small, symbols, False, limit)
    for c in range(symbols):
        done, last = 0, None
        while done < down.queues[c].size:
            a, b = down.queues[c].since(done)
            done += len(a)
            last = a[-1]
            down.visit(a, b)
        a, b = seeds[c]
        if len(a):
            b = b.copy()
            b[0] = 0 if last is None else min(run[last], run[a[0]])
            down.visit(a, b)
    up = _Wave(text, small, symbols, True, limit)
    for c in range(symbols - 1, -1, -1):
        done, last = 0, None
        while done < up.queues[c].size:
            a, b = up.queues[c].since(done)
            done += len(a)
            last = a[-1]
            up.visit(a, b)
        a, b = down.queues[c].all()
        if len(a):
            seam = 0 if last is None else min(run[last], run[a[-1]])
            up.visit(a[::-1], np.append(seam, b[:0:-1]))
    order, common = [np.array([len(text) - 1])], [np.array([0])]
    for c in range(symbols):
        a, b = down.queues[c].all()
        s, t = up.queues[c].all()
        if len(a):
            order.append(a)
            common.append(b)
        if len(s):
            seam = min(run[a[-1]], run[s[-1]]) if len(a) else 0
            order.append(s[::-1])
            common.append(np.append(seam, t[:0:-1]))
    return np.concatenate(order), np.concatenate(common)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes, counted up to `most`."""
    padded = np.append(text, np.full(16, -1, text.dtype) if text.dtype.kind == "i" else np.zeros(16, text.dtype))
    out, active = np.zeros(len(a), np.int64), np.arange(len(a))
    steps = np.arange(16)
    while len(active):
        x, y = a[active] + out[active], b[active] + out[active]
        differ = padded[np.minimum(x[:, None] + steps, len(text))] != padded[np.minimum(y[:, None] + steps, len(text))]
        differ |= (x[:, None] + steps >= len(text)) | (y[:, None] + steps >= len(text))
        n = np.where(differ.any(1), differ.argmax(1), 16)
        out[active] += n
        active = active[(n == 16) & (out[active] < most)]
    return np.minimum(out, most)


def _by_doubling(text: np.ndarray, most: int) -> np.ndarray:
    """Suffixes in order of their first `most` symbols."""
    n, width = len(text), 1
    rank = np.unique(text, return_inverse=True)[1]
    while True:
        next_ = np.zeros(n, np.int64)
        next_[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + next_
        if width >= most or rank.max(initial=0) == n - 1:
            return np.argsort(key, kind="stable")
        rank = np.unique(key, return_inverse=True)[1]
        width *= 2


def sorted_suffixes(text: np.ndarray, most: int, limit: int = IN_MEMORY, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of at least their first `most` symbols, and the common prefix of each with the one before.

    `text` holds numbers from 0 and ends with its only 0. Common prefixes are right below `most`; longer ones are
    at least `most`. The suffixes at left-most smaller places are sorted first: their substrings by one round of
    induction, then, where substrings repeat, the string of their names by recursion. A second round brings all
    other suffixes in order, each with its common prefix.
    """
    symbols = int(text.max()) + 1
    n = len(text)
    if n == 1:
        return np.array([0]), np.array([0])
    small, run = _types(text), _runs(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1

    def seeds(order: np.ndarray, common: np.ndarray):
        first = text[order]
        cut = np.searchsorted(first, np.arange(symbols + 1))
        return [(order[a:b], common[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    rough = lms[np.argsort(text[lms], kind="stable")]
    order, _ = _induce(text, small, symbols, seeds(rough, np.zeros(len(rough), np.int64)), run, limit)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    if len(order) > 1:
        nth = np.cumsum(is_lms) - 1
        end = np.append(lms[1:], n - 1)[nth[order]]
        size = end - order + 1
        same = size[1:] == size[:-1]
        same[same] = _common(text, order[1:][same], order[:-1][same], int(size.max())) >= size[1:][same]
        name = np.append(0, np.cumsum(~same))
        if name[-1] + 1 < len(order):
            reduced = np.empty(len(lms), np.int64)
            reduced[nth[order]] = name
            # The last substring is the end symbol alone, so the reduced string ends with its only 0 as well.
            if (name[-1] + 1) * dense <= len(reduced):
                order = lms[sorted_suffixes(reduced, most, limit, dense)[0]]
            else:
                order = lms[_by_doubling(reduced, most)]
    common = np.zeros(len(order), np.int64)
    common[1:] = _common(text, order[1:], order[:-1], most)
    return _induce(text, small, symbols, seeds(order, common), run, limit)
