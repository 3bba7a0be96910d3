"""Likeness of many names at once: longest common subsequences by bits of words, and the blocks that ``difflib`` matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORD = 64
#: ``difflib`` leaves out frequent letters of second texts from this length on.
JUNK = 200
#: Letters compared at once, which stay in the cache.
CELLS = 1 << 17
_A, _B = 0, 1  # beyond the end of a first, of a second text


def coded(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all names as small numbers from 2 on, and the place where each name starts (and the last ends)."""
    letters, flat = np.unique(np.frombuffer("".join(names).encode("utf-32-le"), np.uint32), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in names], dtype=np.int64)])
    return (flat + 2).astype(np.min_scalar_type(len(letters) + 2)), starts


def _spread(flat: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every letter of the names ``ids``: which of them, its place in the name, the letter."""
    n = starts[ids + 1] - starts[ids]
    which = np.repeat(np.arange(len(ids)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return which, place, flat[starts[ids][which] + place]


def candidates(flat: np.ndarray, starts: np.ndarray, ids: np.ndarray, texts: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, int]]:
    """Names among ``ids`` with each of ``texts`` with which they have a common subsequence of at least ``least`` of the mean length.

    No sum of matching blocks exceeds it.  Letters in common, of any order, are counted first.  Where ``texts is ids``, each
    name meets those before it only.
    """
    n, size = len(ids), starts[ids + 1] - starts[ids]
    if not n or not len(texts):
        return
    words, letters = max(1, -(-int(size.max()) // WORD)), int(flat.max()) + 1
    which, place, code = _spread(flat, starts, ids)
    masks = np.zeros((words, letters, n), np.uint64)
    np.bitwise_or.at(masks, (place // WORD, code, which), np.uint64(1) << (place % WORD).astype(np.uint64))
    small = np.min_scalar_type(max(int(size.max()), int((starts[texts + 1] - starts[texts]).max())))
    counts = np.bincount(code.astype(np.int64) * n + which, minlength=letters * n).reshape(letters, n).astype(small)
    held, needs, present = {}, {}, counts.any(axis=1)
    for at, t in enumerate(texts.tolist()):
        end = at if texts is ids else n
        text = flat[starts[t] : starts[t + 1]]
        m = len(text)
        if m not in needs:
            needs[m] = np.ceil(least * (size + m) / 2).astype(small)
        text = text[present[text]]
        own, times = np.unique(text, return_counts=True)
        bag = np.zeros(end, small)
        for key in zip(own.tolist(), times.tolist()):
            if key not in held:
                held[key] = np.minimum(counts[key[0]], small.type(key[1]))
            bag += held[key][:end]
        kept = np.flatnonzero(bag >= needs[m][:end])
        if len(kept):
            rows = [[masks[w, c].take(kept) for c in own.tolist()] for w in range(words)]
            common = _subsequence(rows, np.searchsorted(own, text).tolist(), len(kept))
            kept = kept[common >= needs[m][kept]]
        if len(kept):
            yield ids[kept], t


def _subsequence(rows: list[list[np.ndarray]], text: list[int], n: int) -> np.ndarray:
    """Lengths of the longest common subsequences of a text and ``n`` names, ``rows`` having by word and letter the places of the letter in each name."""
    v = [np.full(n, ~np.uint64(0)) for _ in rows]
    u, s, carry, top, last = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.uint64), np.uint64(WORD - 1), len(rows) - 1
    for c in text:
        for w, x in enumerate(v):
            np.bitwise_and(x, rows[w][c], out=u)
            np.add(x, u, out=s)
            if w:
                np.add(s, carry, out=s)
            if w < last:
                np.invert(s, out=carry)
                np.bitwise_and(carry, x, out=carry)
                np.bitwise_or(carry, u, out=carry)
                np.right_shift(carry, top, out=carry)
            np.subtract(x, u, out=x)
            np.bitwise_or(x, s, out=x)
    return WORD * len(rows) - sum(np.bitwise_count(x).astype(np.int64) for x in v)


def _longest(flat: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of the longest common block of each pair of stretches (start and length), and its places in both: the first in a, then in b."""
    i, j = np.arange(n.max())[:, None], np.arange(m.max())[:, None]
    first, second = flat.take(a + i, mode="clip"), flat.take(b + j, mode="clip")
    first[i >= n], second[j >= m] = _A, _B
    run, grown, same = np.zeros((len(j) + 1, len(n)), np.uint8), np.empty((len(j), len(n)), np.uint8), np.empty((len(j), len(n)), bool)
    best, at, row, better = np.zeros(len(n), np.uint8), np.zeros(len(n), np.int64), np.empty(len(n), np.uint8), np.empty(len(n), bool)
    for k in range(len(i)):
        np.equal(second, first[k], out=same)
        np.add(run[:-1], 1, out=grown)
        np.multiply(grown, same.view(np.uint8), out=run[1:])
        np.maximum.reduce(run, axis=0, out=row)
        np.greater(row, best, out=better)
        np.copyto(at, k, where=better)
        np.maximum(best, row, out=best)
    size = best.astype(np.int64)
    start = at - size + 1
    order = np.argsort(-size, kind="stable")
    left, second, columns = size[order], second[:, order], np.arange(len(n))
    here = np.ones((len(j), len(n)), bool)
    for k in range(int(left[0])):
        w = int(np.searchsorted(-left, -k))  # those of more than k letters
        letter = first[start[order[:w]] + k, order[:w]]
        here[: len(j) - k, :w] &= second[k:, :w] == letter
        here[len(j) - k :, :w] = False
    place = np.empty(len(n), np.int64)
    place[order[columns]] = here.argmax(axis=0)
    return size, start, place


def matching(flat: np.ndarray, starts: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Letters in the blocks that ``difflib.SequenceMatcher`` matches, for each pair of names; the second have under JUNK letters."""
    got = np.zeros(len(first), np.int64)
    pair, a, ae, b, be = np.arange(len(first)), starts[first], starts[first + 1], starts[second], starts[second + 1]
    while True:
        some = (ae > a) & (be > b)
        pair, a, ae, b, be = pair[some], a[some], ae[some], b[some], be[some]
        if not len(pair):
            return got
        like = (4 * np.log2(ae - a)).astype(np.int64)  # stretches of like lengths go together
        order = np.lexsort((b - be, like))
        pair, a, ae, b, be, like = pair[order], a[order], ae[order], b[order], be[order], like[order]
        n, m = ae - a, be - b
        k, i, j = (np.empty(len(pair), np.int64) for _ in range(3))
        at = 0
        while at < len(pair):
            cut = slice(at, min(at + max(1, CELLS // int(m[at])), int(np.searchsorted(like, like[at], "right"))))
            k[cut], i[cut], j[cut] = _longest(flat, a[cut], n[cut], b[cut], m[cut])
            at = cut.stop
        got += np.bincount(pair, k, len(got)).astype(np.int64)
        i, j, some = a + i, b + j, k > 0
        both = lambda x, y: np.concatenate([x[some], y[some]])  # noqa: B023, E731
        pair, a, ae, b, be = both(pair, pair), both(a, i + k), both(i, ae), both(b, j + k), both(j, be)
