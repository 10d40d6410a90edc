"""Edit distances of many pairs of short texts at once, by bit-parallel columns (Myers 1999, Hyyro 2003)."""

from __future__ import annotations

import numpy as np

#: Words of 64 diagonals that a band may have here, and how many of them the masks of a chunk of pairs take.
WIDE, CELLS = 16, 1 << 20
#: Pairs from which a group is worth its columns, and at most in a chunk.
FEWEST, MOST = 16, 2048
#: Letters of a text up to which it is compared here, and how many of them at a time with the other's.
LONGEST, STEP = 1 << 14, 32

_ONE, _TOP = np.uint64(1), np.uint64(63)


def _coded(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Code points of both lists, end to end, numbered from 0 by those that occur."""
    both = [np.frombuffer("".join(x).encode("utf-32-le"), np.uint32) for x in (a, b)]
    seen = np.zeros(0x110000, bool)
    for x in both:
        seen[x] = True
    number = np.cumsum(seen, dtype=np.int32) - np.int32(1)
    return number[both[0]], number[both[1]], int(seen.sum())


def _flat(lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of the chosen texts: its pair, its position, and its place among all letters."""
    pair = np.repeat(np.arange(len(lengths)), lengths)
    position = np.arange(len(pair)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return pair, position, starts[pair] + position


def _alike(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, left: np.ndarray, way: int) -> np.ndarray:
    """Letters that each pair of texts has in common from places i and j on, of ``left`` at most; way -1: backwards."""
    out, live, step = np.zeros(len(i), np.int64), np.flatnonzero(left > 0), np.arange(STEP)
    while len(live):
        at = np.minimum(out[live, None] + step, left[live, None] - 1)
        differ = a[i[live, None] + way * at] != b[j[live, None] + way * at]
        found = differ.any(axis=1)
        out[live] = np.minimum(out[live] + np.where(found, differ.argmax(axis=1), STEP), left[live])
        live = live[~found & (out[live] < left[live])]
    return out


def _ones(bits: np.ndarray) -> np.ndarray:
    """Words whose lowest ``bits`` bits are set; none below 0, all from 64 on."""
    bits = np.clip(bits, 0, 64)
    return np.where(bits == 64, ~np.uint64(0), (_ONE << np.minimum(bits, 63).astype(np.uint64)) - _ONE)


def _diagonals(a: np.ndarray, b: np.ndarray, starts: tuple[np.ndarray, np.ndarray], m: np.ndarray, n: np.ndarray, most: np.ndarray, wide: int, letters: int) -> np.ndarray:
    """Distances of pairs along a band of 64 * ``wide`` diagonals (Hyyro 2003); the second texts come longest first.

    A path of at most ``most`` edits, under 64 * wide, stays within as many diagonals (Ukkonen 1985), so distances
    up to it are exact, and what is told beyond it is no less than the distance. The top bit of the last word is the
    row ``below`` the main diagonal; the rows that follow on a first text equal nothing and are taken off at the end.
    """
    differ, top = n - m, 64 * wide - 1
    below = (most - differ) // 2
    pair, at, place = _flat(m, starts[0])
    at += (top - below)[pair]
    masks = np.zeros(((max(int(at.max()), int(n[0])) >> 6) + 1 + wide, len(m) * letters), np.uint64)
    np.add.at(masks.reshape(-1), (at >> 6) * masks.shape[1] + pair * letters + a[place], _ONE << (at & 63).astype(np.uint64))
    pair, at, place = _flat(n, starts[1])
    column = np.zeros((int(n[0]), len(n)), np.int64)
    column[at, pair] = b[place] + pair * letters
    active = np.searchsorted(-n, -np.arange(int(n[0])), "left")
    up, down = [~_ones(top - below - 64 * w) for w in range(wide)], [np.zeros(len(m), np.uint64) for _ in range(wide)]
    free = np.zeros(len(m), np.uint64)  # steps along the lowest diagonal that cost nothing
    for j, k in enumerate(active.tolist()):
        at, word, shift = column[j, :k], j >> 6, np.uint64(j & 63)
        equal = [masks[word + w].take(at) for w in range(wide + bool(shift))]
        steps, more = [], None
        for w in range(wide):
            same, pv = equal[w], up[w][:k]
            if shift:
                same = same >> shift | equal[w + 1] << (np.uint64(64) - shift)
            total = (same & pv) + pv
            if w + 1 < wide:
                carry = total < pv
            if more is not None:
                total += more
                if w + 1 < wide:
                    carry |= total < more
            if w + 1 < wide:
                more = carry.astype(np.uint64)
            total ^= pv
            total |= same
            total |= down[w][:k]
            steps.append(total)
        free[:k] += steps[-1] >> _TOP
        for w, diagonal in enumerate(steps):
            pv, mv = up[w][:k], down[w][:k]
            plus, minus = mv | ~(diagonal | pv), pv & diagonal
            diagonal = diagonal >> _ONE
            if w + 1 < wide:
                diagonal |= steps[w + 1] << _TOP
            up[w][:k] = minus | ~(diagonal | plus)
            down[w][:k] = diagonal & plus
    score = below + n - free.view(np.int64)
    for w in range(wide):
        beyond = _ones(np.array(top - 64 * w)) & ~_ones(top - differ - below - 64 * w)
        score += np.bitwise_count(down[w] & beyond).astype(np.int64) - np.bitwise_count(up[w] & beyond).astype(np.int64)
    return score


def distances(a: list[str], b: list[str], most: np.ndarray | None = None) -> np.ndarray:
    """Levenshtein distance of each pair; -1 where the pair is left to a plain comparison.

    That holds for texts whose shorter one is empty, for those that may differ in 64 * WIDE letters or more, and for
    the few of a rare width.
    Distances over ``most`` may be told as any number over it.
    """
    out = np.full(len(a), -1, np.int64)
    swap = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    a, b = [x for x, _ in swap], [y for _, y in swap]
    m, n = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    fit = np.flatnonzero((m > 0) & (n <= LONGEST))
    if len(fit) < FEWEST:
        return out
    m, n = m[fit], n[fit]
    most = m + n if most is None else most[fit]
    x, y, letters = _coded([a[i] for i in fit.tolist()], [b[i] for i in fit.tolist()])
    starts = np.cumsum(m) - m, np.cumsum(n) - n
    begin = _alike(x, y, *starts, m, 1)
    end = _alike(x, y, starts[0] + m - 1, starts[1] + n - 1, m - begin, -1)
    starts, m, n = (starts[0] + begin, starts[1] + begin), m - begin - end, n - begin - end
    out[fit] = np.where(m == 0, n, np.where(n - m > most, most + 1, -1))
    most = np.minimum(most, n)
    width = np.where(out[fit] < 0, most // 64 + 1, 0)
    for wide in np.unique(width[(width > 0) & (width <= WIDE)]).tolist():
        group = np.flatnonzero(width == wide)
        if len(group) < FEWEST:
            continue
        group, at = group[np.argsort(-n[group], kind="stable")], 0
        while at < len(group):
            step = max(FEWEST, min(MOST, CELLS // (letters * ((int(n[group[at]]) >> 6) + 2 + 2 * wide))))
            g = group[at : at + step]
            out[fit[g]] = _diagonals(x, y, (starts[0][g], starts[1][g]), m[g], n[g], most[g], wide, letters)
            at += step
    return out
