"""Jaro-Winkler of all pairs of two lists at once: texts are bit masks, pairs are cells of small matrices, and
the scores are those of jaro_winkler_pair() to the last bit, as they come from a table of its own expression."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np

from .similarity import jaro_winkler_pair

#: Cells of a matrix, whose few copies then stay in a core's cache; below FEW pairs a plain loop costs less.
CELLS, FEW = 1 << 16, 64
#: A second pass goes over the cells that may still reach the score if they are fewer than this share.
SPARSE = 1 / 32
#: Lengths of the second text that share a word size. Longer texts are scored one by one.
WORDS = ((1, 16, np.uint16), (17, 32, np.uint32), (33, 64, np.uint64))


@lru_cache(maxsize=512)
def _table(la: int, lb: int) -> np.ndarray:
    """Scores by common prefix (four at most), matches, and matches that stand in order."""
    out = np.zeros((5, la + 1, la + 1))
    for m in range(1, min(la, lb) + 1):
        for same in range(m + 1):
            jaro = (m / la + m / lb + (m - (m - same) // 2) / m) / 3
            out[:, m, same] = [jaro if jaro <= 0.7 else jaro + p * 0.1 * (1 - jaro) for p in range(5)]
    return out


def rounded(score: float, digits: int | None) -> float:
    """Half up on the shortest decimal form, as Spark rounds doubles."""
    return score if digits is None else float(Decimal(repr(score)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


@lru_cache(maxsize=512)
def _rounded_table(la: int, lb: int, digits: int | None) -> np.ndarray:
    x = _table(la, lb)
    return x if digits is None else np.array([rounded(v, digits) for v in x.ravel().tolist()]).reshape(x.shape)


def _codes(texts: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(x.ljust(width, "\0") for x in texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width)


def _passes(of, free: np.ndarray, windows: list[np.ndarray], steps: range, known: int) -> tuple[np.ndarray, object]:
    """(matches, a function that counts those in order); of(i, out) gives the places of the first text's character i in the second."""
    start, g, x, lows = free.copy(), np.empty_like(free), np.empty_like(free), []
    for i in steps:
        of(i, g)
        np.bitwise_and(g, free, out=x)
        np.bitwise_and(x, windows[i], out=x)
        low = np.negative(x)
        np.bitwise_and(x, low, out=low)
        np.bitwise_xor(free, low, out=free)
        lows.append(low)
    used = np.bitwise_xor(start, free)
    m = np.bitwise_count(used)
    m += np.uint8(known)

    def in_order() -> np.ndarray:
        same, bit, mask = np.full(free.shape, known, np.uint8), np.empty(free.shape, bool), np.empty_like(free)
        for i, low in zip(steps, lows, strict=True):
            np.not_equal(low, 0, out=bit)
            mask[...] = bit
            np.negative(mask, out=mask)
            np.negative(used, out=x)
            np.bitwise_and(x, used, out=x)
            np.bitwise_and(x, mask, out=x)  # the next matched place, where this character has matched
            np.bitwise_xor(used, x, out=used)
            of(i, g)
            np.bitwise_and(g, x, out=g)
            np.not_equal(g, 0, out=bit)
            np.add(same, bit.view(np.uint8), out=same)
        return same

    return m, in_order


def pairs_above(
    a: list[str], b: list[str], least: np.ndarray, shared: int = 0, ratio: float = 0.0, same: bool = False, cap: int = 4, digits: int | None = None,
    below: float = np.inf,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, scores) of the pairs with a score of least[row] or more and under below, scores rounded if digits
    says so. All texts begin with the same `shared` characters. least may be raised between results. Pairs that share
    more than cap (of four) first characters may be left out. same: a is b, and each pair counts once."""
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    ratio_met = lambda x, y: np.minimum(x, y) >= ratio * np.maximum(x, y)

    def plain(rows, cols):
        found = [(i, j, s) for i in rows for j in cols if ratio_met(la[i], lb[j]) and least[i] <= (s := jaro_winkler_pair(a[i], b[j])) < below]
        if found:
            r, c, s = zip(*found, strict=True)
            yield np.array(r, np.int64), np.array(c, np.int64), np.array([rounded(x, digits) for x in s])

    def plain_once(rows, cols):
        if not same:
            yield from plain(rows, cols)
        else:
            for i in rows:
                yield from plain([i], [j for j in cols if (lb[j], j) > (la[i], i)])

    special = [np.flatnonzero((lb < 1) | (lb > WORDS[-1][1])), np.flatnonzero(la < 1)]
    if len(special[0]):
        yield from plain_once(range(len(a)), special[0])
    if len(special[1]):
        yield from plain_once(special[1], np.setdiff1d(np.arange(len(b)), special[0]))
    rows_of = {int(n): np.flatnonzero(la == n) for n in np.unique(la) if n > 0}
    for short, long, word in WORDS:
        cols = np.flatnonzero((lb >= short) & (lb <= long))
        if not len(cols):
            continue
        cols = cols[np.argsort(lb[cols], kind="stable")]
        n = lb[cols]
        masks = None
        for length, rows in rows_of.items():
            fit = np.flatnonzero(ratio_met(np.int64(length), n) & ((n >= length) | (not same)))
            if not len(fit):
                continue
            lo, hi = int(fit[0]), int(fit[-1]) + 1  # the lengths that fit stand together
            if len(rows) * (hi - lo) <= FEW:
                yield from plain_once(rows, cols[lo:hi])
                continue
            if masks is None:
                codes = _codes([b[j] for j in cols], int(n[-1]))
                letters = np.unique(codes)
                masks = np.zeros((len(letters) + 1, len(cols)), word)  # the last row: characters that b lacks
                for i in range(codes.shape[1]):
                    has = np.flatnonzero(n > i)
                    masks[np.searchsorted(letters, codes[has, i]), has] |= word(1 << i)
            own = _codes([a[i] for i in rows], length)
            at = np.minimum(np.searchsorted(letters, own), len(letters) - 1)
            at = np.where(letters[at] == own, at, len(letters))
            kinds, kind = np.unique(n[lo:hi], return_inverse=True)
            tables = np.stack([_table(length, int(k)) for k in kinds])
            given = np.stack([_rounded_table(length, int(k), digits) for k in kinds]).ravel()
            most = np.array([t[cap, min(length, int(k)), min(length, int(k))] for t, k in zip(tables, kinds, strict=True)])
            known = min(shared, length, int(kinds[0]))
            reach = [max(max(length, int(k)) // 2 - 1, 0) for k in kinds]
            full = [(1 << int(k)) - 1 for k in kinds]
            start = np.array([f >> known << known for f in full], word)[kind]
            windows = [np.array([((1 << i + r + 1) - (1 << max(0, i - r))) & f for r, f in zip(reach, full, strict=True)], word)[kind] for i in range(length)]
            wide = min(hi - lo, 1024)
            high = max(1, CELLS // wide)
            order = np.argsort(least[rows], kind="stable")
            for r0 in range(0, len(rows), high):
                pick = order[r0 : r0 + high]
                for c0 in range(lo, hi, wide):
                    c1 = min(c0 + wide, hi)
                    open_ = most[kind[c0 - lo : c1 - lo]]
                    in_reach = np.flatnonzero(open_ >= least[rows[pick]].min())
                    if not len(in_reach):
                        continue
                    d0, d1 = c0 + int(in_reach[0]), c0 + int(in_reach[-1]) + 1
                    mine = pick[least[rows[pick]] <= open_[d0 - c0 : d1 - c0].max()]
                    yield from _cells(
                        rows[mine], cols[d0:d1], at[mine], own[mine], np.ascontiguousarray(masks[:, d0:d1]), codes[d0:d1], kind[d0 - lo : d1 - lo],
                        start[d0 - lo : d1 - lo], [w[d0 - lo : d1 - lo] for w in windows], tables, given, known, least, below, same and length, n[d0:d1],
                    )


def _cells(rows, cols, at, own, masks, codes, kind, start, windows, tables, given, known, least, below, once, n):
    """pairs_above() for one matrix."""
    shape, length = (len(rows), len(cols)), at.shape[1]
    prefix, equal = np.full(shape, min(known, 4), np.uint8), np.ones(shape, bool)
    for i in range(min(known, 4), min(4, length, codes.shape[1])):
        np.logical_and(equal, own[:, i][:, None] == codes[:, i], out=equal)
        np.add(prefix, equal.view(np.uint8), out=prefix)
    free = np.empty(shape, masks.dtype)
    free[...] = start
    m, in_order = _passes(lambda i, out: np.take(masks, at[:, i], axis=0, out=out, mode="clip"), free, windows, range(known, length), known)
    side = length + 1
    base = np.multiply(prefix, side, dtype=np.intp)
    base += m
    base *= side
    base += kind * tables[0].size
    flat = tables.ravel()
    floor = least[rows]
    one = floor.min() == floor.max()  # one floor: whether a score reaches it stands in a table
    best = base + m
    may = (flat >= floor[0]).take(best) if one else flat.take(best) >= floor[:, None]
    if once:
        may &= (n > once) | (cols > rows[:, None])
    k = int(np.count_nonzero(may))
    if not k:
        return
    if k < SPARSE * may.size:
        r, c = np.divmod(np.flatnonzero(may), len(cols))

        def of(i, out):
            out[...] = masks[at[r, i], c]

        _, in_order = _passes(of, start[c], [w[c] for w in windows], range(known, length), known)
        code = base[r, c] + in_order()
        score = flat[code]
        hit = (score >= floor[r]) & (score < below)
        r, c, code = r[hit], c[hit], code[hit]
    else:
        base += in_order()
        may &= ((flat >= floor[0]) & (flat < below)).take(base) if one else ((x := flat.take(base)) >= floor[:, None]) & (x < below)
        found = np.flatnonzero(may)
        r, c = np.divmod(found, len(cols))
        code = base.ravel()[found]
    if len(r):
        yield rows[r], cols[c], given[code]
