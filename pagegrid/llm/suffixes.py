"""Suffix arrays by Larsson-Sadakane refinement and common prefixes by Kasai's bound, in numpy."""

from __future__ import annotations

import numpy as np

#: Symbols compared at once as one number, and bits of each.
FIRST, BITS = 7, 9
#: Bits of a number that is sorted.
WORD = 63


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All parts as one sequence of symbols, each closed by a zero; their starts."""
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    ends = np.cumsum(sizes)
    symbols = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.int64)
    symbols += 1
    symbols[ends - 1] = 0
    return symbols, ends - sizes


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order; symbols lie below 2 ** ``BITS``.

    Suffixes are sorted by their first symbols; then groups that are still equal, and only
    those, are sorted by the rank of what follows, twice as far each time. Where they fit into
    one number, rank, what follows and start are sorted as such: that needs no indirect sort.
    """
    size = len(symbols)
    bits = (size + 1).bit_length()
    mask = (1 << bits) - 1
    # Symbols are numbered from one, so that the end of all sorts before any.
    used = np.bincount(symbols) > 0
    width = max(1, int(used.sum()).bit_length())
    reach = (WORD - bits) // width
    key = _packed(np.cumsum(used)[symbols], reach, width)
    key <<= bits
    key |= np.arange(size)
    key.sort()
    own = key & mask
    key >>= bits
    order = own.copy()
    rank = np.zeros(size + 1, np.int64 if bits > 31 else np.int32)
    active = np.arange(size)
    while True:
        # Groups are named by the place of their first suffix in the order, from one.
        head = np.ones(len(own) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=head[1:-1])
        heads = np.flatnonzero(head)
        group = np.repeat(active[heads[:-1]] + 1, np.diff(heads))
        rank[own] = group
        more = ~(head[:-1] & head[1:])
        active, own, key = active[more], own[more], group[more]
        if not len(active):
            return order
        key <<= bits
        key |= rank[np.minimum(own + reach, size)]
        if 3 * bits <= WORD:
            key <<= bits
            key |= own
            key.sort()
            own = key & mask
            key >>= bits
        else:
            sort = np.argsort(key)
            own, key = own[sort], key[sort]
        order[active] = own
        reach *= 2


def _packed(symbols: np.ndarray, count: int, width: int) -> np.ndarray:
    """By place, the next ``count`` symbols as one number, zeros after the end."""
    size = len(symbols)
    padded = np.concatenate([symbols, np.zeros(count, np.int64)])
    words = np.zeros(size, np.int64)
    for k in range(count):
        words <<= width
        words |= padded[k : k + size]
    return words


def common_prefixes(symbols: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """By start, the symbols (``most`` or fewer) that a suffix shares with the one before it.

    Only suffixes with ``most`` symbols left in their part are asked for; the rest have zero.
    A suffix shares at least what the one a symbol earlier shares, less one (Kasai), and just
    that where the symbols before both are equal. Only the others, and the first of each part,
    are compared, several symbols at a time.
    """
    size = len(symbols)
    place = np.arange(size)
    before = np.full(size, -1)
    before[order[1:]] = order[:-1]
    fresh = before < 1
    fresh |= symbols[np.maximum(before, 1) - 1] != symbols[place - 1]
    fresh[starts] = True
    left = np.repeat(starts + sizes, sizes + 1) - place
    words = np.append(_packed(symbols, FIRST, BITS), 0)
    own = np.flatnonzero(fresh)
    height = np.zeros(len(own), np.int64)
    live = np.flatnonzero(before[own] >= 0)
    h = 0
    while len(live):
        x, y = own[live] + h, before[own[live]] + h
        differ = words[np.minimum(x, size)] ^ words[np.minimum(y, size)]
        for k in range(1, FIRST + 1):
            height[live] += differ < 1 << BITS * (FIRST - k)
        h += FIRST
        live = live[(differ == 0) & (h < left[own[live]])]
    # Kasai's bound is exact up to the next suffix that was compared.
    ends = np.zeros(size, np.int64)
    ends[own] = np.minimum(height, left[own]) + own
    shared = np.minimum(ends[np.maximum.accumulate(np.where(fresh, place, 0))] - place, most)
    return np.where(left >= most, shared, 0)
