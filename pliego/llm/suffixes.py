"""Two-stage suffix sorting of a block of strings, and the repeats it shows.

Only suffixes that are smaller than their successor (the suffix one place on) are sorted directly. Every other suffix is larger
than its successor, so one scan over the buckets of first symbols, from the smallest on, puts it in place: when a suffix
is met in the scan, the suffix before it is next in its own bucket. Adjacent suffixes of the result are compared for
their common prefix. Order and prefixes are only needed to the depth of the repeats that are looked for.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def _words(data: np.ndarray, room: int) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number, zeros beyond the end, ``room`` places more."""
    padded = np.concatenate([data, np.zeros(room + WORD, np.uint8)])
    out = np.zeros(data.size + room, np.uint64)
    for i in range(WORD):
        out = (out << np.uint64(8)) | padded[i : i + out.size]
    return out


def _smaller_than_next(symbols: np.ndarray) -> np.ndarray:
    """For each suffix but the last whether it is smaller than its successor; runs follow the symbol after them."""
    step = np.sign(np.diff(symbols.astype(np.int32)))
    place = np.where(step != 0, np.arange(step.size), step.size)
    after = np.minimum.accumulate(place[::-1])[::-1]
    return np.append(step, 0)[after] > 0


def _direct(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Sort places by ``depth`` bytes: by eight bytes at a time, only what is still tied."""
    order = places[np.argsort(words[places], kind="stable")]
    tied = np.append(False, words[order[1:]] == words[order[:-1]])  # with the one before
    for at in range(WORD, depth, WORD):
        member = tied | np.append(tied[1:], False)
        where = np.flatnonzero(member)
        if not where.size:
            break
        group = np.cumsum(~tied[where])
        keys = words[order[where] + at]
        again = np.lexsort((keys, group))
        order[where] = order[where][again]
        keys = keys[again]
        same = np.append(False, keys[1:] == keys[:-1])
        tied[where] &= same
    return order


def suffix_order(symbols: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in the order of their first ``depth`` bytes. ``symbols`` are bytes + 1, and 0 after each string."""
    smaller = np.append(_smaller_than_next(symbols), False)
    ends = np.flatnonzero(symbols == 0)
    sorted_ = _direct(np.flatnonzero(smaller & (symbols > 0)), words, depth)
    edges = np.searchsorted(symbols[sorted_], np.arange(259))
    waiting: list[list[np.ndarray]] = [[] for _ in range(258)]
    out = []

    def induce(met: np.ndarray, symbol: int) -> np.ndarray:
        """Hand the larger suffixes before ``met`` on to their buckets; returns those of this bucket."""
        before = met[met > 0] - 1
        before = before[~smaller[before] & (symbols[before] > 0)]
        first = symbols[before]
        by = np.argsort(first, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(first[by])) + 1):
            if part.size and first[part[0]] > symbol:
                waiting[first[part[0]]].append(before[part])
        return before[first == symbol]

    out.append(ends)
    induce(ends, 0)
    for symbol in range(1, 257):
        met = np.concatenate(waiting[symbol]) if waiting[symbol] else ends[:0]
        while met.size:
            out.append(met)
            met = induce(met, symbol)
        met = sorted_[edges[symbol] : edges[symbol + 1]]
        if met.size:
            out.append(met)
            induce(met, symbol)
    return np.concatenate(out)


def equal_windows(strings: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``size`` bytes that occur twice or more: number of the group of equal ones, string, start in it."""
    lengths = np.array([len(s) for s in strings], np.int64)
    nothing = np.zeros(0, np.int64)
    if not lengths.size or lengths.max() < size:
        return nothing, nothing, nothing
    data = np.frombuffer(b"\x00".join(strings) + b"\x00", np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    symbols = data.astype(np.int16) + 1
    symbols[ends] = 0
    words = _words(data, size)
    order = suffix_order(symbols, words, size)
    owner = np.searchsorted(ends, order)
    whole = ends[owner] - order >= size  # suffixes that hold a whole window
    order, owner = order[whole], owner[whole]
    same = np.arange(1, order.size)  # places whose window equals the one before, as far as compared
    for at in range(0, size, WORD):
        cut = np.uint64(8 * max(0, WORD - (size - at)))
        same = same[words[order[same] + at] >> cut == words[order[same - 1] + at] >> cut]
    like_last = np.zeros(order.size + 1, bool)
    like_last[same] = True
    member = like_last[:-1] | like_last[1:]
    group = np.cumsum(~like_last[:-1])[member]
    return group, owner[member], order[member] - (ends - lengths)[owner[member]]
