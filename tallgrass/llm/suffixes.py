"""Enhanced suffix arrays over many short byte strings, and the maximal repeats in them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64


def _equal_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading bytes (of 8, big-endian) in which x and y agree."""
    differ = x ^ y
    out = np.full(len(x), 8, dtype=np.int64)
    for k in range(7, -1, -1):
        out[differ >= _U(1 << (8 * (7 - k)))] = k
    return out


def enhanced_suffix_array(data: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes data[start : start + limit] in lexicographic order, and the common prefix of each with its predecessor (0 for the first).

    Sorting goes eight bytes at a time, and only blocks of suffixes that agree
    so far are sorted on. A suffix that ends sorts before its extensions.
    """
    n = len(starts)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    words = np.zeros(len(data) + 1, dtype=_U)
    for k in range(8):
        words = (words << _U(8)) | padded[k : k + len(words)].astype(_U)
    order = np.arange(n)
    lcp = np.zeros(n, dtype=np.int64)
    block = np.zeros(n, dtype=np.int64)
    slots = np.arange(n)
    depth = 0
    while len(slots):
        chosen = order[slots]
        valid = np.clip(limits[chosen] - depth, 0, 8)
        key = words[np.minimum(starts[chosen] + depth, len(words) - 1)]
        spare = ((8 - valid) * 8).astype(_U)
        key = np.where(valid > 0, (key >> np.minimum(spare, _U(56))) << np.minimum(spare, _U(56)), _U(0))
        by = np.lexsort((valid, key, block))
        order[slots] = chosen[by]
        key, valid, own = key[by], valid[by], block[by]
        same_block = own[1:] == own[:-1]
        same = same_block & (key[1:] == key[:-1]) & (valid[1:] == valid[:-1])
        split = np.flatnonzero(same_block & ~same) + 1
        lcp[slots[split]] = depth + np.minimum(_equal_bytes(key[split - 1], key[split]), np.minimum(valid[split - 1], valid[split]))
        # blocks that go on: at least two suffixes that agree and have not ended
        fresh = np.cumsum(np.concatenate(([0], ~same))).astype(np.int64) if len(slots) else block
        size = np.bincount(fresh)
        ended = (size[fresh] > 1) & (valid < 8)
        inner = np.flatnonzero(ended[1:] & same) + 1
        lcp[slots[inner]] = depth + valid[inner]
        going = (size[fresh] > 1) & (valid == 8)
        slots, block = slots[going], fresh[going]
        depth += 8
    return order, lcp


@dataclass
class Repeats:
    """Maximal repeat groups: group g has length lengths[g] and the suffixes order[first[g] : last[g] + 1]."""

    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    lengths: np.ndarray


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, left: np.ndarray, least: int) -> Repeats:
    """The nodes of the common-prefix interval tree, of depth least at least, whose occurrences differ to the left.

    The tree is never built: a stack holds the intervals that are open while the
    array is scanned, and an interval is judged when it closes. left: the byte
    before each suffix, or a negative value where it is unknown, which counts as
    different from all others.
    """
    n = len(order)
    before = left[order] if n else left
    change = np.ones(n, dtype=np.int64)
    change[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
    changes = np.cumsum(change)
    unknown = before < 0
    deep = lcp >= least
    first, last, lengths = [], [], []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], deep.astype(np.int8), [0]))))
    heads, tails = edges[::2] - 1, edges[1::2] - 1
    pair = heads + 1 == tails
    # intervals of two suffixes need no stack
    a, b = heads[pair], tails[pair]
    diverse = (changes[b] > changes[a]) | unknown[a]
    first.append(a[diverse])
    last.append(b[diverse])
    lengths.append(lcp[b[diverse]])
    lcps, change_list, unknown_list = lcp.tolist() if (~pair).any() else [], changes.tolist() if (~pair).any() else [], unknown.tolist() if (~pair).any() else []
    more: list[tuple[int, int, int]] = []
    for head, tail in zip(heads[~pair].tolist(), tails[~pair].tolist(), strict=True):
        stack: list[tuple[int, int]] = []  # (depth, left end)
        for i in range(head + 1, tail + 2):
            depth = lcps[i] if i <= tail else 0
            begin = i - 1
            while stack and stack[-1][0] > depth:
                length, begin = stack.pop()
                if change_list[i - 1] > change_list[begin] or unknown_list[begin]:
                    more.append((begin, i - 1, length))
            if i <= tail and (not stack or stack[-1][0] < depth):
                stack.append((depth, begin))
    if more:
        x = np.array(more, dtype=np.int64)
        first.append(x[:, 0])
        last.append(x[:, 1])
        lengths.append(x[:, 2])
    return Repeats(order, np.concatenate(first), np.concatenate(last), np.concatenate(lengths))


def later_occurrences(found: Repeats, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, length) for each occurrence in each group that does not have the group's least rank."""
    sizes = found.last - found.first + 1
    if not len(sizes):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(found.first, sizes)
    suffix = found.order[at]
    ranks = rank[suffix]
    least = np.repeat(np.minimum.reduceat(ranks, ends - sizes), sizes)
    later = ranks > least
    return suffix[later], np.repeat(found.lengths, sizes)[later]
