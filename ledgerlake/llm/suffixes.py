"""Deep-shallow sorting of suffixes, vectorised.

``sort_suffixes`` orders byte strings of one buffer by their first ``depth`` bytes.
Shallow part: multikey quicksort with eight bytes as a character; after each character only
groups that are still tied go on.  Deep part: a group still tied at the shallow depth goes
into a blind trie.  Inserting a string compares it with one leaf only; the length
of the common prefix says at which node it branches off.  All strings of a group are
compared with the same leaf at once, and those that branch off at the same
depth with the same byte form the next, smaller group.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
WORD = 8
SHALLOW = 32


def words_at_every_byte(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros beyond the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)])
    out = np.zeros(n, U64)
    for i in range(WORD):
        out <<= U64(8)
        out |= padded[i : i + n]
    return out


def sort_suffixes(data: np.ndarray, starts: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order of ``starts``, class of each in that order): classes are numbered by rank, equal strings share one.

    Every start has at least ``depth`` bytes before the buffer ends.
    """
    n = len(starts)
    words = words_at_every_byte(data)
    order = np.arange(n)
    group = np.zeros(n, np.int64)
    for at in range(0, min(shallow, depth), WORD):
        tied = np.flatnonzero(ties(group))
        if not len(tied):
            break
        key = char(words, starts[order[tied]], at, depth)
        inner = np.lexsort((key, group[tied]))
        order[tied] = order[tied][inner]
        key, g = key[inner], group[tied]
        fresh = np.zeros(n, bool)
        fresh[tied[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        group = renumber(group, fresh)
    if depth > shallow:
        order, group = blind_tries(words, starts, order, group, shallow, depth)
    return order, group


def char(words: np.ndarray, starts: np.ndarray, at: int, depth: int) -> np.ndarray:
    """The character of eight bytes at depth ``at``; bytes from ``depth`` on are cleared."""
    out = words[starts + at]
    left = depth - at
    return out if left >= WORD else out >> U64(8 * (WORD - left)) << U64(8 * (WORD - left))


def ties(group: np.ndarray) -> np.ndarray:
    """Whether each entry's neighbour is of the same group."""
    out = np.zeros(len(group), bool)
    same = group[1:] == group[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def renumber(group: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Groups in order, split where ``fresh`` begins a new one."""
    new = fresh.copy()
    new[1:] |= group[1:] != group[:-1]
    new[:1] = False
    return np.cumsum(new)


def blind_tries(words: np.ndarray, starts: np.ndarray, order: np.ndarray, group: np.ndarray, shallow: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Finish the groups tied at ``shallow``."""
    n = len(order)
    # Where each string stands in its trie: one key for each branching it took, compared in turn.
    path: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cell = group.copy()
    open_ = np.flatnonzero(ties(group))
    while len(open_):
        c = cell[open_]
        by = np.argsort(c, kind="stable")
        open_, c = open_[by], c[by]
        head = np.ones(len(c), bool)
        head[1:] = c[1:] != c[:-1]
        leaf = np.flatnonzero(head)[np.cumsum(head) - 1]
        mine, other = starts[order[open_]], starts[order[open_[leaf]]]
        lcp = np.full(len(open_), depth)
        above, below = np.zeros(len(open_), U64), np.zeros(len(open_), U64)
        todo = np.arange(len(open_))
        for at in range(shallow, depth, WORD):
            x, y = char(words, mine[todo], at, depth), char(words, other[todo], at, depth)
            off = x != y
            hit = todo[off]
            diff = x[off] ^ y[off]
            byte = leading_zero_bytes(diff)
            lcp[hit] = at + byte
            shift = U64(8) * (U64(7) - byte.astype(U64))
            above[hit], below[hit] = x[off] >> shift & U64(255), y[off] >> shift & U64(255)
            todo = todo[~off]
            if not len(todo):
                break
        # Smaller than the leaf: the deeper the branching, the larger. Larger: the deeper, the smaller.
        less = (lcp < depth) & (above < below)
        side = np.where(lcp == depth, 0, np.where(less, -1, 1))
        turn = np.where(less, lcp, np.where(side > 0, depth + depth - lcp, 0))
        path.append((open_, side * (4 * depth) + np.where(side < 0, turn, np.where(side > 0, turn, 0)), above.astype(np.int64)))
        rest = np.flatnonzero(lcp < depth)
        if not len(rest):
            break
        ident = np.stack([c[rest], lcp[rest], above[rest].astype(np.int64)], axis=1)
        _, number = np.unique(ident, axis=0, return_inverse=True)
        number = number.reshape(-1)
        size = np.bincount(number)
        cell[open_[rest]] = number
        open_ = open_[rest][size[number] > 1]
    if not path:
        return order, group
    keys = []
    for at, turn, byte in path:
        for k in (turn, byte):
            full = np.zeros(n, np.int64)
            full[at] = k
            keys.append(full)
    for k, (at, turn, _) in enumerate(path):
        keys[2 * k + 1][at[turn == 0]] = 0
    by = np.lexsort((*keys[::-1], group))
    fresh = np.zeros(n, bool)
    for k in (*keys, group):
        fresh[1:] |= k[by][1:] != k[by][:-1]
    return order[by], renumber(np.zeros(n, np.int64), fresh)


def leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    """Number of zero bytes before the first other one."""
    out = np.zeros(len(x), np.int64)
    for i in range(1, WORD):
        out += (x >> U64(64 - 8 * i)) == 0
    return out
