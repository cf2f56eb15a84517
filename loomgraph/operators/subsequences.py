"""Longest common subsequences of names with many ids at once, so that few pairs are compared one by one.

Ids of a block are a tree by their beginnings, kept as arrays for each length. A batch of names goes down the tree together: the
row of a name's table of common subsequences, in bits, is made once for each beginning and not for each id. What a row
can still become bounds the weighted ratio of all ids below, and beginnings that can't reach a name's bound are left.
"""

from __future__ import annotations

import numpy as np

#: Characters of an id that goes into a tree, names in a batch, rows of a batch that are open at once, and beginnings that a first look follows.
LONGEST, NAMES, OPEN, FOLLOWED = 256, 256, 1 << 20, 24
WORD = 64
#: Scores are rounded to six places; what is this much below a bound is kept.
SLACK = 1e-5


def low_bits(n: np.ndarray, word: int) -> np.ndarray:
    """Masks of the lowest ``n`` bits, as far as they are in the given word."""
    n = np.clip(n - word * WORD, 0, WORD).astype(np.uint64)
    return np.where(n == WORD, ~np.uint64(0), (np.uint64(1) << np.minimum(n, np.uint64(WORD - 1))) - np.uint64(1))


def zeros(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the lowest ``n`` bits are zero: the characters in common with the first ``n`` of a name."""
    return sum(np.bitwise_count(~v[:, w] & low_bits(n, w)).astype(np.int64) for w in range(v.shape[1]))


class Tree:
    """Different ids without null characters, at most LONGEST long, in order; level p has the beginnings of length p."""

    def __init__(self, ids: list[str]):
        self.lengths = np.array([len(x) for x in ids], np.int64)
        n, most = len(ids), max(map(len, ids), default=0)
        codes = np.array(ids, f"<U{max(most, 1)}").view(np.uint32).reshape(n, max(most, 1)) if n else np.zeros((0, 1), np.uint32)
        self.alphabet, flat = np.unique(codes, return_inverse=True)
        codes = flat.reshape(codes.shape).astype(np.int32)
        first = np.zeros(n, np.int64)  # where an id differs from the one before it
        if n > 1:
            first[1:] = (codes[1:] != codes[:-1]).argmax(axis=1)
        self.levels = []  # (character, first id, first child, end of children, least length, largest length) of each beginning
        starts, ends = np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n)
        for p in range(1, most + 1):
            at = np.flatnonzero(first < p)
            until = np.append(at[1:], n)
            kept = self.lengths[at] >= p
            own, until = at[kept], until[kept]
            # an id that is a beginning of others stands before them in their place, and is no child of this level
            children = np.searchsorted(own, starts), np.searchsorted(own, ends)
            low, high = self.span(own, until)
            self.levels.append((codes[own, p - 1], own, *children, low, high))
            starts, ends = own, until

    def span(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = np.stack([start, end], axis=1).ravel()
        padded = np.append(self.lengths, 0)  # an end may be the end of all
        return np.minimum.reduceat(padded, cuts)[::2], np.maximum.reduceat(padded, cuts)[::2]


def bound_of(common: np.ndarray, name: np.ndarray, least: np.ndarray, most: np.ndarray, parts_from: float, part_weight: float) -> np.ndarray:
    """The most that the weighted ratio can be with ids of ``least`` to ``most`` characters of which ``common`` can be in common."""
    whole = 200.0 * common / (name + least)
    in_parts = (name >= parts_from * least) | (most >= parts_from * name)
    part = part_weight * 200.0 * common / (np.minimum(name, least) + np.maximum(common, 1))
    return np.where(in_parts, np.maximum(whole, np.minimum(part, 100 * part_weight)), whole)


def search(tree: Tree, names: list[str], bounds: np.ndarray, k: int, parts_from: float, part_weight: float, followed: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (names' numbers, ids' numbers) that may be among the ``k`` best or reach a name's bound, if that is higher.

    Names are not empty. With ``followed``, a first look: only so many of a name's likeliest beginnings are kept at each length, and
    pairs are the ``k`` best found. Ids with the same score need not be more than ``k``, the first ones.
    """
    lengths = np.array([len(x) for x in names], np.int64)
    words = -(-int(lengths.max()) // WORD)
    place = {c: i for i, c in enumerate(tree.alphabet.tolist())}
    masks = np.zeros((len(names), len(place), words), np.uint64)
    for b, x in enumerate(names):
        for at, c in enumerate(x):
            if (i := place.get(ord(c))) is not None:
                masks[b, i, at // WORD] |= np.uint64(1 << at % WORD)
    b, node = np.arange(len(names)), np.zeros(len(names), np.int64)
    v = np.full((len(names), words), ~np.uint64(0))
    found: list[tuple] = []
    for p, (character, first, begin, end, least, most) in enumerate(tree.levels, 1):
        counts = end[node] - begin[node]
        total = int(counts.sum())
        if total > OPEN and len(names) > 1:
            half = len(names) // 2
            one = search(tree, names[:half], bounds[:half], k, parts_from, part_weight, followed)
            two = search(tree, names[half:], bounds[half:], k, parts_from, part_weight, followed)
            return one + [(x + half, y) for x, y in two]
        if not total:
            break
        up = np.repeat(np.arange(len(node)), counts)
        child = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + begin[node][up]
        b, v = b[up], v[up]
        carry = np.zeros(total, bool)
        for w in range(words):
            own = v[:, w]
            hit = own & masks[b, character[child], w]
            summed = own + hit
            over = summed < own
            carried = summed + carry.astype(np.uint64)
            over |= carried < summed
            v[:, w], carry = carried | (own - hit), over
        name = lengths[b]
        rest = most[child] - p
        common = np.minimum(zeros(v, np.maximum(name - rest, 0)) + np.minimum(rest, name), name)
        reach = bound_of(common, name, least[child], most[child], parts_from, part_weight)
        kept = reach >= bounds[b] - SLACK
        ended = kept & (tree.lengths[first[child]] == p)
        if ended.any():
            own, of = b[ended], name[ended]
            exact = zeros(v[ended], of)
            held = np.full(len(of), p)
            found.append((own, first[child][ended], exact, held, 200.0 * exact / (of + p), bound_of(exact, of, held, held, parts_from, part_weight)))
        kept &= most[child] > p
        if followed is not None and kept.any():
            at = np.flatnonzero(kept)
            at = at[np.lexsort((-reach[at], b[at]))]
            rank = np.arange(len(at)) - np.searchsorted(b[at], b[at])
            kept = np.zeros(total, bool)
            kept[at[rank < followed]] = True
        b, node, v = b[kept], child[kept], v[kept]
    if not found:
        return []
    own, row, exact, held, score, reach = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((row, -score, own))
    own, row, exact, held, score, reach = (c[order] for c in (own, row, exact, held, score, reach))
    place_of = np.arange(len(own)) - np.searchsorted(own, own)
    kth = np.full(len(names), -np.inf)
    kth[own[place_of == k - 1]] = score[place_of == k - 1]
    if followed is not None:
        kept = place_of < k
        return [(own[kept], row[kept])]
    # scores of ids of other lengths may be better in parts; of those with one score and length the first k are enough
    kept = reach >= np.maximum(kth, bounds)[own] - SLACK
    own, row, exact, held = (c[kept] for c in (own, row, exact, held))
    plain = (np.maximum(lengths[own], held) < parts_from * np.minimum(lengths[own], held))
    order = np.lexsort((row, held, exact, own))
    own, row, exact, held, plain = (c[order] for c in (own, row, exact, held, plain))
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (exact[1:] != exact[:-1]) | (held[1:] != held[:-1])
    since = np.arange(len(own)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(own) else np.zeros(0, np.int64)
    kept = ~plain | (since < k)
    return [(own[kept], row[kept])]
