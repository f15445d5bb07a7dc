"""The k best items of each query of a tile: rough scores of single precision say which pairs matter, whole ones decide."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_ITEMS, BLOCK_QUERIES = 2048, 512  # rough scores made at once (4 MB); queries of a block are sorted as 16-bit numbers
GROUP = 64           # items whose greatest rough score is looked at first
CROWDED = 1 / 32     # share of a block's items above a query's limit, as with equal scores, from which it is scored in double precision
DENSE = 1 / 200      # share of a tile's pairs that meet in a token from which it is multiplied as a whole row, not match by match
UNIT = 2.0 ** -23    # more than one rounding in single precision
DECIMALS = 6


class Best:
    """The k best (item, score) so far of each query of a block.  Items come in the order of their ids, so a later item enters
    only by a greater rounded score."""

    def __init__(self, queries: int, k: int, least: float):
        self.queries, self.k = queries, k
        self.floor = np.full(queries, least)
        self.full = np.zeros(queries, dtype=bool)
        self.held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.new: list[tuple] = []

    def add(self, rows: np.ndarray, items: np.ndarray, scores: np.ndarray) -> None:
        above = scores > self.floor[rows]
        self.new.append((rows[above], items[above], scores[above]))
        if sum(len(n[0]) for n in self.new) > self.queries or not self.full.all():
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.new:
            rows, items, scores = (np.concatenate(c) for c in zip(self.held, *self.new))
            by = np.argsort(-scores, kind="stable")  # the items of a query stand in their order
            by = by[np.argsort(rows[by].astype(np.uint16), kind="stable")]
            rows, items, scores = rows[by], items[by], scores[by]
            first = np.searchsorted(rows, np.arange(self.queries))
            place = np.arange(len(rows)) - first[rows]
            kept, last = place < self.k, place == self.k - 1
            self.floor[rows[last]] = scores[last]
            self.full[rows[last]] = True
            self.held, self.new = (rows[kept], items[kept], scores[kept]), []
        return self.held


def above(rough: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries, items) of the scores (items x queries) above their query's limit."""
    whole = len(rough) // GROUP * GROUP
    groups = rough[:whole].reshape(-1, GROUP, rough.shape[1])
    g, q = np.nonzero(groups.max(axis=1) > limit)
    hit, i = np.nonzero(groups[g, :, q] > limit[q][:, None])
    rest, q_rest = np.nonzero(rough[whole:] > limit)
    return np.concatenate([q[hit], q_rest]), np.concatenate([g[hit] * GROUP + i, rest + whole])


def best_of(queries: int, items: int, k: int, block: Callable, pairs: Callable, lowest: Callable, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, score) of the k best items of each query with scores above `least`; ties go to the earlier item.

    block(i, j, q, kind) makes the scores of items i to j (rows) for some queries in this precision, pairs(q, i) the whole scores of
    pairs, and lowest(scores, a, b) is what single precision makes of these scores of queries a to b at the lowest.
    """
    starts = range(0, queries, BLOCK_QUERIES)
    best = [Best(min(BLOCK_QUERIES, queries - a), k, least) for a in starts]
    for i in range(0, items, BLOCK_ITEMS):
        j = min(i + BLOCK_ITEMS, items)
        for a, held in zip(starts, best):
            b = a + held.queries
            rough = block(i, j, np.arange(a, b), np.float32)
            limit = lowest(held.floor, a, b)
            if not i and j > k:
                ahead = rough[:j // GROUP * GROUP].reshape(-1, GROUP, b - a).max(axis=1) if j // GROUP > k else rough  # the best of each group are enough
                limit = np.maximum(limit, lowest(lowest(np.partition(ahead.T, len(ahead) - k, axis=1)[:, len(ahead) - k].astype(float), a, b), a, b))
            # rounded down: what is above the limit in double precision is above it in single precision as well
            rows, cols = above(rough, np.nextafter(limit.astype(np.float32), np.float32(-np.inf)))
            crowded = np.bincount(rows, minlength=b - a) > CROWDED * (j - i)
            if crowded.any():
                single, many = ~crowded[rows], np.nonzero(crowded)[0]
                whole = np.round(block(i, j, many + a, np.float64).T, DECIMALS)
                q, c = np.nonzero(whole > held.floor[many][:, None])
                rows, cols = rows[single], cols[single]
                held.add(many[q], c + i, whole[q, c])
            if len(rows):
                held.add(rows, cols + i, np.round(pairs(rows + a, cols + i), DECIMALS))
    found = [(rows + a, cols, scores) for a, held in zip(starts, best) for rows, cols, scores in [held.settle()]]
    return tuple(np.concatenate(c) for c in zip(*found))


def first_copies(rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows, less those that have k equal rows before them: these score the same and lose every tie."""
    if len(rows) <= k:
        return np.arange(len(rows))
    flat = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    same = np.unique(flat, return_inverse=True)[1]
    by = np.argsort(same, kind="stable")
    place = np.empty(len(by), np.int64)
    first = np.searchsorted(same[by], np.arange(same.max() + 1))
    place[by] = np.arange(len(by)) - first[same[by]]
    return np.nonzero(place < k)[0]


def id_order(ids: pa.Array) -> np.ndarray:
    return pc.array_sort_indices(ids, null_placement="at_start").to_numpy()


# --------------------------------------------------------------- vectors
def nearest(asking: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, score) of the k greatest inner products of each query (rows); items are in the order of their ids."""
    kept = first_copies(vectors, k)
    vectors = vectors[kept]
    by_kind = {}
    for kind in (np.float32, np.float64):
        with np.errstate(over="ignore"):
            by_kind[kind] = np.ascontiguousarray(vectors, dtype=kind), np.ascontiguousarray(asking, dtype=kind)
    longest = np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0.0))
    size = np.sqrt(np.einsum("ij,ij->i", asking, asking)) * longest

    def block(i, j, some, kind):
        v, q = by_kind[kind if longest < 1e15 and size.max(initial=0.0) < 1e15 else np.float64]
        return v[i:j] @ q[some].T

    def pairs(rows, cols):
        step = 1 << 16
        return np.concatenate([np.einsum("ij,ij->i", asking[rows[at:at + step]], vectors[cols[at:at + step]]) for at in range(0, len(rows), step)] or [np.empty(0)])
    slack = size * (asking.shape[1] + 4) * UNIT
    rows, cols, scores = best_of(len(asking), len(vectors), k, block, pairs, lambda s, a, b: s - slack[a:b])
    return rows, kept[cols], scores


# ---------------------------------------------------------------- tokens
def unfolded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(position of the list, value) of each element."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), pc.list_flatten(lists).to_numpy(zero_copy_only=False)


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each span, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def heaviest(asking: tuple, documents: tuple, queries: int, items: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, score) of the k greatest positive sums of weight times gain over the tokens that a query and an item share.

    asking and documents hold (position, token, value) of each token; items are in the order of their ids.  Tokens in which
    many pairs meet are multiplied as whole rows, the others match by match.
    """
    at, token, weight = asking
    doc, held, gain = documents
    names, token = np.unique(token, return_inverse=True)
    place = np.minimum(np.searchsorted(names, held), max(len(names) - 1, 0))
    known = names[place] == held if len(names) else np.zeros(len(held), bool)
    doc, held, gain = doc[known], place[known], gain[known]
    n = len(names)
    by = np.lexsort((token, at))
    at, token, weight = at[by], token[by], weight[by]
    key, where = np.unique(held * items + doc, return_inverse=True)  # by token, then by item
    gain = np.bincount(where, weights=gain, minlength=len(key))
    held, doc = key // max(items, 1), key % max(items, 1)
    dense = np.nonzero(np.bincount(token, minlength=n) * np.bincount(held, minlength=n) > DENSE * queries * items)[0]
    row = np.full(n, -1)
    row[dense] = np.arange(len(dense))
    first = np.searchsorted(at, np.arange(queries + 1))
    in_row = row[held] >= 0
    block_of = doc // BLOCK_ITEMS
    # dense cells by block of items
    cells = np.nonzero(in_row)[0]
    cells = cells[np.argsort(block_of[cells], kind="stable")]
    cell_lead = np.searchsorted(block_of[cells], np.arange(-(-items // BLOCK_ITEMS) + 1))
    asked = row[token] >= 0
    weights = np.zeros((queries, len(dense)))
    np.add.at(weights, (at[asked], row[token[asked]]), weight[asked])
    by_kind = {kind: weights.astype(kind) for kind in (np.float32, np.float64)}
    rare = np.nonzero(~asked)[0]
    rare_first = np.searchsorted(at[rare], np.arange(queries + 1))
    made: dict = {}

    def gains(i, j, kind):
        if made.get("at") != (i, kind):
            c = cells[cell_lead[i // BLOCK_ITEMS]:cell_lead[i // BLOCK_ITEMS + 1]]
            out = np.zeros((j - i, len(dense)), dtype=kind)
            out[doc[c] - i, row[held[c]]] = gain[c]
            # each token's postings in this block
            edge = np.arange(n) * items
            made.update({"at": (i, kind), "gains": out, "low": np.searchsorted(key, edge + i), "high": np.searchsorted(key, edge + j)})
        return made["gains"], made["low"], made["high"]

    def block(i, j, asks, kind):
        rows, low, high = gains(i, j, kind)
        out = rows @ by_kind[kind][asks].T
        own = rare_first[asks + 1] - rare_first[asks]
        entry = rare[spans(rare_first[asks], own)]
        column = np.repeat(np.arange(len(asks)), own)
        count = high[token[entry]] - low[token[entry]]
        entry, column, count = entry[count > 0], column[count > 0], count[count > 0]
        if len(entry):
            posting = spans(low[token[entry]], count)
            cell = (doc[posting] - i) * len(asks) + np.repeat(column, count)
            np.add.at(out.reshape(-1), cell, (gain[posting] * np.repeat(weight[entry], count)).astype(kind))
        return out

    def some(rows, cols):
        count = first[rows + 1] - first[rows]
        entry = spans(first[rows], count)
        want = token[entry] * items + np.repeat(cols, count)
        spot = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        part = np.where(key[spot] == want, weight[entry] * gain[spot], 0.0) if len(key) else np.zeros(len(want))
        return np.bincount(np.repeat(np.arange(len(rows)), count), weights=part, minlength=len(rows))

    def pairs(rows, cols):
        step = 1 << 16
        return np.concatenate([some(rows[p:p + step], cols[p:p + step]) for p in range(0, len(rows), step)] or [np.empty(0)])
    off = (first[1:] - first[:-1] + 4) * UNIT
    if (weight >= 0).all() and (gain >= 0).all():
        lowest = lambda s, a, b: s - np.abs(s) * off[a:b]
    else:
        size = np.bincount(at, weights=np.abs(weight), minlength=queries) * np.abs(gain).max(initial=0.0)
        lowest = lambda s, a, b: s - size[a:b] * off[a:b]
    return best_of(queries, items, k, block, pairs, lowest, least=0.0)
