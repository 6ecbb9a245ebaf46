"""Cosine top-k of many queries: blocks of vectors met by matrix products, survivors scored exactly.

A block of queries and a block of vectors make a cell. Single-precision products of unit
vectors leave out what lies below a query's k-th best by more than their error bound;
what is left gets the same double-precision cosine, summed in the same order, as
``retrieval.cosine`` gives, so that ranks and ties are equal to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Components of a block's vectors, about; and queries, first vectors, vectors and exact pairs taken at once.
BLOCK, QUERIES, FIRST, VECTORS, PAIRS = 1 << 23, 256, 1024, 16384, 1 << 16
#: Norms whose squares and products neither overflow nor lose digits.
SMALL, LARGE = 1e-140, 1e140
#: Places in the order of scores that are NaN (above all) and null (below all).
NAN, NULL = 8.0, -8.0


class Vectors:
    """Vectors of any lengths, with ``place`` for the order of their ids, ``null`` where one is null, and ``whole``
    for how many components come before its first null."""

    def __init__(self, column: pa.Array):
        offsets = column.offsets.to_numpy().astype(np.int64)
        values = column.values
        self.null = column.is_null().to_numpy(zero_copy_only=False)
        self.values = values.fill_null(0).to_numpy(zero_copy_only=False)
        self.start, self.size = offsets[:-1], np.diff(offsets)
        gaps = np.r_[np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False)), np.iinfo(np.int64).max]
        self.whole = np.minimum(gaps[np.searchsorted(gaps, self.start)] - self.start, self.size)
        self.place = np.zeros(len(column), np.int64)

    def matrix(self, rows: np.ndarray, n: int) -> np.ndarray:
        return self.values[self.start[rows][:, None] + np.arange(n)].astype(np.float64)

    def lengths(self) -> list[tuple[int, np.ndarray]]:
        """Rows that aren't null, by length."""
        return [(int(n), np.flatnonzero((self.size == n) & ~self.null)) for n in np.unique(self.size[~self.null])]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def in_order(scores: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(scores), NAN, scores)


def cosines(a: np.ndarray, b: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return in_order(np.where(norms == 0, 0.0, dots(a, b) / np.where(norms == 0, 1.0, norms)))


def sized(side: Vectors, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Norms over ``n`` components, unit vectors (zero where there is none), and which rows products can't bound."""
    norms, units = np.empty(len(rows)), np.empty((len(rows), n), np.float32)
    for i in range(0, len(rows), VECTORS):
        own = side.matrix(rows[i : i + VECTORS], n)
        norm = np.sqrt(dots(own, own))
        plain = (norm > SMALL) & (norm < LARGE)
        units[i : i + VECTORS] = np.where(plain[:, None], own / np.where(plain, norm, 1.0)[:, None], 0.0)
        norms[i : i + VECTORS] = norm
    return norms, units, ~((norms == 0) | (norms > SMALL) & (norms < LARGE))


def without_copies(side: Vectors, rows: np.ndarray, n: int, most: int) -> np.ndarray:
    """Of equal vectors the ``most`` with the smallest ids; more can't be among a query's best."""
    if len(rows) <= most:
        return rows
    rows = rows[np.argsort(side.place[rows], kind="stable")]
    if n == 0:
        return rows[:most]
    own = np.ascontiguousarray(side.values[side.start[rows][:, None] + np.arange(n)])
    _, kind = np.unique(own.view(np.dtype((np.void, own.dtype.itemsize * n))).ravel(), return_inverse=True)
    kind = kind * (n + 1) + side.whole[rows]
    by_kind = np.argsort(kind, kind="stable")
    kinds = kind[by_kind]
    first = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    nth = np.arange(len(kinds)) - np.repeat(first, np.diff(np.r_[first, len(kinds)]))
    return rows[np.sort(by_kind[nth < most])]


def search(asked: Vectors, held: Vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, vector, score``: row numbers of each query's k best, of equal scores the smallest ids; never its own id."""
    most = k + int(np.unique(held.place, return_counts=True)[1].max(initial=1))  # what has a query's own id drops out
    best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(chunk: int, q: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        other = asked.place[q] != held.place[v]
        q, v, s = (np.r_[x, y[other]] for x, y in zip(best.get(chunk, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))), (q, v, s), strict=True))
        order = np.lexsort((held.place[v], -s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        keep = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k
        best[chunk] = (q[keep], v[keep], s[keep])

    def score(chunk: int, a: np.ndarray, a_norms: np.ndarray, q: np.ndarray, q_at: np.ndarray, rows: np.ndarray, v_norms: np.ndarray, v_at: np.ndarray, n: int) -> None:
        """Adds exact cosines of the pairs of places ``q_at`` and ``v_at``."""
        for i in range(0, len(q_at), PAIRS):
            x, y = q_at[i : i + PAIRS], v_at[i : i + PAIRS]
            add(chunk, q[x], rows[y], cosines(a[x], held.matrix(rows[y], n), a_norms[x] * v_norms[y]))

    def every(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(x, len(y)), np.tile(y, len(x))

    chunk = 0
    by_id = np.argsort(held.place, kind="stable")[:most]
    nulls = np.flatnonzero(held.null)
    nulls = nulls[np.argsort(held.place[nulls], kind="stable")][:most]
    parts = [(n, without_copies(held, rows, n, most)) for n, rows in held.lengths()]
    none = np.flatnonzero(asked.null)
    for i in range(0, len(none), QUERIES):
        q, v = every(none[i : i + QUERIES], by_id)
        add(chunk := chunk + 1, q, v, np.full(len(q), NULL))
    for q_n, q_rows in asked.lengths():
        began = chunk
        for v_n, rows in parts:
            n, chunk = min(q_n, v_n), began
            gap = held.whole[rows] < n
            gaps, rows = rows[gap], rows[~gap]  # noqa: PLW2901
            firsts = [x[np.argsort(held.place[x], kind="stable")][:most] for x in (gaps, np.r_[gaps, rows])]
            v_norms, v_units, v_odd = sized(held, rows, n)
            plain, odd = np.flatnonzero(~v_odd), np.flatnonzero(v_odd)
            few = plain[np.argsort(held.place[rows[plain]], kind="stable")][:most]
            v_units = v_units[plain]
            error = (n + 8) * 2.0**-23
            for i in range(0, len(q_rows), QUERIES):
                chunk, q = chunk + 1, q_rows[i : i + QUERIES]
                lost = asked.whole[q] < n
                for own, first in ((q[~lost], firsts[0]), (q[lost], firsts[1])):
                    x, y = every(own, first)
                    add(chunk, x, y, np.full(len(x), NULL))
                q = q[~lost]
                a = asked.matrix(q, n)
                norms, units, q_odd = sized(asked, q, n)
                usual, zero = np.flatnonzero(~q_odd & (norms > 0)), np.flatnonzero(norms == 0)
                both = lambda x, y: score(chunk, a, norms, q, *every(x, y)[:1], rows, v_norms, every(x, y)[1], n)  # noqa: E731, B023
                both(np.flatnonzero(q_odd), np.arange(len(rows)))
                both(zero, few)
                both(np.r_[usual, zero], odd)
                cuts = [0, *range(min(FIRST, len(plain)), len(plain), VECTORS), len(plain)]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    if x == y or not len(usual):
                        continue
                    near = units[usual] @ v_units[x:y].T
                    have, _, scores = best.get(chunk, (np.zeros(0, np.int64),) * 3)
                    place = np.searchsorted(have, q[usual], "right") - 1
                    count = place + 1 - np.searchsorted(have, q[usual], "left")
                    least = np.full(len(usual), -np.inf)
                    least[count >= k] = scores[place[count >= k]] - error
                    if (count < k).any() and y - x > most:
                        least = np.maximum(least, np.partition(near, y - x - most, axis=1)[:, y - x - most] - 2 * error)
                    floor = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
                    found = np.flatnonzero(near >= floor[:, None])
                    score(chunk, a, norms, q, usual[found // (y - x)], rows, v_norms, plain[x + found % (y - x)], n)
        chunk = began + -(-len(q_rows) // QUERIES)
        for i in range(0, len(q_rows), QUERIES):
            q, v = every(q_rows[i : i + QUERIES], nulls)
            add(began + 1 + i // QUERIES, q, v, np.full(len(q), NULL))
    found = [x for x in best.values() if len(x[0])]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def meet(batches: Iterator[pa.RecordBatch], k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The best of each cell; rows ``cell, asked, id, vector``, all rows of a cell in one task."""
    rows = list(batches)
    table = pa.Table.from_batches(rows) if rows else None
    rows.clear()
    np.seterr(over="ignore", invalid="ignore")  # of odd vectors
    for cell in table.column("cell").unique().to_pylist() if table else []:
        own = table.filter(pc.equal(table.column("cell"), cell))
        sides = [own.filter(pc.equal(own.column("asked"), pa.scalar(x))).combine_chunks() for x in (True, False)]
        if not all(len(x) for x in sides):
            continue
        ids = [x.column("id").combine_chunks() for x in sides]
        asked, held = (Vectors(x.column("vector").combine_chunks()) for x in sides)
        place = np.unique(np.concatenate([x.to_numpy(zero_copy_only=False) for x in ids]), return_inverse=True)[1]
        asked.place, held.place = place[: len(ids[0])], place[len(ids[0]) :]
        q, v, s = search(asked, held, k)
        scores = pa.array(np.where(s == NAN, np.nan, s), pa.float64(), mask=s == NULL)
        for i in range(0, len(q), PAIRS):
            x, y = (pa.array(r[i : i + PAIRS]) for r in (q, v))
            yield pa.RecordBatch.from_arrays([ids[0].take(x), ids[1].take(y), scores[i : i + PAIRS]], names=names)
