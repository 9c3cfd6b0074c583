"""Numpy and Arrow helpers that run inside tasks on one bounded block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_TILE_CELLS = 2_000_000
#: The same in single precision: wide tiles make the product faster.
_SINGLE_CELLS = 8_000_000
#: Left rows whose lists of groups are held at a time.
_WITHIN_ROWS = 2048
#: Squared lengths between which single precision neither overflows nor loses the margin.
_SINGLE = 1e-20, 1e30
#: Scores of a row that are compared for one bound at most, and bounds per wanted neighbour at least.
_SLABS, _BOUNDS = 32, 16
_PAIR_VALUES = 8_000_000
#: Where fewer than one pair in so many is listed, pairs are scored one by one.
_SPARSE = 8


def column(data, name):
    """One column of a batch or table as a single Arrow array."""
    values = data.column(name)
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def numbers(data, name) -> np.ndarray:
    return column(data, name).to_numpy(zero_copy_only=False)


def matrix(data, name) -> np.ndarray:
    """A vector column as a dense float64 matrix."""
    vectors = column(data, name)
    rows = len(vectors)
    if rows == 0:
        return np.zeros((0, 0))
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if vectors.null_count or lengths.min() != lengths.max():
        raise ValueError(f"column {name}: vectors are missing or differ in dimension")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(flat).all():
        raise ValueError(f"column {name}: a vector has null or non-finite components")
    return flat.reshape(rows, -1)


def pair_scores(left, right, rows, cols, metric):
    """Scores of the listed (row, col) pairs, each summed on its own."""
    out = np.empty(len(rows))
    step = max(1, _PAIR_VALUES // max(1, left.shape[1]))
    for start in range(0, len(rows), step):
        a = left[rows[start : start + step]]
        b = right[cols[start : start + step]]
        if metric == "l2":
            a = a - b
            out[start : start + step] = (a * a).sum(axis=1)
        else:
            out[start : start + step] = -(a * b).sum(axis=1)
    return out


def first_copies(values, norms, ids, count) -> np.ndarray:
    """Positions of the ``count`` smallest ids of every different row, in order of position.

    Rows with equal bytes have equal norms, so norms tell quickly that there are no copies.
    """
    order = np.argsort(norms, kind="stable")
    close = np.diff(norms[order]) == 0
    if not close.any():
        return np.arange(len(values))
    shared = np.zeros(len(values), bool)
    shared[order[1:][close]] = shared[order[:-1][close]] = True
    at = np.flatnonzero(shared)
    rows = np.ascontiguousarray(values[at])
    _, kind = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    by = np.lexsort((ids[at], kind))
    place = np.arange(len(by)) - np.searchsorted(kind[by], kind[by])
    kept = np.ones(len(values), bool)
    kept[at[by[place >= count]]] = False
    return np.flatnonzero(kept)


def nearest(left, left_ids, right, right_ids, k, metric, exclude_self=False, listed=None, within=None):
    """The ``k`` nearest right rows of every left row, ordered by (score, id).

    A matrix product narrows the field with a margin above its rounding error;
    the survivors are scored pair by pair, so equal vectors get equal scores.
    ``listed`` optionally gives, per left row, the right ids that may be used, and
    ``within`` the groups: offsets and groups of the left rows, and the group of every right row.
    Returns (left position, right position, score) with ties broken by id.
    """
    empty = np.zeros(0, dtype=np.int64)
    if k <= 0 or len(left) == 0 or len(right) == 0:
        return empty, empty, np.zeros(0)
    if left.shape[1] != right.shape[1]:
        raise ValueError(f"dimension mismatch: {left.shape[1]} and {right.shape[1]}")
    right_norm = (right * right).sum(axis=1)
    if not (np.isfinite(right_norm).all() and np.isfinite((left * left).sum(axis=1)).all()):
        raise ValueError("a vector is too long for a finite score")
    if listed is None and within is None:
        # Equal rows tie at every score, so only those with the smallest ids can be among the nearest.
        own = np.unique(right_ids, return_counts=True)[1].max() if exclude_self else 0
        kept = first_copies(right, right_norm, right_ids, k + own)
        if len(kept) < len(right):
            same = right[kept], right_ids[kept]
            r, c, d = nearest(left, left_ids, *same, k, metric, exclude_self)
            return r, kept[c], d
    if within is not None:
        row, kind, code = _groups(within)
        sizes = np.bincount(code, minlength=kind.max(initial=0) + 1)
        if int(sizes[kind].sum()) * _SPARSE < len(left) * len(right):
            return _nearest_within(left, left_ids, right, right_ids, k, metric, exclude_self, row, kind, code)
    order = np.argsort(right_ids, kind="stable")
    sorted_ids = right_ids[order]
    if listed is not None and len(listed[1]) * _SPARSE < len(left) * len(right):
        return _nearest_listed(left, left_ids, right, right_ids, k, metric, exclude_self, listed, order, sorted_ids)
    left_norm = (left * left).sum(axis=1)
    longest = max(left_norm.max(), right_norm.max())
    # Listed pairs may be many copies; the others are narrowed in single precision first.
    single = listed is None and _SINGLE[0] <= right_norm.max() and longest <= _SINGLE[1]
    small = _augmented(right, right_norm, metric) if single else None
    parts = _group_parts(code, k) if single and within is not None and not exclude_self else None
    if parts:
        small = small[parts[0]]
    found = []

    def closed(start, stop):
        """Which groups a left row may not use."""
        shut = np.ones((stop - start, code.max() + 1), bool)
        first, last = np.searchsorted(row, [start, stop])
        shut[row[first:last] - start, kind[first:last]] = False
        return shut

    def shut(start, stop):
        """Which right rows a left row may not use."""
        return None if within is None else closed(start, stop)[:, code]

    def own(start, stop):
        return _positions(left_ids[start:stop], order, sorted_ids) if exclude_self else None

    def in_double(start, stop):
        rows, row_norm = left[start:stop], left_norm[start:stop]
        score = -(rows @ right.T)
        if metric == "l2":
            score = row_norm[:, None] + right_norm[None, :] + 2.0 * score
        if listed is not None:
            allowed = np.zeros(score.shape, dtype=bool)
            offsets, ids = listed
            first, last = offsets[start], offsets[stop]
            owner = np.repeat(np.arange(len(rows)), np.diff(offsets[start : stop + 1]))
            wanted = ids[first:last]
            at = np.minimum(np.searchsorted(sorted_ids, wanted), len(sorted_ids) - 1)
            hit = sorted_ids[at] == wanted
            allowed[owner[hit], order[at[hit]]] = True
            score[~allowed] = np.inf
        if within is not None:
            score[shut(start, stop)] = np.inf
        if exclude_self:
            score[own(start, stop)] = np.inf
        margin = 1e-10 * (row_norm + right_norm.max() + 1e-300)
        return np.nonzero(_survivors(score, k, 2 * margin))

    def rank(start, stop, pairs):
        r, c = pairs
        exact = pair_scores(left[start:stop], right, r, c, metric)
        by = np.lexsort((right_ids[c], exact, r))
        r, c, exact = r[by], c[by], exact[by]
        first_of_row = np.searchsorted(r, np.arange(stop - start))
        top = (np.arange(len(r)) - first_of_row[r]) < k
        found.append((r[top] + start, c[top], exact[top]))

    step = max(1, _TILE_CELLS // len(right))
    tile = max(1, _SINGLE_CELLS // len(right)) if single else len(left)
    for start in range(0, len(left), tile):
        stop = min(len(left), start + tile)
        pairs = None
        if single:
            mine = left[start:stop], left_norm[start:stop]
            if parts:
                pairs = _part_survivors(*mine, small, right_norm.max(), k, metric, parts, closed(start, stop))
            else:
                pairs = _single_survivors(*mine, small, right_norm.max(), k, metric, own(start, stop), shut(start, stop))
        if pairs is not None:
            rank(start, stop, pairs)
            continue
        for at in range(start, stop, step):
            rank(at, min(stop, at + step), in_double(at, min(stop, at + step)))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def nearest_sets(left, right, right_ids, k, metric):
    """The right rows that ``nearest`` finds, as left and right positions in order, without their scores.

    Where the ``k``-th score is apart from the next, no pair has to be scored by itself.
    """
    if k <= 0 or len(left) == 0 or len(right) == 0 or left.shape[1] != right.shape[1]:
        return nearest(left, np.zeros(len(left), np.int64), right, right_ids, k, metric)[:2]
    right_norm, found = (right * right).sum(axis=1), []
    step = max(1, _TILE_CELLS // len(right))
    for start in range(0, len(left), step):
        rows = left[start : start + step]
        row_norm = (rows * rows).sum(axis=1)
        score = -(rows @ right.T)
        if metric == "l2":
            score = row_norm[:, None] + right_norm[None, :] + 2.0 * score
        keep = _survivors(score, k, 2e-10 * (row_norm + right_norm.max() + 1e-300))
        open_rows = np.flatnonzero(keep.sum(axis=1) != min(k, len(right)))
        if len(open_rows):
            r, c, _ = nearest(rows[open_rows], np.zeros(len(open_rows), np.int64), right, right_ids, k, metric)
            keep[open_rows] = False
            keep[open_rows[r], c] = True
        r, c = np.nonzero(keep)
        found.append((r + start, c))
    return tuple(np.concatenate(p) for p in zip(*found))


def nearest_within(left, left_ids, right, right_ids, k, metric, exclude_self, lists, keys):
    """``nearest`` where a left row may use some groups of right rows: ``keys`` has their groups.

    ``lists(start, stop)`` gives the offsets and groups of some left rows, a bounded number at a time.
    """
    own = np.unique(right_ids, return_counts=True)[1].max(initial=0) if exclude_self else 0
    values = np.column_stack([right, np.unique(keys, return_inverse=True)[1]])
    kept = first_copies(values, (right * right).sum(axis=1), right_ids, k + own)
    right, right_ids, keys = right[kept], right_ids[kept], keys[kept]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for start in range(0, len(left), _WITHIN_ROWS):
        stop = min(len(left), start + _WITHIN_ROWS)
        within = (*lists(start, stop), keys)
        r, c, d = nearest(left[start:stop], left_ids[start:stop], right, right_ids, k, metric, exclude_self, within=within)
        found.append((r + start, kept[c], d))
    return tuple(np.concatenate(p) for p in zip(*found))


def _groups(within) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left row and code of every group that may be used, in order of rows, and codes of the right rows."""
    offsets, wanted, keys = within
    kinds, code = np.unique(keys, return_inverse=True)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wanted = wanted[offsets[0] : offsets[-1]]
    at = np.minimum(np.searchsorted(kinds, wanted), len(kinds) - 1)
    hit = kinds[at] == wanted
    return row[hit], at[hit], code


def _nearest_within(left, left_ids, right, right_ids, k, metric, exclude_self, row, kind, code):
    """``nearest`` where few groups may be used: group by group, for a bounded number of rows at a time."""
    most = max(1, int(np.bincount(row, minlength=len(left)).max()))
    step = max(1, _TILE_CELLS // (most * k))
    members = np.argsort(code, kind="stable")
    edges = np.searchsorted(code[members], np.arange(code.max() + 2))
    found = []
    for start in range(0, len(left), step):
        first, last = np.searchsorted(row, [start, start + step])
        by = np.argsort(kind[first:last], kind="stable")
        rows, kinds = row[first:last][by], kind[first:last][by]
        cuts = np.flatnonzero(np.diff(kinds)) + 1
        parts = []
        for some in np.split(np.arange(len(rows)), cuts) if len(rows) else []:
            mine, at = rows[some], members[edges[kinds[some[0]]] : edges[kinds[some[0]] + 1]]
            r, c, d = nearest(left[mine], left_ids[mine], right[at], right_ids[at], k, metric, exclude_self)
            parts.append((mine[r], at[c], d))
        if parts:
            r, c, d = (np.concatenate(p) for p in zip(*parts))
            by = np.lexsort((right_ids[c], d, r))
            r, c, d = r[by], c[by], d[by]
            top = (np.arange(len(r)) - np.searchsorted(r, r)) < k
            found.append((r[top], c[top], d[top]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(p) for p in zip(*found))


def _positions(ids, order, sorted_ids) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position in ``ids``, position of a row with that id), every repeat included."""
    first = np.searchsorted(sorted_ids, ids, "left")
    sizes = np.searchsorted(sorted_ids, ids, "right") - first
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(np.arange(len(ids)), sizes), order[np.repeat(first, sizes) + inside]


def _augmented(right, right_norm, metric) -> np.ndarray:
    """Right rows in single precision, for ``l2`` with half their squared length behind."""
    if metric == "l2":
        right = np.hstack([right, 0.5 * right_norm[:, None]])
    return right.astype(np.float32)


def _group_parts(code, k):
    """Right rows dealt to parts of one group each, so that whole parts can be shut: row, whether it
    is there for the first time, and group of every part. None where groups are too small for that.

    Rows are laid out in slabs with one row of every part in each; a part that a group does not
    fill has its last row again.
    """
    sizes = np.bincount(code)
    some = np.flatnonzero(sizes)
    slabs = min(_SLABS, len(code) // (_BOUNDS * k), len(code) // (_BOUNDS // 2 * len(some)))
    if slabs < 2:
        return None
    counts = -(-sizes // slabs)
    kinds = np.repeat(np.arange(len(sizes)), counts)
    first = (np.arange(len(kinds)) - (np.cumsum(counts) - counts)[kinds]) * slabs
    inside = first[None, :] + np.arange(slabs)[:, None]
    fresh = inside < sizes[kinds]
    members = np.argsort(code, kind="stable")
    at = (np.cumsum(sizes) - sizes)[kinds] + np.minimum(inside, sizes[kinds] - 1)
    return members[at.ravel()], fresh.ravel(), kinds


def _part_survivors(rows, row_norm, small, longest, k, metric, parts, closed):
    """``_single_survivors`` where rows may use some groups: the least scores of open parts give the bound."""
    at, fresh, kinds = parts
    score = _single_scores(rows, small, metric)
    width = len(kinds)
    least = score[:, :width].copy()
    for start in range(width, len(at), width):
        np.minimum(least, score[:, start : start + width], out=least)
    np.copyto(least, np.inf, where=closed[:, kinds])
    keep = score <= _bound(least, k, 2 * _margin(small, row_norm, longest))[:, None]
    # Pairs of shut groups are among them.
    if np.count_nonzero(keep) > 4 * _SPARSE * (k + 16) * len(rows):
        return None
    r, c = np.divmod(np.flatnonzero(keep), len(at))
    usable = fresh[c] & ~closed[r, kinds[c % width]]
    return r[usable], at[c[usable]]


def _single_scores(rows, small, metric) -> np.ndarray:
    """Scores of ``nearest`` in single precision without the row's own length, halved for ``l2``."""
    left = -rows if metric == "ip" else np.hstack([-rows, np.ones((len(rows), 1))])
    return left.astype(np.float32) @ small.T


def _margin(small, row_norm, longest) -> np.ndarray:
    """Rounded inputs and a sum of n products: below (n + 4) 2**-24 of the lengths' sum, here doubled."""
    return (small.shape[1] + 4) * 2.0**-23 * (row_norm + longest)


def _single_survivors(rows, row_norm, small, longest, k, metric, own, shut):
    """Pairs that can be among the ``k`` nearest, by scores in single precision.

    None where so many are within the rounding error that double precision must tell them apart.
    """
    score = _single_scores(rows, small, metric)
    if own is not None:
        score[own] = np.inf
    if shut is not None:
        np.copyto(score, np.inf, where=shut)
    keep = _survivors(score, k, 2 * _margin(small, row_norm, longest))
    if np.count_nonzero(keep) > 4 * (k + 16) * len(rows):
        return None
    return np.divmod(np.flatnonzero(keep), keep.shape[1])


def _survivors(score, k, slack) -> np.ndarray:
    """Which finite scores are at most the ``k``-th least of their row, or ``slack`` above.

    The ``k``-th least of the least scores of parts of a row is no less than that of the row,
    and close to it where the parts are many.
    """
    count, width = score.shape
    if k >= width:
        return np.isfinite(score)
    least, slabs = score, min(_SLABS, width // (_BOUNDS * k))
    if slabs > 1:
        part = width // slabs
        least = score[:, :part].copy()
        for at in range(1, slabs):
            np.minimum(least, score[:, at * part : (at + 1) * part], out=least)
    return score <= _bound(least, k, slack)[:, None]


def _bound(least, k, slack) -> np.ndarray:
    """The ``k``-th least score of every row and ``slack``: no infinite score is below, and it is not rounded down."""
    limit = np.partition(least, k - 1, axis=1)[:, k - 1].astype(np.float64) + slack
    top = np.finfo(least.dtype).max
    return np.nextafter(np.minimum(limit, top).astype(least.dtype), least.dtype.type(top))


def _nearest_listed(left, left_ids, right, right_ids, k, metric, exclude_self, listed, order, sorted_ids):
    offsets, wanted = listed
    r = np.repeat(np.arange(len(left)), np.diff(offsets[: len(left) + 1]))
    wanted = wanted[offsets[0] : offsets[len(left)]]
    at = np.minimum(np.searchsorted(sorted_ids, wanted), len(sorted_ids) - 1)
    hit = sorted_ids[at] == wanted
    r, c = r[hit], order[at[hit]]
    # A repeated id counts once.
    pairs = np.unique(r * len(right) + c)
    r, c = pairs // len(right), pairs % len(right)
    if exclude_self:
        other = left_ids[r] != right_ids[c]
        r, c = r[other], c[other]
    exact = pair_scores(left, right, r, c, metric)
    by = np.lexsort((right_ids[c], exact, r))
    r, c, exact = r[by], c[by], exact[by]
    top = (np.arange(len(r)) - np.searchsorted(r, r)) < k
    return r[top], c[top], exact[top]
