"""Scans of boxes in order, in numpy: what a task does with the boxes of one scene or block.

A scan goes through its boxes in batches. A batch finds the boxes near it in an index by size, band and left edge, in
chunks of a bounded number of pairs, so no scan ever holds all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np

#: Boxes that a scan looks up at once, and pairs that it measures at once, about.
BATCH, CHUNK = 1_024, 1_000_000


def area(b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, b[2] - b[0]) * np.maximum(0.0, b[3] - b[1])


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The overlap of pairs of boxes (columns x0, y0, x1, y1), computed as functions.boxes.iou does."""
    shared = np.maximum(0.0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) * np.maximum(0.0, np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))
    union = area(a) + area(b) - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union != 0)


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from low to below high of each range, and which range each is of."""
    n = np.maximum(0, high - low)
    at = np.repeat(np.arange(len(n)), n)
    return np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at], at


class Near:
    """An index of boxes: those that may overlap others by a least share are found by bands of y0 and ranges of x0.

    Boxes are kept by powers of two of their longer side, so one large box does not widen the search for all.
    """

    def __init__(self, boxes: np.ndarray, ids: np.ndarray):
        self.boxes, self.parts = boxes, []
        side = np.maximum(boxes[2, ids] - boxes[0, ids], boxes[3, ids] - boxes[1, ids])
        ids, side = ids[side > 0], side[side > 0]
        kinds = np.ceil(np.log2(side)) if len(side) else side
        for kind in np.unique(kinds):
            own = ids[kinds == kind]
            b = boxes[:, own]
            width, height = (b[2] - b[0]).max(), (b[3] - b[1]).max()
            step = max(height, width) / 4
            left, low = b[0].min(), b[1].min()
            wide = (b[0].max() - left) * 1.5 + 1.0
            key = np.floor((b[1] - low) / step) * wide + (b[0] - left)
            order = np.argsort(key, kind="stable")
            self.parts.append((own[order], key[order], width, height, step, left, b[0].max(), low, b[1].max(), wide))

    def pairs(self, rows: np.ndarray, least: float, few: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks (i, j) of rows of the boxes and indexed ones that may share area and overlap by least; none is missed.

        few: only so many in the middle of each band, for a first look.
        """
        b = self.boxes[:, rows]
        for own, key, width, height, step, left, right, low, top, wide in self.parts:
            x, y = self._range(b[0], b[2], width, least), self._range(b[1], b[3], height, least)
            met = (x[0] <= right) & (x[1] >= left) & (y[0] <= top) & (y[1] >= low) & (x[0] <= x[1]) & (y[0] <= y[1])
            i = np.nonzero(met)[0]
            first = np.floor((np.maximum(y[0][i], low) - low) / step).astype(np.int64)
            last = np.floor((np.minimum(y[1][i], top) - low) / step).astype(np.int64)
            band, at = spread(first, last + 1)
            i = i[at]
            start = np.searchsorted(key, band * wide + (np.maximum(x[0][i], left) - left), "left")
            end = np.searchsorted(key, band * wide + (np.minimum(x[1][i], right) - left), "right")
            if few is not None:
                start = np.maximum(start, (start + end - few) // 2)
                end = np.minimum(end, start + few)
            size = np.cumsum(np.maximum(0, end - start))
            cuts = np.searchsorted(size, np.arange(CHUNK, size[-1] + CHUNK, CHUNK), "left") + 1 if len(size) and size[-1] else []
            begin = 0
            for cut in cuts:
                j, at = spread(start[begin:cut], end[begin:cut])
                if len(j):
                    yield rows[i[begin:cut][at]], own[j]
                begin = cut

    @staticmethod
    def _range(a: np.ndarray, b: np.ndarray, longest: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Where along an axis a box of at most a length may begin: it shares least of both lengths, or its overlap is less."""
        own = b - a
        slack = 1e-9 * (np.abs(a) + np.abs(b) + longest)
        return a - longest + np.maximum(least * longest, least * own) - slack, b - least * own + slack


def usable(boxes: np.ndarray) -> np.ndarray:
    """Rows whose corners are all known."""
    return np.nonzero(np.isfinite(boxes).all(0))[0]


def in_order(conf: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows by confidence falling (NaN first, null last), then by id."""
    odd = np.isnan(conf) & ~missing
    return np.lexsort((ids, -np.where(odd | missing, 0.0, conf), ~odd, missing))


def matched(boxes: np.ndarray, ids: np.ndarray, rows: np.ndarray, truths: np.ndarray, least: float, missing: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The truth that each of rows takes in a scan in their order, -1 if none, and its overlap.

    Each takes the free truth of the largest overlap, at least least, the smaller id among equals. Given missing, whether
    a row's confidence is null, the overlap of a row that takes none is its largest with the truths that no row before it
    took, or for a null confidence with all truths. Truths are copied in the order of the index first: what a row meets
    then lies side by side in memory.
    """
    lying = np.concatenate([np.zeros(0, np.int64), *(part[0] for part in Near(boxes, truths).parts)])
    copied = np.concatenate([rows, lying])
    boxes, ids, rows, truths = boxes[:, copied], ids[copied], np.arange(len(rows)), np.arange(len(rows), len(copied))
    took, told = np.full(len(rows), -1), np.zeros(len(rows))
    taken_at = np.full(boxes.shape[1], len(rows))
    place = np.full(boxes.shape[1], -1)
    place[rows] = np.arange(len(rows))
    near, free, best = Near(boxes, truths), len(truths), np.zeros(boxes.shape[1], np.int64)
    open_ = free
    for begin in range(0, len(rows), BATCH):
        if open_ < 0.7 * free:
            left = truths[taken_at[truths] == len(rows)]
            near, free = Near(boxes, left), len(left)
        batch = rows[begin : begin + BATCH]
        found = []
        for i, j in near.pairs(batch, least):
            still = taken_at[j] == len(rows)
            i, j = i[still], j[still]
            value = iou(boxes[:, i], boxes[:, j])
            enough = (value >= least) & (value > 0 if least > 0 else _meet(boxes[:, i], boxes[:, j]))
            found.append((place[i[enough]], j[enough], value[enough]))
        if found:
            i, j, value = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((ids[j], -value, i))
            i, j, value = i[order], j[order], value[order]
            n = _settled(i, j, best)
            took[i[n]], told[i[n]], taken_at[j[n]] = j[n], value[n], i[n]
            open_ -= len(n)
        if missing is not None:
            _best(near, boxes, batch[(took[begin : begin + BATCH] < 0) & ~missing[begin : begin + BATCH]], place, told, taken_at)
    if missing is not None and missing.any():
        near, never = Near(boxes, truths), np.full(boxes.shape[1], len(rows))
        unknown = rows[missing & (took < 0)]
        for begin in range(0, len(unknown), BATCH):
            _best(near, boxes, unknown[begin : begin + BATCH], place, told, never)
    return np.where(took >= 0, copied[took], -1), told


def _settled(i: np.ndarray, j: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Which of the pairs, in order by i and then by preference, a scan takes that gives each i its first j still free.

    All ask at once: of those that ask for a j the smallest i holds it for now, and the others ask for their next. What
    is held when none is refused is what the scan takes, as every j prefers the smallest i. best: room for a number a j.
    """
    if not len(i):
        return np.zeros(0, np.int64)
    at = np.nonzero(np.append(True, i[1:] != i[:-1]))[0]
    end, own = np.append(at[1:], len(i)), i[at]
    while True:
        asked = j[at]
        best[asked[::-1]] = own[::-1]  # of repeated places the last one written stays
        lost = best[asked] != own
        if not lost.any():
            return at
        at = at + lost
        left = at < end
        at, end, own = at[left], end[left], own[left]


def matched_at(boxes: np.ndarray, ids: np.ndarray, rows: np.ndarray, truths: np.ndarray, leasts: Sequence[float]) -> np.ndarray:
    """For each of the least overlaps, which of rows take a truth in a scan as matched makes it.

    The scans go side by side: pairs are found, measured and ordered once for all.
    """
    lying = np.concatenate([np.zeros(0, np.int64), *(part[0] for part in Near(boxes, truths).parts)])
    copied = np.concatenate([rows, lying])
    boxes, ids, rows, truths = boxes[:, copied], ids[copied], np.arange(len(rows)), np.arange(len(rows), len(copied))
    took, best = np.zeros((len(leasts), len(rows)), bool), np.zeros(boxes.shape[1], np.int64)
    open_ = np.ones((len(leasts), boxes.shape[1]), bool)
    near, free, least = Near(boxes, truths), len(truths), min(leasts)
    for begin in range(0, len(rows), BATCH):
        if begin % (32 * BATCH) == 0 and len(left := truths[open_[:, truths].any(0)]) < 0.7 * free:
            near, free = Near(boxes, left), len(left)
        found = []
        for i, j in near.pairs(rows[begin : begin + BATCH], least):
            value = iou(boxes[:, i], boxes[:, j])
            enough = (value >= least) & (value > 0 if least > 0 else _meet(boxes[:, i], boxes[:, j]))
            found.append((i[enough], j[enough], value[enough]))
        if not found:
            continue
        i, j, value = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((ids[j], -value, i))
        i, j, value = i[order], j[order], value[order]
        for t, least_t in enumerate(leasts):
            n = np.nonzero((value >= least_t) & open_[t, j])[0]
            n = n[_settled(i[n], j[n], best)]
            took[t, i[n]], open_[t, j[n]] = True, False
    return took


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def _best(near: Near, boxes: np.ndarray, rows: np.ndarray, place: np.ndarray, told: np.ndarray, taken_at: np.ndarray) -> None:
    for i, j in near.pairs(rows, 0.0):
        at = place[i]
        still = taken_at[j] > at
        np.maximum.at(told, at[still], iou(boxes[:, i[still]], boxes[:, j[still]]))


#: Boxes on a side of a square of pairs.
SQUARE = 256


def overlaps(boxes: np.ndarray, copies: np.ndarray, tile: np.ndarray, corner: tuple[float, float], cell: float) -> dict[float, int]:
    """How many pairs of rows of different tiles overlap by each value, rounded to six digits, 0 left out.

    Boxes are distinct with their number of copies. Only pairs whose shared lower left corner lies in the cell at corner
    count, so each counts in one cell. Neighbours in the plane are compared square by square.
    """
    fine = cell / 16
    x, y = (np.floor((np.maximum(boxes[i], corner[i]) - corner[i]) / fine) for i in (0, 1))
    order = np.lexsort((boxes[0], x, y))
    boxes, copies, tile = boxes[:, order], copies[order].astype(np.float64), tile[order]
    # squares end where x or y jumps to another fine cell
    moved = np.nonzero(np.append(True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])))[0]
    cuts = np.concatenate([np.arange(a, b, SQUARE) for a, b in zip(moved, np.append(moved[1:], len(order)), strict=True)]) if len(order) else np.zeros(0, int)
    ends = np.append(cuts[1:], len(order))
    low = np.stack([np.minimum.reduceat(boxes[i], cuts) for i in (0, 1)]) if len(cuts) else np.zeros((2, 0))
    high = np.stack([np.maximum.reduceat(boxes[i], cuts) for i in (2, 3)]) if len(cuts) else np.zeros((2, 0))
    begin = np.stack([np.maximum.reduceat(boxes[i], cuts) for i in (0, 1)]) if len(cuts) else np.zeros((2, 0))
    size, counts, odd = area(boxes), np.zeros(1_000_001), {}
    for s in range(len(cuts)):
        a = slice(cuts[s], ends[s])
        p = boxes[:, a, None]
        met = (low[0, s:] < high[0, s]) & (high[0, s:] > low[0, s]) & (low[1, s:] < high[1, s]) & (high[1, s:] > low[1, s])
        for o in (np.nonzero(met)[0] + s).tolist():
            b = slice(cuts[o], ends[o])
            q = boxes[:, None, b]
            left, down = np.maximum(p[0], q[0]), np.maximum(p[1], q[1])
            w, h = np.minimum(p[2], q[2]) - left, np.minimum(p[3], q[3]) - down
            good = (w > 0) & (h > 0) & (tile[a, None] != tile[None, b])
            for i, lower in enumerate((left, down)):
                if max(low[i, s], low[i, o]) < corner[i]:
                    good &= lower >= corner[i]
                if max(begin[i, s], begin[i, o]) >= corner[i] + cell:
                    good &= lower < corner[i] + cell
            if o == s:
                good &= np.arange(len(tile[a]))[:, None] < np.arange(len(tile[b]))[None]
            shared = (w * h)[good]
            total = (size[a, None] + size[None, b])[good]
            value = shared / (total - shared)
            weight = (copies[a, None] * copies[None, b])[good]
            scaled = value * 1e6
            whole = np.floor(scaled + 0.5)
            near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6  # halves are rounded in decimals, as Spark does
            if near.any():
                for v, n in _sums(value[near], weight[near]):
                    odd[v] = odd.get(v, 0) + n
                whole, weight = whole[~near], weight[~near]
            np.add.at(counts, whole.astype(np.int64), weight)
    out = {n / 1e6: int(counts[n]) for n in np.nonzero(counts)[0].tolist() if n}
    for v, n in odd.items():
        v = float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
        if v:
            out[v] = out.get(v, 0) + int(n)
    return out


def _sums(values: np.ndarray, weights: np.ndarray) -> list[tuple[float, float]]:
    known, at = np.unique(values, return_inverse=True)
    return list(zip(known.tolist(), np.bincount(at, weights).tolist(), strict=True))


UNKNOWN, KEPT, GONE = 0, 1, 2


class Growing:
    """An index to which boxes are added: few parts, each about twice as large as the next."""

    def __init__(self, boxes: np.ndarray):
        self.boxes, self.levels = boxes, []

    def add(self, ids: np.ndarray) -> None:
        while self.levels and len(self.levels[-1][0]) <= 2 * len(ids):
            ids = np.concatenate([self.levels.pop()[0], ids])
        self.levels.append((ids, Near(self.boxes, ids)))

    def pairs(self, rows: np.ndarray, least: float, few: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, near in self.levels:
            yield from near.pairs(rows, least, few)


def copies(boxes: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each box of a tile, in order, and for every row the number of its first one among them."""
    order = np.lexsort((tile, *boxes))  # stable
    b, t = boxes[:, order], tile[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[:, 1:] != b[:, :-1]).any(0) | (t[1:] != t[:-1])
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    rows, of = np.nonzero(first)[0], np.zeros(len(order), np.int64)
    of[order] = np.searchsorted(rows, order[new])[np.cumsum(new) - 1]
    return rows, of


def _conflicts(boxes: np.ndarray, tile: np.ndarray, pairs: Iterator, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for i, j in pairs:
        other = tile[i] != tile[j]
        i, j = i[other], j[other]
        value = iou(boxes[:, i], boxes[:, j])
        enough = (value >= least) & (value > 0 if least > 0 else _meet(boxes[:, i], boxes[:, j]))
        yield i[enough], j[enough], value[enough]


def survived(boxes: np.ndarray, tile: np.ndarray, state: np.ndarray, whole: np.ndarray, least: float) -> np.ndarray:
    """The state of each box after a scan in their order: kept, gone, or unknown.

    A box is gone if a kept one of another tile above it overlaps it by least, and kept if all such are gone. What does
    not follow stays unknown: where whole is false, boxes that are not here may reach a box. Given states stay.
    """
    state, kept, unsure = state.copy(), Growing(boxes), Growing(boxes)
    step = 4 * BATCH
    for begin in range(0, len(state), step):
        batch = np.arange(begin, min(begin + step, len(state)))
        doubt = ~whole[batch]
        for share, few in (((1 + least) / 2, 2), ((1 + least) / 2, None), (least, None)):  # most that fall have a kept box close by
            for i, _, _ in _conflicts(boxes, tile, kept.pairs(batch[state[batch] == UNKNOWN], share, few), least):
                state[i] = GONE
        for i, _, _ in _conflicts(boxes, tile, unsure.pairs(batch[(state[batch] == UNKNOWN) & ~doubt], least), least):
            doubt[i - begin] = True
        rest = batch[state[batch] != GONE]
        own = [[] for _ in batch]
        for i, j, _ in _conflicts(boxes, tile, Near(boxes, rest).pairs(rest, least), least):
            for lo, hi in zip(i[j < i].tolist(), j[j < i].tolist(), strict=True):
                own[lo - begin].append(hi)
        for r in rest.tolist():
            if state[r] == UNKNOWN:
                above = {state[h] for h in own[r - begin]}
                state[r] = GONE if KEPT in above else UNKNOWN if UNKNOWN in above or doubt[r - begin] else KEPT
        for told, index in ((KEPT, kept), (UNKNOWN, unsure)):
            if (left := rest[state[rest] == told]).size:
                index.add(left)
    return state


def first_reaching(boxes: np.ndarray, tile: np.ndarray, kept: np.ndarray, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The first kept box above each of rows that overlaps it by least, -1 if none, and the overlap; boxes are in order."""
    first, told = np.full(boxes.shape[1], boxes.shape[1]), np.zeros(boxes.shape[1])
    left, begin, end = rows, 0, max(BATCH, len(kept) // 32)
    while begin < len(kept) and len(left):  # who is reached by one of the highest needs no others
        near = Near(boxes, kept[begin:end])
        for at in range(0, len(left), BATCH):
            for i, j, value in _conflicts(boxes, tile, near.pairs(left[at : at + BATCH], least), least):
                i, j, value = i[j < i], j[j < i], value[j < i]
                np.minimum.at(first, i, j)
                best = first[i] == j
                told[i[best]] = value[best]
        left, begin, end = left[first[left] == boxes.shape[1]], end, 2 * end
    found = first[rows]
    return np.where(found < boxes.shape[1], found, -1), told[rows]
