"""The nearest donors of missing cells, without the distance of every pair.

A matrix product in single precision bounds the distances of a block of targets to a tile of
donors from below.  Only pairs whose bound is within reach of a cell's k-th nearest so far get
their distance, in double precision; the rounding of the bounds is allowed for, so the result
is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Targets and bytes of donors of one product.
_TARGETS = 256
_TILE_BYTES = 1 << 20
#: Bytes of the differences that are held at once.
_DIFFERENCE_BYTES = 8 << 20
#: Pairs that wait for their distance at most, besides those of one product.
_PAIRS = 1 << 18
#: Beyond this size squares are not formed in single precision, even scaled.
_HUGE = 1e150


def distances(probes: int, squares: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Distances scaled up by the share of the probes that is shared; NaN if none is."""
    with np.errstate(divide="ignore", invalid="ignore"):
        distance = np.sqrt(probes / shared * squares)
    distance[shared == 0] = np.nan
    return distance


def held_bytes(probes: int, gaps: float, k: int) -> float:
    """What one target with so many gaps takes in a task."""
    return 28 * probes + 40 * k * gaps + 64


class Nearest:
    """The k nearest donors of every missing cell of some targets.

    ``values`` has NaN for missing.  Donors are met in the order of their ranks, which are
    the targets' own, too: a target is no donor of its own, and ties go to the lower rank.
    """

    def __init__(self, values: np.ndarray, ranks: np.ndarray, k: int, probes: int) -> None:
        self.values, self.ranks, self.k, self.probes = values, ranks, k, probes
        known = ~np.isnan(values)
        self.lacks = ~known
        self.shares = known.sum(axis=1)
        self.target, self.place = np.nonzero(self.lacks)
        self.first = np.searchsorted(self.target, np.arange(len(values) + 1))
        # Both sides less the targets' mean: the bounds get sharper, differences stay.
        with np.errstate(over="ignore", invalid="ignore"):
            middle = np.where(known, values, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
        self.middle = np.where(np.isfinite(middle), middle, 0.0)
        with np.errstate(over="ignore"):
            self.biggest = np.abs(np.where(known, values - self.middle, 0.0)).max(initial=0.0)
        cells = len(self.target)
        self.found = np.zeros(cells, np.int64)
        self.far = np.full(cells, np.inf)  # the k-th nearest so far
        self.distance = np.full((cells, k), np.inf)
        self.donor = np.full((cells, k), -1)
        self.value = np.full((cells, k), np.nan)
        self._left: tuple | None = None

    def meet(self, donors: np.ndarray, ranks: np.ndarray) -> None:
        """Take in the next donors."""
        step = max(1, _TILE_BYTES // (8 * max(1, donors.shape[1])))
        for i in range(0, len(donors) if len(self.target) else 0, step):
            self._tile(donors[i : i + step], ranks[i : i + step])

    def _tile(self, b: np.ndarray, ranks: np.ndarray) -> None:
        has = ~np.isnan(b)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for pair in self._screened(b, has):
            pairs.append(pair)
            waiting += len(pair[0])
            if waiting > _PAIRS:
                self._measure(pairs, b, has, ranks)
                pairs, waiting = [], 0
        self._measure(pairs, b, has, ranks)

    def _factors(self, gappy: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
        """The targets' side of the products, and their squared lengths."""
        key = (gappy.tobytes(), scale)
        if self._left is None or self._left[0] != key:
            width = self.values.shape[1]
            g = int(gappy.sum())
            left = np.empty((len(self.values), width + 2 * g + 2), np.float32)
            lengths = np.empty(len(self.values))
            for i in range(0, len(left), 4 * _TARGETS):
                rows = slice(i, i + 4 * _TARGETS)
                a = np.where(self.lacks[rows], 0.0, (self.values[rows] - self.middle) * scale)
                lengths[rows] = (a * a).sum(axis=1)
                left[rows, :width] = -2.0 * a
                left[rows, width : width + g] = -(a[:, gappy] ** 2)
                left[rows, width + g : width + 2 * g] = -1.0 * self.lacks[rows][:, gappy]
            left[:, -2], left[:, -1] = lengths, 1.0
            self._left = (key, left, lengths)
        return self._left[1:]

    def _reach(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every target the largest distance that may still get in, and its cells short of donors."""
        short = self.found < self.k
        # Later donors lose ties, so a cell whose k donors lie at 0 is done.
        closed = np.where(short | (self.far <= 0), -np.inf, self.far)
        reach = np.full(len(self.values), -np.inf)
        some = self.first[1:] > self.first[:-1]
        reach[some] = np.maximum.reduceat(closed, self.first[:-1][some])
        return reach, short

    def _screened(self, b: np.ndarray, has: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Targets and donors of one tile whose distance may matter."""
        with np.errstate(over="ignore", invalid="ignore"):
            near = np.where(has, b - self.middle, 0.0)
            biggest = max(self.biggest, np.abs(near).max(initial=0.0))
        if not biggest < _HUGE:
            for i in range(len(self.values)):
                yield np.full(len(b), i), np.arange(len(b))
            return
        scale = 2.0 ** -np.frexp(biggest)[1] if biggest > 1 / _HUGE else 1.0
        near *= scale
        gappy = self.lacks.any(axis=0) | ~has.all(axis=0)
        left, lengths = self._factors(gappy, scale)
        other = (near * near).sum(axis=1)
        right = np.concatenate(
            (near, ~has[:, gappy], near[:, gappy] ** 2, np.ones((len(b), 1)), other[:, None]), axis=1
        ).astype(np.float32).T
        # Rounding of the products: each term once, and their sums.
        slack = (len(right) + 16) * 2.0**-23 * 3 * (lengths + other.max()) + 1e-30
        few = int(has.sum(axis=1).min())
        # With few gaps the targets' own probes stand for the shared ones; else those are counted.
        counted = self.shares.min() + few <= self.probes or self.lacks.mean() + (~has).mean() > 0.1
        reach, short = self._reach()
        with np.errstate(over="ignore", invalid="ignore"):
            most = np.where(reach > 0, (reach * scale) ** 2, -np.inf) / self.probes
            if counted:
                held = has[:, gappy].astype(np.float32).T
                mine = (~self.lacks[:, gappy]).astype(np.float32)
                every = np.float32((~gappy).sum())
                looser = np.ones(len(lengths))
            else:
                most = most * self.shares
                looser = self.shares / (self.shares + few - self.probes)
            limit = np.where(reach > 0, most * (1 + 1e-6) + slack, -np.inf).astype(np.float32)
        open_cells = np.flatnonzero(short)
        bounds = np.searchsorted(self.target[open_cells], np.arange(0, len(left) + _TARGETS, _TARGETS))
        donors_of: dict[int, np.ndarray] = {}
        sizes = np.empty((min(_TARGETS, len(left)), len(b)), np.float32)
        closes = np.empty(sizes.shape, bool)
        for block, i in enumerate(range(0, len(left), _TARGETS)):
            rows = slice(i, i + _TARGETS)
            cells = open_cells[bounds[block] : bounds[block + 1]]
            if not cells.size and not (limit[rows] > -np.inf).any():
                continue
            size = np.matmul(left[rows], right, out=sizes[: len(left[rows])])
            if counted:
                shared = mine[rows] @ held + every
                with np.errstate(divide="ignore", invalid="ignore"):
                    size = np.where(shared > 0.5, size / shared, np.float32(np.inf))
            close = np.less_equal(size, limit[rows, None], out=closes[: len(size)])
            if counted and np.isinf(limit[rows]).any():
                close &= np.isfinite(size)
            for place in np.unique(self.place[cells]):
                if place not in donors_of:
                    donors_of[place] = np.flatnonzero(has[:, place])
                others = donors_of[place]
                if not others.size:
                    continue
                targets = self.target[cells[self.place[cells] == place]]
                part = size[np.ix_(targets - i, others)]
                if others.size > self.k:
                    kth = np.partition(part, self.k - 1, axis=1)[:, self.k - 1].astype(float)
                    within = ((kth + slack[targets]) * looser[targets] * (1 + 1e-6) + slack[targets]).astype(np.float32)
                    keep = part <= within[:, None]
                else:
                    keep = np.ones(part.shape, bool)
                r, c = np.nonzero(keep & np.isfinite(part))
                close[targets[r] - i, others[c]] = True
            r, c = np.divmod(np.flatnonzero(close), len(b))
            if r.size:
                yield r + i, c

    def _measure(self, pairs: list, b: np.ndarray, has: np.ndarray, ranks: np.ndarray) -> None:
        """The distances of these pairs, and what comes of them."""
        if not pairs:
            return
        targets, others = (np.concatenate(p) for p in zip(*pairs, strict=True))
        step = max(1, _DIFFERENCE_BYTES // (8 * b.shape[1]))
        for i in range(0, len(targets), step):
            t, o = targets[i : i + step], others[i : i + step]
            with np.errstate(over="ignore", invalid="ignore"):
                gap = b[o] - self.values[t]
                both = has[o] & ~self.lacks[t]
                gap[~both] = 0.0
                distance = distances(self.probes, (gap * gap).sum(axis=1), both.sum(axis=1))
            right = ~np.isnan(distance) & (ranks[o] != self.ranks[t])
            self._merge(t[right], o[right], distance[right], b, ranks)

    def _merge(self, t: np.ndarray, o: np.ndarray, distance: np.ndarray, b: np.ndarray, ranks: np.ndarray) -> None:
        counts = self.first[t + 1] - self.first[t]
        pair = np.repeat(np.arange(len(t)), counts)
        cell = np.arange(len(pair)) + np.repeat(self.first[t] - (np.cumsum(counts) - counts), counts)
        value, apart = b[o[pair], self.place[cell]], distance[pair]
        new = ~np.isnan(value) & ((self.found[cell] < self.k) | (apart < self.far[cell]))
        if not new.any():
            return
        pair, cell, value, apart = pair[new], cell[new], value[new], apart[new]
        touched = np.unique(cell)
        row, column = np.nonzero(np.arange(self.k) < self.found[touched][:, None])
        old = touched[row]
        cell = np.concatenate((old, cell))
        apart = np.concatenate((self.distance[old, column], apart))
        donor = np.concatenate((self.donor[old, column], ranks[o[pair]]))
        value = np.concatenate((self.value[old, column], value))
        order = np.lexsort((donor, apart, cell))
        cell, apart, donor, value = cell[order], apart[order], donor[order], value[order]
        start = np.searchsorted(cell, touched)
        nth = np.arange(len(cell)) - np.repeat(start, np.diff(np.r_[start, len(cell)]))
        kept = nth < self.k
        cell, nth = cell[kept], nth[kept]
        self.distance[cell, nth], self.donor[cell, nth] = apart[kept], donor[kept]
        self.value[cell, nth] = value[kept]
        self.found[touched] = np.minimum(self.k, np.diff(np.r_[start, len(order)]))
        full = touched[self.found[touched] == self.k]
        self.far[full] = self.distance[full, self.k - 1]

    def result(self) -> tuple[np.ndarray, ...]:
        """Target, place, distance, donor's rank and value of all that was found."""
        cell, nth = np.nonzero(np.arange(self.k) < self.found[:, None])
        return (
            self.target[cell], self.place[cell], self.distance[cell, nth],
            self.donor[cell, nth], self.value[cell, nth],
        )
