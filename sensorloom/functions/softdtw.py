"""Soft dynamic time warping of curve batches (Cuturi and Blondel, 2017), for use inside tasks.

Costs are accumulated by antidiagonals. Where no alignment can cost so much that its weight exp(-cost / gamma) leaves the range of doubles,
weights are added up themselves, which takes one exp for each cell; other curves of the batch go by the softened least costs. Arrays have the curves of a batch as their last axis and a row per curve point, so a
step is arithmetic on neighbouring memory; a distance keeps three diagonals, and only an alignment all of them.
"""

from __future__ import annotations

import numpy as np

# weights of alignments stay between exp(-SAFE) and 3 ** points
SAFE = 500.0
POINTS = 300


def _soft_least(a: np.ndarray, b: np.ndarray, c: np.ndarray, gamma: float) -> np.ndarray:
    """-gamma log of the summed exp(-x / gamma); the least one's own term is 1, so two are left to add."""
    low = np.minimum(a, b)
    high = np.maximum(a, b)
    middle = np.maximum(low, c)
    np.minimum(low, c, out=low)
    for other in (middle, high):
        np.subtract(low, other, out=other)
        if gamma != 1.0:
            other /= gamma
        np.exp(other, out=other)
    middle += high
    middle += 1.0
    np.log(middle, out=middle)
    if gamma != 1.0:
        middle *= gamma
    low -= middle
    return low


def _diagonal(d: int, n: int, m: int) -> tuple[int, int]:
    """The rows of diagonal d, from first to last + 1."""
    return max(0, d - m + 1), min(d, n - 1) + 1


def _totals(x: np.ndarray, y: np.ndarray, gamma: float):
    """Accumulated costs diagonal by diagonal: row i + 1 holds point i, all others are infinite; x and y have curves last."""
    n, m = len(x), len(y)
    shape = (n + 1, x.shape[1])
    before, last = np.full(shape, np.inf), np.full(shape, np.inf)
    # the cell in front of the first one
    before[0] = 0.0
    for d in range(n + m - 1):
        first, end = _diagonal(d, n, m)
        # column d - i of row i
        cost = x[first:end] - y[d - end + 1 : d - first + 1][::-1]
        cost *= cost
        here = np.full(shape, np.inf)
        if d == 0:
            here[1] = cost[0]
        else:
            np.add(cost, _soft_least(before[first:end], last[first:end], last[first + 1 : end + 1], gamma), out=here[first + 1 : end + 1])
        if d == 0:
            before[0] = np.inf
        yield here
        before, last = last, here


def _summed(x: np.ndarray, y: np.ndarray, gamma: float):
    """Summed weights of the alignments up to each cell and the cells' own weights, by diagonals; row i + 1 holds point i, all others are 0."""
    n, m = len(x), len(y)
    shape = (n + 1, x.shape[1])
    before, last = np.zeros(shape), np.zeros(shape)
    # the cell in front of the first one
    before[0] = 1.0
    for d in range(n + m - 1):
        first, end = _diagonal(d, n, m)
        own = x[first:end] - y[d - end + 1 : d - first + 1][::-1]
        own *= own
        own /= -gamma
        np.exp(own, out=own)
        here = np.zeros(shape)
        sums = here[first + 1 : end + 1]
        np.add(last[first:end], last[first + 1 : end + 1], out=sums)
        sums += before[first:end]
        sums *= own
        if d == 0:
            before[0] = 0.0
        yield here, own
        before, last = last, here


def _is_safe(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """Of which curves no weight can leave the range of doubles."""
    points = len(x) + len(y)
    apart = np.maximum(x.max(axis=0) - y.min(axis=0), y.max(axis=0) - x.min(axis=0))
    return (apart * apart * points <= SAFE * gamma) & (points <= POINTS)


def _distance(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    safe = _is_safe(x, y, gamma)
    found = np.empty(x.shape[1])
    for chosen, way in ((safe, _by_weights), (~safe, _by_totals)):
        if chosen.any():
            found[chosen] = way(x[:, chosen], y if y.shape[1] == 1 else y[:, chosen], gamma)
    return found


def _by_weights(x, y, gamma):
    for total, _ in _summed(x, y, gamma):
        pass
    return -gamma * np.log(total[len(x)])


def _by_totals(x, y, gamma):
    for total in _totals(x, y, gamma):
        pass
    return total[len(x)]


def _points_first(curves: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(curves.T, dtype=float)


def distances(curves: np.ndarray, centre: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    """Soft-DTW of each curve (rows) to one centre."""
    return _distance(_points_first(curves), np.asarray(centre, dtype=float)[:, None], gamma)


def self_distances(curves: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    """Soft-DTW of each curve to itself, which lies below zero."""
    x = _points_first(curves)
    return _distance(x, x, gamma)


def alignment(curves: np.ndarray, centre: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    """How much each curve point takes part in each centre point (the gradient by the costs)."""
    x, y = _points_first(curves), np.asarray(centre, dtype=float)[:, None]
    safe = _is_safe(x, y, gamma)
    shares = np.empty((len(x), len(y), x.shape[1]))
    for chosen, way in ((safe, _shares_by_weights), (~safe, _shares_by_totals)):
        if chosen.all():
            way(x, y, gamma, shares)
        elif chosen.any():
            part = np.empty((len(x), len(y), int(chosen.sum())))
            way(x[:, chosen], y, gamma, part)
            shares[:, :, chosen] = part
    return shares.transpose(2, 0, 1)


def _shares_by_weights(x, y, gamma, shares):
    """The share of a cell: the weights up to it times those of what may follow, of all weights."""
    n, m = len(x), len(y)
    forward = list(_summed(x, y, gamma))
    scale = 1.0 / forward[-1][0][n]
    # by row: what may follow a cell, times the weight of the cell itself
    ahead, beyond = np.zeros((n + 1, x.shape[1])), np.zeros((n + 1, x.shape[1]))
    for d in reversed(range(n + m - 1)):
        first, end = _diagonal(d, n, m)
        total, own = forward.pop()
        follow = ahead[first + 1 : end + 1] + ahead[first:end]
        follow += beyond[first + 1 : end + 1]
        if d == n + m - 2:
            follow += 1.0
        share = total[first + 1 : end + 1] * follow
        share *= scale
        cells = np.arange(first, end)
        shares[cells, d - cells] = share
        here = np.zeros_like(ahead)
        np.multiply(follow, own, out=here[first:end])
        ahead, beyond = here, ahead


def _shares_by_totals(x, y, gamma, shares):
    n, m = len(x), len(y)
    totals = list(_totals(x, y, gamma))
    # weight and total of the two diagonals behind; no cell there carries weight
    empty = np.zeros((n + 2, x.shape[1]))
    ahead, beyond = empty, empty
    for d in reversed(range(n + m - 1)):
        first, end = _diagonal(d, n, m)
        here = totals[d][first + 1 : end + 1]
        weight = np.zeros_like(empty)
        own = weight[first:end]
        if d == n + m - 2:
            own += 1.0
        # to the next row, the next column, and both
        for step, down, reached in ((1, 1, ahead), (1, 0, ahead), (2, 1, beyond)):
            if d + step > n + m - 2:
                continue
            a, b = _diagonal(d + step, n, m)
            low, high = max(first, a - down), min(end, b - down)
            if low >= high:
                continue
            rows, reach = slice(low - first, high - first), slice(low + down, high + down)
            columns = y[d + step - high - down + 1 : d + step - low - down + 1][::-1]
            gap = x[reach] - columns
            share = totals[d + step][low + down + 1 : high + down + 1] - here[rows] - gap * gap
            own[rows] += reached[reach] * np.exp(share / gamma)
        cells = np.arange(first, end)
        shares[cells, d - cells] = own
        ahead, beyond = weight, ahead
