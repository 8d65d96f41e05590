"""Cutting-stock column generation over a length histogram (numpy; sizes bounded by the number of classes).

Master problem: least number of sequences that hold all pieces, one column per
pattern (how many pieces of each length class a sequence takes). It is solved
by the revised simplex method; an unbounded knapsack by dynamic programming
over the capacity prices the best new column (Gilmore and Gomory, 1961).
"""

from __future__ import annotations

import numpy as np


def price(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of largest summed value within ``capacity``: (value, pieces per class).

    Classes are added one after another; 1, 2, 4, ... pieces of a class at a time reach any number of them.
    """
    best = np.zeros(capacity + 1)
    density = value / size
    order = [j for j in np.argsort(-density, kind="stable").tolist() if value[j] > 1e-12]
    for j in order:
        s, v = int(size[j]), float(value[j])
        while s <= capacity:
            np.maximum(best[s:], best[:-s] + v, out=best[s:])
            s, v = 2 * s, 2 * v
    pattern, c = np.zeros(len(size), np.int64), capacity
    worth = [j for j in order if size[j] <= capacity]
    sizes, values = size[worth], value[worth]
    while c > 0 and len(worth) and best[c] > 1e-12:
        can = np.flatnonzero(sizes <= c)
        got = best[c - sizes[can]] + values[can]
        if not len(can) or got.max() < best[c] - 1e-9:  # the last places of the capacity stay empty
            c -= 1
            continue
        j = can[int(np.argmax(got))]
        most = 1
        while c - (most + 1) * sizes[j] >= 0 and best[c - (most + 1) * sizes[j]] + (most + 1) * values[j] >= best[c] - 1e-9:
            most += 1
        pattern[worth[j]] += most
        c -= most * int(sizes[j])
    return float(pattern @ value), pattern


def greedy(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns of first-fit decreasing over the histogram; each is used as often as its pieces last."""
    left, out = demand.astype(np.int64).copy(), []
    while left.any():
        pattern, room = np.zeros(len(size), np.int64), capacity
        for j in range(len(size) - 1, -1, -1):
            n = min(room // int(size[j]), int(left[j]))
            pattern[j], room = n, room - n * int(size[j])
        used = pattern > 0
        left -= pattern * int((left[used] // pattern[used]).min())
        out.append(pattern)
    return out


def solve(size: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3,
          max_columns: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, amounts): a basis of the relaxed problem within ``gap`` of its optimum.

    Every pattern fits the capacity and amounts meet the demand exactly, also
    if ``max_columns`` ends the search before the gap is reached. Bounds of the
    optimum: Farley's (objective / value of the best column) and the pieces'
    total size. Columns are first taken from a greedy filling; prices are then mixed
    with the sizes, as far as the column found still improves, which asks for well-filled patterns.
    """
    size, demand = np.asarray(size, np.int64), np.asarray(demand, np.float64)
    m, least = len(size), float(np.asarray(size) @ np.asarray(demand)) / capacity
    patterns = np.diag(capacity // size)
    inverse = np.diag(1.0 / np.diag(patterns))
    amount = inverse @ demand
    waiting = greedy(size, demand, capacity)
    mix = 0.9
    for step in range(max_columns):
        if amount.sum() <= (1.0 + gap) * least:
            break
        dual = inverse.sum(axis=0)
        column = None
        while waiting and column is None:
            column = waiting.pop(0)
            column = column if dual @ column > 1.0 + gap else None
        while column is None:
            value, column = price(mix * size / capacity + (1.0 - mix) * np.maximum(dual, 0.0), size, capacity)
            if dual @ column <= 1.0 + gap:
                if mix == 0.0:
                    break
                mix, column = (mix - 0.3 if mix > 0.35 else 0.0), None
        if dual @ column <= 1.0 + gap:
            break
        move = inverse @ column
        can = np.flatnonzero(move > 1e-7)
        if not len(can):
            break
        ratio = amount[can] / move[can]
        tied = can[ratio <= ratio.min() + 1e-9 * (1.0 + ratio.min())]
        out = int(tied[np.argmax(move[tied])])  # of the ties the largest pivot, which keeps the basis regular
        pivot = inverse[out] / move[out]
        theta = amount[out] / move[out]
        amount = np.maximum(amount - theta * move, 0.0)
        inverse = inverse - np.outer(move, pivot)
        inverse[out] = pivot
        amount[out] = theta
        patterns[:, out] = column
        if step % 200 == 199:  # start afresh from the patterns, against rounding
            try:
                inverse = np.linalg.inv(patterns.astype(np.float64))
            except np.linalg.LinAlgError:  # what is found so far is feasible; its rest is packed like any other
                break
            amount = np.maximum(inverse @ demand, 0.0)
    return patterns.T.copy(), amount


def whole_patterns(size: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and whole amounts, rounded down so that no class is taken more often than it has pieces."""
    if not len(size):
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    patterns, amount = solve(size, demand, capacity)
    times = np.floor(amount + 1e-7).astype(np.int64)
    over = (patterns * times[:, None]).sum(axis=0) - np.asarray(demand, np.int64)
    for j in np.flatnonzero(over > 0):  # rounding noise only
        while (patterns[:, j] * times).sum() > demand[j]:
            times[np.flatnonzero((patterns[:, j] > 0) & (times > 0))[0]] -= 1
    used = times > 0
    return patterns[used], times[used]
