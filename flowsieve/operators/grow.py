"""Trees grown in one task on counted cells.

Spark grows a tree by a job per level, so an ensemble of hundreds of rounds is
thousands of jobs even where what a fit goes through is small.  Rows of the same
bins, counted per label, are points; where all points fit a task, a whole
ensemble is grown there by the rules of Spark's learners: the same sums per node,
feature and bin, the same gains and stops, the same rounds, the first of equal
cuts.  Only numpy is used; nothing here knows of Spark.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

# A gain below this share of a node's mean square is rounding.
ROUNDING = 1e-14


@dataclass
class Points:
    """Distinct combinations of bins, in ascending order: (features, points) of bins, bins per feature, (points, columns) of rows."""

    bins: np.ndarray
    widths: list[int]
    counts: np.ndarray


@dataclass
class Tree:
    """Nodes, children after their parents; a leaf has no feature.  ``sums`` holds a column a channel, ``reached`` a leaf a point."""

    feature: np.ndarray
    cut: np.ndarray         # the last bin that goes to the left
    left: np.ndarray
    right: np.ndarray
    gain: np.ndarray
    sums: np.ndarray
    reached: np.ndarray


class Variance:
    """Channels: weight, sum and sum of squares of what is fitted; the last is not needed to compare cuts."""

    used = 2

    @staticmethod
    def weight(sums):
        return sums[0]

    @staticmethod
    def strength(sums):
        return np.divide(sums[1] * sums[1], sums[0], out=np.zeros_like(sums[0]), where=sums[0] > 0)

    @staticmethod
    def impurity(sums):
        n = np.maximum(sums[0], 1e-300)
        return np.where(sums[0] > 0, (sums[2] - sums[1] * sums[1] / n) / n, 0.0)

    @staticmethod
    def scale(sums):
        return sums[2] / np.maximum(sums[0], 1e-300)

    @staticmethod
    def prediction(sums):
        return np.divide(sums[1], sums[0], out=np.zeros_like(sums[0]), where=sums[0] > 0)


class Gini:
    """Channels: the weight of every class."""

    used = None

    @staticmethod
    def weight(sums):
        return sum(sums[1:], sums[0])

    @staticmethod
    def strength(sums):
        n = Gini.weight(sums)
        return np.divide(sum(s * s for s in sums), n, out=np.zeros_like(n), where=n > 0)

    @staticmethod
    def impurity(sums):
        n = np.maximum(Gini.weight(sums), 1e-300)
        return 1.0 - sum((s / n) ** 2 for s in sums)

    @staticmethod
    def scale(sums):
        return 1.0

    @staticmethod
    def prediction(sums):
        return np.argmax(np.stack(sums), axis=0).astype(float)


class Entropy(Gini):
    @staticmethod
    def strength(sums):
        n = Gini.weight(sums)
        safe = np.maximum(n, 1e-300)
        return sum(s * np.log2(np.where(s > 0, s / safe, 1.0)) for s in sums)

    @staticmethod
    def impurity(sums):
        n = np.maximum(Gini.weight(sums), 1e-300)
        return -sum(s / n * np.log2(np.where(s > 0, s / n, 1.0)) for s in sums)


LAWS = {"variance": Variance, "gini": Gini, "entropy": Entropy}


def grow(points: Points, channels: list[np.ndarray], law, depth: int, least: float = 1, least_gain: float = 0.0,
         rng: np.random.Generator | None = None, subset: int | None = None) -> Tree:
    """A tree on the sums of ``channels``; with ``subset``, every node looks at so many features drawn by ``rng``."""
    width, count = points.bins.shape
    reached = np.zeros(count, np.int64)
    flat = points.bins.reshape(-1)
    at, place = np.arange(count), np.zeros(count, np.int64)
    mine, columns = list(channels), list(points.bins)
    open_ = np.zeros(1, np.int64)
    sums = [np.array([c.sum()]) for c in channels]
    nodes = [[np.full(1, -1), np.full(1, -1), np.full(1, -1), np.full(1, -1), np.full(1, -1.0), np.stack(sums, 1)]]
    total = 1
    for _ in range(depth):
        m = len(open_)
        n = law.weight(sums)
        whole = law.strength(sums)
        best, which, cut = np.full(m, -np.inf), np.full(m, -1), np.full(m, -1)
        halves = [np.zeros(m) for _ in channels]
        allowed = np.ones((width, m), bool)
        if subset is not None and subset < width:
            allowed = rng.random((m, width)).argsort(1).argsort(1).T < subset
        for f in range(width):
            size = points.widths[f]
            if size < 2:
                continue
            key = place * size + columns[f]
            left = [np.cumsum(np.bincount(key, c, m * size).reshape(m, size), axis=1)[:, :-1] for c in mine[:law.used]]
            right = [s[:, None] - part for s, part in zip(sums, left)]
            fits = (law.weight(left) >= least - 0.5) & (law.weight(right) >= least - 0.5) & allowed[f][:, None]
            gain = np.where(fits, (law.strength(left) + law.strength(right) - whole[:, None]) / np.maximum(n, 1e-300)[:, None], -np.inf)
            pick = gain.argmax(1)
            value = gain[np.arange(m), pick]
            # Of equal gains the first feature's counts.
            better = value > best
            best, which, cut = np.where(better, value, best), np.where(better, f, which), np.where(better, pick, cut)
            for own, part in zip(halves, left):
                own[better] = part[better, pick[better]]
        split = (best > ROUNDING * law.scale(sums)) & (best >= least_gain) & (law.impurity(sums) > ROUNDING * law.scale(sums))
        if not split.any():
            break
        # Points of nodes that stay leaves are done.
        if not split.all():
            stays = np.flatnonzero(split[place])
            at, place, mine, columns = at[stays], place[stays], [c[stays] for c in mine], [c[stays] for c in columns]
            place = (np.cumsum(split) - 1)[place]
        parents, which, cut = open_[split], which[split], cut[split]
        place = 2 * place + (flat[(which * count)[place] + at] > cut[place])
        m = len(parents)
        below = total + np.arange(2 * m)
        sums = [np.bincount(place, c, 2 * m) for c in mine]
        for own, column, half in zip(sums, [nodes_of(nodes, i)[parents] for i in range(law.used or len(channels))], halves):
            # As Spark has them: the right side is what the left one leaves.
            own[0::2], own[1::2] = half[split], column - half[split]
        done = _flat(nodes)
        done[0][parents], done[1][parents], done[2][parents], done[3][parents], done[4][parents] = which, cut, below[0::2], below[1::2], best[split]
        nodes = [done, [np.full(2 * m, -1), np.full(2 * m, -1), np.full(2 * m, -1), np.full(2 * m, -1), np.full(2 * m, -1.0), np.stack(sums, 1)]]
        reached[at] = below[place]
        total += 2 * m
        open_ = below
    return _merged(Tree(*_flat(nodes), reached), law)


def nodes_of(nodes: list, channel: int) -> np.ndarray:
    return np.concatenate([part[5][:, channel] for part in nodes])


def _flat(nodes: list) -> list[np.ndarray]:
    return nodes[0] if len(nodes) == 1 else [np.concatenate(parts) for parts in zip(*nodes)]


def _merged(tree: Tree, law) -> Tree:
    """Without splits into two leaves that predict the same."""
    value = law.prediction([tree.sums[:, i] for i in range(tree.sums.shape[1])])
    goes = np.arange(len(value))
    while True:
        inner = np.flatnonzero(tree.feature >= 0)
        left, right = tree.left[inner], tree.right[inner]
        same = inner[(tree.feature[left] < 0) & (tree.feature[right] < 0) & (value[left] == value[right])]
        if not len(same):
            break
        for node in same:
            goes[(goes == tree.left[node]) | (goes == tree.right[node])] = node
        tree.feature[same], tree.cut[same], tree.left[same], tree.right[same], tree.gain[same] = -1, -1, -1, -1, -1.0
    tree.reached = goes[tree.reached]
    return tree


def stored(tree: Tree, law, cuts: list[list[float]]) -> tuple[list[dict], dict[int, int]]:
    """Nodes in preorder as Spark stores them, and their numbers by those of ``tree``."""
    columns = [tree.sums[:, i] for i in range(tree.sums.shape[1])]
    value, impurity, weight = (np.asarray(own, dtype=float) for own in (law.prediction(columns), law.impurity(columns), law.weight(columns)))
    rows, numbers, todo = [], {}, [0]
    while todo:
        node = todo.pop()
        numbers[node] = len(numbers)
        if tree.feature[node] >= 0:
            todo += [int(tree.right[node]), int(tree.left[node])]
    for node, number in numbers.items():
        f = int(tree.feature[node])
        inner = f >= 0
        rows.append({
            "id": number, "prediction": float(value[node]), "impurity": float(impurity[node]), "impurityStats": [float(s) for s in tree.sums[node]],
            "rawCount": int(round(weight[node])), "gain": float(tree.gain[node]), "leftChild": numbers[int(tree.left[node])] if inner else -1,
            "rightChild": numbers[int(tree.right[node])] if inner else -1,
            "split": {"featureIndex": f, "leftCategoriesOrThreshold": [float(cuts[f][tree.cut[node]])] if inner else [], "numCategories": -1}})
    return rows, numbers


def importances(tree: Tree, law, width: int) -> np.ndarray:
    """Shares of the features in what the splits of a tree gain, weighted by their nodes."""
    inner = np.flatnonzero(tree.feature >= 0)
    weight = law.weight([tree.sums[:, i] for i in range(tree.sums.shape[1])])
    own = np.bincount(tree.feature[inner], tree.gain[inner] * weight[inner], width)
    return own / own.sum() if own.sum() > 0 else own


def _half_logistic(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 / (1 + exp(2 m)) and 1 / (1 + exp(-2 m))."""
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(2 * margin)), 1 / (1 + np.exp(-2 * margin))


def boost(points: Points, zero: np.ndarray, one: np.ndarray, rounds: int, rate: float, depth: int, least: int = 1, least_gain: float = 0.0,
          ridge: float = 0.0, most: int | None = None, cuts: list[list[float]] | None = None):
    """(margin of every point, trees as stored rows): logistic boosting of rows of two labels, ``zero`` and ``one`` of them at each point.

    Trees are grown on residuals of the ensemble as Spark weighs it, the first whole and the others by ``rate``; with ``ridge`` or ``most``
    leaves then get the values, and lose the splits, that ``leaves`` gives them.  Points without rows are carried along.
    Rows are built only with ``cuts``.
    """
    weight, margin, trees = zero + one, np.zeros(len(zero)), []
    refit = bool(ridge or most)
    shown = np.zeros(len(zero)) if refit else margin
    for number in range(rounds):
        share = rate if number else 1.0
        if number:
            low, high = _half_logistic(margin)
            minus, plus = -4 * high, 4 * low
        else:
            minus, plus = np.full(len(zero), -1.0), np.ones(len(zero))
        channels = [weight, zero * minus + one * plus, zero * minus * minus + one * plus * plus]
        tree = grow(points, channels, Variance, depth, least, least_gain)
        value = Variance.prediction([tree.sums[:, i] for i in range(3)])
        margin = margin + share * value[tree.reached]
        rows, numbers = stored(tree, Variance, cuts) if cuts is not None or most else (None, None)
        if refit:
            low, high = _half_logistic(shown)
            first = np.bincount(tree.reached, 2 * (zero * high - one * low), len(value))
            second = np.bincount(tree.reached, weight * 4 * low * high, len(value))
            rows, own = _refitted(tree, rows, numbers, first, second, ridge, most)
            shown = shown + share * own[tree.reached]
        else:
            shown = margin
        trees.append(rows)
    return shown, trees


def _refitted(tree: Tree, rows, numbers, first: np.ndarray, second: np.ndarray, ridge: float, most: int | None):
    """(rows, value by node) with Newton values of the leaves, and at most so many of them."""
    plain = np.where(second + ridge > 0, -first / np.where(second + ridge > 0, second + ridge, 1.0), 0.0)
    if rows is None:
        return None, plain
    from flowsieve.operators import leaves

    known = {n: i for i, n in numbers.items()}
    held = leaves.tree_of(rows)
    before = held.leaves()
    leaves.sum_up(held, [(float(first[known[leaf.row["id"]]]), float(second[known[leaf.row["id"]]])) for leaf in before])
    if most is not None:
        leaves.prune(held, most, ridge)
    own = plain.copy()
    for node in held.leaves():
        for old in node.taken or (node,):
            own[known[old.row["id"]]] = -node.first / (node.second + ridge) if node.second + ridge > 0 else 0.0
    return leaves.stored_rows(held, ridge), own


def drawn(counts: np.ndarray, rate: float, rng: np.random.Generator) -> np.ndarray:
    """How often a bagged tree sees rows of each kind: the sum of a Poisson draw for every one of them."""
    return rng.poisson(rate * counts).astype(float)


def subset_size(strategy: str, width: int) -> int:
    """Features a node looks at, by Spark's name for it."""
    if strategy == "all":
        return width
    return min(int(strategy), width) if strategy.isdigit() else max(1, math.ceil(float(strategy) * width))
