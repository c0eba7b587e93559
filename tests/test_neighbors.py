import tracemalloc

import numpy as np
import pytest

from flowsieve.operators import neighbors


@pytest.mark.parametrize("offset", [1.0, 1.4])
def test_blocks_side_by_side_compare_only_their_borders(monkeypatch, offset):
    """Units within reach of the other block are found without comparing the blocks whole."""
    rng = np.random.default_rng(8)
    left, right = rng.random((3000, 2)), rng.random((2000, 2)) + [offset, 0.0]
    reach = np.full(3000, 0.05)
    compared, partition = [], np.partition
    monkeypatch.setattr(neighbors.np, "partition", lambda a, *more, **named: compared.append(a.size) or partition(a, *more, **named))
    slips = np.zeros(2000)
    rows, ids, lower, upper = neighbors.surviving(left, reach, [(right, slips, np.arange(2000))], 4)
    monkeypatch.undo()
    assert sum(compared) < 3000 * 2000 // 50
    dist = np.linalg.norm(left[:, None] - right[None], axis=2)
    fourth = np.sort(dist, axis=1)[:, 3]
    want = {(i, j) for i, j in zip(*np.nonzero(dist <= np.minimum(reach, fourth)[:, None]))}
    assert want <= set(zip(rows, ids)) and bool(want) == (offset == 1.0)
    assert np.allclose(lower, dist[rows, ids], atol=1e-6) and np.allclose(upper, dist[rows, ids], atol=1e-6)


def test_no_reach_known_compares_all():
    rng = np.random.default_rng(9)
    left, right = rng.random((50, 3)), rng.random((80, 3)) + 5
    rows, ids, _, _ = neighbors.surviving(left, np.full(50, np.inf), [(right, np.zeros(80), np.arange(80))], 3)
    nearest = np.argsort(np.linalg.norm(left[:, None] - right[None], axis=2), axis=1)[:, :3]
    assert {(i, j) for i in range(50) for j in nearest[i]} <= set(zip(rows, ids))


def test_a_task_holds_few_distances_at_once():
    rng = np.random.default_rng(2)
    points = rng.random((3_000, 8))
    tracemalloc.start()
    found = neighbors.nearest_ids(points, points, np.arange(3_000), np.arange(3_001), 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and len(found[0]) == 12_000
    gaps = np.linalg.norm(points[:50, None] - points[None], axis=2)
    assert (found[1][:200].reshape(50, 4) == np.argsort(gaps, axis=1)[:, :4]).all()


def test_candidates_that_fell_out_of_reach_are_not_kept():
    rng = np.random.default_rng(3)
    asked = rng.random((200, 2)) * 0.01
    # Every block lies nearer than the one before, and codes tell nothing inside a block.
    blocks = [(np.array([30.0 - 1.5 * b, 0.0]) + rng.random((2_000, 2)) * 0.01, np.full(2_000, 0.5), np.arange(2_000) + 2_000 * b) for b in range(20)]
    tracemalloc.start()
    rows, ids, lower, upper = neighbors.surviving(asked, np.full(200, np.inf), iter(blocks), 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert len(rows) == 200 * 2_000 and ids.min() == 38_000 and (lower < upper).all()
