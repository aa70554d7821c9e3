"""Properties that hold for any input, of the parts that run in tasks."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leadline.operators.cube import CONTEXT, Nodes, _guides
from leadline.operators.near import Quadtree, RTree, in_ring
from leadline.operators.spikes import _running_median, forward_backward

coordinate = st.floats(-1e6, 1e6, allow_nan=False, width=32)
places = st.lists(st.tuples(coordinate, coordinate), min_size=1, max_size=80)


@settings(max_examples=60, deadline=None)
@given(places, st.integers(1, 9), st.tuples(coordinate, coordinate, st.floats(0, 1e5), st.floats(0, 1e5)))
def test_leaves_of_a_box_hold_its_points(points, capacity, box):
    x, y = np.array(points, float).T
    tree = Quadtree.build(x, y, (x.min(), y.min(), x.max(), y.max()), capacity, 1.0)
    b = (box[0], box[1], box[0] + box[2], box[1] + box[3])
    inside = (x >= b[0]) & (x <= b[2]) & (y >= b[1]) & (y <= b[3])
    assert set(tree.leaf(x[inside], y[inside])) <= set(tree.leaves_in(*b))
    assert (np.diff(tree.starts.astype(float)) > 0).all() and (tree.parts >= 1).all()


@settings(max_examples=60, deadline=None)
@given(places, st.floats(0.01, 1e5))
def test_pairs_are_all_pairs(points, distance):
    x, y = np.array(points, float).T
    got = [(min(i, j), max(i, j)) for a, b in RTree(x, y).pairs_within(x, y, distance) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    dx, dy = x[:, None] - x[None, :], y[:, None] - y[None, :]
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(dx * dx + dy * dy <= distance * distance, 1)), strict=True)}
    assert len(got) == len(set(got)) and set(got) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-100, 100, width=32), min_size=1, max_size=60), st.integers(1, 4), st.integers(1, 5))
def test_running_median_stays_within_its_source(values, sources, half):
    v = np.array(values, float)
    codes = np.sort(np.arange(len(v)) % sources)
    got = _running_median(v, codes, half)
    for c in range(sources):
        mine = v[codes == c]
        if len(mine):
            assert got[codes == c].min() >= mine.min() and got[codes == c].max() <= mine.max()
        if len(mine) > half:
            padded = np.pad(mine, half, mode="reflect")
            assert np.array_equal(got[codes == c], [np.median(padded[i : i + 2 * half + 1]) for i in range(len(mine))])


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 90), st.integers(1, 40), st.integers(0, 1000))
def test_blocks_do_not_matter(n, block, seed):
    rng = np.random.default_rng(seed)
    emit, move, prior = rng.random((n, 4)) + 1e-3, rng.random((4, 4)) + 1e-3, np.full(4, 0.25)
    move /= move.sum(axis=1, keepdims=True)
    first = rng.random(n) < 0.1
    first[0] = True
    assert np.allclose(forward_backward(emit, move, prior, first, block), forward_backward(emit, move, prior, first, 1))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 10), st.floats(0, 10)), max_size=30))
def test_square_ring(points):
    x, y = (np.array(points, float).T if points else np.zeros((2, 0)))
    ring = np.array([[2.0, 3.0], [7.0, 3.0], [7.0, 8.0], [2.0, 8.0]])
    strict = (x > 2) & (x < 7) & (y > 3) & (y < 8)
    loose = (x >= 2) & (x <= 7) & (y >= 3) & (y <= 8)
    got = in_ring(x, y, ring)
    assert (got >= strict).all() and (got <= loose).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(1, 100), min_size=1, max_size=80))
def test_every_sounding_is_in_the_queue_or_a_hypothesis(depths):
    nodes = Nodes(1)
    nodes.feed(np.zeros(len(depths), np.int64), np.array(depths), np.ones(len(depths)))
    assert nodes.size.sum() + nodes.held.sum() == len(depths)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.booleans())
def test_guides_are_the_nearest_single_hypotheses(seed, mean):
    rng = np.random.default_rng(seed)
    alone = np.unique(rng.integers(0, 40, (rng.integers(0, 30), 2)), axis=0).reshape(-1, 2)
    depth, var = rng.integers(1, 9, len(alone)) * 0.5, rng.random(len(alone))
    at = rng.integers(0, 40, (8, 2))
    guide, spread = _guides(at[:, 0], at[:, 1], alone[:, 0], alone[:, 1], depth, var, mean)
    for (r, c), g, v in zip(at, guide, spread, strict=True):
        around = [((a - r) ** 2 + (b - c) ** 2, d, w) for (a, b), d, w in zip(alone, depth, var, strict=True) if abs(a - r) <= CONTEXT and abs(b - c) <= CONTEXT]
        if not around:
            assert np.isnan(g)
        elif mean:
            assert np.isclose(g, np.mean([d for _, d, _ in around]))
        else:
            assert g == min(around)[1] and v in [w for x, d, w in around if (x, d) == min(around)[:2]]
