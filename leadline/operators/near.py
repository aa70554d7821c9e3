"""Points near other points, and the regions they lie in.

A bounded sample of the points shapes a quadtree whose leaves hold about
equally many points.  Every point goes to its leaf and, within half the
distance of a border, also to the leaves across it; every region goes to the
leaves its box meets.  In a leaf, a bulk-loaded R-tree over the points is
probed by the regions and joined with itself; exact tests follow.  A pair is
kept only in the leaf that holds its midpoint, so none comes out twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

_DEPTH = 26  # levels of the quadtree; codes have two bits a level
_FAN = 32
_PAIRS_AT_ONCE = 1 << 16
#: The sample that shapes the tree grows with the number of leaves up to a bound, and so do the leaves of very large tables: the tree is sent to every task.
SAMPLE_A_LEAF, SAMPLE_MOST, LEAVES_MOST, LEAF_ROWS_MOST = 20, 2_000_000, 1_000_000, 2_000_000


def _spread_bits(v: np.ndarray) -> np.ndarray:
    """Bits of ``v`` moved to the even places."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


@dataclass
class Quadtree:
    """A linear quadtree: leaves in the order of their Morton codes."""

    x0: float
    y0: float
    unit: float
    starts: np.ndarray
    levels: np.ndarray
    parts: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray, y: np.ndarray, box: tuple[float, float, float, float], capacity: int, least: float) -> Quadtree:
        """Leaves of at most ``capacity`` sample points, unless they would be less than ``least`` wide.

        Such a crowded leaf is dealt out to several parts, as many as the sample says it takes.
        """
        side = max(box[2] - box[0], box[3] - box[1], least) * 1.0001
        tree = cls(box[0], box[1], side / (1 << _DEPTH), np.zeros(1, np.uint64), np.zeros(1, np.int64), np.ones(1, np.int64))
        codes = np.sort(tree.codes(x, y))
        deepest = max(0, min(_DEPTH, int(np.floor(np.log2(side / least)))))
        todo, leaves = [(0, 0, 0, len(codes))], []
        while todo:
            level, start, a, b = todo.pop()
            if b - a <= capacity or level >= deepest:
                leaves.append((start, level, max(1, -(-(b - a) // capacity))))
                continue
            quarter = 1 << (2 * (_DEPTH - level - 1))
            at = [a, *np.searchsorted(codes[a:b], np.array([start + q * quarter for q in (1, 2, 3)], np.uint64)) + a, b]
            todo += [(level + 1, start + q * quarter, int(at[q]), int(at[q + 1])) for q in range(4)]
        leaves.sort()
        tree.starts = np.array([s for s, _, _ in leaves], np.uint64)
        tree.levels = np.array([n for _, n, _ in leaves], np.int64)
        tree.parts = np.array([k for _, _, k in leaves], np.int64)
        return tree

    def codes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        top = (1 << _DEPTH) - 1
        cell = lambda v, o: np.clip(np.floor((v - o) / self.unit), 0, top).astype(np.int64)
        return _spread_bits(cell(x, self.x0)) | (_spread_bits(cell(y, self.y0)) << np.uint64(1))

    def leaf(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The leaf of each point; points outside belong to the leaf at the border."""
        return np.searchsorted(self.starts, self.codes(x, y), side="right") - 1

    def leaves_in(self, x0: float, y0: float, x1: float, y1: float) -> list[int]:
        """Leaves that meet a box."""
        top = (1 << _DEPTH) - 1
        lo = [int(np.clip(np.floor((v - o) / self.unit), 0, top)) for v, o in ((x0, self.x0), (y0, self.y0))]
        hi = [int(np.clip(np.floor((v - o) / self.unit), 0, top)) for v, o in ((x1, self.x0), (y1, self.y0))]
        found, todo = [], [(0, 0, 0, 0)]
        while todo:
            level, start, cx, cy = todo.pop()
            width = 1 << (_DEPTH - level)
            if cx > hi[0] or cy > hi[1] or cx + width <= lo[0] or cy + width <= lo[1]:
                continue
            i = int(np.searchsorted(self.starts, np.uint64(start), side="right")) - 1
            if self.levels[i] <= level:
                found.append(i)
                continue
            half, quarter = width // 2, 1 << (2 * (_DEPTH - level - 1))
            todo += [(level + 1, start + q * quarter, cx + half * (q & 1), cy + half * (q >> 1)) for q in range(4)]
        return found


class RTree:
    """A static R-tree, packed by sort-tile-recursive order."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n = len(x)
        strips = max(1, int(np.ceil(np.sqrt(n / _FAN))))
        per = max(1, -(-n // strips))
        by_x = np.argsort(x, kind="stable")
        strip = np.arange(n) // per
        self.order = by_x[np.lexsort((y[by_x], strip))]
        sx, sy = x[self.order], y[self.order]
        self.levels = []
        box = (sx, sy, sx, sy)
        while len(self.levels) == 0 or len(box[0]) > 1:
            at = np.arange(0, len(box[0]), _FAN)
            if not len(at):
                break
            box = (np.minimum.reduceat(box[0], at), np.minimum.reduceat(box[1], at), np.maximum.reduceat(box[2], at), np.maximum.reduceat(box[3], at))
            self.levels.append(box)
        self.n = n

    def _children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For nodes of ``level``, the index of the node and each child's number one level below."""
        below = self.n if level == 0 else len(self.levels[level - 1][0])
        count = np.minimum(node * _FAN + _FAN, below) - node * _FAN
        owner = np.repeat(np.arange(len(node)), count)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return owner, node[owner] * _FAN + inner

    def in_boxes(self, x: np.ndarray, y: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (box, point) where the point lies in the box, edges included."""
        if not self.n or not len(boxes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, node = np.arange(len(boxes)), np.zeros(len(boxes), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            b = self.levels[level]
            hit = (b[0][node] <= boxes[q, 2]) & (b[2][node] >= boxes[q, 0]) & (b[1][node] <= boxes[q, 3]) & (b[3][node] >= boxes[q, 1])
            q, node = q[hit], node[hit]
            owner, node = self._children(level, node)
            q = q[owner]
        p = self.order[node]
        hit = (x[p] <= boxes[q, 2]) & (x[p] >= boxes[q, 0]) & (y[p] <= boxes[q, 3]) & (y[p] >= boxes[q, 1])
        return q[hit], p[hit]

    def counts_within(self, x: np.ndarray, y: np.ndarray, distance: float) -> np.ndarray:
        """How many others lie within ``distance`` of each point.

        Two nodes that lie wholly within the distance of each other count at
        once, so a crowded spot costs its edges, not all its pairs.
        """
        step, count = np.zeros(self.n + 1, np.int64), np.zeros(self.n, np.int64)
        if self.n < 2:
            return count
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            m, width = self.levels[level], _FAN ** (level + 1)
            dx, dy = np.maximum(m[2][a], m[2][b]) - np.minimum(m[0][a], m[0][b]), np.maximum(m[3][a], m[3][b]) - np.minimum(m[1][a], m[1][b])
            whole = dx * dx + dy * dy <= distance * distance
            for p, q in ((a[whole], b[whole]), (b[whole & (a != b)], a[whole & (a != b)])):
                # A node's points are successive in the packed order; each gets the number in the other node.
                n = np.minimum((q + 1) * width, self.n) - q * width - (p == q)
                np.add.at(step, p * width, n)
                np.add.at(step, np.minimum((p + 1) * width, self.n), -n)
            a, b = a[~whole], b[~whole]
            if level:
                a, b = self._closer(level, a, b, distance)
        for u, v in self._meet(x, y, a, b, distance):
            count += np.bincount(u, minlength=self.n) + np.bincount(v, minlength=self.n)
        out = np.empty(self.n, np.int64)
        out[self.order] = count + np.cumsum(step[:-1])
        return out

    def _closer(self, level: int, a: np.ndarray, b: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children, one level below, of pairs of nodes, that may hold points within ``distance``."""
        ia, ca = self._children(level, a)
        ib, cb = self._children(level, b)
        # All children of a against all children of b, node pair by node pair.
        nb = np.bincount(ib, minlength=len(b))
        reps = nb[ia]
        left = np.repeat(ca, reps)
        first_b = np.cumsum(nb) - nb
        inner = np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps)
        right = cb[np.repeat(first_b[ia], reps) + inner]
        m = self.levels[level - 1]
        near = (left <= right) & (m[0][left] - distance <= m[2][right]) & (m[0][right] - distance <= m[2][left]) & (m[1][left] - distance <= m[3][right]) & (m[1][right] - distance <= m[3][left])
        return left[near], right[near]

    def _meet(self, x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, distance: float):
        """Yield places in the packed order (u, v), u < v, of points within ``distance`` in pairs of lowest nodes."""
        sx, sy = x[self.order], y[self.order]
        step = max(1, _PAIRS_AT_ONCE // _FAN)
        for i in range(0, len(a), step):
            left, right = a[i : i + step, None] * _FAN + np.arange(_FAN), b[i : i + step, None] * _FAN + np.arange(_FAN)
            px, py = (np.where(left < self.n, s[np.minimum(left, self.n - 1)], np.nan) for s in (sx, sy))
            qx, qy = (np.where(right < self.n, s[np.minimum(right, self.n - 1)], np.nan) for s in (sx, sy))
            dx, dy = px[:, :, None] - qx[:, None, :], py[:, :, None] - qy[:, None, :]
            k, u, v = np.nonzero(dx * dx + dy * dy <= distance * distance)
            u, v = left[k, u], right[k, v]
            once = u < v
            yield u[once], v[once]

    def pairs_within(self, x: np.ndarray, y: np.ndarray, distance: float):
        """Yield arrays (a, b) of distinct points within ``distance``, each pair once; the tree is joined with itself."""
        if self.n < 2:
            return
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            a, b = self._closer(level, a, b, distance)
        for u, v in self._meet(x, y, a, b, distance):
            yield self.order[u], self.order[v]


def in_ring(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether points lie in a simple polygon, by crossings of a ray; ``ring`` is not closed."""
    inside = np.zeros(len(x), bool)
    for (xa, ya), (xb, yb) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        if ya != yb:
            crosses = (ya > y) != (yb > y)
            inside ^= crosses & (x < (xb - xa) * (y - ya) / (yb - ya) + xa)
    return inside


def _points(df: DataFrame, key: str, x: str, y: str, group: str | None) -> DataFrame:
    rows = df.select(F.col(key).alias("_id"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *([F.col(group).alias("_g")] if group else []))
    bound = F.lit(1e300)
    rows = rows.where((F.col("_id").isNotNull()) & (F.abs("_x") < bound) & (F.abs("_y") < bound) & ~F.isnan("_x") & ~F.isnan("_y"))
    return rows.where("_g is not null") if group else rows


def _regions(df: DataFrame, key: str, ring: str) -> DataFrame:
    """Regions with at least three finite corners; their boxes come from the ring, as stored boxes may be null."""
    rows = df.select(F.col(key).alias("_rid"), F.expr(f"transform({ring}, c -> cast(c.x as double))").alias("_rx"), F.expr(f"transform({ring}, c -> cast(c.y as double))").alias("_ry"))
    return rows.where("_rid is not null and size(_rx) >= 3 and not exists(_rx, v -> v is null or isnan(v)) and not exists(_ry, v -> v is null or isnan(v))")


def _tree(points: DataFrame, leaf_rows: int, least: float, sample_rows: int) -> Quadtree:
    n, x0, y0, x1, y1 = points.agg(F.count("*"), F.min("_x"), F.min("_y"), F.max("_x"), F.max("_y")).first()
    if not n:
        return Quadtree.build(np.zeros(0), np.zeros(0), (0.0, 0.0, 1.0, 1.0), 1, 1.0)
    leaf_rows = min(max(leaf_rows, n // LEAVES_MOST), max(leaf_rows, LEAF_ROWS_MOST))
    sample_rows = min(max(sample_rows, SAMPLE_A_LEAF * n // leaf_rows), max(sample_rows, SAMPLE_MOST))
    share = min(1.0, sample_rows / n)
    sample = points.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 50)) < F.lit(int(share * (1 << 50)))).select("_x", "_y").toPandas()
    return Quadtree.build(sample["_x"].to_numpy(), sample["_y"].to_numpy(), (x0, y0, x1, y1), max(1, int(leaf_rows * share)), least)


def _deal(ids: pd.Series, parts: np.ndarray) -> np.ndarray:
    """The part of each row among the ``parts`` of its leaf, by a hash of its key."""
    return (pd.util.hash_array(ids.to_numpy()) % parts.astype(np.uint64)).astype(np.int64)


def _to_leaves(points: DataFrame, tree: Quadtree) -> DataFrame:
    """Each point with its leaf and part."""

    def assign(batches):
        for pdf in batches:
            leaf = tree.leaf(pdf["_x"].to_numpy(), pdf["_y"].to_numpy())
            yield pdf.assign(_leaf=leaf, _part=_deal(pdf["_id"], tree.parts[leaf]))

    return points.mapInPandas(assign, ", ".join(f"{n} {t}" for n, t in points.dtypes) + ", _leaf bigint, _part bigint")


def _to_leaves_around(points: DataFrame, tree: Quadtree, reach: float) -> DataFrame:
    """Each point with every leaf within ``reach``, for a join of each leaf with itself.

    In a leaf of k parts, a row of part u goes to the blocks (u, t) of all t,
    so that every two rows meet in one block.
    """

    def assign(batches):
        for pdf in batches:
            x, y = pdf["_x"].to_numpy(), pdf["_y"].to_numpy()
            leaf = np.sort(np.stack([tree.leaf(x + i * reach, y + j * reach) for i in (-1, 1) for j in (-1, 1)], axis=1), axis=1)
            own = np.concatenate([np.ones((len(x), 1), bool), leaf[:, 1:] != leaf[:, :-1]], axis=1)
            row, j = np.nonzero(own)
            at = leaf[row, j]
            for k in np.unique(tree.parts[at]):
                some = tree.parts[at] == k
                r, part = row[some], _deal(pdf["_id"].iloc[row[some]], np.full(int(some.sum()), k))
                for t in range(k):
                    yield pdf.iloc[r].assign(_leaf=at[some], _low=np.minimum(part, t), _high=np.maximum(part, t), _part=part)

    return points.mapInPandas(assign, ", ".join(f"{n} {t}" for n, t in points.dtypes) + ", _leaf bigint, _low bigint, _high bigint, _part bigint")


def _regions_to_leaves(regions: DataFrame, tree: Quadtree) -> DataFrame:
    """Each region with all leaves its box meets, and all their parts."""

    def assign(batches):
        for pdf in batches:
            at = [tree.leaves_in(min(x), min(y), max(x), max(y)) for x, y in zip(pdf["_rx"], pdf["_ry"], strict=True)]
            out = pdf.assign(_rleaf=at).explode("_rleaf").astype({"_rleaf": "int64"})
            out = out.assign(_rpart=[list(range(k)) for k in tree.parts[out["_rleaf"].to_numpy()]])
            yield out.explode("_rpart").astype({"_rpart": "int64"})

    return regions.mapInPandas(assign, ", ".join(f"{n} {t}" for n, t in regions.dtypes) + ", _rleaf bigint, _rpart bigint")


def _distinct(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.drop_duplicates("_id", ignore_index=True)


def _memberships(x: np.ndarray, y: np.ndarray, regions: pd.DataFrame):
    """Yield (region's position, points inside) by probing an R-tree with the regions' boxes."""
    boxes = np.array([[min(a), min(b), max(a), max(b)] for a, b in zip(regions["_rx"], regions["_ry"], strict=True)]).reshape(-1, 4)
    q, p = RTree(x, y).in_boxes(x, y, boxes)
    order = np.argsort(q, kind="stable")
    q, p = q[order], p[order]
    for i in range(len(boxes)):
        a, b = np.searchsorted(q, [i, i + 1])
        cand = p[a:b]
        ring = np.stack([np.asarray(regions["_rx"].iloc[i]), np.asarray(regions["_ry"].iloc[i])], axis=1)
        inside = cand[in_ring(x[cand], y[cand], ring)]
        if len(inside):
            yield i, inside


def _members(pts: DataFrame, regs: DataFrame, leaf_rows: int, sample_rows: int) -> DataFrame:
    """The columns of ``pts`` and ``_in``, the regions a point lies in, for distinct points in a region."""
    tree = _tree(pts, leaf_rows, 1.0, sample_rows)
    names = pts.columns

    def probe(pdf: pd.DataFrame, rdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(rdf):
            return pdf[names].iloc[:0].assign(_in=pd.Series([], dtype=object))
        pdf = _distinct(pdf)
        hits = list(_memberships(pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), rdf))
        p = np.concatenate([p for _, p in hits]) if hits else np.zeros(0, np.int64)
        r = np.repeat([i for i, _ in hits], [len(p) for _, p in hits]).astype(np.int64)
        order = np.argsort(p, kind="stable")
        p, rid = p[order], rdf["_rid"].to_numpy()[r[order]]
        at = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, np.int64)
        out = pdf[names].iloc[p[at]].reset_index(drop=True)
        return out.assign(_in=pd.Series([x.tolist() for x in np.split(rid, at[1:])] if len(at) else [], dtype=object))

    fields = ", ".join(f"{n} {t}" for n, t in pts.dtypes)
    return _to_leaves(pts, tree).groupBy("_leaf", "_part").cogroup(_regions_to_leaves(regs, tree).groupBy("_rleaf", "_rpart")).applyInPandas(probe, f"{fields}, _in array<{dict(regs.dtypes)['_rid']}>")


def points_in_regions(points: DataFrame, regions: DataFrame, key: str = "point_id", x: str = "x", y: str = "y", region: str = "area_id", ring: str = "ring", leaf_rows: int = 100_000, sample_rows: int = 100_000) -> DataFrame:
    """``(key, region)`` for each distinct point and each region it lies in.

    Points with a null key, or a coordinate that is null or not finite, and
    regions with a null key or fewer than three corners take no part.  Rows of
    one key count once; a point in several regions gives a row for each.
    Empty tables give an empty result.
    """
    members = _members(_points(points, key, x, y, None), _regions(regions, region, ring), leaf_rows, sample_rows)
    return members.select(F.col("_id").alias(key), F.explode("_in").alias(region))


def near_pairs_in_regions(points: DataFrame, regions: DataFrame, distance: float, key: str = "point_id", x: str = "x", y: str = "y", group: str = "container", region: str = "area_id", ring: str = "ring", leaf_rows: int = 100_000, sample_rows: int = 100_000) -> DataFrame:
    """Pairs of points of different groups at most ``distance`` apart, with each region both lie in: ``(key_a, key_b, region)``, ``key_a < key_b``.

    Nulls and repeated rows are treated as in :func:`points_in_regions`; a
    point with a null group takes no part.  Only points in a region are joined
    with each other, so a crowded spot outside all regions costs one probe.
    """
    pts = cut(_members(_points(points, key, x, y, group), _regions(regions, region, ring), leaf_rows, sample_rows))
    return _near(pts, distance, leaf_rows, sample_rows, True).select(F.col("_a").alias(f"{key}_a"), F.col("_b").alias(f"{key}_b"), F.col("_in").alias(region))


def near_pairs(points: DataFrame, distance: float, key: str = "point_id", x: str = "x", y: str = "y", group: str = "container", leaf_rows: int = 100_000, sample_rows: int = 100_000) -> DataFrame:
    """Pairs of points of different groups at most ``distance`` apart: ``(key_a, key_b)``, ``key_a < key_b``; nulls and repeated rows as above."""
    return _near(_points(points, key, x, y, group), distance, leaf_rows, sample_rows, False).select(F.col("_a").alias(f"{key}_a"), F.col("_b").alias(f"{key}_b"))


def near_counts(points: DataFrame, distance: float, key: str = "point_id", x: str = "x", y: str = "y", group: str = "container", leaf_rows: int = 100_000, sample_rows: int = 100_000) -> DataFrame:
    """``(key, n_near)``: for every point the number of points of other groups at most ``distance`` away, 0 included.

    Nulls and repeated rows are treated as in :func:`near_pairs`.  A point is
    counted in its own leaf, which holds all points within the distance of its
    border; no pair leaves a task, and a crowded spot is counted node by node.
    """
    if not distance > 0:
        raise ValueError("distance must be positive")
    pts = _points(points, key, x, y, group)
    tree = _tree(pts, leaf_rows, 4 * distance, sample_rows)
    kind = dict(pts.dtypes)["_id"]

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, across = pdf["_leaf"].iloc[0], pdf["_low"].iloc[0] != pdf["_high"].iloc[0]
        pdf = _distinct(pdf)
        xs, ys = pdf["_x"].to_numpy(), pdf["_y"].to_numpy()
        g, part = pd.factorize(pdf["_g"])[0].astype(np.int64), (pdf["_part"] == pdf["_low"].iloc[0]).to_numpy(np.int64)

        def same(label: np.ndarray) -> np.ndarray:
            out = np.zeros(len(xs), np.int64)
            order = np.argsort(label, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
                out[at] = RTree(xs[at], ys[at]).counts_within(xs[at], ys[at], distance)
            return out

        # All, without those of the same group; between two parts, without those of the same part either.
        n = same(np.zeros(len(xs), np.int64)) - same(g)
        if across:
            n -= same(part) - same(2 * g + part)
        own = tree.leaf(xs, ys) == leaf
        return pd.DataFrame({"_id": pdf["_id"].to_numpy()[own], "_n": n[own]})

    blocks = _to_leaves_around(pts, tree, distance * (1 + 1e-9) + 1e-7).groupBy("_leaf", "_low", "_high")
    return blocks.applyInPandas(count, f"_id {kind}, _n bigint").groupBy(F.col("_id").alias(key)).agg(F.sum("_n").alias("n_near"))


def _near(pts: DataFrame, distance: float, leaf_rows: int, sample_rows: int, shared: bool) -> DataFrame:
    """Rows ``(_a, _b)``, and ``_in`` for each region in the ``_in`` of both, if ``shared``."""
    if not distance > 0:
        raise ValueError("distance must be positive")
    tree = _tree(pts, leaf_rows, 4 * distance, sample_rows)
    reach = distance / 2 * (1 + 1e-9) + 1e-7
    kinds = dict(pts.dtypes)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(batches, ignore_index=True)  # a block, which the tree keeps small
        leaf, across = pdf["_leaf"].iloc[0], pdf["_low"].iloc[0] != pdf["_high"].iloc[0]
        pdf = _distinct(pdf)
        xs, ys, ids, part = (pdf[c].to_numpy() for c in ("_x", "_y", "_id", "_part"))
        g = pd.factorize(pdf["_g"])[0]
        if shared:
            size = pdf["_in"].str.len().to_numpy()
            owner, rid = np.repeat(np.arange(len(pdf)), size), np.concatenate(pdf["_in"].to_list())
            member = {}
            for r in np.unique(rid):
                member[r] = np.zeros(len(pdf), bool)
                member[r][owner[rid == r]] = True
        for a, b in RTree(xs, ys).pairs_within(xs, ys, distance):
            keep = g[a] != g[b]
            if across:
                keep &= part[a] != part[b]
            a, b = a[keep], b[keep]
            keep = tree.leaf((xs[a] + xs[b]) / 2, (ys[a] + ys[b]) / 2) == leaf
            a, b = a[keep], b[keep]
            low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
            # Pairs go out as they are found; there may be far more of them than points.
            if not shared:
                yield pd.DataFrame({"_a": low, "_b": high})
                continue
            for r, m in member.items():
                both = m[a] & m[b]
                if both.any():
                    yield pd.DataFrame({"_a": low[both], "_b": high[both], "_in": r})

    schema = f"_a {kinds['_id']}, _b {kinds['_id']}" + (f", _in {kinds['_in'].removeprefix('array<').removesuffix('>')}" if shared else "")
    return _to_leaves_around(pts, tree, reach).groupBy("_leaf", "_low", "_high").applyInPandas(join, schema)
