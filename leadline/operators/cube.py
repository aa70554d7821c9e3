"""CUBE: combined uncertainty and bathymetry estimation.

After Calder and Mayer, "Automatic processing of high-rate, high-density
multibeam echosounder data" (2003).  Every node takes in the soundings close to
it, each with a variance that grows with its distance; a short median queue
turns stray values aside; a Kalman filter follows the depth, and a value that
doesn't fit starts another hypothesis.  At the end one hypothesis of each node
is chosen.

Scale.  Blocks of a few nodes are estimated each by itself, from the soundings
that reach them; what leaves a block is a few numbers a node.  The soundings of
one block pass through it in order, a batch at a time, so a block is the least
unit of work but not of memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import to_mm
from .cells import register_tile_method
from .keys import with_cells
from .neighbors import halo_points

CUBE = "cube"
BLOCK = 16  # nodes a side
PART = 128  # nodes a side of what is chosen from together

#: Fixed values of the published method: length of the median queue, share of
#: the depth within which a sounding is taken in and the least such distance,
#: confidence factor, offset and limits of the monitor.
QUEUE, CAPTURE, CAPTURE_LEAST, CONFIDENCE, OFFSET, BAYES_LEAST, RUN_MOST = 11, 0.05, 0.5, 1.96, 4.0, 0.135, 5
#: Constant and depth-dependent part of the permitted uncertainty.
IHO = {"exclusive": (0.15, 0.0075), "special": (0.25, 0.0075), "order1a": (0.5, 0.013), "order1b": (0.5, 0.013), "order2": (1.0, 0.023)}
METHODS = ("local", "prior", "posterior", "predict")
VARIANCES = ("cube", "input", "max")
#: Nodes to either side in which a node with one hypothesis guides its neighbors.
CONTEXT = 10


class Nodes:
    """The estimators of n nodes, side by side in arrays."""

    def __init__(self, n: int):
        self.queue_z, self.queue_v, self.held = np.full((n, QUEUE), np.inf), np.zeros((n, QUEUE)), np.zeros(n, np.int64)
        self.count = np.zeros(n, np.int64)  # hypotheses
        self.mean, self.var, self.size, self.bayes, self.run, self.square = (np.zeros((n, 1)) for _ in range(6))

    def feed(self, node: np.ndarray, z: np.ndarray, v: np.ndarray) -> None:
        """Soundings in order: the first of every node, then the second, and so on."""
        order = np.argsort(node, kind="stable")
        node, z, v = node[order], z[order], v[order]
        begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
        length = np.diff(np.r_[begin, len(node)])
        for k in range(int(length.max()) if len(length) else 0):
            at = begin[length > k] + k
            self._queue(node[at], z[at], v[at])

    def _queue(self, node: np.ndarray, z: np.ndarray, v: np.ndarray) -> None:
        full = self.held[node] == QUEUE
        some = node[full]
        if len(some):
            # The middle one goes on to the filter; the new one takes its place.
            self._filter(some, self.queue_z[some, QUEUE // 2], self.queue_v[some, QUEUE // 2])
        slot = np.where(full, QUEUE // 2, self.held[node])
        self.queue_z[node, slot], self.queue_v[node, slot] = z, v
        self.held[node] += ~full
        rank = np.argsort(self.queue_z[node], axis=1, kind="stable")
        self.queue_z[node] = np.take_along_axis(self.queue_z[node], rank, axis=1)
        self.queue_v[node] = np.take_along_axis(self.queue_v[node], rank, axis=1)

    def flush(self) -> None:
        """Nodes that got less than a full queue take in what they have, from the middle outward."""
        few = np.flatnonzero((self.count == 0) & (self.held > 0))
        for k in range(QUEUE):
            step = (k + 1) // 2 * (1 if k % 2 else -1)
            at = self.held[few] // 2 + step
            ok = (at >= 0) & (at < self.held[few])
            if ok.any():
                self._filter(few[ok], self.queue_z[few[ok], at[ok]], self.queue_v[few[ok], at[ok]])

    def _filter(self, node: np.ndarray, z: np.ndarray, v: np.ndarray) -> None:
        width = self.mean.shape[1]
        there = np.arange(width)[None, :] < self.count[node][:, None]
        error = np.where(there, np.abs(z[:, None] - self.mean[node]) / np.sqrt(self.var[node] + v[:, None]), np.inf)
        h = np.argmin(error, axis=1)
        e = error[np.arange(len(node)), h]
        with np.errstate(over="ignore"):
            factor = np.exp(0.5 * (OFFSET**2 - 2 * OFFSET * np.where(np.isfinite(e), e, 1e3)))
        fits = factor >= BAYES_LEAST
        cum = factor * np.minimum(1.0, self.bayes[node, h])
        run = np.where(factor > 1, 0, self.run[node, h] + 1)
        # A hypothesis that drifts, bit by bit, is left as it is, and another begun.
        fits &= (cum >= BAYES_LEAST) & (run <= RUN_MOST)
        a, i = node[fits], h[fits]
        m, p, zz, vv = self.mean[a, i], self.var[a, i], z[fits], v[fits]
        gain = p / (p + vv)
        self.mean[a, i], self.var[a, i] = m + gain * (zz - m), p * vv / (p + vv)
        self.size[a, i] += 1
        self.square[a, i] += (zz - m) * (zz - self.mean[a, i])
        self.bayes[a, i], self.run[a, i] = cum[fits], run[fits]
        b = node[~fits]
        if len(b):
            if int(self.count[b].max()) == width:
                more = lambda x: np.concatenate([x, np.zeros_like(x)], axis=1)
                self.mean, self.var, self.size, self.bayes, self.run, self.square = map(more, (self.mean, self.var, self.size, self.bayes, self.run, self.square))
            j = self.count[b]
            self.mean[b, j], self.var[b, j], self.size[b, j], self.bayes[b, j] = z[~fits], v[~fits], 1, 1.0
            self.count[b] += 1


def reach(z: np.ndarray, tvu: np.ndarray, thu: np.ndarray, resolution: float, order: str) -> np.ndarray:
    """How far from a node a sounding still counts: what its variance leaves within the permitted one, and the capture distance."""
    fixed, per = IHO[order]
    ratio = np.maximum((fixed**2 + (per * z) ** 2) / CONFIDENCE**2 / np.maximum(tvu, 1e-12), 2.0)
    effect = np.maximum(resolution * np.sqrt(ratio - 1) - 2.5758 * np.sqrt(thu), resolution)
    return np.minimum(effect, np.maximum(CAPTURE * np.abs(z), CAPTURE_LEAST))


class Raster:
    """The estimators of a raster whose south-west corner is (x0, y0); ``tvu`` and ``thu`` are variances."""

    def __init__(self, x0: float, y0: float, n_rows: int, n_cols: int, resolution: float, order: str = "order1a"):
        self.x0, self.y0, self.n_rows, self.n_cols, self.resolution, self.order = x0, y0, n_rows, n_cols, resolution, order
        self.nodes = Nodes(n_rows * n_cols)

    def add(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, tvu: np.ndarray, thu: np.ndarray) -> None:
        """Take in soundings in the order given."""
        res = self.resolution
        r = reach(z, tvu, thu, res, self.order)
        low = lambda v, o: np.ceil((v - r - o) / res - 0.5).astype(np.int64)
        high = lambda v, o: np.floor((v + r - o) / res - 0.5).astype(np.int64)
        i0, i1 = np.maximum(low(y, self.y0), 0), np.minimum(high(y, self.y0), self.n_rows - 1)
        j0, j1 = np.maximum(low(x, self.x0), 0), np.minimum(high(x, self.x0), self.n_cols - 1)
        ni, nj = np.maximum(i1 - i0 + 1, 0), np.maximum(j1 - j0 + 1, 0)
        pairs = ni * nj
        # In pieces, so that soundings that reach many nodes need no more memory.
        piece = np.cumsum(pairs) // 2_000_000
        for p in np.unique(piece):
            at = np.flatnonzero((piece == p) & (pairs > 0))
            s = np.repeat(at, pairs[at])
            k = np.arange(len(s)) - np.repeat(np.cumsum(pairs[at]) - pairs[at], pairs[at])
            i, j = i0[s] + k // nj[s], j0[s] + k % nj[s]
            far = np.hypot(x[s] - self.x0 - (j + 0.5) * res, y[s] - self.y0 - (i + 0.5) * res)
            near = far < r[s]
            s, far = s[near], far[near]
            v = tvu[s] * (1 + ((far + CONFIDENCE * np.sqrt(thu[s])) / res) ** 2)
            self.nodes.feed(i[near] * self.n_cols + j[near], z[s], v)

    def finish(self) -> Nodes:
        self.nodes.flush()
        return self.nodes


def hypotheses(nodes: Nodes) -> pd.DataFrame:
    """``(node, depth, var, size, spread)``, a row for each hypothesis."""
    node, h = np.nonzero(np.arange(nodes.mean.shape[1])[None, :] < nodes.count[:, None])
    n = nodes.size[node, h]
    return pd.DataFrame({"node": node, "depth": nodes.mean[node, h], "var": nodes.var[node, h], "size": n.astype(np.int64), "spread": nodes.square[node, h] / np.maximum(n - 1, 1)})


def _rings() -> list[list[tuple[int, int]]]:
    """The steps to the nodes of a context, those of equal distance together, the nearest first."""
    steps: dict[int, list[tuple[int, int]]] = {}
    for i in range(-CONTEXT, CONTEXT + 1):
        for j in range(-CONTEXT, CONTEXT + 1):
            steps.setdefault(i * i + j * j, []).append((i, j))
    return [steps[d] for d in sorted(steps)]


def _guides(row: np.ndarray, col: np.ndarray, at_row: np.ndarray, at_col: np.ndarray, depth: np.ndarray, var: np.ndarray, mean: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, col), depth and variance of the nearest node with a single hypothesis, or with ``mean`` the mean depth of all in the context; NaN if there are none.

    Of equally near ones the shoalest counts.  ``at_row`` ... are the nodes
    with a single hypothesis.
    """
    r0, c0 = int(row.min()) - CONTEXT, int(col.min()) - CONTEXT
    shape = int(row.max()) + CONTEXT + 1 - r0, int(col.max()) + CONTEXT + 1 - c0
    ok = (at_row >= r0) & (at_row < r0 + shape[0]) & (at_col >= c0) & (at_col < c0 + shape[1])
    d, v = np.full(shape, np.nan), np.full(shape, np.nan)
    d[at_row[ok] - r0, at_col[ok] - c0], v[at_row[ok] - r0, at_col[ok] - c0] = depth[ok], var[ok]
    y, x = row - r0, col - c0
    guide, spread = np.full(len(row), np.nan), np.full(len(row), np.nan)
    if mean:
        total, count = np.zeros(len(row)), np.zeros(len(row))
        for ring in _rings():
            for i, j in ring:
                z = d[y + i, x + j]
                there = ~np.isnan(z)
                total[there] += z[there]
                count += there
        guide[count > 0] = total[count > 0] / count[count > 0]
        return guide, spread
    left = np.arange(len(row))
    for ring in _rings():
        if not len(left):
            break
        i, j = np.array(ring).T
        z = d[y[left, None] + i, x[left, None] + j]
        z = np.where(np.isnan(z), np.inf, z)
        k = np.argmin(z, axis=1)
        got = np.isfinite(z[np.arange(len(left)), k])
        a = left[got]
        guide[a] = z[got, k[got]]
        spread[a] = v[y[a] + i[k[got]], x[a] + j[k[got]]]
        left = left[~got]
    return guide, spread


def choose(hyp: pd.DataFrame, method: str = "local", variance: str = "cube") -> pd.DataFrame:
    """One hypothesis for each node: ``(row, col, depth, total_uncertainty, hypothesis_count, hypothesis_ratio)``.

    ``hyp`` has ``row``, ``col`` and the columns of :func:`hypotheses`.
    ``prior`` takes the one with most soundings; ``local`` the one nearest in
    depth to the nearest node with a single hypothesis; ``posterior`` weighs
    both; ``predict`` takes the one nearest to the mean of the single
    hypotheses around.  The ratio is 0 for a single hypothesis and rises to 5
    the less soundings favor the chosen one.
    """
    hyp = hyp.sort_values(["row", "col", "size", "depth"], ascending=[True, True, False, True], kind="stable").reset_index(drop=True)
    row, col, size, depth, var = (hyp[c].to_numpy() for c in ("row", "col", "size", "depth", "var"))
    begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (col[1:] != col[:-1])]) if len(hyp) else np.zeros(0, np.int64)
    count = np.diff(np.r_[begin, len(hyp)])
    picked = begin.copy()  # the one with most soundings
    several = np.flatnonzero(count > 1)
    if method != "prior" and len(several):
        alone, first = begin[count == 1], begin[several]
        guide, spread = _guides(row[first], col[first], row[alone], col[alone], depth[alone], var[alone], method == "predict")
        n = count[several]
        at = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        far = np.abs(depth[at] - np.repeat(guide, n))
        score = -far if method != "posterior" else np.log(size[at]) - 0.5 * far**2 / (var[at] + np.repeat(spread, n))
        owner = np.repeat(np.arange(len(several)), n)
        best = np.lexsort((at, -score, owner))[np.cumsum(n) - n]
        told = ~np.isnan(guide)
        picked[several[told]] = at[best[told]]
    total = np.add.reduceat(size, begin) if len(begin) else np.zeros(0)
    rest = total - size[picked]
    ratio = np.where(count == 1, 0.0, np.clip(5.0 - size[picked] / np.maximum(rest, 1), 0.0, 5.0))
    out = hyp.iloc[picked]
    v = {"cube": out["var"], "input": out["spread"], "max": np.maximum(out["var"], out["spread"])}[variance]
    return pd.DataFrame({"row": out["row"].to_numpy(), "col": out["col"].to_numpy(), "depth": out["depth"].to_numpy(), "total_uncertainty": CONFIDENCE * np.sqrt(v.to_numpy()), "hypothesis_count": count, "hypothesis_ratio": ratio})


def cube_cells(keyed: DataFrame, leaf: float, prefix: str = "tile", parameters: dict | None = None) -> DataFrame:
    """Cells of points with tile keys, ``resolution``, ``tvu`` and ``thu``: ``(keys, depth, total_uncertainty, hypothesis_count, hypothesis_ratio, density)``.

    Parameters: ``method``, ``iho_order``, ``variance_selection``, and ``halo``,
    the points of neighboring tiles (columns ``for_x``, ``for_y``); without it,
    those within a tenth of a tile of the borders among ``keyed``.  Points
    without depth or uncertainties count in the density only.
    """
    given = parameters or {}
    method, order, variance = given.get("method", "local"), given.get("iho_order", "order1a"), given.get("variance_selection", "cube")
    if method not in METHODS or order not in IHO or variance not in VARIANCES:
        raise ValueError(f"method must be one of {METHODS}, iho_order of {tuple(IHO)}, variance_selection of {VARIANCES}")
    tx, ty = f"{prefix}_x", f"{prefix}_y"
    keys, columns = [tx, ty, "resolution"], ["x", "y", "z", "tvu", "thu"]
    halo = given.get("halo")
    if halo is None:
        halo = halo_points(keyed.select(F.col(tx).alias("tile_x"), F.col(ty).alias("tile_y"), *columns), leaf, leaf / 10)
    tiles = keyed.select(*keys).distinct()
    own = keyed.select(*keys, *columns)
    around = halo.select(F.col("for_x").alias(tx), F.col("for_y").alias(ty), *columns).join(tiles, [tx, ty]).select(*keys, *columns)
    every = own.unionByName(around).dropna(subset=columns).select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    # The blocks of nodes within the capture distance; the kernel looks closer.
    far, res = F.greatest(F.abs("z") * CAPTURE, F.lit(CAPTURE_LEAST)), F.col("resolution")
    last = F.ceil(F.lit(leaf) / res) - 1
    first_node = lambda c, o: F.greatest(F.ceil((F.col(c) - far - F.col(o)) / res - 0.5), F.lit(0))
    last_node = lambda c, o: F.least(F.floor((F.col(c) + far - F.col(o)) / res - 0.5), last)
    span = lambda c, o: F.when(first_node(c, o) <= last_node(c, o), F.sequence(F.floor(first_node(c, o) / BLOCK).cast("int"), F.floor(last_node(c, o) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    blocks = every.withColumn("_bi", F.explode(span("y", ty))).withColumn("_bj", F.explode(span("x", tx)))

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raster = None
        for pdf in batches:
            if raster is None:
                f = pdf.iloc[0]
                n, i, j, step = int(np.ceil(leaf / f["resolution"])), int(f["_bi"]) * BLOCK, int(f["_bj"]) * BLOCK, f["resolution"]
                raster = Raster(f[tx] + j * step, f[ty] + i * step, min(BLOCK, n - i), min(BLOCK, n - j), step, order)
            raster.add(*(pdf[c].to_numpy(np.float64) for c in columns))
        if raster is not None:
            found = hypotheses(raster.finish())
            node = found.pop("node").to_numpy()
            yield found.assign(row=i + node // raster.n_cols, col=j + node % raster.n_cols, **{k: f[k] for k in keys})[[*keys, "row", "col", "depth", "var", "size", "spread"]]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf.iloc[0]
        found = choose(pdf, method, variance).assign(**{k: f[k] for k in keys})
        own = (found["row"] // PART == f["_pi"]) & (found["col"] // PART == f["_pj"])
        return found.loc[own, [*keys, "row", "col", "depth", "total_uncertainty", "hypothesis_count", "hypothesis_ratio"]]

    key_types = ", ".join(f"{k} double" for k in keys) + ", row int, col int"
    # From south to north, west to east, so that the result doesn't depend on how soundings were stored; a
    # block's soundings pass by in batches, however many they are.
    whole = [*keys, "_bi", "_bj"]
    blocks = blocks.repartition(*whole).sortWithinPartitions(*whole, "y", "x", "z", "tvu", "thu")
    hyp = blocks.groupBy(*whole).applyInPandas(block, f"{key_types}, depth double, var double, size bigint, spread double")
    # Parts of a tile choose by themselves: each with the single hypotheses within the context of its border.
    hyp = hyp.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "row", "col")))
    near = lambda c: F.sequence(F.floor((F.col(c) - F.when(F.col("_n") == 1, CONTEXT).otherwise(0)) / PART), F.floor((F.col(c) + F.when(F.col("_n") == 1, CONTEXT).otherwise(0)) / PART))
    most = F.ceil(F.lit(leaf) / F.col("resolution") / PART) - 1
    parts = hyp.withColumn("_pi", F.explode(near("row"))).where(F.col("_pi").between(0, most)).withColumn("_pj", F.explode(near("col"))).where(F.col("_pj").between(0, most))
    nodes = parts.groupBy(*keys, "_pi", "_pj").applyInPandas(pick, f"{key_types}, depth double, total_uncertainty double, hypothesis_count bigint, hypothesis_ratio double")
    nodes = nodes.withColumns({c: to_mm(F.col(c)) for c in ("depth", "total_uncertainty", "hypothesis_ratio")})
    density = with_cells(keyed, prefix).groupBy(*keys, "row", "col").agg(F.count("*").alias("density"))
    return nodes.join(density, [*keys, "row", "col"], "full").withColumn("density", F.coalesce("density", F.lit(0)))


register_tile_method(CUBE, cube_cells)
