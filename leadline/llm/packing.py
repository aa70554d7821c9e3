"""Filling containers of fixed capacity: multiway differencing in batches.

Items are dealt out at random to batches of bounded size.  In a batch, the
Karmarkar-Karp method for k windows starts with a partial partition for every
item and again and again merges the two most unbalanced ones, the fullest
windows of one with the emptiest of the other.  The windows come out nearly
equal; single items change places where one is just over the capacity, and k
rises where that doesn't help.  Batches are independent, so
the work grows as the input, and in a batch of hundreds of windows the one that
is never quite full hardly counts.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_ITEMS = 600
#: Items of one task.  Rows are tiny and the work is not, so the number of tasks is not left to their bytes.
TASK_ITEMS = 6_000


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each item: near-equal sums by Karmarkar-Karp multiway differencing."""
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, np.int64)
    # A node is an item (its number) or two nodes together; a partial partition is k sums with a node each.
    left, right = [], []
    partial, heap = {}, []
    for i in range(n):
        partial[i] = (np.array([float(sizes[i])]), np.array([i]))  # only the windows in use, fullest first
        heap.append((-float(sizes[i]), i))
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (sa, na), (sb, nb) = partial.pop(a), partial.pop(b)
        overlap = len(sa) + len(sb) - k
        if overlap <= 0:
            sums, nodes = np.concatenate([sa, sb]), np.concatenate([na, nb])
        else:
            # Fullest of a with emptiest of b; a window meets another only where both are in use.
            keep_a, keep_b = len(sa) - overlap, len(sb) - overlap
            joined = np.arange(n + len(left), n + len(left) + overlap)
            left += na[keep_a:].tolist()
            right += nb[keep_b:][::-1].tolist()
            sums = np.concatenate([sa[:keep_a], sb[:keep_b], sa[keep_a:] + sb[keep_b:][::-1]])
            nodes = np.concatenate([na[:keep_a], nb[:keep_b], joined])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        partial[fresh] = (sums, nodes)
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == k else 0.0)), fresh))
        fresh += 1
    _, nodes = partial[heap[0][1]]
    window = np.full(n + len(left), -1, np.int64)
    window[nodes] = np.arange(len(nodes))
    for j in range(len(left) - 1, -1, -1):
        window[left[j]] = window[right[j]] = window[n + j]
    return window[:n]


def exchange(sizes: np.ndarray, window: np.ndarray, k: int, capacity: int) -> np.ndarray:
    """Even out what differencing leaves: swap or move single items out of windows over ``capacity`` while that lowers the fuller of the two."""
    window = window.copy()
    sums = np.bincount(window, weights=sizes, minlength=k)
    # Beside every item, an empty place in every window.
    size, at = np.concatenate([sizes, np.zeros(k)]), np.concatenate([window, np.arange(k)])
    for _ in range(4 * k):
        full = int(np.argmax(sums))
        if sums[full] <= capacity:
            break
        mine = np.flatnonzero(at[: len(sizes)] == full)
        change = size[mine, None] - size[None, :]
        after = np.maximum(sums[full] - change, sums[at][None, :] + change)
        after[:, at == full] = np.inf
        i, j = np.unravel_index(np.argmin(after), after.shape)
        if after[i, j] >= sums[full]:
            break
        other = at[j]
        sums[full] -= change[i, j]
        sums[other] += change[i, j]
        at[mine[i]] = other
        if j < len(sizes):
            at[j] = full
    return at[: len(sizes)]


def _least(sizes: np.ndarray, capacity: int) -> int:
    """A number of windows that no filling can do with less than."""
    # No two items over half the capacity share a window; what the rest must fill beside them adds to it.
    large = sizes[2 * sizes > capacity]
    left = capacity * len(large) - int(large.sum())
    # Of items over a third, a window without a larger one takes two at most.
    middle = sizes[(3 * sizes > capacity) & (2 * sizes <= capacity)]
    beside = int(np.searchsorted(np.sort(capacity - large), middle.min(), side="left")) if len(middle) and len(large) else len(large)
    alone = max(0, len(middle) - (len(large) - beside)) if len(middle) else 0
    return max(1, -(-int(sizes.sum()) // capacity), len(large) + max(0, -(-(int(sizes.sum()) - int(large.sum()) - left) // capacity)), len(large) + -(-alone // 2))


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, as few windows as differencing can fill without exceeding ``capacity``; no item may exceed it.

    The number of windows starts from a lower bound and rises in growing
    steps until all fit; between the last number that failed and the first
    that did, it is halved down.
    """
    window = np.zeros(len(sizes), np.int64)
    some = np.flatnonzero(sizes > 0)
    part = sizes[some]
    if not len(some):
        return window

    def attempt(k: int) -> np.ndarray | None:
        w = exchange(part, difference(part, k), k, capacity)
        return w if np.bincount(w, weights=part).max() <= capacity else None

    low, step = _least(part, capacity) - 1, 1
    best = None
    while best is None:
        k = min(low + step, len(part))
        best = attempt(k)
        if best is None:
            low, step = k, 2 * step
    high = k
    while high - low > 1:
        k = (low + high) // 2
        w = attempt(k)
        if w is None:
            low = k
        else:
            high, best = k, w
    window[some] = best
    return window


def pack(df: DataFrame, key: str, size: str, capacity: int, batch_items: int = BATCH_ITEMS) -> DataFrame:
    """``(key, piece, size, start, window)``: every item in exactly one window of at most ``capacity``.

    An item longer than the capacity is cut: each piece but the last fills a
    window of its own, the last is packed with the other items; ``start`` is
    where a piece begins in its item.  Items of size 0, null sizes among them,
    take no space and go to a window of their batch.  Rows with a null key take
    no part; rows of one key count once, with its largest size.  An empty table
    gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    items = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.greatest(F.coalesce(F.max(size), F.lit(0)), F.lit(0)).cast("bigint").alias("_size"))
    n = items.count()
    batches = max(1, -(-n // batch_items))
    tasks = min(batches, max(1, -(-n // TASK_ITEMS)))
    kind = dict(items.dtypes)["_key"]

    def windows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key", kind="stable")
        keys, size, batch = pdf["_key"].to_numpy(), pdf["_size"].to_numpy(np.int64), int(pdf["_batch"].iloc[0])
        full = np.where(size > capacity, (size - 1) // capacity, 0)
        rest = size - full * capacity
        w = fill(rest, capacity)
        owner = np.repeat(np.arange(len(keys)), full)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        used = int(w.max()) + 1 if len(w) else 0
        out = pd.DataFrame({
            "key": np.concatenate([keys, keys[owner]]),
            "piece": np.concatenate([full, piece]),
            "size": np.concatenate([rest, np.full(len(owner), capacity)]),
            "start": np.concatenate([full * capacity, piece * capacity]),
            "window": np.concatenate([w, used + np.arange(len(owner))]),
        })
        return out.assign(window=[f"{batch}-{x}" for x in out["window"]])

    packed = items.withColumn("_batch", F.pmod(F.xxhash64("_key"), F.lit(batches))).repartition(tasks, "_batch").groupBy("_batch").applyInPandas(windows, f"key {kind}, piece int, size bigint, start bigint, window string")
    return packed.select(F.col("key").alias(key), "piece", F.col("size").alias(size), "start", "window")
