"""Percentiles of very large columns: mergeable relative-error sketches.

A sketch is a stack of compactors.  When one overflows, it sorts its items,
keeps those at the protected end, and hands every second one of the others to
the next level, where each stands for twice as many.  The protected end holds
back more the fewer compactions there were, so the rank error is proportional
to the distance from that end (relative-error streaming quantiles of Cormode,
Karnin, Liberty, Thaler and Vesely).  Sketches of days, files or partitions
merge level by level; a group of few values is kept as it is, without error.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

SECTION = 32
_SECTIONS = 3
#: Rows of one task that are gathered before they are sketched.
_GATHER = 1_000_000


def rank_error(section: int = SECTION) -> float:
    """Three standard deviations of the rank error, relative to the rank counted from the protected end."""
    return 3 * math.sqrt(0.0512 / _SECTIONS) / section


def _coin(items: np.ndarray, state: int, level: int, low: bool) -> int:
    """0 or 1, the same on every run, as good as independent from one compaction to the next."""
    return zlib.crc32(items.tobytes(), state * 1_000_003 + level * 17 + low & 0xFFFFFFFF) >> 16 & 1


class Sketch:
    """Compactors of one group; ``low`` protects the smallest values, else the largest."""

    __slots__ = ("n", "levels", "states", "section", "low")

    def __init__(self, section: int = SECTION, low: bool = True):
        self.n, self.section, self.low = 0, section, low
        self.levels: list[np.ndarray] = []
        self.states: list[int] = []

    def _shape(self, state: int) -> tuple[int, int]:
        """Length and number of sections of a compactor after ``state`` compactions."""
        size, count = float(self.section), _SECTIONS
        while state >= 1 << (count - 1) and size / math.sqrt(2) >= 4:
            size, count = size / math.sqrt(2), 2 * count
        return max(4, 2 * round(size / 2)), count

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            length, count = self._shape(self.states[h])
            if len(self.levels[h]) > 2 * length * count:
                items = np.sort(self.levels[h])
                if not self.low:
                    items = items[::-1]
                state = self.states[h]
                trailing = (~state & (state + 1)).bit_length() - 1
                # Of a buffer that came in one piece, all beyond the half that is held back may go.
                held = length * count + max(0, count - trailing - 1) * length
                held = min(held, len(items)) + ((len(items) - held) & 1)
                moved = items[held:]
                # The coin hangs on the items, too: sketches of equal size must not all err to one side.
                coin = _coin(items, state, h, self.low)
                self.levels[h] = items[:held]
                self.states[h] = state + 1
                if h + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                    self.states.append(0)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], moved[coin::2]])
                continue
            h += 1

    def add(self, values: np.ndarray) -> Sketch:
        """Take in values, a buffer at a time."""
        step = 4 * self.section * _SECTIONS
        for a in range(0, len(values), step):
            part = values[a : a + step]
            self.merge_levels([part], [0], len(part))
        return self

    def merge_levels(self, levels: list[np.ndarray], states: list[int], n: int) -> Sketch:
        """Take in another sketch, given by its levels."""
        self.n += n
        while len(self.levels) < len(levels):
            self.levels.append(np.zeros(0))
            self.states.append(0)
        for h, (items, state) in enumerate(zip(levels, states, strict=True)):
            self.levels[h] = np.concatenate([self.levels[h], items])
            self.states[h] |= state
        self._compress()
        return self


def _quantiles(values: np.ndarray, weights: np.ndarray, q: list[float]) -> list[float]:
    """The least value whose rank reaches q * n."""
    order = np.argsort(values, kind="stable")
    c = np.cumsum(weights[order])
    at = np.searchsorted(c, np.maximum(1, np.ceil(np.asarray(q) * c[-1] - 1e-9)))
    return values[order][np.minimum(at, len(c) - 1)].tolist()


#: What a row of a sketch holds: all values there were, or a level of a sketch that protects the smallest or the largest.
RAW, LOW, HIGH = 0, 1, 2
_FIELDS = "tail int, n bigint, level int, state bigint, items array<double>"
#: Tails to keep; a quantile is read from the sketch that protects its side.
TAILS = (LOW, HIGH)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Small integers that are equal where the values are."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _batch(heads: pa.Table, rows: np.ndarray, tail, n, level, state, offsets, items) -> pa.RecordBatch:
    columns = [c.combine_chunks() for c in heads.take(pa.array(rows, pa.int64())).columns]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(items, pa.float64()))
    rest = [pa.array(np.asarray(tail, np.int32)), pa.array(np.asarray(n, np.int64)), pa.array(np.asarray(level, np.int32)), pa.array(np.asarray(state, np.int64)), lists]
    return pa.RecordBatch.from_arrays([*columns, *rest], [*heads.column_names, "tail", "n", "level", "state", "items"])


def _raw(heads: pa.Table, rows: np.ndarray, size: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Rows of groups whose values are few enough to be kept."""
    k = len(rows)
    return _batch(heads, rows, np.full(k, RAW), size, np.zeros(k), np.zeros(k), np.r_[0, np.cumsum(size)], values)


def _stacks(heads: pa.Table, sketches: list[tuple[int, Sketch]]) -> list[pa.RecordBatch]:
    """Rows of whole sketches, each with the row of ``heads`` that names its group."""
    rows = [(i, LOW if s.low else HIGH, s.n if h == 0 else 0, h, s.states[h], s.levels[h]) for i, s in sketches for h in range(len(s.levels))]
    if not rows:
        return []
    i, tail, n, h, states, items = zip(*rows, strict=True)
    return [_batch(heads, np.array(i), np.array(tail), np.array(n), np.array(h), np.array(states), np.r_[0, np.cumsum([len(x) for x in items])], np.concatenate(items))]


def _flush(t: pa.Table, names: list[str], section: int, tails: tuple[int, ...]) -> list[pa.RecordBatch]:
    """Sketch rows of gathered values; groups that fit in a compactor go on as they are."""
    room = 2 * section * _SECTIONS
    codes = np.zeros(t.num_rows, np.int64)
    for c in names:
        one = _codes(t.column(c))
        codes = pd.factorize(codes * (int(one.max()) + 1) + one)[0]
    order = np.argsort(codes, kind="stable")
    codes, values = codes[order], t.column("_v").to_numpy()[order]
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    size = np.diff(np.r_[at, len(codes)])
    small = size <= room
    heads = t.select(names)
    out = [_raw(heads, order[at[small]], size[small], values[np.repeat(small, size)])]
    large = [(order[at[i]], Sketch(section, tail == LOW).add(values[at[i] : at[i] + size[i]])) for i in np.flatnonzero(~small) for tail in tails]
    return out + _stacks(heads, large)


def sketch(df: DataFrame, keys: dict[str, Column], value: Column, section: int = SECTION, tails: tuple[int, ...] = TAILS) -> DataFrame:
    """Sketches of ``value`` for every combination of ``keys``: ``(keys..., tail, n, level, state, items)``, one row a level.

    Each task sketches what it reads before anything is shuffled, so a group
    of any size arrives as a short sketch for each of ``tails`` from every
    task.  A group of few values is kept as it is.  Rows with a null key, a
    null value or NaN take no part; infinite values count.  The result can be
    stored and merged with others of the same ``section`` and ``tails``.
    """
    names = list(keys)
    rows = df.select(*[e.alias(c) for c, e in keys.items()], value.cast("double").alias("_v")).dropna()  # dropna drops NaN too
    fields = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in names)

    def partial(batches):
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= _GATHER:
                yield from _gathered(held)
                held, count = [], 0
        if count:
            yield from _gathered(held)

    def _gathered(held):
        return _flush(pa.Table.from_batches(held), names, section, tails)

    return merge(rows.mapInArrow(partial, f"{fields}, {_FIELDS}"), names, section, tails)


def merge(sketches: DataFrame, keys: list[str], section: int = SECTION, tails: tuple[int, ...] = TAILS) -> DataFrame:
    """The sketches of every combination of ``keys``, from those of days, files or partitions."""
    rows = sketches.select(*keys, "tail", "n", "level", "state", "items")
    fields = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in keys)
    room = 2 * section * _SECTIONS

    def combine(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if rest.num_rows >= 20_000:
                done, rest = _groups(rest, final=False)
                yield from done
        if rest is not None and rest.num_rows:
            yield from _groups(rest, final=True)[0]

    def _groups(t: pa.Table, final: bool):
        heads = t.select(keys)
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in keys:
            v = _codes(heads.column(c))
            new[1:] |= v[1:] != v[:-1]
        at = np.flatnonzero(new)
        last = t.num_rows if final else int(at[-1])
        if last == 0:  # one group only, and it may go on
            return _squeeze(t, heads)
        at = at if final else at[:-1]
        offsets, values, tail, n, level, state = _arrays(t)
        ends = np.r_[at[1:], last]
        size = offsets[ends] - offsets[at]
        small = (np.maximum.reduceat(tail[:last], at) == RAW) & (size <= room)
        keep = np.repeat(small, size)  # the groups' values follow each other
        parts = [_raw(heads, at[small], size[small], values[offsets[0] : offsets[last]][keep])]
        parts += _stacks(heads, [(at[g], s) for g in np.flatnonzero(~small) for s in _merged(at[g], ends[g], tail, n, level, state, offsets, values)])
        return parts, None if final else t.slice(last)

    def _arrays(t: pa.Table):
        items = t.column("items").combine_chunks()
        tail, n, level, state = (t.column(c).to_numpy() for c in ("tail", "n", "level", "state"))
        return items.offsets.to_numpy().astype(np.int64), items.values.to_numpy(), tail, n, level, state

    def _merged(begin, end, tail, n, level, state, offsets, values) -> list[Sketch]:
        """A group's sketches, one for each tail; values that were kept as they are go to all."""
        every = {t: Sketch(section, t == LOW) for t in tails}
        raw = [values[offsets[r] : offsets[r + 1]] for r in range(begin, end) if tail[r] == RAW]
        for t, s in every.items():
            levels, states, count = [], [], 0
            for r in range(begin, end):
                if tail[r] != t:
                    continue
                # Level 0 begins a sketch; its further levels follow.
                if level[r] == 0 and levels:
                    s.merge_levels(levels, states, count)
                    levels, states, count = [], [], 0
                levels.append(values[offsets[r] : offsets[r + 1]])
                states.append(int(state[r]))
                count += int(n[r])
            if levels:
                s.merge_levels(levels, states, count)
            if raw:
                s.add(np.concatenate(raw))
        return list(every.values())

    def _squeeze(t: pa.Table, heads: pa.Table):
        """A group of very many sketches, merged so far and carried on as one."""
        offsets, values, tail, n, level, state = _arrays(t)
        merged = _merged(0, t.num_rows, tail, n, level, state, offsets, values)
        return [], pa.Table.from_batches(_stacks(heads, [(0, s) for s in merged])).cast(t.schema)

    # Rows of one sketch stay together in order of level: they come from one task, one after the other.
    rows = rows.withColumn("_from", F.monotonically_increasing_id())
    spread = rows.repartition(*keys).sortWithinPartitions(*keys, "_from").drop("_from")
    return spread.mapInArrow(combine, f"{fields}, {_FIELDS}")


def quantiles(sketches: DataFrame, keys: list[str], q: dict[str, float], section: int = SECTION) -> DataFrame:
    """``(keys..., n, names of q..., {name}_error..., rank_error)`` from merged sketches.

    A quantile is the least value whose estimated rank reaches q * n, read from
    the sketch that protects its side: the smallest values up to the median,
    the largest beyond, or the one there is.  ``rank_error`` bounds the error
    of a rank, as a share of that rank counted from the protected end, at three
    standard deviations; ``{name}_error`` tells it for each quantile as a
    number of ranks.  All are 0 where every value is still held.
    """
    rows = sketches.select(*keys, "tail", "n", "level", "items")
    per_key = cut(rows.groupBy(*keys).agg(F.sum(F.col("n")).alias("_n"), F.max("tail").alias("_tail"), F.countDistinct("tail").alias("_tails"), F.collect_list(F.struct("tail", "level", "items")).alias("_l")))
    per_key = per_key.withColumn("n", (F.col("_n") / F.col("_tails")).cast("bigint"))  # each tail's sketch counts all
    kinds = dict(rows.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    error = rank_error(section)
    names = [*q, *[f"{c}_error" for c in q], "rank_error"]

    # Groups that are held whole are read off in the JVM, the others in Python.
    ordered = F.array_sort(F.element_at("_l", 1)["items"])
    place = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n") - F.lit(1e-9))).cast("int")
    whole = per_key.where(F.col("_tail") == RAW).withColumn("_s", ordered).select(*keys, "n", *[F.element_at("_s", place(p)).alias(c) for c, p in q.items()], *[F.lit(0.0).alias(c) for c in names[len(q) :]])

    def read(batches):
        for pdf in batches:
            out = []
            for levels, n in zip(pdf["_l"], pdf["n"], strict=True):
                sides = {}
                for tail in {x["tail"] for x in levels}:
                    mine = [x for x in levels if x["tail"] == tail]
                    v = np.concatenate([np.asarray(x["items"]) for x in mine])
                    w = np.repeat([1 << x["level"] for x in mine], [len(x["items"]) for x in mine])
                    sides[tail] = (v, w)
                found, wrong = [], []
                for p in q.values():
                    side = (LOW if p <= 0.5 else HIGH) if len(sides) > 1 else next(iter(sides))
                    found += _quantiles(*sides[side], [p])
                    wrong.append(error * n * (p if side == LOW else 1 - p))
                out.append([*found, *wrong, error])
            yield pdf[[*keys, "n"]].assign(**{c: [r[i] for r in out] for i, c in enumerate(names)})

    rest = per_key.where(F.col("_tail") != RAW).select(*keys, "n", "_l").mapInPandas(read, f"{fields}, n bigint, " + ", ".join(f"`{c}` double" for c in names))
    return whole.unionByName(rest)
