"""Implausible readings: a hidden Markov model per source.

Each value column of a source, in measuring order, is one chain with the
states *normal*, *spike*, *stuck* and *out of range*.  What is observed of a
reading is its distance from the running median in units of the source's own
scatter, whether it repeats the reading before, and whether it breaks a hard
bound.  Scatter and repeat rate are statistics over all readings of the
source.  Forward-backward probabilities and the hard bounds assign the flags.

Scale.  A source of up to ``slice_rows`` readings is handled whole, many
sources to a task.  A longer one is cut along time into slices with a halo on
either side; its statistics are histograms which the slices add up.  No task
sees more than a few times ``slice_rows`` rows, however long a source is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

NORMAL, SPIKE, STUCK, OUT = range(4)
STATES = ("normal", "spike", "stuck", "out_of_range")

#: Log-spaced bins for |residual| (ratio 2 %) and bins for asinh(value).
_R_BINS, _R_LOW, _R_STEP = 1500, math.log(1e-6), 0.02
_V_BINS, _V_LIM = 4096, 16.0
_SHORT_RUN = 8
_PARAMETERS = ("sigma", "repeat", "varies", "deep")


@dataclass(frozen=True)
class Channel:
    """How one value column is judged.

    ``low`` and ``high``: no instrument means a value outside; ``low_open``
    excludes ``low`` itself.  ``deep``: a value under 0 is out of range in a
    source whose 2 % quantile lies above this.  ``floor``: the least scatter,
    as a share of the source's median.
    """

    column: str
    low: float = -math.inf
    high: float = math.inf
    low_open: bool = False
    deep: float | None = None
    floor: float = 0.0


#: The deepest sea floor is about 10,935 m, the highest shore a
#: sounding can dry by far less than 500 m; uncertainties are positive.
DEPTH = Channel("z", low=-500.0, high=11_000.0, deep=3.0, floor=1e-5)
UNCERTAINTY = Channel("tvu", low=0.0, high=1_000.0, low_open=True, floor=0.02)


@dataclass(frozen=True)
class Model:
    """Parameters of the chain, alike for all sources.

    ``half_window``: readings on either side in the running median, so that a
    spike of up to ``half_window // 2 + 1`` readings cannot move it.
    ``spread``: the normal emission's standard deviation in units of the
    source's scatter, wide enough for stretches of rougher noise.
    ``rough``: the same in units of the scatter nearby.
    """

    half_window: int = 7
    nearby: int = 40
    spread: float = 1.55
    rough: float = 0.9
    spike_width: float = 400.0
    to_spike: float = 1e-3
    to_stuck: float = 1e-6
    to_out: float = 1e-3
    spike_stays: float = 0.4
    stuck_stays: float = 0.98
    repeat_when_stuck: float = 0.999
    varies: float = 0.1
    halo: int = 512


def _starts(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)


def _running_median(v: np.ndarray, codes: np.ndarray, half: int) -> np.ndarray:
    """Median of the ``2 * half + 1`` readings around each, within its code, mirrored at the ends."""
    out = np.empty_like(v)
    at = np.r_[_starts(codes), len(codes)]
    inner = np.arange(-half, half + 1)
    for a in range(0, len(v), 1 << 18):
        b = min(len(v), a + (1 << 18))
        pad = np.pad(v[max(0, a - half) : b + half], (max(0, half - a), max(0, b + half - len(v))))
        out[a:b] = np.median(sliding_window_view(pad, 2 * half + 1), axis=1)
    edge = np.unique(np.concatenate([np.minimum(at[:-1, None] + np.arange(half), at[1:, None] - 1).ravel(), np.maximum(at[1:, None] - 1 - np.arange(half), at[:-1, None]).ravel()])) if len(at) > 1 else np.zeros(0, np.int64)
    if len(edge):
        seg = np.searchsorted(at, edge, side="right") - 1
        lo, hi = at[seg][:, None], at[seg + 1][:, None] - 1
        i = edge[:, None] + inner[None, :]
        span = np.maximum(hi - lo, 1)
        i = np.abs((i - lo) % (2 * span))  # mirrored, again and again in short sources
        i = lo + np.where(i > span, 2 * span - i, i)
        out[edge] = np.median(v[np.clip(i, lo, hi)], axis=1)
    return out


@dataclass
class _Readings:
    """The readings of one column that lie within the hard bounds, in order of source and time."""

    at: np.ndarray
    v: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    repeat: np.ndarray
    r: np.ndarray
    run_id: np.ndarray
    run_len: np.ndarray
    out: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, null: np.ndarray, codes: np.ndarray, ch: Channel, m: Model) -> _Readings:
        within = np.isfinite(values) & ((values > ch.low) if ch.low_open else (values >= ch.low)) & (values <= ch.high) & ~null
        at = np.flatnonzero(within)
        v, c = values[at], codes[at]
        n = len(v)
        first = np.zeros(n, bool)
        first[_starts(c)] = True
        repeat = np.r_[False, v[1:] == v[:-1]][:n] & ~first
        run_id = np.cumsum(~repeat) - 1
        run_len = np.bincount(run_id) if n else np.zeros(0, np.int64)
        r = v - _running_median(v, c, m.half_window)
        return cls(at, v, c, first, repeat, r, run_id, run_len, ~null & ~within)

    def part(self, a: int, b: int) -> _Readings:
        """The readings of codes ``a`` to ``b``, renumbered from 0."""
        i, j = np.searchsorted(self.codes, [a, b])
        return _Readings(self.at[i:j], self.v[i:j], self.codes[i:j] - a, self.first[i:j], self.repeat[i:j], self.r[i:j], self.run_id[i:j], self.run_len, self.out)


def _summary(x: _Readings, n_codes: int, core: np.ndarray) -> dict[str, np.ndarray]:
    """Per source, what adds up over slices; only ``core`` readings count."""
    use = core[x.at]
    codes = x.codes[use]
    r = np.abs(x.r[use])
    r_bin = np.clip(((np.log(np.maximum(r, 1e-300)) - _R_LOW) / _R_STEP).astype(np.int64) + 1, 0, _R_BINS - 1)
    v_bin = np.clip(((np.arcsinh(x.v[use]) + _V_LIM) * (_V_BINS / (2 * _V_LIM))).astype(np.int64), 0, _V_BINS - 1)
    length = x.run_len[x.run_id[use]]
    short = length <= _SHORT_RUN
    count = lambda w: np.bincount(codes, weights=w, minlength=n_codes)
    return {
        "r": np.bincount(codes * _R_BINS + r_bin, minlength=n_codes * _R_BINS).reshape(n_codes, _R_BINS),
        "v": np.bincount(codes * _V_BINS + v_bin, minlength=n_codes * _V_BINS).reshape(n_codes, _V_BINS),
        "s": np.stack([count(np.ones(len(codes))), count(short), count(short & x.repeat[use]), count(length <= 3)], axis=1).astype(np.int64),
    }


def _quantile(hist: np.ndarray, q: float) -> np.ndarray:
    c = np.cumsum(hist, axis=1)
    return np.argmax(c >= np.maximum(1, np.ceil(q * c[:, -1:])), axis=1)


def _value_of(b: np.ndarray) -> np.ndarray:
    return np.sinh((b + 0.5) * (2 * _V_LIM / _V_BINS) - _V_LIM)


def _parameters(s: dict[str, np.ndarray], ch: Channel, m: Model) -> dict[str, np.ndarray]:
    """Scatter, repeat rate, and whether the column varies and is always deep, per source."""
    to_r = lambda b: np.where(b == 0, 0.0, np.exp(_R_LOW + _R_STEP * (b - 0.5)))
    mad = to_r(_quantile(s["r"], 0.5))
    nonzero = s["r"].copy()
    nonzero[:, 0] = 0
    step = np.where(nonzero.sum(axis=1) > 0, to_r(_quantile(nonzero, 0.5)), 0.0)
    middle = np.abs(_value_of(_quantile(s["v"], 0.5)))
    n, short, repeats, varied = s["s"].T
    # Readings of a column that is constant but for a few leaps say nothing about scatter.
    step = np.where(nonzero.sum(axis=1) >= 0.05 * np.maximum(n, 1), step, 0.0)
    return {
        "sigma": np.maximum.reduce([1.4826 * mad, 0.5 * step, ch.floor * middle, np.full(len(mad), 1e-4)]),
        "repeat": np.clip((repeats + 0.5) / (short + 10.0), 0.005, 0.9),
        "varies": (varied >= m.varies * np.maximum(n, 1)) & (n > 0),
        "deep": _value_of(_quantile(s["v"], 0.02)) > (math.inf if ch.deep is None else ch.deep),
    }


def forward_backward(emit: np.ndarray, move: np.ndarray, prior: np.ndarray, first: np.ndarray, block: int = 32) -> np.ndarray:
    """Posterior state probabilities of concatenated chains, exactly.

    ``emit``: n x k likelihoods; ``first`` marks where a chain begins.  Chains
    are cut into blocks of readings which advance side by side; products of
    transfer matrices carry the messages from block to block.
    """
    n, k = emit.shape
    if not n:
        return emit.copy()
    scale = emit.max(axis=1, keepdims=True)
    emit = emit / np.maximum(scale, 1e-300)
    blocks = -(-n // block)
    pad = blocks * block - n
    e = np.concatenate([emit, np.ones((pad, k))]).reshape(blocks, block, k)
    start = np.concatenate([first, np.ones(pad, bool)]).reshape(blocks, block)
    reset = np.broadcast_to(prior, (k, k))
    step = np.where(start[..., None, None], reset, move) * e[:, :, None, :]
    total = step[:, 0]
    for t in range(1, block):
        total = total @ step[:, t]
        total = total / total.sum(axis=(1, 2), keepdims=True)
    alpha_in, beta_in = np.empty((blocks, k)), np.empty((blocks, k))
    a = prior.copy()
    for i in range(blocks):
        alpha_in[i] = a
        a = a @ total[i]
        a /= a.sum()
    b = np.ones(k)
    for i in range(blocks - 1, -1, -1):
        beta_in[i] = b
        b = total[i] @ b
        b /= b.sum()
    alpha = np.empty((blocks, block, k))
    a = alpha_in
    for t in range(block):
        a = np.matmul(a[:, None, :], step[:, t])[:, 0]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[:, t] = a
    b = beta_in
    for t in range(block - 1, -1, -1):
        alpha[:, t] *= b
        b = np.matmul(step[:, t], b[:, :, None])[:, :, 0]
        b = b / b.sum(axis=1, keepdims=True)
    post = alpha.reshape(-1, k)[:n]
    return post / post.sum(axis=1, keepdims=True)


def _nearby_scatter(x: _Readings, width: int) -> np.ndarray:
    """Scatter of the residuals nearby: the larger of two, in chunks of ``width`` readings of a source and in chunks shifted by half of that.

    The chunk at either end takes what is left over.
    """
    begin = np.flatnonzero(x.first)
    size = np.diff(np.r_[begin, len(x.r)])
    place = np.arange(len(x.r)) - np.repeat(begin, size)
    most = np.maximum(np.repeat(size, size) // width - 1, 0)
    a = np.abs(x.r)

    def scatter(inner: np.ndarray) -> np.ndarray:
        chunk = np.cumsum(x.first | np.r_[False, inner[1:] != inner[:-1]]) - 1
        order = np.lexsort((a, chunk))
        n = np.bincount(chunk)
        return 1.4826 * a[order][np.r_[0, np.cumsum(n)[:-1]] + n // 2][chunk]

    return np.maximum(scatter(np.minimum(place // width, most)), scatter(np.clip((place - width // 2) // width, 0, np.maximum(most - 1, 0))))


def _judge(x: _Readings, p: dict[str, np.ndarray], ch: Channel, m: Model, n_all: int) -> tuple[np.ndarray, np.ndarray]:
    """State and probability of every reading of the column; absent readings are normal."""
    state, prob = np.full(n_all, NORMAL, np.int8), np.zeros(n_all)
    state[x.out], prob[x.out] = OUT, 1.0
    if not len(x.v):
        return state, prob
    sigma, p0 = p["sigma"][x.codes], p["repeat"][x.codes]
    width = np.maximum(m.spread * sigma, m.rough * _nearby_scatter(x, m.nearby))
    dry = p["deep"][x.codes] & (x.v < 0)
    gauss = np.exp(-0.5 * (x.r / width) ** 2) / (width * math.sqrt(2 * math.pi))
    flat = np.full(len(x.r), 1.0) / (m.spike_width * sigma)
    again = np.where(x.repeat, p0, 1 - p0)
    stays = np.where(x.repeat, m.repeat_when_stuck, 1 - m.repeat_when_stuck)
    emit = np.stack([gauss * again, flat * again, np.where(p["varies"][x.codes], gauss * stays, 0.0), np.zeros(len(x.r))], axis=1) + 1e-200
    emit[dry] = [1e-200, 1e-200, 1e-200, 1.0]
    stay = 1 - m.to_spike - m.to_stuck - m.to_out
    move = np.array([
        [stay, m.to_spike, m.to_stuck, m.to_out],
        [1 - m.spike_stays - m.to_stuck - m.to_out, m.spike_stays, m.to_stuck, m.to_out],
        [1 - m.stuck_stays - m.to_spike - m.to_out, m.to_spike, m.stuck_stays, m.to_out],
        [stay, m.to_spike, m.to_stuck, m.to_out],
    ])
    post = forward_backward(emit, move, move[0], x.first)
    s = np.argmax(post, axis=1).astype(np.int8)
    pr = 1 - post[:, NORMAL]
    # The first reading of a stuck run repeats nothing; it belongs to the run.
    stuck_run = np.zeros(len(x.run_len), bool)
    stuck_run[x.run_id[s == STUCK]] = True
    whole = stuck_run[x.run_id] & (s == NORMAL)
    s[whole], pr[whole] = STUCK, 1.0
    state[x.at], prob[x.at] = s, pr
    return state, prob


def _prepare(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, list]:
    """One row a reading, in order of source and time, with the sources' codes and names."""
    pdf = pdf.sort_values(["_source", "_time", "_id"], kind="stable")
    i, s = pdf["_id"].to_numpy(), pdf["_source"].to_numpy()
    pdf = pdf[np.r_[True, (i[1:] != i[:-1]) | (s[1:] != s[:-1])][: len(pdf)]]
    codes, names = pd.factorize(pdf["_source"])
    return pdf, codes.astype(np.int64), list(names)


def _readings(pdf: pd.DataFrame, codes: np.ndarray, i: int, ch: Channel, m: Model) -> _Readings:
    return _Readings.of(pdf[f"_v{i}"].to_numpy(np.float64), pdf[f"_n{i}"].to_numpy(bool), codes, ch, m)


def _all_parameters(x: _Readings, n_codes: int, ch: Channel, m: Model) -> dict[str, np.ndarray]:
    """Parameters of many whole sources; the histograms of a few hundred at a time."""
    core = np.ones(int(x.at[-1]) + 1 if len(x.at) else 0, bool)
    parts = [_parameters(_summary(x.part(a, min(n_codes, a + 256)), min(n_codes, a + 256) - a, core), ch, m) for a in range(0, n_codes, 256)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _result(pdf: pd.DataFrame, judged: list[tuple[np.ndarray, np.ndarray]], channels: tuple[Channel, ...], keep: np.ndarray) -> pd.DataFrame:
    parts = []
    for ch, (state, prob) in zip(channels, judged, strict=True):
        hit = keep & (state != NORMAL)
        parts.append(pd.DataFrame({"id": pdf["_id"].to_numpy()[hit], "source": pdf["_source"].to_numpy()[hit], "channel": ch.column, "state": np.array(STATES, object)[state[hit]], "probability": prob[hit]}))
    return pd.concat(parts, ignore_index=True)


def flag_implausible(
    df: DataFrame,
    channels: tuple[Channel, ...] = (DEPTH, UNCERTAINTY),
    source: str = "container",
    time: str = "ping_time",
    key: str = "point_id",
    model: Model = Model(),
    slice_rows: int = 200_000,
) -> DataFrame:
    """The implausible readings of ``df``: one row ``(key, source, channel, state, probability)`` for each reading and value column.

    A reading is one ``key``, however many rows it has; rows of a key are
    taken to be equal in the columns used.  Rows with a null ``key``,
    ``source`` or ``time`` take no part.  A null value is no reading: it is
    never flagged and readings on either side of it follow each other.  NaN
    and infinite values are out of range.  Equal times are put in the order
    of ``key``.  An empty table gives an empty result; other columns of
    ``df``, whatever their names, are not looked at.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(key).alias("_id"), F.col(source).alias("_source"), F.unix_micros(F.col(time)).alias("_time"),
        *[e for i, ch in enumerate(channels) for e in (F.col(ch.column).cast("double").alias(f"_v{i}"), F.col(ch.column).isNull().alias(f"_n{i}"))],
    ).where("_id is not null and _source is not null and _time is not null")
    types = dict(rows.dtypes)
    out_schema = f"id {types['_id']}, source {types['_source']}, channel string, state string, probability double"

    counts = cut(rows.groupBy("_source").agg(F.count("*").alias("_n")))  # a row a source, used several times
    is_long = F.col("_n") > slice_rows
    total = counts.agg(F.sum("_n"), F.count(F.when(is_long, 1)), F.sum(F.when(is_long, F.col("_n")))).first()
    n_rows, n_long, n_long_rows = int(total[0] or 0), int(total[1]), int(total[2] or 0)
    long = counts.where(F.col("_n") > slice_rows)
    # There are at most rows / slice_rows long sources; past the bound they are joined by a shuffle.
    small = (lambda x: F.broadcast(x)) if n_long <= 50_000 else (lambda x: x)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, codes, names = _prepare(pdf)
        judged = []
        for i, ch in enumerate(channels):
            x = _readings(pdf, codes, i, ch, model)
            judged.append(_judge(x, _all_parameters(x, len(names), ch, model), ch, model, len(pdf)))
        return _result(pdf, judged, channels, np.ones(len(pdf), bool))

    buckets = max(1, -(-n_rows // slice_rows))
    short = rows.join(small(long.select("_source")), "_source", "left_anti") if n_long else rows
    flags = short.withColumn("_bucket", F.pmod(F.xxhash64("_source"), F.lit(buckets))).groupBy("_bucket").applyInPandas(whole, out_schema)
    if n_long:
        slices = max(2, -(-n_long_rows // slice_rows))
        flags = flags.unionByName(_long_sources(rows.join(small(long.select("_source")), "_source", "left_semi"), slices, small, channels, model, out_schema))
    return flags.select(F.col("id").alias(key), F.col("source").alias(source), "channel", "state", "probability")


def _long_sources(rows: DataFrame, slices: int, small, channels: tuple[Channel, ...], model: Model, out_schema: str) -> DataFrame:
    """Sources too long for one task, in ``slices`` even slices along source and time."""
    halo = model.halo

    def tag(batches):
        """Each row for its own slice, the first and last ``halo`` also for the slice before and after."""
        pid, seen, tail = TaskContext.get().partitionId(), 0, None
        for pdf in batches:
            yield pdf.assign(_slice=pid, _core=True)
            if seen < halo:
                yield pdf.iloc[: halo - seen].assign(_slice=pid - 1, _core=False)
            seen += len(pdf)
            tail = pdf.iloc[-halo:] if tail is None or len(pdf) >= halo else pd.concat([tail, pdf]).iloc[-halo:]
        if tail is not None:
            yield tail.assign(_slice=pid + 1, _core=False)

    order = ["_source", "_time", "_id"]
    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    tagged = rows.repartitionByRange(slices, *order).sortWithinPartitions(*order).mapInPandas(tag, f"{fields}, _slice int, _core boolean")
    # Slices depend on a sample that Spark draws; both passes below must see the same ones.
    tagged = cut(tagged)
    names = [f"{k}{i}" for i in range(len(channels)) for k in ("r", "v", "s")]
    source_type = dict(rows.dtypes)["_source"]

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, codes, sources = _prepare(pdf)
        core, row = pdf["_core"].to_numpy(bool), {"_source": sources[0], "_slice": pdf["_slice"].iloc[0]}
        for i, ch in enumerate(channels):
            s = _summary(_readings(pdf, codes, i, ch, model), 1, core)
            row |= {f"{k}{i}": v[0] for k, v in s.items()}
        return pd.DataFrame([row])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"_source": pdf["_source"].iloc[0]}
        for i, ch in enumerate(channels):
            p = _parameters({k: np.sum(np.stack(pdf[f"{k}{i}"].to_numpy()), axis=0)[None, :] for k in ("r", "v", "s")}, ch, model)
            row |= {f"{k}{i}": float(v[0]) for k, v in p.items()}
        return pd.DataFrame([row])

    def judge(pdf: pd.DataFrame, params: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(params):
            return pd.DataFrame({"id": [], "source": [], "channel": [], "state": [], "probability": []})
        pdf, codes, _ = _prepare(pdf)
        judged = []
        for i, ch in enumerate(channels):
            p = {k: params[f"{k}{i}"].to_numpy() for k in _PARAMETERS}
            p |= {k: p[k] > 0.5 for k in ("varies", "deep")}
            judged.append(_judge(_readings(pdf, codes, i, ch, model), p, ch, model, len(pdf)))
        return _result(pdf, judged, channels, pdf["_core"].to_numpy(bool))

    sums = tagged.groupBy("_source", "_slice").applyInPandas(summarise, f"_source {source_type}, _slice int, " + ", ".join(f"{n} array<bigint>" for n in names))
    # A source has rows / slice_rows slices, each a few thousand counts.
    params = sums.groupBy("_source").applyInPandas(add, f"_source {source_type}, " + ", ".join(f"{k}{i} double" for i in range(len(channels)) for k in _PARAMETERS))
    each = tagged.select("_source", "_slice").distinct().join(small(params), "_source")
    each = each.toDF(*[f"_p{c}" if c in ("_source", "_slice") else c for c in each.columns])
    return tagged.groupBy("_source", "_slice").cogroup(each.groupBy("_p_source", "_p_slice")).applyInPandas(judge, out_schema)
