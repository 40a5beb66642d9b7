"""Implausible readings: out of range, spikes, and stuck values, judged against the signal's own behaviour.

Chunks are cut into blocks of ``BLOCK`` chunks per signal with ``HALO`` chunks of context on either side, so a signal
with a third of all rows is many tasks and every task is bounded. Within a block, robust principal components of the
profile matrix (rows are successive profiles of one period) separate low-rank normal behaviour from a sparse part and noise;
the distance from the low-rank part is the score of a reading, and a check of the shape of each sparse one follows. Ranges
and constant runs are tested by themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, HALO = 64, 16  #: chunks
PROFILE = 32  #: readings of a profile where the signal shows no period of its own
SPARSE = 2.0  #: times the noise that a reading must lie off the low-rank part to belong to the sparse part
SCORE, AROUND = 1.3, 2.5  #: times the high quantile of the distances from the low-rank part, of the block and around a reading
BOTH_SIDES, SHARP = 2.3, 2.5  #: the same for departures from both the readings before and after, of the block and around it
FOLLOW, SHARE = 0.4, 0.4  #: how much of these a reading next to a spike needs, and of the spike's departure
CALM, CALM_LATE, CALM_WITHIN = 0.4, 0.5, 12  #: no more than a few readings within so many depart by this share of a spike's departure
LONGEST_SPIKE = 6  #: readings
STUCK_TIMES, STUCK_LEAST = 4.0, 15  #: times the longest run that the signal otherwise has, and readings
RESTLESS = 0.2  #: share of readings that differ from the one before, below which a signal hardly ever changes


def shrink(x: np.ndarray, by: float) -> np.ndarray:
    """``x`` with singular values lessened by ``by``, from the eigenvectors of the smaller Gram matrix."""
    if x.shape[0] > x.shape[1]:
        return shrink(x.T, by).T
    squares, u = np.linalg.eigh(x @ x.T)
    d = np.sqrt(np.maximum(squares, 0))
    keep = d > by
    u = u[:, keep]
    return (u * (1 - by / d[keep])) @ (u.T @ x)


def pursuit(m: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """The low-rank and the sparse part of ``m`` by stable principal component pursuit: what is left is noise.

    In turn, singular values are lessened by about what noise alone has, and the readings further than ``SPARSE`` times the
    noise from the low-rank part are given to the sparse part. The noise is measured anew each time, by the median.
    """
    least = 1e-9 * (np.abs(m).max() + 1e-12)
    noise = max(1.4826 * _ranked(np.abs(np.diff(m, axis=1)), 0.5) / np.sqrt(2) if m.shape[1] > 1 else 0.0, least)
    low, sparse = m, np.zeros_like(m)
    for _ in range(rounds):
        low = shrink(m - sparse, 0.7 * noise * sum(np.sqrt(m.shape)))
        rest = m - low
        noise = max(1.4826 * _ranked(np.abs(rest), 0.5), least)
        now = np.sign(rest) * np.maximum(np.abs(rest) - SPARSE * noise, 0)
        settled = np.abs(now - sparse).max() < 0.02 * SPARSE * noise
        sparse = now
        if settled:
            break
    return low, sparse


def period(f: np.ndarray) -> int:
    """Length of a profile: the lag of the highest autocorrelation from 8 readings to an eighth of the series."""
    n = len(f)
    top = min(n // 8, 512)
    if top <= 8:
        return min(PROFILE, max(2, n // 4))
    z = f - f.mean()
    p = np.fft.rfft(z, 2 * n)
    acf = np.fft.irfft(p * np.conj(p))[: top + 1]
    if acf[0] <= 0:
        return PROFILE
    lag = 8 + int(np.argmax(acf[8:]))
    return lag if acf[lag] > 0.3 * acf[0] else min(PROFILE, n // 4)


def _windows(f: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(f, n)


def _ranked(x: np.ndarray, share: float) -> float:
    """The value below which ``share`` of ``x`` lies."""
    k = int(share * (x.size - 1))
    return float(np.partition(x, k, axis=None)[k])


def _spread(r: np.ndarray) -> float:
    return max(_ranked(r, 0.95), 0.8 * _ranked(r, 0.97))


def two_sided(f: np.ndarray, most: int = 4) -> np.ndarray:
    """How far each reading lies outside of both neighbours at a distance of 1 to ``most``, at the widest. Slopes and steps
    have none."""
    widest = np.zeros(len(f))
    for k in range(1, most + 1):
        before, after = f[k:-k] - f[: -2 * k], f[k:-k] - f[2 * k :]
        widest[k:-k] = np.maximum(widest[k:-k], np.where(before * after > 0, np.minimum(np.abs(before), np.abs(after)), 0))
    return widest


def _beside(values: np.ndarray, at: np.ndarray, look: int, skip: int) -> np.ndarray:
    """High quantile of ``values`` around each place, the nearest ones left out."""
    edge = np.full(look, np.nan)
    near = _windows(np.r_[edge, values, edge], 2 * look + 1)[at]
    near = np.sort(np.c_[near[:, : look - skip], near[:, look + skip + 1 :]], axis=1)  # NaN comes last
    known = np.isfinite(near).sum(axis=1)
    return np.where(known > 0, near[np.arange(len(at)), (0.9 * np.maximum(known - 1, 0)).astype(int)], 0.0)


def spike_mask(f: np.ndarray, ends: bool = True, pursue: bool = True) -> np.ndarray:
    """Which readings of ``f`` (finite, in range) are spikes. ``ends``: the last reading is the signal's last.

    The distance from the low-rank part of the profile matrix is the score: a spike belongs to the sparse part, and its
    score is high in the block and around it. The check that follows is of its shape: it departs from the readings before
    and after alike, is short, and goes on as before. Without ``pursue`` only the check is left (for comparison).
    """
    n = len(f)
    odd = np.zeros(n, bool)
    if n < 24 or f.max() == f.min():
        return odd
    step = np.diff(np.unique(f)).min()
    widest = two_sided(f)
    both = widest / max(_spread(widest), step)
    off = widest
    candidate = both >= FOLLOW * BOTH_SIDES
    if pursue:
        middle = _ranked(f, 0.5)
        length = period(np.clip(f, _ranked(f, 0.01), _ranked(f, 0.99)))
        rows = -(-n // length)
        padded = np.full(rows * length, middle)
        padded[:n] = f
        low, sparse = pursuit(padded.reshape(rows, length) - middle)
        off = np.abs(padded - middle - low.reshape(-1))[:n]
        candidate &= sparse.reshape(-1)[:n] != 0
    at = np.flatnonzero(candidate)
    if not len(at):
        return odd
    score, local, sharp = np.full(n, np.inf), np.full(n, np.inf), np.zeros(n)
    sharp[at] = widest[at] / np.maximum(_beside(widest, at, 24, 5), step)
    if pursue:
        score = off / max(_spread(off), step)
        local[at] = off[at] / np.maximum(_beside(off, at, 24, 4), step)
    odd = candidate & (score >= SCORE) & (local >= AROUND) & (both >= BOTH_SIDES) & (sharp >= SHARP)
    if not odd.any():
        return odd
    # in a phase of strong activity the readings around depart as far
    for i in np.flatnonzero(odd):
        odd[i] = (widest[max(0, i - CALM_WITHIN) : i + CALM_WITHIN + 1] >= CALM * widest[i]).sum() < LONGEST_SPIKE
    # a spike goes on in a neighbour that departs by a good part of what it does
    near = candidate & (local >= FOLLOW * AROUND) & (sharp >= FOLLOW * SHARP)
    for _ in range(LONGEST_SPIKE):
        left = np.r_[False, odd[:-1]] & (widest >= SHARE * np.r_[0, widest[:-1]])
        right = np.r_[odd[1:], False] & (widest >= SHARE * np.r_[widest[1:], 0])
        odd = odd | (near & (left | right))
    first = np.flatnonzero(odd & ~np.r_[False, odd[:-1]])
    last = np.flatnonzero(odd & ~np.r_[odd[1:], False])
    for a, z in zip(first, last):
        beside = np.r_[off[max(0, a - LONGEST_SPIKE) : a], off[z + 1 : z + 1 + LONGEST_SPIKE]]
        # it lasts, or doesn't go on as before, or starts a phase that the end cuts short
        late = ends and z >= n - CALM_WITHIN - 1 and len(beside) and beside.max() >= CALM_LATE * off[a : z + 1].max()
        if z - a + 1 > LONGEST_SPIKE or (ends and z == n - 1) or late:
            odd[a : z + 1] = False
    return odd


def stuck_mask(f: np.ndarray) -> np.ndarray:
    """Which readings of ``f`` belong to a run of one value far longer than the signal otherwise has."""
    n = len(f)
    out = np.zeros(n, bool)
    if n < STUCK_LEAST:
        return out
    first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
    length = np.diff(np.r_[first, n])
    order = np.argsort(-length)
    long = [i for i in order if length[i] >= STUCK_LEAST]
    if not long:
        return out
    lengths = length[order]
    for i in long:
        usual = lengths[lengths < length[i] / STUCK_TIMES]
        between = lengths[(lengths >= length[i] / STUCK_TIMES) & (lengths <= length[i])]
        # other runs of about this length: either stuck as well (few, far above the rest) or how the signal is
        rest = n - lengths[lengths >= length[i] / STUCK_TIMES].sum()
        if not len(usual) or rest < 2 * STUCK_LEAST or len(usual) / rest < RESTLESS or len(between) > 1 + len(usual) // 50:
            continue
        if any(STUCK_TIMES * usual[0] > x for x in between if x < length[i]) and usual[0] * STUCK_TIMES * 2 > length[i]:
            continue
        out[first[i] : first[i] + length[i]] = True
    return out


def _judge(at: np.ndarray, size: np.ndarray, v: np.ndarray, block: int, low: float, high: float) -> list[np.ndarray]:
    """One block of one signal, its own chunks and the halo around them: chunk and place of the readings that are out of
    range, spikes or stuck, and the three flags."""
    chunk = np.repeat(at, size)
    place = np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size)
    core = chunk // BLOCK == block
    read = ~np.isnan(v)
    outside = read & ((v < low) | (v > high) | np.isinf(v))
    good = np.flatnonzero(read & ~outside)
    spike, stuck = np.zeros(len(v), bool), np.zeros(len(v), bool)
    if len(good) and core.any():
        stuck[good] = stuck_mask(v[good])
        moving = good[~stuck[good]]  # a stuck stretch says nothing of what the signal does around it
        spike[moving] = spike_mask(v[moving], ends=bool(at[-1] // BLOCK == block) and moving[-1:].tolist() == good[-1:].tolist())
    hit = core & (outside | spike | stuck)
    return [chunk[hit], place[hit], outside[hit], spike[hit], stuck[hit]]


def _judge_task(group: pa.Table) -> pa.Table:
    """All blocks of a group in turn. Chunks sent twice count once."""
    signal = group.column("signal").combine_chunks().dictionary_encode()
    code, block, at = signal.indices.to_numpy(), group.column("block").to_numpy(), group.column("chunk_idx").to_numpy()
    order = np.lexsort((at, block, code))
    code, block, at = code[order], block[order], at[order]
    keep = np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1]) | (at[1:] != at[:-1])] if len(order) else np.zeros(0, bool)
    order, code, block, at = order[keep], code[keep], block[keep], at[keep]
    lists = group.column("values").combine_chunks().take(pa.array(order))
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    v = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    bounds = [group.column(c).to_numpy()[order] for c in ("low", "high")]
    low, high = (np.where(np.isnan(b), fill, b) for b, fill in zip(bounds, (-np.inf, np.inf)))
    upto = np.r_[0, np.cumsum(size)]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])]) if len(code) else []
    found, whose = [[] for _ in range(5)], []
    for a, z in zip(first, [*first[1:], len(code)]):
        part = _judge(at[a:z], size[a:z], v[upto[a] : upto[z]], int(block[a]), low[a], high[a])
        whose.append(np.full(len(part[0]), code[a]))
        for x, y in zip(found, part):
            x.append(y)
    chunk, place, outside, spike, stuck = (np.concatenate(x) if x else np.zeros(0) for x in found)
    who = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(whose) if whose else np.zeros(0), pa.int32()), signal.dictionary).cast(pa.string())
    return pa.table({"signal": who, "chunk_idx": pa.array(chunk, pa.int32()), "value_idx": pa.array(place, pa.int32()), "out_of_range": pa.array(outside, pa.bool_()), "spike": pa.array(spike, pa.bool_()), "stuck": pa.array(stuck, pa.bool_())})


TASK_CHUNKS = 2048  #: chunks of a group, about; a block is never torn


def implausible(shard: DataFrame, specs: DataFrame) -> DataFrame:
    """``signal, chunk_idx, value_idx, out_of_range, spike, stuck``: the readings that have at least one of the three.

    Null and NaN are no readings; infinite values are out of range. Chunks sent twice count once; a chunk without
    signal, index or values has no readings; a spec that isn't in ``specs`` has no range. Empty tables give no rows.
    """
    s = shard.select("spec_type", "signal", "chunk_idx", "values").where(F.col("signal").isNotNull() & F.col("chunk_idx").isNotNull() & (F.size("values") > 0))
    groups = max(1, -(-shard.count() // TASK_CHUNKS))  # from the files' footers
    k = specs.select("spec_type", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")).dropDuplicates(["spec_type"])
    own = F.floor(F.col("chunk_idx") / BLOCK)
    within = F.col("chunk_idx") - own * BLOCK
    blocks = F.array_compact(F.array(own, F.when(within < HALO, own - 1), F.when(within >= BLOCK - HALO, own + 1)))
    s = s.withColumn("block", F.explode(F.filter(blocks, lambda b: b >= 0)))
    s = s.join(F.broadcast(k), "spec_type", "left")  # the fixed table of specs, a row per spec_type
    out = "signal string, chunk_idx int, value_idx int, out_of_range boolean, spike boolean, stuck boolean"
    nan = F.lit(float("nan"))
    s = s.select("signal", "block", "chunk_idx", "values", F.coalesce("low", nan).alias("low"), F.coalesce("high", nan).alias("high"))
    return s.groupBy(F.pmod(F.xxhash64("signal", "block"), F.lit(groups)).alias("_group")).applyInArrow(_judge_task, out)
