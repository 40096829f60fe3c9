"""Near-duplicates among embeddings by sorted projection passes.

A pass orders vectors lexicographically by concatenated random hashes: the nearest of
random centers, then (in large tables) the nearest of further centers within that cell,
then random sign bits around the center.  Centers are drawn from a sample of the
vectors, so cells follow the data: a crowded topic has as many more, smaller cells as
it has more vectors, and a direction that all vectors share plays no part.  Within a
cell each vector is compared with its neighbours in a bounded window; passes differ
in their centers and planes, and links are united over all of them.

The number of passes is measured: pairs at the threshold are set up around vectors of
the sample, and where they are missed most (the worst tenth) all passes miss them with
a probability of about ``miss`` (pairs more alike far more rarely).  An exact check
follows: what the passes missed is found by a bound on the cosine from the leading
directions of the sample, in tiles of bounded size.  Where that many passes cost more
than comparing all pairs in tiles, all pairs are compared at once.  So the links are
those of brute force at any size; the check is quadratic in the number of balls.

Passes carry a sketch of each vector, a byte a dimension, with the angle it is off by.
So a vector is a small ball on the sphere.  Two balls whose farthest points must link
are linked; two whose nearest points can't link are not; what lies between is decided
in double precision on the vectors themselves, which are read for that alone.

Bounded windows alone would lose links in crowds, so crowds become balls first.
Equal vectors are one class.  A few rounds of sorted passes then gather classes
around a centroid as long as all lie within half the threshold's angle of it: any two
members of such a ball link, without comparing them.  Two more rounds gather what is
still crowded into loose balls, whose members may link.  Loose balls with themselves,
and balls that may link, are compared member by member, in blocks of ``CHUNK`` by
``CHUNK`` that give counts and a spanning forest only.  So no group's pairs are written
out, and none of a crowd's links is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import below, connected_components, cut, roots

THRESHOLD = 0.9
MISS = 0.01
#: neighbours compared at once
WINDOW = 256
#: windows of a cell aimed at, and windows within a cell that a vector is compared with
CELL, REACH = 4, 8
#: centers that a vector is compared with at once
CENTERS = 1024
ROUNDS = 3
LOOSE_ROUNDS = 2
#: neighbours that make a crowd, as a part of a window
CROWD = 1 / 8
#: of the threshold's angle
LOOSE = 0.8
CHUNK = 256
#: vectors of a tile where all pairs are compared
TILE = 8192
#: least tiles, and numbers of a tile at most, where the rest of the pairs is checked; rows and columns of a block; pairs of the sample that pass the bound
TILES, TILE_NUMBERS, BLOCK, PASSED = 12, 1 << 22, (512, 4096), 1e-3
#: more than single precision takes from the bound
_ROUNDING = 1e-4
#: vectors and bytes of the sample at most
SAMPLE, SAMPLE_BYTES = 32768, 1 << 23
PROBES, PARTNERS, TRIALS = 256, 8, 16
_BITS = 16
_EPS = 2e-3
#: sketches of single vectors are off by less than this
_SMALL = 0.05
ITEM = "item long, q binary, rho float, size long"
READ = "fine boolean, digest binary, q binary, rho float"


def passes_needed(n: int, threshold: float, window: int, miss: float) -> int:
    """The least number: passes by sign bits that each halve the data, which leave ``window`` of n vectors with chance q for a pair."""
    keep = 1 - math.acos(threshold) / math.pi
    q = keep ** max(0.0, math.log2(max(1, n) / window))
    return max(6, math.ceil(math.log(miss) / math.log(max(1e-12, 1 - q)))) if q < 1 else 6


def unit(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32)
    return x / np.linalg.norm(x, axis=1)[:, None]


def exact_unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by the largest number first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, also of very small angles; 1e-5 is beyond the error of single precision."""
    chord = np.linalg.norm(x.astype(np.float64) - y, axis=-1)
    return 2 * np.arcsin(np.minimum(1, chord / 2)) + 1e-5


def sketch(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte a dimension for rows of length 1, and the angles they are off by, rounded up."""
    q = np.rint(x * (127 / np.abs(x).max(axis=1))[:, None]).astype(np.int8)
    return q, np.nextafter(angles(x, unit(q)).astype(np.float32), np.float32(9))


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    data = np.ascontiguousarray(rows)
    width = data.dtype.itemsize * (data.shape[1] if data.ndim == 2 else 1)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def _by_dim(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of a list column, by length."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    for dim in np.unique(sizes):
        rows = np.nonzero(sizes == dim)[0]
        yield rows, values[starts[rows][:, None] + np.arange(dim)]


def _read(rows: DataFrame, *, exact: bool) -> DataFrame:
    """``(id, fine, digest, q, rho)`` for each of ``rows(id, v)``, or ``(digest, vector)`` of those that are fine if ``exact``.

    A vector is known by a 128-bit digest of its numbers; null where it can't link."""
    name = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            if not n:
                continue
            digests, sketches, rho, raw = [None] * n, [None] * n, np.zeros(n, np.float32), [None] * n
            for at, x in _by_dim(batch.column(1)):
                good = known[at] & np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                at, x = at[good], x[good] + 0.0  # one zero
                if not len(at):
                    continue
                if not exact:
                    q, rho[at] = sketch(exact_unit(x))
                for k, i in enumerate(at):
                    data = x[k].tobytes()
                    digests[i] = hashlib.blake2b(data, digest_size=16).digest()
                    if exact:
                        raw[i] = data
                    else:
                        sketches[i] = q[k].tobytes()
            fine = np.array([d is not None for d in digests])
            if exact:
                yield pa.RecordBatch.from_arrays([pa.array([d for d in digests if d], pa.binary()), pa.array([d for d in raw if d], pa.binary())], names=["digest", "vector"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(rho)], names=["id", "fine", "digest", "q", "rho"])

    return rows.mapInArrow(run, "digest binary, vector binary" if exact else f"id {name}, {READ}")


class Sample(NamedTuple):
    """Sketches of a sample of all items, by dimension; ``share`` items stand behind each, ``cell`` are to be in a cell."""

    token: str
    rows: dict[int, np.ndarray]
    share: float
    cell: int


def sample_of(items: DataFrame) -> tuple[Sample, int]:
    """A sample of bounded size, by hashes of the ids, and the number of items."""
    n, widest = items.agg(F.count("*"), F.max(F.length("q"))).first()
    if not n:
        return Sample("", {}, 1.0, CELL * WINDOW), 0
    limit = max(1, min(SAMPLE, SAMPLE_BYTES // widest))
    chosen = below(items.select("item", "q", F.xxhash64("item", F.lit(3)).alias("h")), limit, n).orderBy("h", "item").limit(limit).select("q").toArrow()
    by_dim: dict[int, list[bytes]] = {}
    for q in chosen.column("q").to_pylist():
        by_dim.setdefault(len(q), []).append(q)
    rows = {dim: np.frombuffer(b"".join(x), np.int8).reshape(-1, dim) for dim, x in by_dim.items()}
    token = hashlib.sha256(b"".join(x.tobytes() for _, x in sorted(rows.items()))).hexdigest()
    return Sample(token, rows, n / chosen.num_rows, CELL * WINDOW), n


class Cells:
    """The hashes of a pass: cells around centers, and sign bits within a cell."""

    def __init__(self, sample: np.ndarray, share: float, cell: int, number: int):
        m, dim = sample.shape
        rng = np.random.default_rng([20_240_607, number, dim])
        self.x, order = unit(sample), rng.permutation(m)
        self.planes = rng.standard_normal((dim, _BITS)).astype(np.float32)
        count = min(m, max(1, math.ceil(m * share / cell)))
        first = count if count <= CENTERS else math.ceil(math.sqrt(count))
        self.first, self.second = order[:first], None
        if first < count:
            near, place = self._nearest(self.x, self.first), np.empty(m, np.int64)
            place[order] = np.arange(m)
            self.second = {}
            for k in range(first):
                own = np.nonzero(near == k)[0]
                # a center is known by its place in the sample, so that a tie settled otherwise elsewhere moves one cell only
                self.second[k] = own[np.argsort(place[own])][: math.ceil(count / first)]

    def _nearest(self, x: np.ndarray, centers: np.ndarray) -> np.ndarray:
        c = self.x[centers].T
        return np.concatenate([np.argmax(x[k : k + 4096] @ c, axis=1) for k in range(0, len(x), 4096)] or [np.empty(0, np.int64)])

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, bits) of each row."""
        near = self._nearest(x, self.first)
        cell = self.first[near]
        if self.second is not None:
            for k in np.unique(near):
                if len(self.second[k]):
                    rows = np.nonzero(near == k)[0]
                    cell[rows] = self.second[k][self._nearest(x[rows], self.second[k])]
        bits = ((x - self.x[cell]) @ self.planes > 0) @ (1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64))
        return cell, bits


class _Held:
    """A sample that is told from others by its token, so that a worker makes the cells of a pass once."""

    def __init__(self, sample: Sample):
        self.sample = sample

    def __hash__(self) -> int:
        return hash(self.sample.token)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Held) and (self.sample.token, self.sample.share, self.sample.cell) == (other.sample.token, other.sample.share, other.sample.cell)


@lru_cache(maxsize=16)
def _cells_of(held: _Held, number: int, dim: int) -> Cells:
    return Cells(held.sample.rows[dim], held.sample.share, held.sample.cell, number)


def passes_measured(sample: Sample, threshold: float, miss: float, most: int) -> int:
    """Passes, up to ``most``, for pairs at the threshold around the tenth of the sample where they are missed most."""
    passes = 1
    for dim, q in sample.rows.items():
        if len(q) * sample.share <= sample.cell or dim < 2:
            continue
        rng = np.random.default_rng([7, dim])
        probes = unit(q[rng.permutation(len(q))[:PROBES]])
        away = rng.standard_normal((len(probes), PARTNERS, dim)).astype(np.float32)
        away -= (away @ probes[:, :, None]) * probes[:, None, :]
        away /= np.linalg.norm(away, axis=2, keepdims=True)
        partners = (threshold * probes[:, None, :] + math.sqrt(1 - threshold**2) * away).reshape(-1, dim)
        hits, x, window = np.zeros(len(probes)), unit(q), REACH * sample.cell / CELL
        for number in range(TRIALS):
            cells = Cells(q, sample.share, sample.cell, number)
            filled = np.bincount(cells.keys(x)[0], minlength=len(q)) * sample.share
            mine, bits = cells.keys(probes)
            theirs, other = (k.reshape(len(probes), PARTNERS) for k in cells.keys(partners))
            common = _BITS - np.frexp((bits[:, None] ^ other).astype(float))[1]
            need = np.ceil(np.log2(np.maximum(1, filled[mine] / window)))  # bits that leave a window of a full cell
            hits += ((theirs == mine[:, None]) & (common >= need[:, None])).sum(axis=1)
        missed = 1 - (hits + 0.5) / (TRIALS * PARTNERS + 1)
        worst = np.sort(missed)[-max(1, len(missed) // 10) :]
        while passes < most and np.mean(worst**passes) > miss:
            passes += 1
    return passes


def _keyed(items: DataFrame, numbers: list[int], sample: Sample) -> DataFrame:
    """Each item once per pass; a cell is in one partition, in the order of its bits."""
    held = _Held(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, data = _bytes_of(batch.column("q"))
            sizes = np.diff(at)
            for dim in np.unique(sizes):
                rows = np.nonzero(sizes == dim)[0]
                some = batch.take(pa.array(rows))
                x = unit(data[at[rows][:, None] + np.arange(dim)].view(np.int8))
                for number in numbers:
                    if int(dim) in held.sample.rows:
                        cell, bits = _cells_of(held, number, int(dim)).keys(x)
                    else:  # a dimension so rare that the sample has none of it
                        cell = bits = np.zeros(len(rows), np.int64)
                    tag = pa.array(np.full(len(rows), (number << 32) + int(dim)))
                    yield pa.RecordBatch.from_arrays([*some.columns, tag, pa.array(cell.astype(np.int32)), pa.array(bits.astype(np.int32))], names=[*some.schema.names, "tag", "cell", "bits"])

    keyed = items.select("item", "q", "rho", "size").mapInArrow(run, ITEM + ", tag long, cell int, bits int")
    return keyed.repartition("tag", "cell").sortWithinPartitions("tag", "cell", "bits", "item")


def _runs(batches: Iterator[pa.RecordBatch], most: int, again: int) -> Iterator[tuple]:
    """The rows of a cell: (rows given before, ids, vectors, rho, sizes), up to ``most`` at once, the last ``again`` of them given again."""
    now, parts, count, old = None, [], 0, 0

    def merged():
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))

    for batch in batches:
        if not batch.num_rows:
            continue
        tag, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tag", "cell"))
        ids, rho, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("item", "rho", "size"))
        at, data = _bytes_of(batch.column("q"))
        starts = np.concatenate([[0], np.nonzero((tag[1:] != tag[:-1]) | (cell[1:] != cell[:-1]))[0] + 1, [len(tag)]])
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if now != (tag[s], cell[s]):
                if count > old:
                    yield (old, *merged())
                now, parts, count, old = (tag[s], cell[s]), [], 0, 0
            dim = int(tag[s]) & 0xFFFFFFFF
            while s < e:
                k = min(e, s + most - count)
                parts.append((ids[s:k], unit(data[at[s] : at[k]].view(np.int8).reshape(k - s, dim)), rho[s:k].astype(np.float64), sizes[s:k]))
                count, s = count + k - s, k
                if count == most:
                    whole = merged()
                    yield (old, *whole)
                    parts = [tuple(c[most - again :] for c in whole)] if again else []
                    count = old = again
    if count > old:
        yield (old, *merged())


def _gather(items: DataFrame, number: int, sample: Sample, angle: float, limit: float, floor: float = 0.0) -> DataFrame:
    """One round: ``(child, item, q, rho, size)``, the children of each ball that was made.

    A ball has ``CROWD`` of a window's children or more, started from one with the others within
    ``angle``, and reaches ``limit`` from its center at most; its ``rho`` is ``floor`` at least."""

    block, least = 4 * WINDOW, int(CROWD * WINDOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, x, rho, sizes in _runs(batches, block, 0):
            if len(ids) < least:
                continue
            out: list[tuple] = []
            free = np.ones(len(ids), bool)
            near = (x @ x.T) >= math.cos(angle)
            crowd = near.sum(axis=1)
            for i in np.argsort(-crowd, kind="stable"):
                if crowd[i] < least:
                    break
                if not free[i]:
                    continue
                j = np.nonzero(near[i] & free)[0]
                while len(j) >= least:  # all within the ball, or the farthest go
                    mean = sizes[j].astype(np.float64) @ x[j]
                    q, _ = sketch((mean / np.linalg.norm(mean))[None, :])
                    reach = angles(x[j], unit(q)) + rho[j]
                    if reach.max() <= limit:
                        free[j] = False
                        out += [(int(ids[k]), int(ids[j].min()), q.tobytes(), max(floor, float(reach.max()) + 1e-6), int(sizes[j].sum())) for k in j]
                        break
                    j = j[reach <= limit]
            if out:
                c = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.float32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds, strict=True)], names=["child", "item", "q", "rho", "size"])

    return _keyed(items, [number], sample).mapInArrow(run, "child long, " + ITEM)


def _compared(ids, x, rho, other, y, sigma, threshold: float, before: np.ndarray | None = None) -> pa.RecordBatch | None:
    """``(a, b, certain)`` for the balls of one side and of the other; ``before[i]`` columns are open to row i."""
    theta = math.acos(threshold)
    dot = x @ y.T
    most = rho.max() + sigma.max()
    if most <= 2 * _SMALL:
        i, j = np.nonzero(dot >= math.cos(theta + most + _EPS))
    else:
        i, j = np.nonzero(dot >= np.cos(np.minimum(math.pi, theta + rho[:, None] + sigma[None, :] + _EPS)))
    use = (ids[i] != other[j]) if before is None else (j < before[i])
    i, j = i[use], j[use]
    return _told(ids, rho, other, sigma, i, j, dot[i, j], theta)


def _told(ids, rho, other, sigma, i: np.ndarray, j: np.ndarray, dot: np.ndarray, theta: float) -> pa.RecordBatch | None:
    """``(a, b, certain)`` of the balls i and j with the cosines ``dot``."""
    tight = theta / 2
    spread, angle = rho[i] + sigma[j], np.arccos(np.clip(dot, -1, 1))
    certain = (angle + spread <= theta - _EPS) & (rho[i] <= tight) & (sigma[j] <= tight)
    keep = angle <= theta + spread + _EPS
    a, b = np.minimum(ids[i], other[j])[keep], np.maximum(ids[i], other[j])[keep]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(certain[keep])], names=["a", "b", "certain"]) if len(a) else None


def _candidates(items: DataFrame, numbers: list[int], sample: Sample, threshold: float) -> DataFrame:
    """``(a, b, certain)`` with a < b: balls that link whole, and balls that may."""

    strip, window = WINDOW, REACH * WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for old, ids, x, rho, _ in _runs(batches, 4 * window, window):
            for k in range(old, len(ids), strip):
                low, high = max(0, k - window), min(len(ids), k + strip)
                if high - low > 1 and (out := _compared(ids[k:high], x[k:high], rho[k:high], ids[low:high], x[low:high], rho[low:high], threshold, np.arange(k, high) - low)):
                    yield out

    return _keyed(items, numbers, sample).mapInArrow(run, "a long, b long, certain boolean").distinct()


def _tiled(items: DataFrame, tiles: int, compare: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
    """What ``compare(dim, left, right)`` gives for each pair of tiles; a side is (ids, vectors, rho), one and the same for a tile with itself."""
    mine = F.pmod(F.xxhash64("item", F.lit(3)), F.lit(tiles)).cast("long")
    placed = items.select(F.length("q").cast("long").alias("dim"), "item", "q", "rho", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("other"))
    dealt = placed.select("dim", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "item", "rho", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def compared():
            tile, ids, x, rho = (np.concatenate([h[k] for h in held]) for k in range(4))
            held.clear()
            sides = [(ids[at], unit(x[at]), rho[at]) for at in (tile == k for k in dict.fromkeys(now[1:]))]
            if all(len(side[0]) for side in sides):
                yield from compare(int(now[0]), sides[0], sides[-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            dim, lo, hi, tile, ids, rho = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "lo", "hi", "mine", "item", "rho"))
            at, data = _bytes_of(batch.column("q"))
            starts = np.concatenate([[0], np.nonzero((dim[1:] != dim[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))[0] + 1, [len(dim)]])
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if now != (dim[s], lo[s], hi[s]):
                    if held:
                        yield from compared()
                    now = (dim[s], lo[s], hi[s])
                held.append((tile[s:e], ids[s:e], data[at[s] : at[e]].view(np.int8).reshape(e - s, int(dim[s])), rho[s:e].astype(np.float64)))
        if held:
            yield from compared()

    sides = dealt.repartition("dim", "lo", "hi").sortWithinPartitions("dim", "lo", "hi")
    return sides.mapInArrow(run, "a long, b long, certain boolean").distinct()


def _all_candidates(items: DataFrame, n: int, threshold: float) -> DataFrame:
    """As _candidates(), from all pairs: tiles of about TILE items, each compared with itself and each other one."""
    strip = WINDOW

    def compare(dim: int, left: tuple, right: tuple) -> Iterator[pa.RecordBatch]:
        ids, x, rho = left
        for k in range(0, len(ids), strip):  # of bounded size
            if out := _compared(ids[k : k + strip], x[k : k + strip], rho[k : k + strip], *right, threshold):
                yield out

    return _tiled(items, max(1, math.ceil(n / TILE)), compare)


def leading(q: np.ndarray, threshold: float) -> np.ndarray:
    """Orthonormal leading directions of a sample, as many as leave few of its pairs that may reach the threshold.

    By them a cosine is bounded: x.y <= x'.y' + |x''||y''|, where x' is the part of x along them and x'' what is left."""
    x = unit(q).astype(np.float64)
    values, basis = np.linalg.eigh(x.T @ x)
    along = x[:1024] @ basis[:, ::-1]
    least, dim = math.cos(math.acos(threshold) + 2 * _SMALL + _EPS), x.shape[1]
    for k in range(8, dim, 8):
        rest = np.sqrt(np.maximum(0, 1 - (along[:, :k] ** 2).sum(axis=1)))
        passed = along[:, :k] @ along[:, :k].T + rest[:, None] * rest[None, :] >= least
        if passed.sum() - len(along) <= PASSED * len(along) ** 2:
            break
    else:
        k = dim
    return np.ascontiguousarray(basis[:, ::-1][:, :k]).astype(np.float32)


def _rest(items: DataFrame, n: int, sample: Sample, threshold: float) -> DataFrame:
    """As _candidates(), every pair that may link: the exact check, in tiles and blocks of bounded size.

    Blocks hold balls of about one reach; a block's pairs are told by the bound of leading(), and only those that it leaves are compared in all dimensions."""
    theta, (tall, wide) = math.acos(threshold), BLOCK
    directions = items.sparkSession.sparkContext.broadcast({dim: leading(q, threshold) for dim, q in sample.rows.items() if dim > 8})

    def bounded(x: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
        if basis is None or basis.shape[1] == x.shape[1]:
            return x
        along = x @ basis
        return np.column_stack([along, np.sqrt(np.maximum(0, 1 - np.square(along, dtype=np.float64).sum(axis=1)) + _ROUNDING / 10).astype(np.float32)])

    def compare(dim: int, left: tuple, right: tuple) -> Iterator[pa.RecordBatch]:
        basis, few = directions.value.get(dim), max(1, TILE_NUMBERS // dim)
        sides = []
        for ids, x, rho in (left, right):
            by = np.argsort(rho, kind="stable")
            sides.append((ids[by], x[by], rho[by], bounded(x[by], basis)))
        (ids, x, rho, f), (other, y, sigma, g) = sides
        for s in range(0, len(ids), tall):
            for t in range(s // wide * wide if left is right else 0, len(other), wide):
                mine, theirs = slice(s, s + tall), slice(t, t + wide)
                least = math.cos(min(math.pi, theta + rho[mine].max() + sigma[theirs].max() + _EPS)) - _ROUNDING
                i, j = np.nonzero(f[mine] @ g[theirs].T >= least)
                i, j = i + s, j + t
                if left is right:
                    once = i < j
                    i, j = i[once], j[once]
                for k in range(0, len(i), few):
                    a, b = i[k : k + few], j[k : k + few]
                    if out := _told(ids, rho, other, sigma, a, b, np.einsum("ij,ij->i", x[a], y[b]), theta):
                        yield out

    widest = max(sample.rows, default=1)
    tile = max(TILE, min(TILE_NUMBERS // widest, math.ceil(n / TILES)))
    return _tiled(items, max(1, math.ceil(n / tile)), compare)


def _matrix(values: list[bytes], kind: str) -> np.ndarray:
    return exact_unit(np.frombuffer(b"".join(values), kind).reshape(len(values), -1))


def _linked(pairs: DataFrame, vectors: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Of ``pairs(a, b)`` of classes those that link, in double precision; ``vectors(class, vector)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            keep = np.zeros(len(x), bool)
            sizes = np.array([len(v) for v in x])
            for size in np.unique(sizes):
                rows = np.nonzero(sizes == size)[0]
                keep[rows] = (_matrix([x[i] for i in rows], kind) * _matrix([y[i] for i in rows], kind)).sum(axis=1) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    with_a = pairs.join(vectors.select(F.col("class").alias("a"), F.col("vector").alias("x")), "a")
    both = with_a.join(vectors.select(F.col("class").alias("b"), F.col("vector").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _verified(uncertain: DataFrame, members: DataFrame, sizes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """``(class, root, links)``: by block, for each class with links in it their number and a class it is connected to.

    ``uncertain(a, b)``: balls to compare, also one with itself; ``members(item, tight,
    class, vector, copies)``; classes of one tight ball are not compared.  A block is a
    chunk of a by a chunk of b."""
    chunks = sizes.select("item", F.ceil(F.col("classes") / CHUNK).cast("long").alias("t"))
    with_a = uncertain.join(chunks.select(F.col("item").alias("a"), F.col("t").alias("ta")), "a")
    tasks = with_a.join(chunks.select(F.col("item").alias("b"), F.col("t").alias("tb")), "b")
    zero = F.lit(0).cast("long")
    tasks = tasks.withColumn("ca", F.explode(F.sequence(zero, F.col("ta") - 1))).withColumn("cb", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("ca")).otherwise(zero), F.col("tb") - 1)))
    placed = members.join(chunks, "item").select("item", F.pmod(F.xxhash64("class"), F.col("t")).alias("chunk"), "class", "tight", "vector", "copies")
    side = lambda ball, chunk, left: tasks.join(placed, (F.col(ball) == F.col("item")) & (F.col(chunk) == F.col("chunk"))).select("a", "b", "ca", "cb", F.lit(left).alias("left"), "class", "tight", "vector", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def compare():
            x, y = ([h for h in held if h[0] is left] for left in (True, False))
            if not x or not y:
                return None
            linked = (_matrix([h[3] for h in x], kind) @ _matrix([h[3] for h in y], kind).T) >= threshold
            linked &= np.array([h[2] for h in x])[:, None] != np.array([h[2] for h in y])[None, :]
            same = now[0] == now[1] and now[2] == now[3]  # a chunk with itself: each pair is there twice
            ids = np.array([h[1] for h in x] + [h[1] for h in y])
            order, at = np.unique(ids, return_inverse=True)
            i, j = np.nonzero(linked)
            root = order[roots(len(order), at[: len(x)][i], at[len(x) :][j])]
            counts = np.concatenate([linked @ np.array([h[4] for h in y]), np.zeros(len(y), np.int64) if same else np.array([h[4] for h in x]) @ linked])
            rows = np.nonzero(counts)[0]
            if not len(rows):
                return None
            return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(root[at[rows]]), pa.array(counts[rows])], names=["class", "root", "links"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "ca", "cb", "left", "class", "tight", "vector", "copies")]
            for a, b, ca, cb, left, k, tight, vector, copies in zip(*columns, strict=True):
                if now != (a, b, ca, cb):
                    if held and (out := compare()):
                        yield out
                    now, held = (a, b, ca, cb), []
                held.append((left, k, tight, vector, copies))
        if held and (out := compare()):
            yield out

    rows = side("a", "ca", True).unionByName(side("b", "cb", False))
    dealt = rows.repartition("a", "b", "ca", "cb").sortWithinPartitions("a", "b", "ca", "cb")
    return dealt.mapInArrow(run, "class long, root long, links long")


def embedding_components(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    threshold: float = THRESHOLD,
    miss: float = MISS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``(<id_col>, n_links, component_id, kept)``, one row per row of ``vectors``.

    Vectors link at a cosine of at least ``threshold`` (above 0, for the same number of
    dimensions).  ``n_links`` counts the other rows linked directly, equal vectors
    among them; ``component_id`` is the smallest id reachable, itself included.  Vectors
    that are null, empty, zero or hold null or non-finite numbers, and rows without an
    id, link with nothing; a row without an id has no component and is not kept.
    Repeated ids each get a row; other columns are not read; an empty table gives an
    empty result."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold lies between 0 and 1")
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    read = _read(rows, exact=False)
    classes = cut(read.where("fine").groupBy("digest").agg(F.first("q").alias("q"), F.first("rho").alias("rho"), F.min("id").alias("low"), F.count("*").alias("copies")).withColumn("class", F.monotonically_increasing_id()))

    theta = math.acos(threshold)
    items = classes.select(F.col("class").alias("item"), "q", "rho", F.col("copies").alias("size"))
    place = classes.select("class", F.col("class").alias("tight"), F.col("class").alias("item"))
    sample, n = sample_of(items)
    crowded = {False: rounds, True: LOOSE_ROUNDS}
    for loose, times in crowded.items():
        for k in range(times):
            # by its rho a loose ball is never taken for a tight one, whose members link unseen
            made = cut(_gather(items, 1000 + 100 * loose + k, sample, *((theta, LOOSE * theta, theta / 2 + 1e-6) if loose else (theta / 2, theta / 2 - _EPS))))
            if made.isEmpty():
                break
            balls = made.select("item", "q", "rho", "size").dropDuplicates(["item"])
            left = items.join(made.select(F.col("child").alias("item")), "item", "left_anti")
            items = cut(left.unionByName(balls))
            up = made.select(F.col("child").alias("item"), F.col("item").alias("up"))
            place = place.join(up, "item", "left").withColumn("item", F.coalesce("up", "item")).drop("up")
            place = cut(place if loose else place.withColumn("tight", F.col("item")))
            sample, n = sample_of(items)

    most = math.ceil(n / (1.5 * CELL * WINDOW))  # about as many passes compare as many pairs as there are
    passes = max(passes_needed(n, threshold, REACH * WINDOW, miss), passes_measured(sample, threshold, miss, most))
    if passes >= most:
        pairs = cut(_all_candidates(items, n, threshold))
    else:
        found = cut(_candidates(items, list(range(passes)), sample, threshold))
        pairs = cut(found.unionByName(_rest(items, n, sample, threshold)).groupBy("a", "b").agg(F.max("certain").alias("certain")))
    members = cut(place.join(classes, "class").select("item", "class", "tight", "digest", "copies", "low"))
    loose_balls = items.where(F.col("rho") > theta / 2).select(F.col("item").alias("a"), F.col("item").alias("b"))
    sure = pairs.where("certain").select("a", "b")
    maybe = cut(pairs.where("NOT certain").select("a", "b").join(sure, ["a", "b"], "left_anti").unionByName(loose_balls))
    # vectors are read for what is not certain only
    asked = maybe.select(F.explode(F.array("a", "b")).alias("item")).distinct()
    wanted = members.join(asked, "item", "left_semi").select("class", "digest", "item", "tight", "copies")
    held = cut(_read(rows, exact=True).join(wanted, "digest").groupBy("class").agg(F.first("vector").alias("vector"), *[F.first(c).alias(c) for c in ("item", "tight", "copies")]))
    counted = cut(wanted.groupBy("item").agg(F.count("*").alias("classes")))
    crowd = counted.where("classes > 1").select("item")
    some = maybe.join(crowd.select(F.col("item").alias("a"), F.lit(True).alias("in_a")), "a", "left").join(crowd.select(F.col("item").alias("b"), F.lit(True).alias("in_b")), "b", "left")
    alone = some.where("in_a IS NULL AND in_b IS NULL").select("a", "b")
    blocks = some.where("in_a OR in_b").select("a", "b")
    # of single classes the item is the class
    whole = cut(sure.unionByName(_linked(alone, held.select("class", "vector"), kind, threshold)))
    checked = cut(_verified(blocks, held, counted, kind, threshold))

    # the nodes are tight balls; a ball that links whole is one
    ball = cut(members.groupBy("tight").agg(F.sum("copies").alias("rows"), F.min("low").alias("low")))
    node = members.select("class", "tight")
    met = checked.select("class", "root").where("class <> root").distinct()
    met = met.join(node, "class").select("root", F.col("tight").alias("a")).join(node.withColumnRenamed("class", "root"), "root").select("a", F.col("tight").alias("b"))
    found = connected_components(whole.unionAll(met))
    rooted = ball.join(found, ball["tight"] == found["node"], "left").select("tight", "rows", "low", F.coalesce("component", "tight").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component"))
    both = whole.unionAll(whole.select("b", "a"))
    around = both.join(ball.select(F.col("tight").alias("b"), "rows"), "b").groupBy("a").agg(F.sum("rows").alias("around")).withColumnRenamed("a", "tight")
    told = rooted.join(lows, "root").join(around, "tight", "left").select("tight", (F.col("rows") - 1 + F.coalesce("around", F.lit(0))).alias("n"), "component")
    beside = checked.groupBy("class").agg(F.sum("links").alias("beside"))
    per_class = members.select("class", "tight", "digest").join(told, "tight").join(beside, "class", "left").select("digest", (F.col("n") + F.coalesce("beside", F.lit(0))).alias("n_links"), "component")
    out = read.select("id", "digest").join(per_class, "digest", "left").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component"))
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
