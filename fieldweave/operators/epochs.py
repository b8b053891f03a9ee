"""The epoch loop of a field layout over blocks of points, with one shuffle of positions an epoch.

Points are dealt into blocks by a hash. A block holds the edges of its points; of each block it is sent only the
positions that its edges reach. An epoch is one cogrouped pass over blocks: due attraction, repulsion from the cells'
field, and the step. Cells' moments are summed block by block; they, and the field of at most PAIRED_BOXES ** 2 cells,
are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.operators.saving import saved

#: Points of a block at most, and points for which another task is worth its cost.
ROWS, WORTH = 1 << 16, 1 << 10
#: What a block holds: its points, its edges, and the places that another block needs.
POINTS, EDGES, NEEDED = range(3)
STATIC = "block int, kind int, other int, data binary"
SENT = "block int, sender int, data binary, low double, high double, bad boolean"
#: The sender of a block's own positions, all of them.
OWN = -1


@dataclass(frozen=True)
class Step:
    """What all points of an epoch share."""

    epoch: int
    alpha: float
    a: float
    b: float
    clip: float
    total_clip: float | None
    low: float
    width: float
    boxes: int
    field: np.ndarray  # phi, px, py of each cell


def _column(table: pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column(name)]


def _split(data: np.ndarray, *kinds: type) -> list[np.ndarray]:
    """Arrays of equal length that lie one after the other."""
    n, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(data[at : at + size].view(k) if at % 8 == 0 else data[at : at + size].copy().view(k))
        at += size
    return out


def _joined(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def _packed_edges(key: tuple, table: pa.Table) -> pa.Table:
    """A block's edges with places among the positions that it is sent, and what it needs of each block."""
    block = key[0].as_py()
    src, dst_block, dst, every = (table.column(c).to_numpy() for c in ("place", "other", "there", "interval"))
    needed, at = np.unique(dst_block.astype(np.int64) << 32 | dst, return_inverse=True)
    order = np.lexsort((at, src))  # sums in one order
    rows = [(block, EDGES, 0, _joined(every[order].astype(np.float64), src[order].astype(np.int32), at[order].astype(np.int32)))]
    of = needed >> 32
    rows += [(int(c), NEEDED, block, (needed[of == c] & 0xFFFFFFFF).astype(np.int32).tobytes()) for c in np.unique(of)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["block", "kind", "other", "data"])


def _packed_points(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("place")
    data = _joined(*(table.column(c).to_numpy().astype(t) for c, t in (("id", np.int64), ("x", np.float64), ("y", np.float64), ("scale", np.float64))))
    return pa.Table.from_pylist([{"block": key[0].as_py(), "kind": POINTS, "other": 0, "data": data}], pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("other", pa.int32()), ("data", pa.binary())]))


def _sent(block: int, x: np.ndarray, y: np.ndarray, needed: dict[int, np.ndarray]) -> pa.Table:
    """A block's own positions, and to each block those that it needs."""
    low, high = float(min(x.min(), y.min())), float(max(x.max(), y.max()))
    bad = not (np.isfinite(x).all() and np.isfinite(y).all())
    rows = [(block, OWN, _joined(x, y), low, high, bad)]
    rows += [(to, block, _joined(x[at], y[at]), None, None, None) for to, at in sorted(needed.items())]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.bool_())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["block", "sender", "data", "low", "high", "bad"])


def _held(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], dict[int, np.ndarray]]:
    """Of a block's rows: ids, x, y, scale; intervals, sources, places of ends; what others need."""
    kinds, others = (table.column(c).to_numpy() for c in ("kind", "other"))
    points, edges, needed = None, [np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)], {}
    for kind, other, data in zip(kinds.tolist(), others.tolist(), _column(table, "data")):
        if kind == POINTS:
            points = _split(data, np.int64, np.float64, np.float64, np.float64)
        elif kind == EDGES:
            edges = _split(data, np.float64, np.int32, np.int32)
        else:
            needed[other] = data.view(np.int32)
    return points, edges, needed


def _first(key: tuple, static: pa.Table) -> pa.Table:
    (_, x, y, _), _, needed = _held(static)
    return _sent(key[0].as_py(), x, y, needed)


def _cells(x: np.ndarray, y: np.ndarray, low: float, width: float, boxes: int) -> np.ndarray:
    """The number of each point's cell."""
    cx, cy = (np.minimum(np.floor((v - low) / width), boxes - 1).astype(np.int64) for v in (x, y))
    return cx * boxes + cy


def _moved(x: np.ndarray, y: np.ndarray, scale: np.ndarray, ends: tuple[np.ndarray, np.ndarray], edges: list[np.ndarray], s: Step) -> tuple[np.ndarray, np.ndarray]:
    every, src, at = edges
    due = (s.epoch >= every) & (np.floor(s.epoch / every) > np.floor((s.epoch - 1) / every))
    src, at = src[due], at[due]
    dx, dy = x[src] - ends[0][at], y[src] - ends[1][at]
    d2 = dx * dx + dy * dy
    far = np.where(d2 > 0, d2, 1.0)
    g = np.where(d2 > 0, -2 * s.a * s.b * far ** (s.b - 1) / (1 + s.a * far**s.b), 0.0)
    pull = [np.bincount(src, np.clip(g * d, -s.clip, s.clip), len(x)) for d in (dx, dy)]
    phi, px, py = s.field[:, _cells(x, y, s.low, s.width, s.boxes)]
    push = [phi * x - px, phi * y - py]
    norm = np.sqrt(push[0] * push[0] + push[1] * push[1])
    cut = np.where(norm > s.clip, s.clip / np.where(norm > 0, norm, 1.0), 1.0)
    move = [scale * (a + r * cut) for a, r in zip(pull, push)]
    rate = s.alpha * (np.minimum(1.0, s.total_clip / (np.sqrt(move[0] ** 2 + move[1] ** 2) + 1e-12)) if s.total_clip is not None else 1.0)
    return x + rate * move[0], y + rate * move[1]


def _epoch(s: Step) -> Callable:
    def work(key: tuple, static: pa.Table, sent: pa.Table) -> pa.Table:
        (_, _, _, scale), edges, needed = _held(static)
        came = dict(zip(sent.column("sender").to_pylist(), _column(sent, "data")))
        x, y = _split(came.pop(OWN), np.float64, np.float64)
        parts = [_split(came[c], np.float64, np.float64) for c in sorted(came)]
        ends = tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(2))
        return _sent(key[0].as_py(), *_moved(x, y, scale, ends, edges, s), needed)

    return work


def _moments(low: float, width: float, boxes: int) -> Callable:
    """Counts and sums of each of a block's cells."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column("data"):
                x, y = _split(np.frombuffer(data.as_buffer(), np.uint8), np.float64, np.float64)
                at = _cells(x, y, low, width, boxes)
                out.append(_joined(*(np.bincount(at, w, boxes * boxes).astype(np.float64) for w in (None, x, y))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], ["block", "data"])

    return work


def _field(moments: np.ndarray, low: float, width: float, boxes: int, gamma: float, a: float, b: float, clip: float, eps: float = 1e-3) -> np.ndarray:
    """phi, px and py of each cell from the moments of all: the kernel by cells' offsets, as ``field.mesh_repulsion`` has it."""
    side = np.arange(boxes) * width
    step = (side[:, None] - side[None]) ** 2
    d2 = (step[:, None, :, None] + step[None, :, None, :]).reshape(boxes * boxes, boxes * boxes)
    kernel = np.minimum(clip, 2 * gamma * b / ((eps + d2) * (1 + a * d2**b)))
    return moments @ kernel


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own, sent in zip(batch.column("points"), batch.column("data")):
            ids = _split(np.frombuffer(own.as_buffer(), np.uint8), np.int64, np.float64, np.float64, np.float64)[0]
            x, y = _split(np.frombuffer(sent.as_buffer(), np.uint8), np.float64, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x), pa.array(y)], ["id", "x", "y"])


def run(edges: DataFrame, init: DataFrame, scale: DataFrame, rates: list[float], boxes: int, a: float, b: float, clip: float, gamma: float, total_clip: float | None = None, rows: int = ROWS, worth: int = WORTH) -> DataFrame:
    """(id, x, y) after an epoch for each rate, from edges(src, dst, interval), init(id, x, y) and scale(id, scale)."""
    spark = init.sparkSession
    n = init.count()
    if not n:
        return init.select("id", "x", "y")
    count = max(-(-n // rows), min(2 * spark.sparkContext.defaultParallelism, -(-n // worth)))
    dealt = init.select("id", F.col("x").cast("double"), F.col("y").cast("double")).join(scale, "id", "left").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    placed = saved(dealt.select("id", "x", "y", F.coalesce("scale", F.lit(0.0)).alias("scale"), "block", (F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1).alias("place")))
    at = lambda *names: placed.select("id", "block", "place").toDF(*names)
    ends = edges.join(at("src", "block", "place"), "src").join(at("dst", "other", "there"), "dst").select("block", "place", "other", "there", "interval")
    held = placed.groupBy("block").applyInArrow(_packed_points, STATIC).union(ends.groupBy("block").applyInArrow(_packed_edges, STATIC))
    static = saved(held.repartition(count, "block"))
    sent = saved(static.groupBy("block").applyInArrow(_first, SENT).repartition(count, "block"))
    for epoch, alpha in enumerate(rates):
        own = sent.filter(F.col("sender") == OWN)
        low, high, bad = own.agg(F.min("low"), F.max("high"), F.max("bad")).first()
        if bad:
            raise FloatingPointError("positions are not finite")
        width = (high - low) / boxes if high > low else 1.0
        found = own.select("block", "data").mapInArrow(_moments(low, width, boxes), "block int, data binary").collect()  # a row a block, three numbers a cell
        total = np.sum([np.frombuffer(r.data).reshape(3, -1) for r in sorted(found)], axis=0)
        s = Step(epoch, alpha, a, b, clip, total_clip, low, width, boxes, _field(total, low, width, boxes, gamma, a, b, clip))
        moved = static.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_epoch(s), SENT)
        sent = saved(moved.repartition(count, "block"))
    own = sent.filter(F.col("sender") == OWN).select("block", "data")
    points = static.filter(F.col("kind") == POINTS).select("block", F.col("data").alias("points"))
    return saved(points.join(own, "block").mapInArrow(_unpacked, "id long, x double, y double"))
