"""Repulsion by interpolation on a mesh and a fast Fourier transform spread over Spark's tasks.

Points are scattered to the nodes of their box (``order`` nodes an axis, Lagrange weights), the nodes'
charges are convolved with the kernel, and the potentials are gathered back with the same weights:
force = phi * position - psi, with phi from the charges 1 and psi from the charges (x, y).

Nodes of all boxes form one even grid, so the convolution is circular on a grid of twice the size. Its
transform goes over rows (a task holds a strip, one row of boxes), is dealt anew by blocks of columns,
goes over columns, is multiplied with the kernel's, and goes back the same way. No task holds more than a
strip or a block of columns, and only occupied boxes are shuffled at first. The kernel's transform is
worked out on the workers, once a worker and grid.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.field import cells

#: Columns of a block in the second half of the transform.
COLUMNS = 64
#: Values of the field up to which it is broadcast: boxes ** 2 * order ** 2 nodes of three doubles.
BROADCAST_NODES = 1 << 17
TERMS = ("x", "y", "one")


@dataclass(frozen=True)
class Repulsion:
    """2 gamma b / ((eps + d2) (1 + a d2^b)), clipped. ``near`` nodes around the origin may hold the mean over
    ``samples`` squared places of their cell instead of the value in its middle."""

    gamma: float = 1.0
    a: float = 1.577
    b: float = 0.895
    eps: float = 1e-3
    clip: float = 4.0
    near: int | None = None
    samples: int = 4

    def of(self, d2: np.ndarray) -> np.ndarray:
        return 2 * self.gamma * self.b / ((self.eps + d2) * (1 + self.a * d2**self.b))

    def table(self, n: int, h: float) -> np.ndarray:
        """Values by offset (rows, columns) of 0 to n - 1 nodes."""
        at = np.arange(n) * h
        out = self.of(at[:, None] ** 2 + at[None, :] ** 2)
        if self.near is not None:
            inside = ((np.arange(self.samples) + 0.5) / self.samples - 0.5) * h
            for i in range(min(self.near + 1, n)):
                for j in range(min(self.near + 1, n)):
                    out[i, j] = self.of((i * h + inside)[:, None] ** 2 + (j * h + inside)[None, :] ** 2).mean()
        return np.clip(out, -self.clip, self.clip)


@dataclass(frozen=True)
class BoundedRepulsion:
    """strength (1 + d2) ** -power: needs no clipping."""

    strength: float = 1.0
    power: float = 2.0

    def table(self, n: int, h: float) -> np.ndarray:
        at = np.arange(n) * h
        return self.strength * (1 + at[:, None] ** 2 + at[None, :] ** 2) ** -self.power


@lru_cache(maxsize=1)
def _kernel_rows(kernel, n: int, h: float) -> np.ndarray:
    """Row transforms of the embedded circulant: offset t stands at t and at 2 n - t, and n is never used."""
    quarter = kernel.table(n, h)
    back = np.r_[np.arange(n), 0, np.arange(n - 1, 0, -1)]
    full = quarter[back][:, back]
    full[n], full[:, n] = 0, 0
    return np.fft.rfft(full, axis=1)


def weights(u: Column, order: int) -> list[Column]:
    """Lagrange weights of a place in a box (0 to 1) at nodes (j + 0.5) / order."""
    nodes = [(j + 0.5) / order for j in range(order)]
    one = lambda j: reduce(lambda a, b: a * b, [(u - nodes[k]) / (nodes[j] - nodes[k]) for k in range(order) if k != j], F.lit(1.0))
    return [one(j) for j in range(order)]


def placed(layout: DataFrame, boxes: int, order: int) -> DataFrame:
    """Points with their box, its width and their weights at its nodes along both axes."""
    at = cells(layout, boxes)
    place = lambda c, cell: (F.col(c) - F.col("low")) / F.col("width") - F.col(cell)
    return at.select("id", "x", "y", "cx", "cy", "width", F.array(*weights(place("x", "cx"), order)).alias("wx"), F.array(*weights(place("y", "cy"), order)).alias("wy"))


def charges(points: DataFrame, order: int) -> DataFrame:
    """One row an occupied box: the sums of (x, y, 1) at its order ** 2 nodes, as three arrays, nodes along y first."""
    value = {"x": F.col("x"), "y": F.col("y"), "one": F.lit(1.0)}
    pair = lambda j, k: F.col("wx")[j] * F.col("wy")[k]
    sums = lambda t: F.array(*[F.sum(pair(j, k) * value[t]) for j in range(order) for k in range(order)]).alias(t)
    return points.groupBy("cx", "cy").agg(*[sums(t) for t in TERMS])


def _blocks(n: int) -> list[tuple[int, int]]:
    """Blocks of the n + 1 columns that a real transform of 2 n has."""
    return [(s, min(s + COLUMNS, n + 1)) for s in range(0, n + 1, COLUMNS)]


def convolved(boxes_of: DataFrame, boxes: int, order: int, width: float, kernel) -> DataFrame:
    """(cx, cy, phi, px, py): the potentials at the nodes of every box in an occupied strip."""
    n, h = boxes * order, width / order
    spans = _blocks(n)

    def out(table: pa.Table, rows: list[tuple], names: str) -> pa.Table:
        kinds = [pa.int32(), pa.int32(), pa.binary()]
        return pa.table([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], names=names.split())

    def forward(table: pa.Table) -> pa.Table:
        """A strip's rows, transformed along y and cut into blocks of columns."""
        cx, cy = table["cx"][0].as_py(), table["cy"].to_numpy()
        strip = np.zeros((len(TERMS), order, boxes, order))
        for t, name in enumerate(TERMS):
            strip[t][:, cy, :] = np.array(table[name].to_pylist()).reshape(-1, order, order).transpose(1, 0, 2)
        wave = np.fft.rfft(strip.reshape(len(TERMS), order, n), 2 * n, axis=2)
        return out(table, [(cx, b, wave[:, :, s:e].tobytes()) for b, (s, e) in enumerate(spans)], "cx block wave")

    def middle(table: pa.Table) -> pa.Table:
        """A block of columns: transformed along x, multiplied with the kernel's transform, and back."""
        block, cxs = table["block"][0].as_py(), table["cx"].to_pylist()
        s, e = spans[block]
        grid = np.zeros((len(TERMS), 2 * n, e - s), complex)
        for cx, wave in zip(cxs, table["wave"].to_pylist(), strict=True):
            grid[:, cx * order : (cx + 1) * order] = np.frombuffer(wave, complex).reshape(len(TERMS), order, e - s)
        response = np.fft.fft(_kernel_rows(kernel, n, h)[:, s:e], axis=0).real  # even in both offsets
        back = np.fft.ifft(np.fft.fft(grid, axis=1) * response, axis=1)
        return out(table, [(cx, block, back[:, cx * order : (cx + 1) * order].tobytes()) for cx in cxs], "cx block wave")

    def inverse(table: pa.Table) -> pa.Table:
        """A strip's potentials, box by box."""
        cx = table["cx"][0].as_py()
        wave = np.zeros((len(TERMS), order, n + 1), complex)
        for block, cut in zip(table["block"].to_pylist(), table["wave"].to_pylist(), strict=True):
            s, e = spans[block]
            wave[:, :, s:e] = np.frombuffer(cut, complex).reshape(len(TERMS), order, e - s)
        field = np.fft.irfft(wave, 2 * n, axis=2)[:, :, :n].reshape(len(TERMS), order, boxes, order).transpose(0, 2, 1, 3).reshape(len(TERMS), boxes, order * order)
        columns = [pa.array(np.full(boxes, cx, np.int32)), pa.array(np.arange(boxes, dtype=np.int32))]
        return pa.table([*columns, *(pa.array(list(field[t]), pa.list_(pa.float64())) for t in (2, 0, 1))], names=["cx", "cy", "phi", "px", "py"])

    waves = boxes_of.groupBy("cx").applyInArrow(forward, "cx int, block int, wave binary")
    back = waves.groupBy("block").applyInArrow(middle, "cx int, block int, wave binary")
    return back.groupBy("cx").applyInArrow(inverse, "cx int, cy int, phi array<double>, px array<double>, py array<double>")


def mesh_force(layout: DataFrame, boxes: int, order: int = 1, kernel=None) -> DataFrame:
    """(id, fx, fy): repulsion of all points, on a mesh of ``boxes`` an axis with ``order`` nodes an axis each.

    At order 1 it equals the sum over pairs of boxes. Points that all coincide repel one another by nothing.
    An empty layout has no forces.
    """
    if not 1 <= boxes * order <= 4096:
        raise ValueError("boxes * order must lie between 1 and 4096")
    points = placed(layout, boxes, order)
    width = points.select("width").first()
    if width is None:
        return layout.select("id", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"))
    field = convolved(charges(points, order), boxes, order, float(width[0]), kernel or Repulsion())
    small = boxes * boxes * order * order <= BROADCAST_NODES
    at = points.join(F.broadcast(field) if small else field, ["cx", "cy"])
    pair = lambda c: reduce(lambda a, b: a + b, [F.col("wx")[j] * F.col("wy")[k] * F.col(c)[j * order + k] for j in range(order) for k in range(order)])
    return at.select("id", (pair("phi") * F.col("x") - pair("px")).alias("fx"), (pair("phi") * F.col("y") - pair("py")).alias("fy"))
