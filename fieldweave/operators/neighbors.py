"""Exact nearest neighbours by a join of vector blocks.

Vectors are packed into blocks of rows; each pair of blocks is one Arrow row, worked off in tiles by NumPy, so
memory is bounded by the block and the work spreads over all pairs of blocks. A tile is screened in float32 (one
matrix product for euclidean distances) with a bound on its rounding; what the bound can't rule out is computed in
float64, term by term. The pairs of one block follow each other inside a task, which carries the k best so far: its
bound soon rules out nearly all. Each task's lists of a block are shuffled as one row and merged block by block.
Ties go to the smaller id. Metrics: euclidean, sqeuclidean, manhattan, chebyshev, cosine.

Points without a vector, or with a null, NaN or infinite component, have no row and are no one's neighbour.
Of rows with the same id one counts, that of the smallest vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.operators.saving import saved

BLOCK = 512
#: Bytes of a wide block's vectors, entries of its lists of the best, and rows and columns of a tile.
BLOCK_BYTES, LIST_ROWS, TILE = 1 << 21, 1 << 19, (256, 1024)
#: Pairs whose exact distances are computed at once.
PAIRS = 1 << 18
#: New neighbours of a row up to which they are put in their places, not sorted with the rest.
INSERTED = 24
METRICS = ("euclidean", "sqeuclidean", "manhattan", "chebyshev", "cosine")
PACKED = "block long, ids binary, vectors binary"


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "cosine":
        norm = lambda x: np.sqrt((x * x).sum(1))
        return 1 - (a @ b.T) / np.maximum(np.outer(norm(a), norm(b)), 1e-300)
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    out = np.zeros((len(a), len(b)))
    gap = np.empty_like(out)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        np.subtract(x[:, None], y, out=gap)
        if metric in ("euclidean", "sqeuclidean"):
            np.multiply(gap, gap, out=gap)
            out += gap
        elif metric == "manhattan":
            out += np.abs(gap, out=gap)
        else:
            np.maximum(out, np.abs(gap, out=gap), out=out)
    return np.sqrt(out, out=out) if metric == "euclidean" else out


def usable(points: DataFrame) -> DataFrame:
    """points(id, features) as (long, array<double>), without those that have no distance to others."""
    finite = F.forall("features", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return points.select(F.col("id").cast("long"), F.col("features").cast("array<double>")).filter(F.col("id").isNotNull() & F.col("features").isNotNull() & finite)


def blocks(points: DataFrame, size: int = BLOCK, n: int | None = None) -> DataFrame:
    """points(id, features) to (block, ids, vectors): consecutive ids by hash, one row a block; n: their number, if known."""
    points = usable(points)
    n = points.count() if n is None else n
    count = max(1, -(-n // size))
    dealt = points.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)))
    packed = F.sort_array(F.collect_list(F.struct("id", "features")))
    first = F.filter("p", lambda x, i: (i == 0) | (x.id != F.get("p", i - 1).id))  # rows of one id lie in one block
    one_each = dealt.groupBy("block").agg(packed.alias("p")).select("block", first.alias("p"))
    return one_each.select("block", F.col("p.id").alias("ids"), F.col("p.features").alias("vectors"))


def _matrix(column: pa.Array, i: int) -> np.ndarray:
    rows = column[i].values
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), -1)


def wide_blocks(points: DataFrame, held: int = 1, most: int | None = None) -> DataFrame:
    """Blocks as bytes (block, ids, vectors): larger ones for larger tables, as a pair costs the moving of both.

    ``held``: entries that a kernel holds for each row; ``most``: rows of a block at most.
    """
    n, width = usable(points).agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("features")), F.lit(1))).first()
    share = -(-n // (4 * points.sparkSession.sparkContext.defaultParallelism))
    size = max(BLOCK, min(share, BLOCK_BYTES // (8 * max(1, width))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = [np.asarray(batch.column("ids")[i].values).tobytes()], [_matrix(batch.column("vectors"), i).tobytes()]
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), *(pa.array(x, pa.binary()) for x in row)], ["block", "ids", "vectors"])

    return blocks(points, max(1, min(size, LIST_ROWS // held, most or size)), n).mapInArrow(pack, PACKED)


def _bytes(batch: pa.RecordBatch, column: str, i: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(column)[i].as_buffer(), kind)


def _vectors(batch: pa.RecordBatch, column: str, i: int, rows: int) -> np.ndarray:
    return _bytes(batch, column, i, np.float64).reshape(rows, -1)


class _Screen:
    """Distances of a block's rows to others: screened by tiles with a bound on the error, exact for given pairs.

    Squares of euclidean distances come from one matrix product in float32; manhattan distances from levels of the
    components in 16 bits, as the sum of absolute gaps is twice that of the greater ones less both sums.
    """

    def __init__(self, a: np.ndarray, metric: str):
        self.a, self.metric, self.safe = a, metric, False
        self.product, self.levels = metric in ("euclidean", "sqeuclidean"), metric == "manhattan"
        if self.product:
            self.centre = a.mean(0)
            near = a - self.centre
            self.size = (near * near).sum(1)
            with np.errstate(over="ignore"):
                self.left = np.column_stack([-2 * near, self.size, np.ones(len(a))]).astype(np.float32)
        self.columns = np.ascontiguousarray(a.T)

    def meet(self, b: np.ndarray) -> None:
        self.b, self.other = b, np.ascontiguousarray(b.T)
        width = b.shape[1]
        if self.product:
            near = b - self.centre
            size = (near * near).sum(1)
            with np.errstate(over="ignore"):
                self.right = np.ascontiguousarray(np.column_stack([near, np.ones(len(b)), size]).astype(np.float32).T)
            # rounding of the inputs, of the terms and of their sum in any order, with room; denormals come on top
            terms = 2 * (width + 8)
            self.slack = terms * 2.0**-24 * (self.size + size.max()) + terms * 1e-37
            self.safe = max(self.size.max(), size.max()) < 1e30  # beyond, float32 may overflow
        elif self.levels:
            low = np.minimum(self.a.min(0), b.min(0))
            most = 65_000 // width
            self.step = float((np.maximum(self.a.max(0), b.max(0)) - low).max()) / max(1, most)
            self.safe = most >= 64 and 1e-30 < self.step < 1e30
            if self.safe:
                self.left, self.right = (np.rint((x - low) / self.step).astype(np.uint16).T.copy() for x in (self.a, b))
                self.sums = [x.sum(0, dtype=np.int64).astype(np.float32) for x in (self.left, self.right)]
                self.slack = np.full(len(self.a), width * self.step * 1.0001 + 1e-5 * width * most * self.step)
        if not self.safe:
            self.slack = np.full(len(self.a), 1e-12 if self.metric == "cosine" else 0.0)

    def tile(self, rows: slice, cols: slice) -> np.ndarray:
        """Screened values, within ``slack`` of the exact ones in their scale (squares for euclidean distances)."""
        if not self.safe:
            return distances(self.a[rows], self.b[cols], "sqeuclidean" if self.product else self.metric)
        if self.product:
            return self.left[rows] @ self.right[:, cols]
        mine, other = self.left[:, rows], self.right[:, cols]
        out = np.zeros((mine.shape[1], other.shape[1]), np.uint16)
        gap = np.empty_like(out)
        for x, y in zip(mine, other):
            np.maximum(x[:, None], y, out=gap)
            out += gap
        return (2 * out.astype(np.float32) - self.sums[0][rows, None] - self.sums[1][cols]) * np.float32(self.step)

    def scale(self, d: np.ndarray) -> np.ndarray:
        """Distances in the scale of the tiles, rounded up."""
        return d * d * (1 + 1e-15) if self.metric == "euclidean" else d

    def exact(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """As ``distances`` has them."""
        if self.metric == "cosine":
            norm = lambda x: np.sqrt((x * x).sum(1))
            x, y = self.a[rows], self.b[cols]
            return 1 - (x * y).sum(1) / np.maximum(norm(x) * norm(y), 1e-300)
        out = np.zeros(len(rows))
        for x, y in zip(self.columns, self.other):
            gap = x[rows] - y[cols]
            if self.product:
                out += gap * gap
            elif self.metric == "manhattan":
                out += np.abs(gap)
            else:
                np.maximum(out, np.abs(gap), out=out)
        return np.sqrt(out) if self.metric == "euclidean" else out


def _below(bound: np.ndarray) -> np.ndarray:
    """Bounds as float32, not below themselves."""
    out = bound.astype(np.float32)
    return np.where(out < bound, np.nextafter(out, np.float32(np.inf)), out)


def _counts(marks: np.ndarray) -> np.ndarray:
    """How many are set in each row."""
    return np.bitwise_count(np.packbits(marks, axis=1)).sum(1, dtype=np.int64)


def _slices(n: int, step: int) -> list[slice]:
    return [slice(x, min(x + step, n)) for x in range(0, n, step)]


def _knn_kernel(k: int, metric: str, keep_self: bool, packed: bool = False):
    """The k best of each row of block a among all blocks that it meets in a row; ``packed``: as one row a block."""

    places = np.arange(k)

    def merged(best: np.ndarray, ids: np.ndarray, row: np.ndarray, d: np.ndarray, dst: np.ndarray) -> None:
        order = np.argsort(row, kind="stable")
        row, d, dst = row[order], d[order], dst[order]
        place = np.arange(len(row)) - np.maximum.accumulate(np.where(np.append(True, row[1:] != row[:-1]), np.arange(len(row)), 0))
        if place.max() < INSERTED:  # few new ones a row are put in their places, one each at a time
            for turn in range(place.max() + 1):
                x = np.flatnonzero(place == turn)
                r, new, own = row[x], d[x, None], dst[x, None]
                b, i = best[r], ids[r]
                at = ((b < new) | ((b == new) & (i < own))).sum(1)[:, None]
                for kept, one in ((best, new), (ids, own)):
                    v = kept[r]
                    kept[r] = np.where(places < at, v, np.where(places == at, one, np.roll(v, 1, axis=1)))
            return
        held = np.unique(row)
        row = np.append(np.repeat(held, k), row)
        d, dst = np.append(best[held].ravel(), d), np.append(ids[held].ravel(), dst)
        order = np.lexsort((dst, d, row))
        row, d, dst = row[order], d[order], dst[order]
        place = np.arange(len(row)) - np.maximum.accumulate(np.where(np.append(True, row[1:] != row[:-1]), np.arange(len(row)), 0))
        keep = place < k
        best[row[keep], place[keep]], ids[row[keep], place[keep]] = d[keep], dst[keep]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = screen = None

        def found() -> pa.RecordBatch:
            if packed:
                return pa.RecordBatch.from_arrays([pa.array([at]), *(pa.array([x.tobytes()], pa.binary()) for x in (a_ids, ids, best))], ["block", "src", "dst", "dist"])
            ok = np.isfinite(best).ravel()
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(a_ids, k)[ok]), pa.array(ids.ravel()[ok]), pa.array(best.ravel()[ok])], ["src", "dst", "dist"])

        def settle(held: list[tuple[np.ndarray, np.ndarray]], b_ids: np.ndarray) -> None:
            rows, cols = (np.concatenate(x) for x in zip(*held))
            for part in _slices(len(rows), PAIRS):
                r, c = rows[part], cols[part]
                if not keep_self:
                    r, c = (x[a_ids[r] != b_ids[c]] for x in (r, c))
                d, dst = screen.exact(r, c), b_ids[c]
                ok = (d < best[r, -1]) | ((d == best[r, -1]) & (dst < ids[r, -1]))
                if ok.any():
                    merged(best, ids, r[ok], d[ok], dst[ok])

        for batch in batches:
            for i, a in enumerate(batch.column("a").to_pylist()):
                if a != at:
                    if screen is not None:
                        yield found()
                    at, a_ids = a, _bytes(batch, "a_ids", i, np.int64).copy()
                    screen = _Screen(_vectors(batch, "a_vectors", i, len(a_ids)).copy(), metric)
                    best, ids = np.full((len(a_ids), k), np.inf), np.full((len(a_ids), k), np.iinfo(np.int64).max)
                b_ids = _bytes(batch, "b_ids", i, np.int64)
                screen.meet(_vectors(batch, "b_vectors", i, len(b_ids)))
                held, n = [], 0
                for rows in _slices(len(a_ids), TILE[0]):
                    for cols in _slices(len(b_ids), TILE[1]):
                        s, slack = screen.tile(rows, cols), screen.slack[rows]
                        bound = screen.scale(best[rows, -1]) + slack
                        unknown, need = np.flatnonzero(np.isinf(bound)), k + (not keep_self)
                        if len(unknown) and s.shape[1] > need:
                            bound[unknown] = np.partition(s[unknown], need - 1, axis=1)[:, need - 1] + 2 * slack[unknown]
                        if s.dtype == np.float32:
                            bound = _below(bound)
                        # in large tables few rows of a tile hold a hit, which their least value tells at less cost
                        some = np.flatnonzero(s.min(1) <= bound) if screen.safe else np.arange(len(s))
                        hits = np.flatnonzero((s if len(some) == len(s) else s[some]) <= bound[some, None])
                        if len(hits):
                            r, c = np.divmod(hits, s.shape[1])
                            held.append((some[r] + rows.start, c + cols.start))
                            n += len(hits)
                        # hits of several tiles are worked off together; a row without k others needs its bound at once
                        if n >= PAIRS or (n and len(unknown)):
                            settle(held, b_ids)
                            held, n = [], 0
                if n:
                    settle(held, b_ids)
        if screen is not None:
            yield found()

    return kernel


def _merge_lists(k: int):
    """The k best of each row of a block, from its list of each task."""

    def merge(table: pa.Table) -> pa.Table:
        src = np.frombuffer(table["src"][0].as_py(), np.int64)
        dst, dist = (np.concatenate([np.frombuffer(x, kind).reshape(-1, k) for x in table[c].to_pylist()], axis=1) for c, kind in (("dst", np.int64), ("dist", np.float64)))
        order = np.lexsort((dst, dist), axis=1)[:, :k]
        dst, dist = (np.take_along_axis(x, order, 1).ravel() for x in (dst, dist))
        ok = np.isfinite(dist)
        rows = np.repeat(src, k), dst, np.tile(np.arange(1, k + 1, dtype=np.int32), len(src)), dist
        return pa.table([pa.array(x[ok]) for x in rows], names=["src", "dst", "rank", "dist"])

    return merge


def block_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of blocks. Each side is dealt out once, evenly by block number; the product itself is never shuffled.

    The second side has fewer parts, so that a block of the first meets many in one task, whose lists so soon rule out nearly all.
    """
    n = a.sparkSession.sparkContext.defaultParallelism
    dealt = lambda x, parts: x.repartitionById(parts, F.pmod(x.columns[0], F.lit(parts)).cast("int"))
    return dealt(a, 2 * n).crossJoin(dealt(b, max(1, n // 2)))


def knn(points: DataFrame, k: int = 15, metric: str = "euclidean") -> DataFrame:
    """(src, dst, rank, dist): the k nearest others of every point, rank from 1."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if k < 1:
        return points.sparkSession.createDataFrame([], "src long, dst long, rank int, dist double")
    packed = wide_blocks(points, k)
    pairs = block_pairs(packed.toDF("a", "a_ids", "a_vectors"), packed.toDF("b", "b_ids", "b_vectors"))
    some = pairs.mapInArrow(_knn_kernel(k, metric, False, True), "block long, src binary, dst binary, dist binary")
    return some.groupBy("block").applyInArrow(_merge_lists(k), "src long, dst long, rank int, dist double")


def with_self(neighbours: DataFrame) -> DataFrame:
    """The graph convention: each point is its own neighbour of rank 0 at distance 0."""
    own = neighbours.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(0).alias("rank"), F.lit(0.0).alias("dist"))
    return neighbours.unionByName(own)


def nearer_counts(points: DataFrame, candidates: DataFrame, metric: str = "euclidean") -> DataFrame:
    """candidates(src, dst) with rank = 1 + how many points are strictly nearer to src than dst is.

    Block by block: first the candidates' distances, from the pairs of blocks that hold both, then the points nearer
    than those. A tile is counted in float32; distances that rounding may put on either side are computed exactly.
    """
    packed = saved(wide_blocks(points, 16))  # met four times
    wanted = candidates.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dsts"))
    other = packed.toDF("b", "b_ids", "b_vectors")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, rows, owner, dst = _lists(batch, i, "dsts")
                others = _bytes(batch, "b_ids", i, np.int64)
                at = np.minimum(np.searchsorted(others, dst), len(others) - 1)
                here = np.flatnonzero(others[at] == dst)
                if len(here):
                    screen = _Screen(_vectors(batch, "vectors", i, len(ids)), metric)
                    screen.meet(_vectors(batch, "b_vectors", i, len(others)))
                    for part in _slices(len(here), PAIRS):
                        x = here[part]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[rows[owner[x]]]), pa.array(dst[x]), pa.array(screen.exact(rows[owner[x]], at[x]))], ["src", "dst", "d"])

    def nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = screen = None

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids[rows][owner]), pa.array(dst), pa.array(counts)], ["src", "dst", "nearer"])

        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                if block != current:
                    if screen is not None:
                        yield found()
                    current = block
                    ids, rows, owner, dst = (x.copy() for x in _lists(batch, i, "dsts"))
                    bound = np.asarray(batch.column("ds")[i].values.flatten()).copy()
                    screen = _Screen(_vectors(batch, "vectors", i, len(ids))[rows], metric)
                    counts = np.zeros(len(dst), np.int64)
                    place = np.arange(len(dst)) - np.searchsorted(owner, owner)
                others = _bytes(batch, "b_ids", i, np.int64)
                screen.meet(_vectors(batch, "b_vectors", i, len(others)))
                for part in _slices(len(rows), TILE[0]):
                    mine = np.arange(*np.searchsorted(owner, (part.start, part.stop)))
                    for cols in _slices(len(others), TILE[1]):
                        s, own = screen.tile(part, cols), ids[rows[part]]
                        at = np.minimum(np.searchsorted(others[cols], own), cols.stop - cols.start - 1)
                        self_too = np.flatnonzero(others[cols][at] == own)
                        s[self_too, at[self_too]] = np.inf
                        for turn in range(int(place[mine].max(initial=-1)) + 1):
                            w = mine[place[mine] == turn]
                            r = owner[w] - part.start
                            least, most = bound[w] ** 2 * (1 - 1e-15) if metric == "euclidean" else bound[w], screen.scale(bound[w])
                            low, high = least - screen.slack[owner[w]], most + screen.slack[owner[w]]
                            if s.dtype == np.float32:
                                low, high = -_below(-low), _below(high)
                            t = s if len(r) == len(s) else s[r]
                            sure, unsure = _counts(t < low[:, None]), _counts(t <= high[:, None])
                            counts[w] += sure
                            doubt = np.flatnonzero(unsure > sure)
                            x, c = np.nonzero((t[doubt] >= low[doubt, None]) & (t[doubt] <= high[doubt, None]))
                            for some in _slices(len(x), PAIRS):
                                at_w = w[doubt[x[some]]]
                                np.add.at(counts, at_w, screen.exact(owner[at_w], c[some] + cols.start) < bound[at_w])
        if screen is not None:
            yield found()

    # the lists of a block's rows lie beside it, in the order of its ids
    def beside(lists: DataFrame) -> DataFrame:
        held = owned.join(lists, "src")
        return packed.join(held.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(*[c for c in held.columns if c != "block"]))).alias("w")), "block")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                ids = _bytes(batch, "ids", i, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids)], ["block", "src"])

    owned = packed.mapInArrow(members, "block long, src long")
    sources = beside(wanted).select("block", "ids", "vectors", F.col("w.src").alias("srcs"), F.col("w.dsts").alias("dsts"))
    known = block_pairs(sources, other).mapInArrow(between, "src long, dst long, d double")
    bounds = known.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "d"))).alias("c"))
    ready = beside(bounds).select("block", "ids", "vectors", F.col("w.src").alias("srcs"), F.transform("w.c", lambda c: c["dst"]).alias("dsts"), F.transform("w.c", lambda c: c["d"]).alias("ds"))
    return block_pairs(ready, other).mapInArrow(nearer, "src long, dst long, nearer long").groupBy("src", "dst").agg((F.sum("nearer") + 1).alias("rank"))


def _lists(batch: pa.RecordBatch, i: int, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids, the places of those that have lists, the list of each entry, and the entries."""
    ids, srcs = _bytes(batch, "ids", i, np.int64), np.asarray(batch.column("srcs")[i].values)
    lists = batch.column(column)[i].values
    return ids, np.searchsorted(ids, srcs), np.repeat(np.arange(len(srcs)), np.diff(lists.offsets.to_numpy())), np.asarray(lists.flatten())


def pair_distances_by_block(first: DataFrame, second: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(i, j, x, y) of all pairs i < j: their distances in both sets of vectors, block by block."""
    both = first.select("id", F.col("features").alias("f1")).join(second.select("id", F.col("features").alias("f2")), "id")
    n1 = F.size("f1")
    packed = blocks(both.select("id", F.concat(F.array(n1.cast("double")), F.col("f1").cast("array<double>"), F.col("f2").cast("array<double>")).alias("features")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (np.asarray(batch.column(c)[i].values) for c in ("a_ids", "b_ids"))
                p, q = _matrix(batch.column("a_vectors"), i), _matrix(batch.column("b_vectors"), i)
                cut = 1 + int(p[0, 0])
                rows, cols = np.nonzero(a[:, None] < b[None, :])
                x, y = (distances(p[:, s], q[:, s], metric)[rows, cols] for s in (slice(1, cut), slice(cut, None)))
                yield pa.RecordBatch.from_arrays([pa.array(a[rows]), pa.array(b[cols]), pa.array(x), pa.array(y)], ["i", "j", "x", "y"])

    return block_pairs(packed.toDF("a", "a_ids", "a_vectors"), packed.toDF("b", "b_ids", "b_vectors")).mapInArrow(kernel, "i long, j long, x double, y double")
