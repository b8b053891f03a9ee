"""Document fingerprints by a randomised edit embedding.

A walk reads the characters of a text; at each step a shared random function of the step and the
character says whether it moves on, so walks over texts that differ by few edits fall into step
again and their outputs agree (edit distance becomes Hamming distance). Every step adds a shared
random sign of its character to one of the fingerprint's bits, in turn; the sign of a bit's sum is
the bit. Texts longer than a lane are walked lane by lane. Likeness is twice the share of equal
bits less one, not below 0: unrelated texts are near 0 and equal texts are 1.

Near classes are found by banding: digits of four bits are sampled into bands, equal bands bring
distinct fingerprints together, and whole fingerprints are verified; a bucket's members are searched
breadth first, so only the links of a spanning forest are written and copies cost nothing. The more
fingerprints, the wider the bands (chance buckets stay small) and the more of them (MISS). A bucket
of more than LARGE is dealt into parts, and each two of its parts are searched together, in one task
each: every two members meet, whatever the bucket's size. The class of a document is the smallest id that near links reach (LIKE or more alike), null if it has none.

Null texts count as empty; an empty text has an all-zero fingerprint. "Next" is the next document
by descending doc_id (null ids last, equal ids by text), after the last the first; a lone document
follows itself. Repeated rows are neighbours like any rows. Very long texts are walked lane by lane,
CHUNK code points at once. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm.common import release, shared_path
from fieldweave.llm.components import components

BITS = 512
LANE = 4096
#: Code points that are walked at once.
CHUNK = 4_000_000
#: Rows of a range of ids at about, and ranges at most; their bounds go to the driver.
RANGE_ROWS, MOST_RANGES = 2_000, 4_096
#: Likeness of a near pair, chance that no band brings a pair at that bound together, and members of a part of a bucket at about.
LIKE, MISS, LARGE = 0.8, 0.08, 4_096

_rng = np.random.default_rng(577215664)
STEPS = 2 * LANE
MOVES = _rng.integers(0, 2, (STEPS, 256), dtype=np.int64)
SIGNS = (_rng.integers(0, 2, (STEPS, 256), dtype=np.int16) * 2 - 1).astype(np.int16)


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """(texts, BITS // 8) bytes."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)
    firsts = np.cumsum(lengths) - lengths
    per_text = (lengths + LANE - 1) // LANE
    owner = np.repeat(np.arange(len(texts)), per_text)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    start = firsts[owner] + number * LANE
    size = np.minimum(firsts[owner] + lengths[owner] - start, LANE)
    order = np.argsort(-size, kind="stable")
    at, size, owner = start[order].copy(), size[order], owner[order]
    last = at + size - 1
    sums = np.zeros((BITS, len(at)), np.int16)
    moving = np.searchsorted(-size, -np.arange(0, 2 * (size[0] if len(size) else 0), 1) / 2, side="left")
    for j, k in enumerate(moving):
        if not k:
            break
        seen = kind[at[:k]]
        sums[j % BITS, :k] += SIGNS[j].take(seen)
        at[:k] += MOVES[j].take(seen)
        np.minimum(at[:k], last[:k], out=at[:k])
    totals = np.zeros((len(texts), BITS), np.int32)
    np.add.at(totals, owner, sums.T)
    return np.packbits(totals > 0, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = BITS - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return np.maximum(0.0, 2.0 * same / BITS - 1.0)


def edited(text: str, following: str) -> str:
    """The text's last half, rounded down, replaced by as many first code points of what follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs_out(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all texts but the last, which only follows."""
    n = len(texts) - 1
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    prints = fingerprints_of([*texts, *changed])
    own, new = prints[: n + 1], prints[n + 1 :]
    hexed = lambda x: [r.tobytes().hex() for r in x]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:n], pa.int64()),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
            pa.array(hexed(own[:n]), pa.string()),
            pa.array(hexed(new), pa.string()),
            pa.array(likeness(own[:n], new)),
            pa.array(likeness(own[:n], own[1:])),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _neighbour_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, followers last. A range ends with its first follower; more are skipped."""
    ids: list = []
    texts: list[str] = []
    held, area = 0, None
    done = False
    for batch in batches:
        for r, ghost, i, t in zip(*(batch.column(c).to_pylist() for c in ("area", "ghost", "doc_id", "text"))):
            if r != area:
                area, done = r, False
                ids, texts, held = [], [], 0
            if done:
                continue
            ids.append(i), texts.append(t or "")
            held += len(texts[-1])
            if ghost or held > CHUNK:
                yield _pairs_out(ids, texts)
                done = bool(ghost)
                ids, texts = ids[-1:], texts[-1:]
                held = len(texts[0])


def _area(bounds: list[int]):
    """How many bounds are at or below doc_id, by binary search; null ids are below all."""
    if not bounds:
        return F.lit(0)
    array = F.array(*(F.lit(int(b)) for b in bounds)) if len(bounds) < 64 else F.from_json(F.lit(str([int(b) for b in bounds])), "array<bigint>")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(x, _):
        mid = F.floor((x["lo"] + x["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(array, mid) <= F.col("doc_id"), F.lit(False))
        on = x["lo"] < x["hi"]
        return F.struct(F.when(on & below, mid + 1).otherwise(x["lo"]).alias("lo"), F.when(on & ~below, mid).otherwise(x["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, halve)["lo"]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows by range of ids, each range followed by the first row of the next one down.

    Texts are shuffled once. Only the ranges' bounds (a fixed number) reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    bounds = sorted(set(rows.filter("doc_id IS NOT NULL").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    # quantiles are doubles: bounds need not be ids themselves, any cut will do
    rows = rows.withColumn("area", _area([int(b) for b in bounds]))
    tops = sorted(rows.groupBy("area").agg(F.max("doc_id").alias("top")).collect())  # at most MOST_RANGES rows
    pairs = [(r.area, r.top, tops[(k + 1) % len(tops)].area) for k, r in enumerate(tops)]
    # the first row of each range, from above, follows the last row of the range above it
    sent = spark.createDataFrame(pairs, "area int, top long, above int") if pairs else spark.createDataFrame([], "area int, top long, above int")
    joined = rows.join(F.broadcast(sent), "area")
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(F.struct(F.col("area"), F.lit(False).alias("ghost")), F.struct(F.col("above").alias("area"), F.lit(True).alias("ghost"))))
    each = joined.select("doc_id", "text", F.explode(F.coalesce(copies, F.array(F.struct(F.col("area"), F.lit(False).alias("ghost"))))).alias("c"))
    placed = each.select("c.area", "c.ghost", "doc_id", "text").repartition("area")
    return placed.sortWithinPartitions("area", "ghost", F.col("doc_id").desc_nulls_last(), "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to both neighbours."""
    return with_next(docs).mapInArrow(_neighbour_batches, SCHEMA)


def band_digits(n: int) -> list[list[int]]:
    """Hexadecimal digits of each band for n distinct fingerprints."""
    width = min(12, max(4, math.ceil((math.log2(max(n, 2)) - 2) / 4)))
    hit = ((1 + LIKE) / 2) ** (4 * width)
    rng = np.random.default_rng(1618)
    return [sorted(rng.choice(BITS // 4, width, replace=False).tolist()) for _ in range(math.ceil(math.log(MISS) / math.log(1 - hit)))]


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest over the near pairs of rows of 64-bit words."""
    left, links = np.arange(len(prints)), []
    most = int(BITS * (1 - LIKE) / 2)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[x]).sum(axis=1) <= most
            if near.any():
                met, left = left[near], left[~near]
                links += [(x, int(y)) for y in met]
                queue.extend(met.tolist())
    return links


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by band and key (with the pair of parts): links inside each of these groups, two parts at most."""
    held: list[bytes] = []
    at = None

    def linked() -> pa.RecordBatch:
        links = _forest(np.frombuffer(b"".join(held), np.uint64).reshape(-1, BITS // 64))
        pick = lambda k: pa.array([held[x[k]] for x in links], pa.binary())
        return pa.RecordBatch.from_arrays([pick(0), pick(1)], ["a", "b"])

    for batch in batches:
        for band, key, fp in zip(*(batch.column(c).to_pylist() for c in ("band", "key", "fp"))):
            if (band, key) != at:
                if len(held) > 1:
                    yield linked()
                held, at = [], (band, key)
            held.append(fp)
    if len(held) > 1:
        yield linked()


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b): hashes of distinct fingerprints that are near, a spanning forest of each bucket's near pairs.

    prints: a column ``fingerprint`` (hex). Equal fingerprints are one.
    """
    one = prints.select("fingerprint").distinct()
    digits = lambda at: F.concat(*(F.substring("fingerprint", i + 1, 1) for i in at))
    keyed = one.select(F.unhex("fingerprint").alias("fp"), F.posexplode(F.array(*map(digits, band_digits(one.count())))).alias("band", "key"))
    parts = F.floor((F.count(F.lit(1)) + LARGE - 1) / LARGE)
    large = keyed.groupBy("band", "key").agg(parts.alias("parts")).filter("parts > 1")
    dealt = keyed.join(large, ["band", "key"], "left").select("band", "key", "fp", F.coalesce("parts", F.lit(1)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # each two parts of a large bucket meet under a key of their own
    twos = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda k: F.pmod(part + k, F.col("parts")))
    keys = F.transform(twos, lambda o: F.concat_ws(":", "key", F.least(part, o).cast("string"), F.greatest(part, o).cast("string")))
    met = dealt.select("band", F.explode(F.when(F.col("parts") > 1, keys).otherwise(F.array("key"))).alias("key"), "fp")
    links = met.repartition("band", "key").sortWithinPartitions("band", "key", "fp").mapInArrow(_near_batches, "a binary, b binary")
    return links.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).distinct()


def near_classes(prints: DataFrame) -> DataFrame:
    """prints(doc_id, fingerprint, ...) with near_class, the smallest id of the documents that near links reach."""
    node = F.xxhash64(F.unhex("fingerprint"))
    roots = components(near_links(prints))
    low = prints.groupBy(node.alias("fp")).agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    rooted = low.join(roots, low.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("near_class"), F.sum("n").alias("n_class")).filter("n_class > 1")
    by_print = rooted.join(least, "root").select("fp", "near_class")
    return prints.withColumn("fp", node).join(by_print, "fp", "left").drop("fp")


def op8_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "fingerprints")
    fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).write.option("compression", "zstd").parquet(path)
    release(spark)  # the texts' shuffle is done with
    return near_classes(spark.read.parquet(path))
