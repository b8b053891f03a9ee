"""Exact removal of repeated byte strings by a depth-limited most-significant-digit radix sort.

A byte goes if some string of DEPTH bytes that covers it also starts anywhere else. Suffixes are
ordered through their first DEPTH bytes only, digit by digit; after each digit, suffixes alone in
their group are done, and the groups left after the last digit are exactly the repeated strings.

The first digit is the string's smallest GRAM-byte piece by hash (with its offset): equal strings
have it in common, and neighbouring suffixes share it, so one row stands for the run of suffixes
around a piece instead of one row for each byte. Runs whose piece occurs once are dropped, runs
alike in all their bytes are joined into one representative with a count, and only the bytes of
representatives that still share a piece with others travel to the remaining digit passes.

The same passes run over words (lowered, letters and digits) with a threshold of 50 words; there a
word counts if its window stands in another document as well. Nothing is removed for that reason.

Strings are equal where two independent 64-bit hashes agree, that of the piece and that of the rest.
Null texts count as empty: nothing is removed. Texts shorter than DEPTH keep all their bytes.
Repeated rows are repeats of each other, so their long texts go entirely; for words, rows with the
same id and text are one document. Very long texts are cut into overlapping pieces for the scan
only. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import bytewords as bw
from fieldweave.llm.common import checkpointed, release, text_key

#: Units scanned at once; positions must fit in the low bits of a hash.
PIECE, LOW_BITS = 1 << 20, np.uint64(21)
#: Contexts of one piece up to which they are refined in one task; beyond, suffixes are grouped by Spark.
TOGETHER = 12_000
#: Bytes of contexts that a task refines at once, if its groups are not larger.
REFINE_BYTES = 2 << 20
CONTEXT = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Unit:
    """What strings are made of: their threshold, the piece and digit lengths, and whether repeats must lie across documents."""

    depth: int
    gram: int
    digit: int
    words: bool = False

    def values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One 64-bit value a unit, and the rows' bounds in them."""
        if not self.words:
            return bw.LETTER[data], offsets
        low, starts, ends, rows = bw.words(data, offsets)
        return bw.span_hashes(low, starts, ends), np.append(0, np.cumsum(np.bincount(rows, minlength=len(offsets) - 1)))

    def cut(self, data: bytes) -> np.ndarray:
        """The units of a text, as they travel."""
        flat = np.frombuffer(data, np.uint8)
        return self.values(flat, np.array([0, len(flat)]))[0] if self.words else flat

    def read(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.uint64) if self.words else bw.LETTER[np.frombuffer(data, np.uint8)]

    @property
    def size(self) -> int:
        return 8 if self.words else 1


BYTES = Unit(400, 128, 100)
DEPTH = BYTES.depth
WORDS = Unit(50, 16, 10, True)


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, in linear time."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs_of(values: np.ndarray, offsets: np.ndarray, unit: Unit = BYTES) -> tuple[np.ndarray, ...]:
    """Runs of suffixes that share their smallest piece: row, first and last start, piece, context."""
    n, depth, gram = len(values), unit.depth, unit.gram
    none = np.zeros(0, np.int64)
    if n < depth:
        return none, none, none, none, none
    up, down = bw.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    grams = bw.mixed((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    least = _window_minima((grams >> LOW_BITS << LOW_BITS) | place, depth - gram + 1)
    anchor = (least & np.uint64((1 << int(LOW_BITS)) - 1)).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    whole = start + depth <= offsets[row + 1]
    new = np.empty(len(anchor), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    end = last + depth
    # other values than the piece's, so that both hashes clash only by chance of 2 ** -128
    np.cumsum(bw.mixed(values ^ CONTEXT) * up[:-1], out=total[1:])
    context = bw.mixed((total[end] - total[first]) * down[first] + ((anchor[first] - first) * 65536 + end - first).astype(np.uint64))
    r = row[first]
    return r, first - offsets[r], last - offsets[r], grams[anchor[first]].view(np.int64), context.view(np.int64)


def _run_batches(unit: Unit):
    names = ["doc_id", "tk", "first", "last", "gram", "ctx"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bw.text_buffer(batch.column("text"))
            for a, b in bw.blocks(offsets, PIECE):
                part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if unit.words:
                    part, bounds = unit.values(part, bounds)
                for cut in range(0, max(1, len(part) - unit.depth + 1), PIECE):  # one, but for a very long text
                    long = len(part) > PIECE and b == a + 1
                    held = part[cut : cut + PIECE + unit.depth - 1] if long else part
                    row, first, last, gram, ctx = runs_of(held if unit.words else bw.LETTER[held], np.array([0, len(held)]) if long else bounds, unit)
                    if len(row):
                        take = pa.array(a + row)
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("tk").take(take), pa.array((first + cut).astype(np.int32)), pa.array((last + cut).astype(np.int32)), pa.array(gram), pa.array(ctx)], names)
                    if not long:
                        break

    return kernel


def runs(keyed: DataFrame, unit: Unit = BYTES) -> DataFrame:
    return keyed.mapInArrow(_run_batches(unit), "doc_id long, tk long, first int, last int, gram long, ctx long")


def _cut_batches(unit: Unit):
    """The units of the wanted contexts of each text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                units = unit.cut(batch.column("text")[i].as_py() or b"")
                parts = batch.column("parts")[i].values
                first, size = (parts.field(c).to_numpy() for c in ("first", "size"))
                pieces = pa.array([units[x : x + n].tobytes() for x, n in zip(first.tolist(), size.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(parts.field(c) for c in ("gram", "ctx", "k", "low", "high")), pieces], ["gram", "ctx", "k", "low", "high", "units"])

    return kernel


def _suffixes(texts: list[bytes], unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of the joined contexts, powers by place in a context; start, place and context of each suffix."""
    values = unit.read(b"".join(texts))
    lengths = np.array([len(t) for t in texts]) // unit.size
    begins = np.cumsum(lengths) - lengths
    up, down = bw.powers(int(lengths.max()) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[np.arange(len(values)) - np.repeat(begins, lengths)], out=total[1:])
    counts = lengths - unit.depth + 1
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    return total, down, (place + begins[owner]).astype(np.int32), place, owner


def repeated_suffixes(texts: list[bytes], unit: Unit = BYTES, groups: np.ndarray | None = None, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset in it) of the suffixes whose first units occur more than once in a group of contexts.

    With low and high, the least and greatest document of each context, they must occur in two documents.
    """
    total, down, start, place, owner = _suffixes(texts, unit)
    key = np.zeros(len(start), np.uint64) if groups is None else bw.mixed(groups.view(np.uint64))[owner]
    for depth in range(0, unit.depth, unit.digit):
        digit = (total[start + (depth + unit.digit)] - total[start + depth]) * down[place + depth]
        key = bw.mixed(key + digit * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        if low is not None and depth + unit.digit >= unit.depth and len(k):
            begin = np.flatnonzero(~same[:-1])
            docs = owner[order]
            apart = np.minimum.reduceat(low[docs], begin) != np.maximum.reduceat(high[docs], begin)
            left = np.sort(order[np.repeat(apart, np.diff(np.append(begin, len(k))))])
        elif low is not None:  # a context may stand for several documents
            left = np.sort(order[same[1:] | same[:-1] | (low != high)[owner[order]]])
        else:
            left = np.sort(order[same[1:] | same[:-1]])
        key, start, place, owner = key[left], start[left], place[left], owner[left]
    return owner, place


def _covers(owner: np.ndarray, offset: np.ndarray, n: int, depth: int) -> list[list[int]]:
    """Flat [start, end, ...] of the units that the suffixes cover, for each context."""
    out: list[list[int]] = [[] for _ in range(n)]
    if len(owner):
        new = np.append(True, (owner[1:] != owner[:-1]) | (offset[1:] - offset[:-1] > depth))
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(owner)) - 1
        for o, x, y in zip(owner[s].tolist(), offset[s].tolist(), (offset[e] + depth).tolist()):
            out[o] += [x, y]
    return out


def _refine_batches(unit: Unit):
    """Batches sorted by piece; contexts that share a piece are refined together."""

    def out(held: list[tuple]) -> pa.RecordBatch:
        gram, ctx, low, high, texts = (list(x) for x in zip(*held))
        bounds = (np.array(low), np.array(high)) if unit.words else (None, None)
        owner, offset = repeated_suffixes(texts, unit, np.array(gram), *bounds)
        return pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(ctx, pa.int64()), pa.array(_covers(owner, offset, len(held), unit.depth), pa.list_(pa.int32()))], ["gram", "ctx", "cover"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "ctx", "low", "high", "units"))):
                if held and row[:2] == held[-1][:2]:
                    continue  # the same context, fetched from a repeated row
                if size > REFINE_BYTES and row[0] != held[-1][0]:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield out(held)

    return kernel


def _suffix_batches(unit: Unit):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                total, down, start, place, owner = _suffixes(part.column("units").to_pylist(), unit)
                key = bw.mixed((total[start + unit.depth] - total[start]) * down[place]).view(np.int64)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in ("gram", "ctx", "low", "high")), pa.array(place), pa.array(key)], ["gram", "ctx", "low", "high", "offset", "key"])

    return kernel


def _length(flat: list[int]) -> int:
    """Units under any of the stretches."""
    n = at = 0
    for s, e in sorted(zip(flat[::2], flat[1::2])):
        n += max(0, e - max(s, at))
        at = max(at, e)
    return n


def _finish_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, size, digest = [], [], [], []
        for text, covers in zip(batch.column("text").to_pylist(), batch.column("covers").to_pylist()):
            text, kept, at, n, gone = text or b"", hashlib.sha256(), 0, 0, 0
            for s, e in sorted(zip((covers or [])[::2], (covers or [])[1::2])):
                if s > at or not n:
                    n += 1
                    kept.update(text[at:s])
                    gone += e - s
                elif e > at:
                    gone += e - at
                at = max(at, e)
            kept.update(text[at:])
            removed.append(gone), spans.append(n), size.append(len(text)), digest.append(kept.hexdigest())
        shared = [_length(x or []) for x in batch.column("shared").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(digest, pa.string()), pa.array(shared, pa.int64())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("tk"), F.col("text").cast("binary").alias("text"))


def repeats(docs: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """doc_id, tk, cover: flat [start, end, ...] of repeated units, some rows for each document with any."""
    keyed = _keyed(docs)
    every = runs(keyed, unit)
    # written first, so that the joins below have a shuffle on either side and hot pieces can be split
    shared = checkpointed(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"))
    left = checkpointed(every.join(shared, "gram", "left_semi"))
    release(docs.sparkSession)
    size = F.col("last") - F.col("first") + unit.depth
    document = F.xxhash64("doc_id", "tk")
    ctxs = left.groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(document).alias("low"), F.max(document).alias("high"), F.min(F.struct("doc_id", "tk", "first", size.alias("size"))).alias("rep"))
    ctxs = checkpointed(ctxs)
    mixed_grams = checkpointed(ctxs.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"))
    todo = ctxs.join(mixed_grams, "gram").select("gram", "ctx", "k", "low", "high", "rep.*")
    by_doc = todo.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("gram", "ctx", "k", "low", "high", "first", "size")).alias("parts"))  # bounded by the document
    texts = keyed.withColumnsRenamed({"doc_id": "d2", "tk": "t2"}).join(by_doc, F.col("d2").eqNullSafe(by_doc.doc_id) & (F.col("t2") == by_doc.tk)).select("text", "parts")
    parts = texts.mapInArrow(_cut_batches(unit), "gram long, ctx long, k long, low long, high long, units binary")
    few, many = F.col("k") <= TOGETHER, F.col("k") > TOGETHER
    covers = parts.filter(few).repartition("gram").sortWithinPartitions("gram", "ctx").mapInArrow(_refine_batches(unit), "gram long, ctx long, cover array<int>")
    if mixed_grams.filter(many).limit(1).count():
        suffixes = checkpointed(parts.filter(many).mapInArrow(_suffix_batches(unit), "gram long, ctx long, low long, high long, offset int, key long"))
        told = F.min("low") < F.max("high") if unit.words else F.count(F.lit(1)) > 1
        often = checkpointed(suffixes.groupBy("gram", "key").agg(told.alias("often")).filter("often").select("gram", "key"))
        held = suffixes.join(often, ["gram", "key"], "left_semi").groupBy("gram", "ctx").agg(F.array_sort(F.collect_set("offset")).alias("o"))
        apart = lambda x, y: y - x > unit.depth
        begin = F.filter("o", lambda x, i: (i == 0) | apart(F.get("o", i - 1), x))
        end = F.transform(F.filter("o", lambda x, i: (i == F.size("o") - 1) | apart(x, F.get("o", i + 1))), lambda x: x + unit.depth)
        covers = covers.union(held.select("gram", "ctx", F.flatten(F.zip_with(begin, end, lambda x, y: F.array(x, y))).alias("cover")))
    covers = covers.filter(F.size("cover") > 0).groupBy("gram", "ctx").agg(F.first("cover").alias("cover"))
    whole = ctxs.filter("low < high" if unit.words else "n > 1").select("gram", "ctx", F.array(F.lit(0), F.col("rep.size")).alias("cover"))
    found = checkpointed(whole.union(covers.join(whole, ["gram", "ctx"], "left_anti")))
    release(docs.sparkSession)
    return left.join(found, ["gram", "ctx"]).select("doc_id", "tk", F.transform("cover", lambda x: x + F.col("first")).alias("cover"))


def removed(docs: DataFrame) -> DataFrame:
    """One row per document: bytes, bytes removed, removed runs, the digest of what is kept, and words shared with others."""
    keyed = _keyed(docs).withColumnsRenamed({"doc_id": "d2", "tk": "t2"})
    none = F.lit(None).cast("array<int>")
    both = repeats(docs).withColumn("shared", none).unionByName(repeats(docs, WORDS).select("doc_id", "tk", none.alias("cover"), F.col("cover").alias("shared")))
    found = both.groupBy("doc_id", "tk").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("cover", "shared")))  # bounded by the document
    rows = keyed.join(found, F.col("d2").eqNullSafe(found.doc_id) & (F.col("t2") == found.tk), "left").select(F.col("d2").alias("doc_id"), "text", F.col("cover").alias("covers"), "shared")
    return rows.mapInArrow(_finish_batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
