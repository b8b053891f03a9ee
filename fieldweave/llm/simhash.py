"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at most three
bits, one half differs in at most one. Each half is indexed under its 32 variants with one bit
wild; equal keys bring every such pair together, and the whole fingerprints are then compared.

Equal fingerprints are collapsed first, so copies cost nothing. Inside a bucket links are found
by a breadth-first search that only writes the links of a spanning forest, which keeps every
component and never all pairs; a large bucket is cut again by variants of the other half's halves.

Null texts count as empty. Texts without words have fingerprint zero and link like any other. Very
long texts are read whole, BLOCK shingles at a time. Repeated rows get equal results. A component
whose ids are all null has a null id. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldweave.llm.common import checkpointed, text_key
from fieldweave.llm.components import components

NEAR = 3
#: Buckets above this size are cut again before they are searched.
LARGE = 2048
#: Shingles whose bits are counted at once.
BLOCK = 1 << 17


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """uint64 fingerprints: majority of the bits of XXH64 over three-word shingles."""
    out = np.zeros(len(texts), np.uint64)
    sums = np.zeros((len(texts), 64), np.int64)
    counts = np.zeros(len(texts), np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    held: list[bytes] = []
    owners: list[int] = []
    sizes: list[int] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        if waiting:
            bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, 8), axis=1)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            np.add.at(sums, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
        held.clear(), owners.clear(), sizes.clear()
        waiting = 0

    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        n = max(1, len(words) - 2)
        counts[i] = n
        for at in range(0, n, BLOCK):
            part = words[at : at + BLOCK + 2]
            shingles = [digest(s, 42) for s in map(join, zip(part, part[1:], part[2:]))] if len(words) > 2 else [digest(join(words), 42)]
            held.extend(shingles), owners.append(i), sizes.append(len(shingles))
            waiting += len(shingles)
            if waiting >= BLOCK:
                flush()
    flush()
    majority = sums * 2 > counts[:, None]
    out[:] = np.packbits(majority, axis=1).view(">u8").ravel()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            prints = fingerprints_of([t or b"" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tk"), pa.array(prints.view(np.int64))], ["doc_id", "tk", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tk (text key) and fp, the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("tk"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, tk long, fp long")


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal keys."""
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1)) if len(keys) else np.zeros(0, int)
    return starts, np.append(starts[1:], len(keys))


def _forest(prints: np.ndarray) -> list[np.ndarray]:
    """Edges of a spanning forest over the links of distinct fingerprints."""
    left, edges = prints, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= NEAR
            if near.any():
                met, left = left[near], left[~near]
                edges.append(np.stack([np.full(len(met), x), met], axis=1))
                queue.extend(met)
    return edges


def bucket_links(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Links inside the buckets of keys (sorted); prints are distinct within a key."""
    starts, ends = _groups(keys)
    sizes = ends - starts
    two = starts[sizes == 2]
    close = np.bitwise_count(prints[two] ^ prints[two + 1]) <= NEAR
    edges = [np.stack([prints[two][close], prints[two + 1][close]], axis=1)]
    for s, e in zip(starts[sizes > 2], ends[sizes > 2]):
        group = prints[s:e]
        if len(group) <= LARGE:
            edges += _forest(group)
            continue
        other = np.uint64(0) if keys[s] >> 32 >= 32 else np.uint64(32)  # the half that is not the key's
        for half in (0, 16):
            part = (group >> (other + np.uint64(half))) & np.uint64(0xFFFF)
            for bit in range(16):
                k = part & np.uint64(0xFFFF ^ (1 << bit))
                order = np.argsort(k, kind="stable")
                for a, b in zip(*_groups(k[order])):
                    edges += _forest(group[order[a:b]])
    return np.concatenate(edges)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key; a bucket may run on into the next batches."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def out(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        links = np.unique(np.sort(bucket_links(keys, prints).view(np.int64), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, prints = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        prints = prints.view(np.uint64)
        cut = int(np.searchsorted(keys, keys[-1])) if keys[0] != keys[-1] else 0
        if cut:
            kept.append((keys[:cut], prints[:cut]))
            yield out(*(np.concatenate(x) for x in zip(*kept)))
            kept = []
        elif kept and kept[0][0][0] != keys[0]:
            yield out(*(np.concatenate(x) for x in zip(*kept)))
            kept = []
        kept.append((keys[cut:], prints[cut:]))
    if kept:
        yield out(*(np.concatenate(x) for x in zip(*kept)))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints of the same component."""
    one = prints.select("fp").distinct()
    variant = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")
    half = F.when(F.col("v") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    wild = F.expr("~shiftleft(1L, CAST(v % 32 AS INT))")
    key = F.shiftleft(F.col("v").cast("long"), 32).bitwiseOR(half.bitwiseAND(wild))
    keyed = one.select("fp", variant).select(key.alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_batches, "a long, b long").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, tk, fp, root (the component's least fingerprint) and component_id of every document."""
    prints = checkpointed(fingerprints(docs))
    one = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(prints))
    rooted = one.join(roots, one.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "tk", "fp", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest id, with all its columns.

    Ids that are null come last; of equal ids the text with the smaller key stays, and of rows that are equal in
    both the first by the hash of all columns. Reserved names: __fw_tk, __fw_n.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("m")
    keep = classes(docs).groupBy("root").agg(first).select(F.col("m.doc_id").alias("__fw_id"), F.col("m.tk").alias("__fw_key"))
    keyed = docs.withColumn("__fw_tk", text_key(F.col("text")))
    kept = keyed.join(keep, keyed.doc_id.eqNullSafe(keep["__fw_id"]) & (F.col("__fw_tk") == keep["__fw_key"]), "left_semi")
    n = F.row_number().over(Window.partitionBy("doc_id", "__fw_tk").orderBy(F.xxhash64(*docs.columns)))
    return kept.withColumn("__fw_n", n).filter("__fw_n = 1").drop("__fw_n", "__fw_tk")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
