"""Prefix trie of conversations, rolled up by pointer jumping.

Every conversation c is rebuilt: its first h turns are those of conversation c - c % 5, where h is the
unsigned crc32 of c's decimal digits modulo 9, then come its own turns after its first h. A node of the
trie is a distinct sequence of first turns. Its key is a sum of hashes of its turns, each hash taken
together with the turn's position, so keys are running sums: a conversation of any length is cut over
tasks by ranges, and the sum before a task's first rows is added afterwards (one row a task). A row
knows its own key and, less its own hash, its parent's: digest-keyed parent edges, without a join.

Rollup: each node holds a pointer to an ancestor (first its parent) and the sums of the descendants nearer
than it. A round adds every node's sums to the node it points to and replaces the pointer by that node's
own. After r rounds the sums reach 2**r levels down, so a trie of depth d takes log2(d) + 1 rounds. Hot
targets are summed before the shuffle, and joins on pointers are plain joins, whose hot keys Spark splits.

Null roles and texts are empty ones, other than that all texts count in full, by two 62-bit sums of SHA-256
hashes. Turns are ordered by turn, nulls first; ties by the SHA-256 of role and text, so that repeated rows
are repeated turns. Rows of a null conv_id belong to no conversation and are passed over. c % 5 keeps the
sign of c. A conversation whose rebuilt form has no turns ends at the root. An empty table has no nodes, not
even the root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm.common import checkpointed, dropped, shared_path

HEADS, FAMILY = 9, 5
#: Keys are sums modulo 2**62, so that two of them add up within a long.
MASK = (1 << 62) - 1
#: Decimal ids joined into one row before a node's rows meet in one task.
CHUNK = 256


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes): texts are replaced by digests before anything is shuffled."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    columns = F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(F.unhex(digest), 1, 16).alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    return conversations.filter("conv_id IS NOT NULL").select(*columns)


def _runs(c: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, c[1:] != c[:-1]])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position of each turn in its conversation, counted within the task."""
    part, last, before = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column("conv_id").to_numpy()
        starts = _runs(c)
        at = np.arange(1, len(c) + 1) - np.repeat(starts, np.diff(np.r_[starts, len(c)]))
        if c[0] == last:
            at[: starts[1] if len(starts) > 1 else len(c)] += before
        last, before = c[-1], at[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part)), b.column("conv_id"), pa.array(at), b.column("digest"), b.column("bytes")], ["part", "conv_id", "at", "digest", "bytes"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums of the hashes of (position, turn) within the task: the node's key, and its parent's."""
    part, last, before = TaskContext.get().partitionId(), None, np.zeros(2, np.uint64)
    for b in batches:
        if not b.num_rows:
            continue
        c, at = b.column("conv_id").to_numpy(), b.column("at").to_numpy()
        hashed = b"".join(hashlib.sha256(b"%d:" % i + d).digest()[:16] for i, d in zip(at.tolist(), b.column("digest").to_pylist(), strict=True))
        own = np.frombuffer(hashed, np.uint64).reshape(-1, 2)
        total = np.cumsum(own, axis=0)  # modulo 2**64, which the mask reduces further
        starts = _runs(c)
        base = np.where(starts[:, None] > 0, total[starts - 1], np.uint64(0))
        key = total - np.repeat(base, np.diff(np.r_[starts, len(c)]), axis=0)
        if c[0] == last:
            key[: starts[1] if len(starts) > 1 else len(c)] += before
        last, before = c[-1], key[-1]
        lanes = [pa.array((x & np.uint64(MASK)).astype(np.int64)) for x in (key[:, 0], key[:, 1], key[:, 0] - own[:, 0], key[:, 1] - own[:, 1])]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part)), b.column("conv_id"), b.column("at"), b.column("bytes"), *lanes], ["part", "conv_id", "at", "bytes", "k1", "k2", "p1", "p2"])


def _with_carry(table: DataFrame, carried: dict[str, str]) -> DataFrame:
    """Add to each column what the same conversation had reached in the tasks before.

    ``carried`` names for each column the one whose last value in a task goes on. Tasks hold ranges of
    (conv_id, at), so only a task's first conversation has rows before it; one row a task is collected.
    """
    values = list(dict.fromkeys(carried.values()))
    tails = table.groupBy("part").agg(F.max(F.struct("conv_id", "at", *[F.col(v).alias(f"v_{v}") for v in values])).alias("t")).collect()
    rows, conv, sums = [], None, []
    for tail in sorted(tails, key=lambda r: r.part):
        ends = [tail.t[f"v_{v}"] for v in values]
        if conv is not None:
            rows.append((tail.part, conv, *sums))
        sums = [(a + b) & MASK for a, b in zip(sums, ends, strict=True)] if tail.t.conv_id == conv else ends
        conv = tail.t.conv_id
    carry = table.sparkSession.createDataFrame(rows, ", ".join(["part long", "conv_id long", *[f"c_{v} long" for v in values]]))
    joined = table.join(F.broadcast(carry), ["part", "conv_id"], "left")
    return joined.select("part", "conv_id", *[((F.col(c) + F.coalesce(f"c_{carried[c]}", F.lit(0))) % (MASK + 1)).alias(c) if c in carried else F.col(c) for c in table.columns if c not in ("part", "conv_id")])


class _Tables:
    """Tables in the shared folder, which are dropped when no step needs them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, name: str, df: DataFrame) -> DataFrame:
        self.paths.append(shared_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.parquet(self.paths[-1])

    def drop(self, keep: int = 0) -> None:
        gone, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        dropped(self.spark, gone)


def rebuilt(conversations: DataFrame, tables: _Tables) -> tuple[DataFrame, DataFrame]:
    """Rows (part, conv_id, at, bytes, k1, k2, p1, p2) of all rebuilt turns; (conv_id, length) of all conversations."""
    read = tables.written("trie-turns", turns(conversations))
    dealt = read.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "digest").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")
    own = tables.written("trie-numbered", dealt.mapInArrow(_numbered, "part long, conv_id long, at long, digest binary, bytes long"))
    own = _with_carry(own, {"at": "at"}).drop("part")
    lengths = own.groupBy("conv_id").agg(F.max("at").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = lengths.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base", "left")
    plan = tables.written("trie-plan", plan.select("conv_id", "base", "n", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("m")))
    first = own.filter(F.col("at") < HEADS).withColumnRenamed("conv_id", "base")
    heads = plan.select("conv_id", "base", "m").filter("m > 0").join(first, "base").filter("at <= m").select("conv_id", "at", "digest", "bytes")
    # own turns move up where the other conversation has fewer than h turns
    moved = plan.filter("m < h AND n > h").select("conv_id", (F.col("h") - F.col("m")).alias("up"))
    tails = own.filter(F.col("at") > h).join(moved, "conv_id", "left").select("conv_id", (F.col("at") - F.coalesce("up", F.lit(0))).alias("at"), "digest", "bytes")
    rows = heads.unionByName(tails).repartitionByRange("conv_id", "at").sortWithinPartitions("conv_id", "at")
    keyed = tables.written("trie-keyed", rows.mapInArrow(_summed, "part long, conv_id long, at long, bytes long, k1 long, k2 long, p1 long, p2 long"))
    length = F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return _with_carry(keyed, {"k1": "k1", "k2": "k2", "p1": "k1", "p2": "k2"}), plan.select("conv_id", length.alias("length"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring ids of one node, joined in rows of at most CHUNK."""
    for b in batches:
        if not b.num_rows:
            continue
        k1, k2, c = (b.column(n).to_numpy() for n in ("k1", "k2", "conv_id"))
        cuts = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]).tolist() + [len(c)]
        spans = [(s, min(s + CHUNK, end)) for start, end in zip(cuts, cuts[1:], strict=False) for s in range(start, end, CHUNK)]
        firsts = [s for s, _ in spans]
        ids = pa.array([",".join(map(str, c[s:e].tolist())) for s, e in spans])
        yield pa.RecordBatch.from_arrays([pa.array(k1[firsts]), pa.array(k2[firsts]), pa.array(c[firsts]), ids], ["k1", "k2", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, fed chunk by chunk: nothing but the hash's state is held."""
    names = ["k1", "k2", "ends_sha256"]
    at, digest, done = None, None, []
    for b in batches:
        for k1, k2, ids in zip(*(b.column(n).to_pylist() for n in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) == at:
                digest.update(b"," + ids.encode())
            else:
                if at:
                    done.append((*at, digest.hexdigest()))
                at, digest = (k1, k2), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], pa.string() if i == 2 else pa.int64()) for i in range(3)], names)
        done = []
    if at:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, digest.hexdigest())], names)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(k1, k2, conv_id) to (k1, k2, ends_sha256): ids in ascending order, joined by commas."""
    sorted_ends = ends.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    chunks = sorted_ends.mapInArrow(_packed, "k1 long, k2 long, first long, ids string")
    return chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digested, "k1 long, k2 long, ends_sha256 string")


def rolled_up(nodes: DataFrame, depth: int, tables: _Tables) -> DataFrame:
    """(k1, k2, n_leaves, saved_tokens) summed over subtrees, from nodes(k1, k2, p1, p2, depth, leaves, saved)."""
    state = tables.written("trie-rollup", nodes.select("k1", "k2", F.col("p1").alias("q1"), F.col("p2").alias("q2"), "depth", "leaves", "saved"))
    held = tables.paths.pop()
    step = 1
    while step <= depth:
        sums = state.filter(F.col("depth") >= step).groupBy("q1", "q2").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        sums = sums.select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), "more_leaves", "more_saved")
        target = state.filter(F.col("depth") >= step).select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("q1").alias("r1"), F.col("q2").alias("r2"))
        # nodes nearer to the root than two steps have no ancestor that far: no join, so no hot null key
        far = state.filter(F.col("depth") >= 2 * step).join(target, ["q1", "q2"]).select("k1", "k2", F.col("r1").alias("q1"), F.col("r2").alias("q2"), "depth", "leaves", "saved")
        near = state.filter(F.col("depth") < 2 * step).withColumns({"q1": F.lit(None).cast("long"), "q2": F.lit(None).cast("long")}).select(*far.columns)
        added = far.unionByName(near).join(sums, ["k1", "k2"], "left")
        total = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        state = tables.written("trie-rollup", added.select("k1", "k2", "q1", "q2", "depth", total("leaves"), total("saved")))
        dropped(tables.spark, [held])
        held = tables.paths.pop()
        step *= 2
    tables.paths.append(held)
    return state.select("k1", "k2", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    spark = conversations.sparkSession
    tables = _Tables(spark)
    try:
        rows, lengths = rebuilt(conversations, tables)
        root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("length").alias("depth")).first()
        grouped = rows.groupBy("k1", "k2").agg(*[F.max(c).alias(c) for c in ("p1", "p2", "at", "bytes")], F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
        below = grouped.select("k1", "k2", "p1", "p2", F.col("at").alias("depth"), "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
        below = tables.written("trie-nodes", below)
        top = [(0, 0, None, None, 0, root.conv_id, root.n_convs, 0)] if root.n_convs else []
        every = below.unionByName(spark.createDataFrame(top, "k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, n_convs long, saved long"))
        children = below.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
        nodes = every.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        nodes = tables.written("trie-children", nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")))
        last = rows.groupBy("conv_id").agg(F.max_by(F.struct("k1", "k2"), "at").alias("k")).select("k.k1", "k.k2", "conv_id")
        turnless = lengths.filter("length = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
        ends = ends_digest(last.unionByName(turnless))
        sums = rolled_up(nodes, root.depth or 0, tables)
        parent = nodes.filter("depth > 0 AND n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
        low = nodes.filter("depth > 1").join(parent, ["p1", "p2"]).select(*nodes.columns, "parent_conv_id")
        high = nodes.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root.conv_id)).cast("long"))
        out = low.unionByName(high).join(sums, ["k1", "k2"]).join(ends, ["k1", "k2"], "left")
        nothing = hashlib.sha256(b"").hexdigest()
        return checkpointed(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))
    finally:
        tables.drop()


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# In SQL the rollup is a join of every node with its ancestors, found through its smallest member's prefixes.
ORACLE = {
    "op13_prefix_trie": rf"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) % {HEADS} AS h FROM own GROUP BY conv_id),
plan AS (SELECT n.conv_id, n.conv_id - n.conv_id % {FAMILY} AS base, n.h, least(n.h, coalesce(b.n, 0)) AS m FROM n LEFT JOIN n b ON b.conv_id = n.conv_id - n.conv_id % {FAMILY}),
r AS (SELECT p.conv_id, pos, digest, bytes FROM plan p JOIN own o ON o.conv_id = p.base AND pos <= m
  UNION ALL SELECT p.conv_id, pos - h + m, digest, bytes FROM plan p JOIN own o ON o.conv_id = p.conv_id AND pos > h),
pre AS (SELECT conv_id, pos AS depth, bytes, sha256(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS k FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM plan),
up AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS pk, lead(k) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS last FROM pre),
node AS (SELECT k, any_value(pk) AS pk, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM up GROUP BY k),
kids AS (SELECT pk AS k, count(*) AS n_children FROM node WHERE pk IS NOT NULL GROUP BY pk),
sums AS (SELECT p.k, count(*) FILTER (kids.k IS NULL) AS n_leaves, sum(d.saved) AS saved_tokens FROM node d JOIN pre p ON p.conv_id = d.conv_id AND p.depth <= d.depth LEFT JOIN kids ON kids.k = d.k GROUP BY p.k)
SELECT node.conv_id, node.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, node.ends_sha256
FROM node LEFT JOIN node parent ON parent.k = node.pk LEFT JOIN kids ON kids.k = node.k JOIN sums ON sums.k = node.k"""
}
