"""Toxicity by class-conditional Kneser-Ney models.

A word with its left neighbour is told in four steps: its first four bytes, its first six given
those, the whole word given those six, and the left neighbour given the word. Each class (toxic,
ordinary) has discounted counts of the steps in labelled texts. What the discounts free goes to a
backoff that both classes share: the continuation counts of all documents, that is in how many
different left contexts a word stands (a stem: the sum over its words). A form that one class never
showed falls back to its stem and the shared counts; a pair that no two labelled texts show backs
off in both classes and says nothing.

A toxic text is mostly ordinary words, so the toxic model of a text mixes SHARE of the toxic class
with the ordinary one. The log-likelihoods of both models are compared per word, and a logistic
curve over asinh(difference / SHARE) turns the length-normalised difference into a score.

The continuation counts are one row for each word of the corpus, so what is gathered grows with the
input and stays distributed. Left contexts are counted in two bitmaps of 64 bits that merge by OR:
one takes all contexts, the other one in 32; counts of a few contexts are exact but for chance
clashes of 1 in 64, counts over about 150 are estimates from the second (an error of some 15 %).

Labels come from rows whose crc32(doc_id) mod 5 is not 0, of which a sample by hash of about
TRAIN_ROWS rows and TRAIN_BYTES bytes at most is learnt from (the documented bound of the fit, so
the model that is broadcast is bounded too). The curve is fitted on the sample's rows of remainder
1, at most CURVE_ROWS, scored by a model without them.

Null and empty texts get the score of a text without evidence. Very long texts are read whole. Rows
labelled more than once count as toxic if any label says so; null labels and null ids are not learnt
from, and a null id is not held out. Without labels of both classes the score is the share of toxic
labels (0 if none). Repeated rows are scored alike, an empty table gives no rows, other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import bytewords as bw
from fieldweave.llm.common import checkpointed, release, shared_path, text_key

#: Bounds on the labelled rows that the fit takes, on their bytes, and on the rows of the curve.
TRAIN_ROWS, TRAIN_BYTES, CURVE_ROWS = 20_000, 30_000_000, 10_000
#: Discounts of steps that one, two, or more texts of a class show.
DISCOUNTS = (0.9, 1.4, 1.6)
#: Share of toxic words in the model of a toxic text.
SHARE = 0.02
#: Words without evidence that every text counts besides its own.
PRIOR_WORDS = 30
#: Bytes of text worked off at once; some 60 times as many are held by a worker. The power tables take the next power of two.
BLOCK_BYTES = (1 << 19) - 1
#: Words gathered by a task before they are passed on.
HELD_WORDS = 300_000
SALTS = [np.uint64(x) for x in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35, 0x27D4EB2F165667C5, 0x9E3779B185EBCA87)]
#: Documents of each class that show b after a, without and with those of the curve apart.
EVENT = "level int, a long, b long, t1 int, o1 int, t int, o int"
#: Log ratios of a step, and of one that no text shows after it; with 1: by the model without the rows of the curve.
RATIOS = ("r1", "u1", "r", "u")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _words(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys of each word: four bytes, six bytes, word, left word (its text's first: a mark); and its row."""
    low, starts, ends, rows = bw.words(buffer, offsets)
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return none, none, none, none, rows
    size = np.minimum(ends - starts, 6)
    padded = np.concatenate([low, np.zeros(6, np.uint8)])
    packed = np.zeros(len(starts), np.uint64)
    for k in range(6):
        packed |= np.where(k < size, padded[starts + k], 0).astype(np.uint64) << np.uint64(8 * k)
        if k == 3:
            four = bw.mixed(packed ^ SALTS[0])
    word = bw.mixed(bw.span_hashes(low, starts, ends) ^ SALTS[2])
    left = np.append(SALTS[3], word[:-1])
    left[np.append(True, rows[1:] != rows[:-1])] = SALTS[3]
    return four, bw.mixed(packed ^ SALTS[1]), word, left, rows


def _pairs(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    return bw.mixed(left * SALTS[3] + word)


def _merged(word: np.ndarray, rest: list[np.ndarray], bits: list[np.ndarray]) -> list[np.ndarray]:
    """One row a word: any of the rest, bits by OR."""
    order = np.argsort(word, kind="stable")
    w = word[order]
    first = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, int)
    return [w[first], *(x[order][first] for x in rest), *(np.bitwise_or.reduceat(x[order], first) if len(first) else x for x in bits)]


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their stems and the bitmaps of their left contexts."""
    held: list[list[np.ndarray]] = []
    one = np.uint64(1)

    def out(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        cols = [np.concatenate(x) for x in zip(*parts)]
        return _merged(cols[0], cols[1:3], cols[3:])

    def batch_of(cols: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in cols], ["word", "six", "four", "near", "far"])

    for batch in batches:
        buffer, offsets = bw.text_buffer(batch.column("text"))
        for a, b in bw.blocks(offsets, BLOCK_BYTES):
            four, six, word, left, _ = _words(buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            spread = bw.mixed(left ^ SALTS[1])
            near = one << (spread & np.uint64(63))
            far = np.where(spread >> np.uint64(59) == 0, one << (spread >> np.uint64(6) & np.uint64(63)), np.uint64(0))
            held.append(_merged(word, [six, four], [near, far]))
            if sum(len(x[0]) for x in held) >= HELD_WORDS:
                held = [out(held)]
                if len(held[0][0]) >= HELD_WORDS // 2:
                    yield batch_of(held.pop())
    if held:
        yield batch_of(out(held))


def contexts(docs: DataFrame) -> DataFrame:
    """word, six, four and n, in how many left contexts each word of all documents stands."""
    seen = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_context_batches, "word long, six long, four long, near long, far long")
    each = seen.groupBy("word").agg(F.first("six").alias("six"), F.first("four").alias("four"), F.bit_or("near").alias("near"), F.bit_or("far").alias("far"))
    free = lambda c: F.greatest(64 - F.bit_count(c), F.lit(0.5)) / 64
    n = F.when(F.bit_count("near") <= 58, -64 * F.log(free("near"))).otherwise(F.greatest(-64 * 32 * F.log(free("far")), F.lit(150.0)))
    return each.select("word", "six", "four", n.alias("n"))


def _event_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps (b after a) of labelled texts by class; each text counts a step once."""
    names = [x.split()[0] for x in EVENT.split(", ")]
    for batch in batches:
        buffer, offsets = bw.text_buffer(batch.column("text"))
        toxic, curve = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("toxic", "curve"))
        for x, y in bw.blocks(offsets, BLOCK_BYTES):
            four, six, word, left, rows = _words(buffer[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
            if not len(word):
                continue
            for level, a, b in ((0, np.zeros_like(four), four), (1, four, six), (2, six, word), (3, word, left)):
                order = np.lexsort((rows, a, b))
                a, b, r = a[order], b[order], rows[order]
                other = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
                new = other | np.append(True, r[1:] != r[:-1])
                a, b, r, other = a[new], b[new], r[new], other[new]
                start = np.flatnonzero(other)
                t, c = toxic[x:y][r] == 1, curve[x:y][r]
                sums = [np.add.reduceat(v.astype(np.int32), start) for v in (t & c, ~t & c, t & ~c, ~t & ~c)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), level, np.int32)), pa.array(a[start].view(np.int64)), pa.array(b[start].view(np.int64)), *(pa.array(v, pa.int32()) for v in sums)], names)


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        yield pa.RecordBatch.from_arrays([pa.array(_pairs(b, a).view(np.int64)), batch.column("r1"), batch.column("r")], ["key", "r1", "r"])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def step_ratios(events: DataFrame, corpus: DataFrame) -> DataFrame:
    """key and RATIOS of the steps that labelled texts show; key 0 stands for the empty history."""
    spark = events.sparkSession
    classes = {"t1": F.col("t"), "o1": F.col("o"), "t": F.col("t") + F.col("t1"), "o": F.col("o") + F.col("o1")}
    seen = _written(events.groupBy("level", "a", "b").agg(*(F.sum(c).alias(c) for c in classes)), "steps").select("level", "a", "b", *(v.cast("double").alias(c) for c, v in classes.items()))
    by = _written(seen.groupBy("level", "a").agg(*(F.sum(c).alias(f"h_{c}") for c in classes), *(F.count_if(F.col(c) > 0).alias(f"k_{c}") for c in classes)), "histories")

    def discounted(c: str, shared):
        """Discounted share of a step, and what the discount frees dealt out by the lower order."""
        one, two, more = DISCOUNTS
        n, h, k = F.col(c), F.col(f"h_{c}"), F.col(f"k_{c}")
        off = F.when(n > 2, more).when(n > 1, two).when(n > 0, one).otherwise(0.0)
        return F.when(h > 0, (n - off + F.least(one * k, h) * shared) / h).otherwise(shared)

    ratio = lambda x, y: F.log(F.greatest(x, F.lit(1e-300)) / F.greatest(y, F.lit(1e-300)))
    # the shared lower order: a step's left contexts over those of its history, from all documents
    counts = [corpus.select(F.lit(2).alias("level"), F.col("word").alias("b"), "n")]
    counts += [corpus.groupBy(F.col(c).alias("b")).agg(F.sum("n").alias("n")).select(F.lit(i).alias("level"), "b", "n") for i, c in enumerate(("four", "six"))]
    counts = counts[0].unionByName(counts[1]).unionByName(counts[2])
    above = counts.select((F.col("level") + 1).alias("level"), F.col("b").alias("a"), F.col("n").alias("above")).unionByName(corpus.agg(F.sum("n").alias("above")).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("a"), "above"))
    release(spark)
    steps = seen.filter("level < 3 OR t + o >= 2").join(counts, ["level", "b"], "left").join(above, ["level", "a"], "left").join(by, ["level", "a"])
    shared = F.least(F.when(F.col("level") < 3, F.coalesce("n", F.lit(0.5))).otherwise(1.0) / F.coalesce("above", F.lit(1.0)), F.lit(1.0))
    steps = _written(steps.select("level", "a", "b", *(ratio(discounted(t, shared), discounted(o, shared)).alias(r) for r, t, o in (("r1", "t1", "o1"), ("r", "t", "o")))), "ratios")
    freed = lambda c: F.when(F.col(f"h_{c}") > 0, F.least(DISCOUNTS[0] * F.col(f"k_{c}") / F.col(f"h_{c}"), F.lit(1.0))).otherwise(1.0)
    ends = by.filter("level < 3").select(F.col("a").alias("key"), ratio(freed("t1"), freed("o1")).alias("u1"), ratio(freed("t"), freed("o")).alias("u"))
    known = steps.filter("level < 3").select(F.col("b").alias("key"), "r1", "r").join(ends, "key", "full")
    left = steps.filter("level = 3").select("a", "b", "r1", "r").mapInArrow(_pair_batches, "key long, r1 double, r double")
    every = known.unionByName(left, allowMissingColumns=True)
    return every.select("key", *(F.coalesce(c, F.lit(0.0)).cast("float").alias(c) for c in RATIOS))


class Model:
    """Log ratios of the steps by key, sorted, and the curve. Its size is bounded by the labelled sample."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ratios = keys[order], ratios[:, order].astype(np.float16)
        self.curve = np.zeros(2)

    def _at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def differences(self, buffer: np.ndarray, offsets: np.ndarray, whole: bool = True) -> np.ndarray:
        """Log-likelihood of the toxic model less that of the ordinary one, per word, of each text."""
        four, six, word, left, rows = _words(buffer, offsets)
        n = len(offsets) - 1
        if not len(word) or not len(self.keys):
            return np.zeros(n)
        step, end = self.ratios[2:].astype(np.float32) if whole else self.ratios[:2].astype(np.float32)
        _, once, back = np.unique(word, return_index=True, return_inverse=True)
        total, open_ = np.zeros(len(once), np.float32), np.ones(len(once), bool)
        last = np.zeros(len(once), np.uint64)
        for key in (four[once], six[once], word[once]):
            at, known = self._at(key)
            total += np.where(open_ & known, step[at], 0)
            was, seen = self._at(last)
            total += np.where(open_ & ~known & seen, end[was], 0)
            open_ &= known
            last = key
        pair = _pairs(left, word)
        if not hasattr(self, "sieve"):
            self.sieve = np.zeros(1 << 24, bool)
            self.sieve[(self.keys >> np.uint64(40)).astype(np.int64)] = True
        maybe = np.flatnonzero(self.sieve[(pair >> np.uint64(40)).astype(np.int64)])
        at, known = self._at(pair[maybe])
        ratio = total[back]
        ratio[maybe[known]] += step[at[known]]
        mixture = np.log1p(SHARE * np.expm1(ratio.astype(np.float64)))
        return np.bincount(rows, mixture, n) / (np.bincount(rows, minlength=n) + PRIOR_WORDS)

    def fit_curve(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        """A logistic curve by Newton's steps, with a slight ridge; the share of toxic labels where there is no contrast."""
        w = np.array([0.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6))])
        x = np.arcsinh(x / SHARE)
        if len(y) and y.min() < y.max() and x.std() > 0:
            spread = x.std()
            z = np.c_[x / spread, np.ones(len(x))]
            w = np.zeros(2)
            for _ in range(60):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([0.1, 1e-6]), z.T @ (p - y) + [0.1 * w[0], 0])
                w -= move
                if np.abs(move).max() < 1e-9:
                    break
            w = np.array([w[0] / spread, w[1]])
        self.curve = w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * np.arcsinh(x / SHARE) + self.curve[1], -30, 30)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "sieve"}


def _thinned(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """About that share of the rows, by a hash of their id."""
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Count contexts over all documents and steps over the labelled sample; fit the curve."""
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sized = docs.select(F.col("doc_id").cast("long"), F.octet_length("text").alias("size"))  # texts stay where they are
    found = sized.join(marked, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("share"), F.sum("size").alias("bytes"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    share, bytes_ = found.share or 0.0, found.bytes or 0
    if not found.toxic or found.toxic == found.n:
        model = Model(np.zeros(0, np.uint64), np.zeros((4, 0)))
        model.fit_curve(np.zeros(0), np.zeros(0), share)
        return model
    part = min(1.0, rows / found.n, TRAIN_BYTES / max(bytes_, 1))
    curve = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    chosen = checkpointed(_thinned(marked.join(sized.select("doc_id").distinct(), "doc_id", "left_semi"), part, 0))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    # the share was chosen to leave about TRAIN_ROWS ids; more than twice as many are not broadcast
    sample = _written(texts.join(F.broadcast(chosen) if chosen.count() <= 2 * rows else chosen, "doc_id").withColumn("curve", curve), "labelled")
    corpus = _written(contexts(docs), "contexts")
    release(docs.sparkSession)
    events = sample.mapInArrow(_event_batches, EVENT)
    ratios = step_ratios(events, corpus).toArrow()
    keys = ratios.column("key").to_numpy().view(np.uint64)
    model = Model(keys, np.stack([ratios.column(c).to_numpy() for c in RATIOS]))
    del ratios, keys
    release(docs.sparkSession)
    few = _thinned(sample.filter("curve"), 5 * CURVE_ROWS / max(part * found.n, 1), 1)
    points = _differences(few.select("toxic", "text"), model, False, "toxic int").toArrow()
    model.fit_curve(points.column("x").to_numpy(), points.column("toxic").to_numpy(), share)
    return model


def _differences(rows: DataFrame, model: Model, whole: bool, columns: str) -> DataFrame:
    """The other columns and x, the difference of each text; the broadcast goes with the plan."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in columns.split(", ")]

    def batches_scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer, offsets = bw.text_buffer(batch.column("text"))
            x = np.zeros(batch.num_rows)
            for a, b in bw.blocks(offsets, BLOCK_BYTES):
                x[a:b] = held.value.differences(buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], whole)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x), pa.array(held.value.score(x))], [*names, "x", "score"])

    return rows.mapInArrow(batches_scored, f"{columns}, x double, score double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, tk (text key), score and predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("tk"), F.col("text").cast("binary").alias("text"))
    scored = _differences(rows, model, True, "doc_id long, tk long")
    return scored.select("doc_id", "tk", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
