"""Benchmark decontamination over a distributed positional inverted index.

1. Count, over all documents, every term that the benchmark uses.
2. Store postings (term, document, position and the words around it) of the three rarest terms of
   each benchmark window, in the cluster's shared folder.
3. Phrases: start each window from its rarest term, shift the posting list by the term's offset,
   intersect with the next rarest terms at their offsets, then require the whole phrase.
4. Proximity: places where at least SHARE of a window's words stand where the phrase has them or at
   most SLOP words from there. Two of ten words may be missing, so one of the three rarest is there:
   each of the three, where it stands, fixes candidate places. Windows under LEAST words are sought as phrases only.

Proximity matches are reported beside the phrases (n_near_windows) and don't make a document
contaminated. Rare terms are tied by their place in the window. Null texts count as empty: no words,
no hits. Items without words have no window. Repeated rows with the same id and text get the same
counts. Very long texts are read whole. Empty tables are allowed on either side. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldweave.llm.common import ascii_words, shared_path, small_side, text_key

WINDOW = 10
#: Share of a window's words that a proximity match holds, how far each may stand from its place, and the least window.
SHARE, SLOP, LEAST = 0.8, 2, 5
SEEDS = 3


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows: win, words, n (its length)."""
    words = benchmark.select(ascii_words(F.col("text")).alias("iw")).filter(F.size("iw") > 0)
    starts = words.select("iw", F.explode(F.sequence(F.lit(0), F.greatest(F.size("iw") - size, F.lit(0)))).alias("s"))
    cut = starts.select(F.slice("iw", F.col("s") + 1, size).alias("words")).distinct()
    return cut.select(F.xxhash64(F.array_join("words", " ")).alias("win"), "words", F.size("words").alias("n"))


def window_items(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """win, item_id: the items that hold each window."""
    words = benchmark.select("item_id", ascii_words(F.col("text")).alias("iw")).filter(F.size("iw") > 0)
    starts = words.select("item_id", "iw", F.explode(F.sequence(F.lit(0), F.greatest(F.size("iw") - size, F.lit(0)))).alias("s"))
    return starts.select(F.xxhash64(F.array_join(F.slice("iw", F.col("s") + 1, size), " ")).alias("win"), "item_id").distinct()


def term_counts(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """term, times: occurrences in all documents of each term of the windows."""
    terms = wins.select(F.explode("words").alias("term")).distinct()
    tokens = docs.select(F.explode_outer(ascii_words(F.col("text"))).alias("term"))
    seen = tokens.join(small_side(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("times"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("times", F.lit(0)).alias("times"))


def rarest_terms(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its terms' offsets, rarest first (o1, o2, o3), and the rarest term itself."""
    each = wins.select("win", F.posexplode("words").alias("off", "term")).join(counts, "term")
    order = each.groupBy("win").agg(F.array_sort(F.collect_list(F.struct("times", "off"))).alias("by"))
    pick = lambda i: F.coalesce(F.get("by", F.lit(i))["off"], F.get("by", F.lit(0))["off"])
    return wins.join(order, "win").select("win", "words", "n", *(pick(i).alias(f"o{i + 1}") for i in range(SEEDS))).withColumn("term", F.get("words", F.col("o1")))


def seeds_of(planned: DataFrame) -> DataFrame:
    """win, words, n, off, term: every window once for each of its rarest terms."""
    offsets = F.array_distinct(F.array(*(f"o{i + 1}" for i in range(SEEDS))))
    return planned.select("win", "words", "n", F.explode(offsets).alias("off")).withColumn("term", F.get("words", F.col("off")))


def store_postings(docs: DataFrame, terms: DataFrame, path: str, reach: int = WINDOW - 1) -> DataFrame:
    """Write and reread the index: term, doc_id, tk, pos and the words within reach, from lo on."""
    words = docs.select("doc_id", text_key(F.col("text")).alias("tk"), ascii_words(F.col("text")).alias("w"))
    # no filter on the words: Spark would push it down and split every text twice
    tokens = words.select("doc_id", "tk", "w", F.explode_outer(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))).alias("pos"))
    lo = F.greatest(F.col("pos") - reach, F.lit(0))
    postings = tokens.withColumn("term", F.get("w", F.col("pos"))).join(small_side(terms), "term")
    postings.select("term", "doc_id", "tk", "pos", lo.alias("lo"), F.slice("w", lo + 1, F.col("pos") - lo + reach + 1).alias("around")).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def phrase_matches(postings: DataFrame, wins: DataFrame) -> DataFrame:
    """doc_id, tk, win, start, n: exact places of windows, from rare terms to the whole phrase."""
    held = postings.join(small_side(wins), "term").withColumn("start", F.col("pos") - F.col("o1"))
    word = lambda off: F.get("around", F.col("start") - F.col("lo") + F.col(off))
    want = lambda off: F.get("words", F.col(off))
    met = held.filter((F.col("start") >= 0) & (word("o2") == want("o2")) & (word("o3") == want("o3")))
    whole = met.filter(F.slice("around", F.greatest(F.col("start") - F.col("lo") + 1, F.lit(1)), F.col("n")) == F.col("words"))
    return whole.select("doc_id", "tk", "win", "start", "n").distinct()


def proximity_matches(postings: DataFrame, seeds: DataFrame, slop: int = SLOP, share: float = SHARE) -> DataFrame:
    """doc_id, tk, win, start, met: places that hold at least ``share`` of a window's words.

    A word counts if it stands at most ``slop`` words from where the phrase would have it.
    """
    held = postings.join(small_side(seeds.filter(F.col("n") >= LEAST)), "term")
    at = F.col("pos") - F.col("off") - F.col("lo")  # where the phrase would begin in the words around
    enough = F.ceil(F.lit(share) * F.col("n"))
    # words that are there at all, in any order: most places end here
    some = F.size(F.array_intersect("words", "around")) + F.col("n") - F.size(F.array_distinct("words"))
    stand = lambda w, i: F.array_contains(F.slice("around", F.greatest(at + i - slop, F.lit(0)) + 1, F.greatest(F.lit(2 * slop + 1) + F.least(at + i - slop, F.lit(0)), F.lit(0))), w)
    met = F.size(F.filter(F.transform("words", stand), lambda x: x))
    found = held.filter(some >= enough).withColumn("met", F.when(some >= enough, met)).filter(F.col("met") >= enough)
    return found.select("doc_id", "tk", "win", (F.col("pos") - F.col("off")).alias("start"), "met").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: words, words hit, items with windows found, whether any was, and the windows that
    stand in it only in proximity."""
    spark = docs.sparkSession
    wins = windows(benchmark, size)
    planned = rarest_terms(wins, term_counts(docs, wins))
    plan_path = shared_path(spark, "windows")
    planned.write.parquet(plan_path)  # the counts are taken once
    planned = spark.read.parquet(plan_path)
    seeds = seeds_of(planned)
    postings = store_postings(docs, seeds.select("term").distinct(), shared_path(spark, "postings"), size - 1 + SLOP)
    found_path = shared_path(spark, "matches")
    phrase_matches(postings, planned).write.parquet(found_path)
    found = spark.read.parquet(found_path)
    key = ["doc_id", "tk"]
    so_far = Window.partitionBy(*key).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("start") + F.col("n") - F.greatest("start", F.coalesce(F.max(F.col("start") + F.col("n")).over(so_far), F.lit(0)))
    hits = found.select(*key, "start", "n").distinct().withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    items = found.select(*key, "win").distinct().join(small_side(window_items(benchmark, size)), "win").groupBy(*key).agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    exact = found.select("doc_id", "tk", "win").distinct().toDF("id3", "tk3", "win3")
    close = proximity_matches(postings, seeds).select("doc_id", "tk", "win").distinct()
    near = close.join(exact, close.doc_id.eqNullSafe(exact.id3) & (close.tk == exact.tk3) & (close.win == exact.win3), "left_anti").groupBy("doc_id", "tk").agg(F.count(F.lit(1)).alias("n_near")).toDF("id4", "tk4", "n_near")
    both = hits.join(items, [hits.doc_id.eqNullSafe(items.doc_id), hits.tk == items.tk], "left").select(hits.doc_id.alias("id2"), hits.tk.alias("tk2"), "n_hit", "items")
    counted = docs.select("doc_id", text_key(F.col("text")).alias("tk"), F.size(ascii_words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_or_none = F.coalesce("items", F.array().cast("array<string>"))
    told = counted.join(both, counted.doc_id.eqNullSafe(both.id2) & (counted.tk == both.tk2), "left")
    return told.join(near, told.doc_id.eqNullSafe(near.id4) & (told.tk == near.tk4), "left").select(
        "doc_id",
        "tk",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_or_none).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items_or_none), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near_windows"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("tk")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op7_decontamination": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
win AS (SELECT item_id, words[s + 1:s + {WINDOW}] AS words FROM (SELECT item_id, words, unnest(range(0, greatest(len(words) - {WINDOW}, 0) + 1)) AS s FROM b WHERE len(words) > 0)),
n AS (SELECT DISTINCT len(words) AS n FROM win),
d AS (SELECT doc_id, n, words[s + 1:s + n] AS words, s FROM (SELECT doc_id, n, words, unnest(range(0, len(words) - n + 1)) AS s FROM w, n WHERE len(words) >= n)),
m AS (SELECT DISTINCT doc_id, item_id, words, s, n FROM d JOIN win USING (words)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
dw AS (SELECT DISTINCT words, len(words) AS n FROM win WHERE len(words) >= {LEAST}),
wt AS (SELECT words, n, unnest(words) AS t, unnest(range(n)) AS o FROM dw),
dt AS (SELECT doc_id, unnest(words) AS t, unnest(range(len(words))) AS p FROM w),
tc AS (SELECT t, count(*) AS c FROM dt WHERE t IN (SELECT t FROM wt) GROUP BY t),
sd AS (SELECT words, n, t, o FROM (SELECT wt.*, row_number() OVER (PARTITION BY words ORDER BY coalesce(c, 0), o) AS r FROM wt LEFT JOIN tc USING (t)) WHERE r <= {SEEDS}),
c AS (SELECT DISTINCT doc_id, sd.words, n, p - o AS s FROM dt JOIN sd USING (t)),
k AS (SELECT DISTINCT doc_id, c.words FROM c JOIN w USING (doc_id) WHERE len(list_intersect(c.words, w.words[greatest(s - {SLOP}, 0) + 1:s + n + {SLOP}])) + n - len(list_distinct(c.words)) >= ceil({SHARE} * n)
  AND len(list_filter(range(n), lambda i: list_contains(w.words[greatest(s + i - {SLOP}, 0) + 1:s + i + {SLOP} + 1], c.words[i + 1]))) >= ceil({SHARE} * n)),
near AS (SELECT doc_id, count(DISTINCT words) AS n_near_windows FROM k WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = k.doc_id AND m.words = k.words) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_windows, 0)::BIGINT AS n_near_windows
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN near USING (doc_id)"""
}
