"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces of a public model file sit in a double-array trie with their log scores. A text gets a
leading space, spaces become the whitespace marker, and the best-scoring split of each stretch is
found by Viterbi; characters without a piece fall back to byte pieces. Pieces never hold a marker
after other characters (checked when loading), so stretches that begin with markers are split on
their own. Of splits with equal scores the one whose last piece is longest wins.

Models whose scores are merge ranks carry no log scores; theirs follow Zipf's law from the rank.
A literal marker in a text is written as bytes, so decoding gives every text back exactly.

Null texts stay null: no pieces, null ids, null decoding. An empty text has no pieces, empty ids and
decodes to itself. Very long texts are coded whole, stretch by stretch. An empty table gives no rows.
Lone surrogates can't occur in Spark's UTF-8 strings. Repeated rows are coded alike; other columns
are ignored, whatever their names. The model file is read once on the driver, and its bytes are
broadcast (some hundred KB); each worker builds the trie from them.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import string
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Log score of a byte piece, below any split into real pieces of the same text.
BYTE_SCORE = -30.0
#: Stretches whose splits a worker remembers; longer ones are split one by one and forgotten.
REMEMBERED, LONG = 300_000, 48


LATIN = re.compile("[a-zA-Z\u00c0-\u024f]")


class DoubleArray:
    """Double-array trie over UTF-8 bytes: child = base[node] + byte + 1 if check[child] == node."""

    def __init__(self, words: list[bytes]):
        children: dict[int, dict[int, int]] = {0: {}}
        value: dict[int, int] = {}
        count = 1
        for i, word in enumerate(words):
            node = 0
            for byte in word:
                node_children = children[node]
                if byte not in node_children:
                    node_children[byte] = count
                    children[count] = {}
                    count += 1
                node = node_children[byte]
            value[node] = i
        size = count + 1024
        base, check, val = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
        used = np.zeros(size, bool)
        used[0] = True
        place = {0: 0}
        hints = [1] * 257  # where to look for room, by number of children; moves on only
        todo = [(-len(children[0]), 0)]  # nodes with many children first, while there is room
        while todo:
            _, node = heapq.heappop(todo)
            at = place[node]
            val[at] = value.get(node, -1)
            if not children[node]:
                continue
            labels = np.array(sorted(children[node])) + 1
            start = max(hints[len(labels)], int(labels[0]))
            while True:
                if start + 1024 > len(used):
                    grow = len(used)
                    used, base = np.append(used, np.zeros(grow, bool)), np.append(base, np.zeros(grow, np.int64))
                    check, val = np.append(check, np.full(grow, -1)), np.append(val, np.full(grow, -1))
                first = start + np.flatnonzero(~used[start : start + 256])  # places for the first child
                fits = first[~used[(first - labels[0])[:, None] + labels].any(axis=1)]
                if len(fits):
                    break
                start += 256
            base[at] = fits[0] - labels[0]
            hints[len(labels)] = max(hints[len(labels)], start)
            for label in labels.tolist():
                child = int(base[at]) + label
                used[child], check[child] = True, at
                follow = children[node][label - 1]
                place[follow] = child
                heapq.heappush(todo, (-len(children[follow]), follow))
        self.base, self.check, self.value = base.tolist(), check.tolist(), val.tolist()

    def prefixes(self, text: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, word) of every word that begins at the place."""
        base, check, value, node = self.base, self.check, self.value, 0
        for end in range(at, len(text)):
            child = base[node] + text[end] + 1
            if child >= len(check) or check[child] != node:
                return
            node = child
            if value[node] >= 0:
                yield end + 1, value[node]


class PieceModel:
    """Pieces, their log scores, byte pieces and the trie. Its size is that of the vocabulary."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """pieces: (text, score, kind) by id; kind is normal, byte or control."""
        ranked = all(float(s).is_integer() for _, s, k in pieces if k == "normal")
        harmonic = math.log(math.log(len(pieces) + 2) + 1)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "normal" else b"" for p, _, k in pieces]
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        usable = [(i, p) for i, (p, _, k) in enumerate(pieces) if k == "normal" and p]
        if any(re.search(f"[^{MARK}]{MARK}", p) for _, p in usable):
            raise ValueError("a piece holds a marker after other characters")
        if len(self.byte_id) < 256:
            raise ValueError("the model has no byte pieces")
        self.ids = [i for i, _ in usable]
        score = lambda i: -math.log(2.7 - pieces[i][1]) - harmonic if ranked else pieces[i][1]
        self.scores = [score(i) for i in self.ids]
        self.trie = DoubleArray([p.encode() for _, p in usable])
        pad = [0] * 300
        self.arrays = [np.array(x + y, np.int64) for x, y in ((self.trie.base, pad), (self.trie.check, [-1] * 300), (self.trie.value, [-1] * 300))]
        self.score_of = np.array(self.scores)
        # where no piece goes on (checked), a stretch can be parted: around line breaks, and between a
        # Latin letter and the mark after it
        part = "" if any("\n" in p for _, p in usable) else "\n"
        joins = {p[k + 1] for _, p in usable for k in range(len(p) - 1) if LATIN.match(p[k])}
        marks = "".join(re.escape(c) for c in string.punctuation if c not in joins)
        word = f"{LATIN.pattern}++(?=[{marks}])|" if marks else ""
        self.stretch = re.compile(f"{MARK}*(?:{word}[^{MARK}{part}]+)|{MARK}+" + "|\n" * bool(part))
        self.seen: dict[str | None, tuple[list[int], int, float]] = {}

    @classmethod
    def from_file(cls, path: str) -> PieceModel:
        return cls.from_bytes(Path(path).read_bytes())

    @classmethod
    def from_bytes(cls, content: bytes) -> PieceModel:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=content)
        kind = lambda i: "byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal"
        return cls([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])

    def split(self, stretch: str) -> tuple[list[int], int, float]:
        """Piece ids, number of byte pieces and log score of the best split of a stretch."""
        text = stretch.encode()
        n = len(text)
        best, back, word = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        scores, top = self.scores, len(check)
        for at in range(n):
            here = best[at]
            if here == -math.inf:
                continue
            node, end = 0, at
            while end < n:
                child = base[node] + text[end] + 1
                if child >= top or check[child] != node:
                    break
                node = child
                end += 1
                w = value[node]
                if w >= 0 and here + scores[w] > best[end]:
                    best[end], back[end], word[end] = here + scores[w], at, w
            first = text[at]
            size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            if here + BYTE_SCORE * size > best[at + size]:
                best[at + size], back[at + size], word[at + size] = here + BYTE_SCORE * size, at, -1
        return (*self._traced(text, back, word, n), best[n])

    def split_many(self, stretches: list[str]) -> None:
        """Viterbi over many stretches at once, place by place; the same splits as ``split``."""
        base, check, value = self.arrays
        texts = sorted((x.encode() for x in stretches), key=len)
        for at in range(0, len(texts), 2048):
            some = texts[at : at + 2048]
            n, size = len(some), len(some[-1])
            lengths = np.array([len(x) for x in some])
            grid = np.full((n, size), 255, np.int64)  # 255 is in no text
            grid[np.arange(size) < lengths[:, None]] = np.frombuffer(b"".join(some), np.uint8)
            best = np.full((n, size + 4), -np.inf)
            best[:, 0] = 0
            back, word = np.zeros((n, size + 4), np.int64), np.full((n, size + 4), -1)
            for p in range(size):
                lanes = live = np.flatnonzero((best[:, p] > -np.inf) & (lengths > p))
                node = np.zeros(len(lanes), np.int64)
                for q in range(p, size):
                    child = base[node] + grid[lanes, q] + 1
                    ok = check[child] == node
                    lanes, node = lanes[ok], child[ok]
                    if not len(lanes):
                        break
                    w = value[node]
                    hit = w >= 0
                    x, w = lanes[hit], w[hit]
                    score = best[x, p] + self.score_of[w]
                    better = score > best[x, q + 1]
                    x = x[better]
                    best[x, q + 1], back[x, q + 1], word[x, q + 1] = score[better], p, w[better]
                first = grid[live, p]
                width = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
                score = best[live, p] + BYTE_SCORE * width
                better = score > best[live, p + width]
                x, to = live[better], (p + width)[better]
                best[x, to], back[x, to], word[x, to] = score[better], p, -1
            total = best[np.arange(n), lengths].tolist()
            for i, (backs, words) in enumerate(zip(back.tolist(), word.tolist())):
                text = some[i]
                self.seen[text.decode()] = (*self._traced(text, backs, words, len(text)), total[i])

    def _traced(self, text: bytes, back: list[int], word: list[int], at: int) -> tuple[list[int], int]:
        out: list[int] = []
        fallen = 0
        while at:
            if word[at] >= 0:
                out.append(self.ids[word[at]])
            else:
                out += [self.byte_id[b] for b in reversed(text[back[at] : at])]
                fallen += at - back[at]
            at = back[at]
        out.reverse()
        return out, fallen

    def _stretches(self, text: str) -> list[str]:
        """Stretches of a text that is not empty; None stands for a literal marker."""
        if MARK not in text:
            return self.stretch.findall(MARK + text.replace(" ", MARK))
        out = []
        for k, part in enumerate(text.split(MARK)):
            out += [None] * bool(k) + self.stretch.findall(MARK * (not k) + part.replace(" ", MARK))
        return out

    def encode_many(self, texts: list[str]) -> list[tuple[list[int], float, int]]:
        """(ids, log score, byte pieces) of each text."""
        parts = [self._stretches(t) if t else [] for t in texts]
        fresh = set().union(*parts).difference(self.seen)
        if len(self.seen) + len(fresh) > REMEMBERED:
            self.seen.clear()
            fresh = set().union(*parts)
        fresh.discard(None)
        self.split_many([x for x in fresh if len(x) <= LONG])
        out, seen = [], self.seen
        seen[None] = ([self.byte_id[b] for b in MARK.encode()], 3, 3 * BYTE_SCORE)
        for p in parts:
            found = [seen.get(x) or self.split(x) for x in p]
            ids, fallen, scores = zip(*found) if found else ((), (), ())
            out.append((list(chain.from_iterable(ids)), sum(scores), sum(fallen)))
        return out

    def encode(self, text: str) -> tuple[list[int], float, int]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:] if ids else ""


_built: dict[bytes, PieceModel] = {}


def _model(content: bytes) -> PieceModel:
    """The model of this worker; the last one is kept."""
    if content not in _built:
        _built.clear()
        _built[content] = PieceModel.from_bytes(content)
    return _built[content]


CODED = "doc_id long, n_pieces long, n_byte_pieces long, log_score double, ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def _coded(docs: DataFrame, model_path: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def batches_coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(held.value)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                codes, scores, fallen = zip(*m.encode_many([t or "" for t in texts]))
                arrays = [None if t is None else np.array(c, np.int32) for t, c in zip(texts, codes)]
                back = [None if t is None else m.decode(c) for t, c in zip(texts, codes)]
                columns = [
                    part.column("doc_id"),
                    pa.array(map(len, codes), pa.int64()),
                    pa.array(fallen, pa.int64()),
                    pa.array(map(float, scores), pa.float64()),
                    pa.array(arrays, pa.list_(pa.int32())),
                    pa.array([None if x is None else digest(x.astype("<i4").tobytes()) for x in arrays], pa.string()),
                    pa.array([None if x is None else digest(x.encode()) for x in back], pa.string()),
                    pa.array([x == t for x, t in zip(back, texts)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in CODED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches_coded, CODED)


def encode(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, log_score and ids of every document, the digests of the ids and of what
    they decode to, and whether that is the text (round_trip)."""
    return _coded(docs, model_path)


def decode(coded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id and text of coded documents (columns doc_id, ids); null ids stay null."""
    held = coded.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def batches_decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else _model(held.value).decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(batches_decoded, "doc_id long, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the pieces of every document and of what they decode to."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
