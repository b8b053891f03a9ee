"""Secret scans with multipart credential linking.

Strong candidates (the base kinds) are always reported. Weak ones - a bare 40-character key, a
login name, an endpoint address - are reported only when the complementary parts stand within the
same scope: intervals around the parts of a document are joined by a sorted sweep, so the work is
linear in the parts and no pairs are written out. A document's parts never leave its row, so
nothing is shuffled.

Null texts count as empty: no spans. Offsets are code points, ends exclusive. Equal starts are
ordered by kind as listed in KINDS. Repeated rows are scanned alike. Very long texts are scanned
whole, in time about linear in their length. An empty table gives no rows. Other columns, whatever
their names, are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "key", "login", "endpoint")
#: Code points between two parts of one credential at most.
SCOPE = 300

_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile(
    "(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEY = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
LOGIN = re.compile(r"""(?<![A-Za-z0-9])(?:[uU]ser(?:name|_id|)|[lL]ogin|[cC]lient_?[iI]d|[aA]ccess_?[kK]ey_?[iI]d)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""")
ENDPOINT = re.compile(r"""(?:https?|jdbc:[a-z]+|postgres|mysql|redis|amqp|mongodb|ftp|s3)://[^\s"'<>]{4,}""")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


class _Side:
    """Spans by start, with the furthest end so far, so that one look-up tells whether any reaches a place."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts = [s for s, _, _ in spans]
        self.ends = list(accumulate((e for _, e, _ in spans), max))

    def near(self, start: int, end: int, scope: int = SCOPE) -> bool:
        """Interval join of one span with the side: does any lie within the scope of it?"""
        k = bisect_right(self.starts, end + scope)
        return k > 0 and self.ends[k - 1] + scope >= start

    def touches(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates whose complementary parts are near."""
    covered = _Side(base)
    free = lambda m: not covered.touches(m.start(), m.end())
    endpoints = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if "://" in text else []
    logins = [(m.start(), m.end(), "login") for m in LOGIN.finditer(text) if free(m)] if ":" in text or "=" in text else []
    if not (base or logins):
        return []
    keys = [(m.start(), m.end(), "key") for m in KEY.finditer(text) if free(m) and re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    ids = _Side([x for x in base if x[2] == "access"] + logins)
    secrets = _Side([x for x in base if x[2] != "access"] + keys)
    near = lambda spans, *sides: [x for x in spans if all(side.near(*x[:2]) for side in sides)]
    return near(keys, ids) + near(logins, secrets) + near(endpoints, ids, secrets)


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by start, then kind as listed."""
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base = base_spans(text)
    return sorted(base, key=order), sorted(base + linked_spans(text, base), key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base_text, text, counts = [], [], {k: [] for k in KINDS[:3]}
        for t in batch.column("text").to_pylist():
            base, spans = all_spans(t or "")
            kinds = [x[2] for x in base]
            for k, c in counts.items():
                c.append(kinds.count(k))
            base_text.append(hashlib.sha256(joined(base).encode()).hexdigest())
            text.append(joined(spans))
        columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(base_text, pa.string()), pa.array(text, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and spans."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, mark: str = "[secret]") -> str:
    _, spans = all_spans(text)
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:] if spans else text


@F.pandas_udf(T.StringType())
def _redact(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: redacted(t) if t else t)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every reported span replaced by a mark; all rows stay."""
    return docs.withColumn("text", _redact(F.col("text")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
