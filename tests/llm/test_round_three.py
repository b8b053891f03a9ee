"""Personal data, exact centroid clustering and the conversation trie against brute force."""

import hashlib
import re
import tracemalloc
import zlib
from collections import defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
import pytest

from fieldweave.llm import centroids, compact_windows, edit_fingerprint, personal_data, prefix_trie, toxicity

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind: str, m: str) -> bool:
    digits = re.sub("[^0-9]", "", m)
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return 14 <= len(digits) <= 19 and total % 10 == 0


def base_spans(text: str) -> list[str]:
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if passes(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


AWKWARD = [
    None, "", "a@b", "a@b.c@d.e.f", "x.y@z.com_q@r.org", "a@b@c.d", "é@ü.com ä.b@c-d.e-", "1.2.3.4.5.6.7.8", "256.1.1.1 0000255.00.0.1 1.2.3", "4111 1111 1111 1111",
    "4111-1111-1111-1112 and 4111111111111111,", "+1 (826) 555-4081 190.137.223.204", "+1 (826) 555-4081", "++49 170 1234567+44 20 7946 0958.", "tel 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5",
    "😀 me@here.net 😀 10.0.0.1", "a@b.c" * 300, "9" * 3000, "+" * 2000 + "1" * 12, "." * 500 + "@" + "." * 500, "mail: jane (at) host (dot) org", "SSN: 123-45-6789, IBAN: DE89 3704 0044 0532 0130 00",
    "z" * 20000 + "@" + "y" * 20000, "1.1." * 2000, "0 " * 3000,
]


def test_base_spans_of_awkward_texts(spark):
    rows = [*enumerate(AWKWARD), (None, "a@b.c"), (3, AWKWARD[3])]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, kind int, spans string").repartition(3)
    got = personal_data.find(docs).collect()
    assert len(got) == len(rows)
    texts = dict(enumerate(AWKWARD)) | {None: "a@b.c"}
    for r in got:
        base = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (r.doc_id, base, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in BASE]
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), personal_data.KINDS.index(x.split(":")[0])))
    assert personal_data.find(docs.filter("1 = 0")).count() == 0


def test_phone_run_together_with_what_follows(spark):
    docs = spark.createDataFrame([(i, f"call +1 (826) 555-{1000 + i}") for i in range(40)] + [(99, "Des +1 (826) 555-4081 190.137.223.204 du")], "doc_id long, text string")
    assert personal_data.find(docs).filter("doc_id = 99").first().spans == "phone:4:21,ip:22:37"


def test_unsupported_forms_are_left_alone(spark):
    """Numbers that only look like a card, with no vote for them, don't become spans."""
    docs = spark.createDataFrame([(i, f"card 4111 1111 1111 1111 and build {4111111111111112 + 10 * i}") for i in range(0, 30)], "doc_id long, text string")
    for r in personal_data.find(docs).collect():
        assert all(passes("card", "4111 1111 1111 1111") and x.startswith("card:5:24") or passes("card", str(4111111111111112 + 10 * r.doc_id)) for x in r.spans.split(","))


def test_reliabilities_against_plain_em(spark):
    """The patterns' EM in SQL equals the same updates in plain Python."""
    rng = np.random.default_rng(5)
    counts = defaultdict(int)
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = [rng.choice(3, p=np.array(personal_data.START[name][int(y)])) for name in personal_data.LABELERS]
        counts["".join(map(str, votes)) + "a--"] += 1
    rows = sorted(counts.items())
    got = personal_data.reliabilities(spark.createDataFrame([(2, p, n) for p, n in rows], "kind int, pattern string, n long")).first()
    start = np.array([[personal_data.START[name][y] for name in personal_data.LABELERS] for y in (0, 1)])
    prior, t = 0.5, start.copy()
    v, n = np.array([[int(c) for c in p[:5]] for p, _ in rows]), np.array([float(x) for _, x in rows])
    posterior = lambda: 1 / (1 + (1 - prior) / prior * np.prod(t[0][range(5), v], axis=1) / np.prod(t[1][range(5), v], axis=1))
    for _ in range(personal_data.ROUNDS):
        q = posterior()
        w = personal_data.PRIOR_WEIGHT
        for y, share in ((0, 1 - q), (1, q)):
            t[y] = [[((n * share)[v[:, k] == c].sum() + w * start[y][k][c]) / ((n * share).sum() + w) for c in range(3)] for k in range(5)]
        prior = ((n * q).sum() + 1) / (n.sum() + 2)
    assert abs(got.model.prior - prior) < 1e-9
    assert np.allclose(np.array(got.model.t).reshape(2, 5, 3), t, atol=1e-9)
    assert abs(prior - 0.4) < 0.05  # the truth behind the votes
    assert np.allclose([s.q for s in got.seen], posterior(), atol=1e-9)


def cluster_by_hand(vectors, k, rounds):
    kept = [(i, [floor(Fraction(float(c)) * 64) for c in x]) for i, x in vectors]
    chosen = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [x for _, x in chosen[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[near(x)[1]].append(x)
        cents = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(cents)]
    found = [(i, near(x)[1], near(x)[0]) for i, x in kept]
    total = sum(d for *_, d in found)
    fits = lambda d: d if d < 2**63 else None
    inertia = {n: [sum(d for _, m, d in found if m == n), all(fits(d) is not None for _, m, d in found if m == n)] for _, n, _ in found}
    whole = all(ok for _, ok in inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, n, fits(d), fits(inertia[n][0]) if inertia[n][1] else None, fits(total) if whole else None, digest[n]) for i, n, d in found), key=str)


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e30])
def test_clusters_are_exact(spark, scale):
    rng = np.random.default_rng(7)
    grid = rng.integers(-3, 4, (90, 64)) / 64 * scale  # many ties
    rows = [(int(i), [float(c) for c in x]) for i, x in enumerate(grid)] + [(5, [float(c) for c in grid[5]]), (5, [0.0] * 64), (None, [float(c) for c in grid[9]])]
    odd = [(200, None), (201, [1.0] * 63), (202, [None] + [1.0] * 63), (203, [float("nan")] * 64), (204, [float("inf")] + [0.0] * 63), (205, [])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<double>, cluster int, x string").repartition(4)
    got = sorted((tuple(r) for r in centroids.cluster(table, rounds=2).collect()), key=str)
    assert got == cluster_by_hand(rows, 16, 2)


def test_few_or_no_vectors(spark):
    table = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], "vec_id long, embedding array<float>")
    assert sorted(r.distance for r in centroids.cluster(table).collect()) == [0, 0]
    assert centroids.cluster(table.filter("1 = 0")).collect() == []


def test_intervals_hold_the_exact_value():
    rng = np.random.default_rng(3)
    for size in (10, 10**4, 10**8, 10**12):
        v, c = rng.integers(-size, size, (50, 64)), rng.integers(-size, size, (16, 64))
        low, high = centroids.intervals(v, c)
        for i in range(50):
            for j in range(16):
                exact = sum(int(x) ** 2 for x in c[j]) - 2 * sum(int(a) * int(b) for a, b in zip(v[i], c[j], strict=True))
                assert low[i, j] <= exact <= high[i, j]


def trie_by_hand(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0), tie, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    made = {c: own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[: h[c]] + own[c][h[c] :] for c in own}
    members = defaultdict(list)
    for c, x in made.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0) for n in below)
        ends = ",".join(map(str, sorted(c for c in convs if len(made[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_trie_over_task_borders(spark, seed):
    """Conversations cut over tasks, one of a third of all rows, shared beginnings, nulls, ties and repeats."""
    rng = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", None], ["hi", "hé", "", None, "long " * 9]
    rows = [(int(c), int(t), roles[t % 2], texts[rng.integers(3)]) for c in range(40) for t in range(rng.integers(0, 12))]
    rows += [(41, t, "user", texts[rng.integers(5)]) for t in range(120)]
    rows += [(43, None, None, "x"), (43, None, "user", None), (43, 1, "user", "same"), (43, 1, "user", "same"), (None, 0, "user", "lost"), (-7, 0, "user", "hi"), (-5, 0, "user", "hi"), (-5, 1, None, "hi")]
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, k1 int, depth string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((tuple(r) for r in prefix_trie.trie(table).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(empty).collect() == []


def test_many_ends_of_one_node(spark):
    """A node's ids are hashed chunk by chunk, over more rows than one chunk holds."""
    ids = [*range(-3, 1000)]
    ends = spark.createDataFrame([(1, 2, c) for c in ids] + [(1, 3, 8)], "k1 long, k2 long, conv_id long").repartition(5)
    got = {(r.k1, r.k2): r.ends_sha256 for r in prefix_trie.ends_digest(ends).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 3): hashlib.sha256(b"8").hexdigest()}


def test_queries_equal_their_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for query, sql in ((centroids.op12_centroid_clustering, centroids.ORACLE), (prefix_trie.op13_prefix_trie, prefix_trie.ORACLE)):
        expected = con.sql(sql[query.__name__])
        got = query(spark, sf).select(*expected.columns)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected.fetchall()))


def test_native_plan(spark, sf):
    plan = personal_data.labelled(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """A chain of fingerprints in one bucket is one class, whatever the size at which a bucket is searched in parts."""
    monkeypatch.setattr(edit_fingerprint, "band_digits", lambda n: [[0, 1, 2, 3]])
    rng = np.random.default_rng(8)
    free = 16 + rng.permutation(edit_fingerprint.BITS - 16)
    bits = np.zeros(edit_fingerprint.BITS, np.uint8)
    rows = []
    for i in range(12):
        rows.append((i, np.packbits(bits).tobytes().hex()))
        bits[free[40 * i : 40 * (i + 1)]] ^= 1
    prints = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    monkeypatch.setattr(edit_fingerprint, "LARGE", 2)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 12), pa.array(["k"] * 12), pa.array(sorted(bytes.fromhex(r[1]) for r in rows))], ["band", "key", "fp"])
    assert sum(x.num_rows for x in edit_fingerprint._near_batches(iter([batch]))) == 11
    for large in (4096, 3):
        monkeypatch.setattr(edit_fingerprint, "LARGE", large)
        assert {r.near_class for r in edit_fingerprint.near_classes(prints).collect()} == {0}, large


def test_all_windows_of_a_class_meet():
    """Five passages of one class: all ten pairs; their copies are linked to them once, whatever the batches (F12)."""
    doc = np.array([50, 20, 21, 40, 10, 30])
    side = np.array([0, 1, 1, 2, 3, 4])  # 20 and 21 hold the same
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(6, 7), doc, np.zeros(6, np.int32), np.zeros(6, np.int32), np.full(6, 60, np.int32), np.full(6, 120, np.int32), side)], compact_windows.WINDOW)
    for size in (1, 2, 6):
        out = [r for b in compact_windows._link_batches(iter([whole.slice(i, size) for i in range(0, 6, size)])) for r in b.to_pylist()]
        got = [(r["a"], r["b"]) for r in out]
        assert len(got) == len(set(got)) == 11
        assert set(got) == {(a, b) for a in doc.tolist() for b in doc.tolist() if a > b and (21 not in (a, b) or (a, b) == (21, 20))}
        assert [r["key"] for r in out if r["a"] == 21] == [0]


def test_toxicity_holds_small_blocks(monkeypatch):
    """A worker's memory over 4 MB of text; blocks of 2 MB with their power tables took over 100 MB (pipeline, toxicity)."""
    monkeypatch.setattr(toxicity.bw, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50_000, 300)) for _ in range(2200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts).cast(pa.binary())], ["text"])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in toxicity._context_batches(iter([batch]))) >= 50_000 - 1
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 70_000_000


def test_windows_of_many_documents():
    """Windows of documents that are worked off together are those of each alone, by a search of every sequence's least place."""
    rng = np.random.default_rng(12)
    T = compact_windows.TOKENS
    sizes = [0, T - 1, T, 3, 200, T + 1, 0, 150, 1]
    values = rng.integers(0, 40, sum(sizes)).astype(np.uint64) << np.uint64(40)  # many equal
    bounds = np.append(0, np.cumsum(sizes))
    want = []
    for d, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        v = values[a:b].tolist()
        for c in sorted({min(range(s, s + T), key=lambda i: (v[i], i)) for s in range(len(v) - T + 1)}):
            l, r = c, c
            while l > 0 and v[l - 1] > v[c]:
                l -= 1
            while r + 1 < len(v) and v[r + 1] >= v[c]:
                r += 1
            want.append((d, a + l, a + c, a + r))
    assert list(zip(*(x.tolist() for x in compact_windows.windows_of(values, bounds)))) == want
