"""Personal data by weak supervision, in Spark SQL functions only.

Five labelers vote on every candidate span (1 yes, 2 no, 0 abstain): ``regex`` (the strict form of its
kind holds), ``check`` (its value: check digits, ranges, lengths), ``gazetteer`` (top-level domains,
dialling codes, card issuers, given names, IBAN countries), ``context`` (cue words in the 40 characters
before) and ``boundary`` (it stands free of letters and digits). Candidates are the contract's matches,
passing or not, and looser forms: phones without a plus or run together with what follows, written-out
e-mail addresses, social security numbers, IBANs and names of persons.

Candidates are counted by kind and vote pattern - at most a few thousand patterns, however many texts -
and expectation-maximisation over the patterns estimates per kind how often each labeler says what of
true and of false spans, without any labels. Its posteriors then train the final classifier, a naive
Bayes model over the votes and the span's shape (length, neighbours), which decides on the candidates
that are not base spans. Base spans always stay.

No text is shuffled: spans are found, checked and labelled within a document's row, in time linear in its
length (patterns are possessive; offsets are summed up in blocks). What crosses tasks are pattern counts.

Null texts count as empty and have no spans; an empty table gives no rows. Repeated rows have a row each.
Very long texts are read whole. Offsets are code points, ends exclusive. Spans of one start are ordered by
kind as in ``KINDS``, then by end; spans of different kinds may overlap. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm.common import checkpointed

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "person")
LABELERS = ("regex", "check", "gazetteer", "context", "boundary")
YES, NO, ABSTAIN = 1, 2, 0

# The contract's kinds. \G or a look-behind starts only at a run's first character or after the last
# match, and possessive quantifiers give nothing back: both change no match and keep the search linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"  # runs of fewer than 14 digits fail in any case
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.|$)){4}$"

# Looser forms.
LOOSE_PHONE = r"(?=[+(0-9])(?<![0-9A-Za-z+])(?:(?:(?:\+|00)?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}|00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,4})(?![0-9A-Za-z])"
LOOSE_EMAIL = r"(?=[A-Za-z0-9])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:[\[({]at[\])}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[({]dot[\])}]|\.) ?[A-Za-z0-9-]{2,63}+){1,4}|(?<= )at [A-Za-z0-9-]{1,63}+(?: dot [A-Za-z0-9-]{2,63}+){1,4})"
SSN = r"(?=[0-9])(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IBAN = r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

# Gazetteers (fixed values).
DOMAINS = "com org net edu gov mil int info biz io co us uk de fr es it nl be ch at se no dk fi pl pt cz ru cn jp kr in au nz ca br mx ar eu"
DIALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 380 420 421 852 971 972"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6011|62|64|65)"
IBAN_COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MT NL NO PL PT RO SE SI SK"
GIVEN = "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Maria Peter Hans Klaus Sabine Ursula Jean Pierre Marie Sophie Carlos Jose Juan Carmen Lucia"
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Sr Sra"
PERSON = rf"(?=[A-Z])(?<![A-Za-z])(?:(?:{'|'.join(TITLES.split())})\.? (?:[A-Z][a-z]{{1,20}} )?|(?:{'|'.join(GIVEN.split())}) )[A-Z][a-z]{{1,20}}(?![A-Za-z])"

CUES = {
    "email": "e-?mail|contact|write to|reach|mailto|adresse|correo|courriel",
    "ip": r"\bip\b|host|server|address|addr|client|remote|from",
    "card": "card|visa|master|amex|credit|debit|karte|tarjeta|carte",
    "phone": r"phone|tel\b|tel[.:]|call|mobile|cell|fax|telefon|tél|teléfono|whatsapp",
    "ssn": r"ssn|social security|security number",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "person": r"name|dear|regards|signed|contact|patient|customer|mr|mrs|attn",
}
COUNTER_CUES = r"isbn|version|\bv\.?$|serial|sha|hash|token|order|invoice|build|revision|uuid|\bid[:= ]"

#: Starting guesses: how often a labeler votes (abstain, yes, no) on false and on true spans. They also stand as
#: PRIOR_WEIGHT pseudo-spans of each class, so that kinds with few candidates keep sensible reliabilities.
START = {
    "regex": ((0.35, 0.05, 0.6), (0.3, 0.65, 0.05)),
    "check": ((0.2, 0.15, 0.65), (0.1, 0.87, 0.03)),
    "gazetteer": ((0.5, 0.2, 0.3), (0.4, 0.55, 0.05)),
    "context": ((0.6, 0.05, 0.35), (0.58, 0.4, 0.02)),
    "boundary": ((0.05, 0.45, 0.5), (0.02, 0.94, 0.04)),
}
PRIOR_WEIGHT, ROUNDS, THRESHOLD = 20.0, 25, 0.5
BLOCK, CONTEXT = 128, 40


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once: a lambda's argument is, an inlined column may not be."""
    return F.transform(F.array(value), body)[0]


def sums_before(lengths: Column) -> Column:
    """Exclusive running sums of an array: blocks first, then their offsets, so that no long array is copied again and again."""
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    zero = F.array(F.lit(0).cast("long"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda i: F.aggregate(F.slice(lengths, i * BLOCK + 1, BLOCK), zero, grow))
    offsets = lambda runs: F.aggregate(F.transform(runs, lambda r: F.element_at(r, -1)), zero, grow)
    shifted = lambda runs, off: F.flatten(F.transform(runs, lambda r, i: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda x: x + off[i])))
    return let(blocks, lambda runs: let(offsets(runs), lambda off: shifted(runs, off)))


SPAN = "struct<start:bigint,end:bigint,text:string,before:string,after:string>"


def matches(text: Column, pattern: str, rest: Callable[[Column], Column] | None = None) -> Column:
    """struct(found, rest): matches with offsets and surroundings; the text, with matches that ``rest`` accepts blanked.

    The text is split only if there are matches.
    """
    none = F.struct(F.array().cast(f"array<{SPAN}>").alias("found"), text.alias("rest"))

    def spans(s: Column) -> Column:
        lengths = F.transform(s.gaps, lambda gap, i: (F.char_length(gap) + F.char_length(F.coalesce(F.get(s.m, i), F.lit("")))).cast("long"))
        one = lambda m, i, before: F.struct(
            (before[i] + F.char_length(s.gaps[i])).alias("start"),
            (before[i] + F.char_length(s.gaps[i]) + F.char_length(m)).alias("end"),
            m.alias("text"),
            F.right(s.gaps[i], F.lit(CONTEXT)).alias("before"),
            F.left(s.gaps[i + 1], F.lit(1)).alias("after"),
        )
        found = let(sums_before(lengths), lambda before: F.transform(s.m, lambda m, i: one(m, i, before)))
        left = text
        if rest is not None:
            hidden = lambda m: F.when(rest(m), F.repeat(F.lit("#"), F.char_length(m))).otherwise(m)
            left = F.array_join(F.transform(s.gaps, lambda gap, i: F.concat(gap, F.coalesce(hidden(F.get(s.m, i)), F.lit("")))), "")
        return F.struct(found.alias("found"), left.alias("rest"))

    split = lambda m: F.struct(m.alias("m"), F.split(text, pattern, -1).alias("gaps"))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(let(split(m), spans)))


def _digits(m: Column) -> Column:
    return F.translate(m, " ().+-", "")


def _between(c: Column, low: int, high: int) -> Column:
    return c.between(F.lit(low), F.lit(high))


#: The contract's tests of a match.
PASSES: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(OCTETS),
    "card": lambda m: _between(F.char_length(_digits(m)), 14, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: _between(F.char_length(_digits(m)), 10, 15),
}


def _mod97(m: Column) -> Column:
    """An IBAN's remainder: its first four characters last, letters as 10 to 35."""
    s = F.replace(m, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(value(c) < 10, 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """YES where ``yes``; NO where ``no``, or, if that is None, wherever else."""
    return F.when(yes, YES).otherwise(NO if no is None else F.when(no, NO).otherwise(ABSTAIN)).cast("int")


def _one_of(c: Column, listed: str) -> Column:
    return c.rlike(f"^(?:{'|'.join(listed.split())})$")


def check_vote(kind: str, m: Column) -> Column:
    digits = F.char_length(_digits(m))
    if kind == "email":
        return _vote(m.rlike(r"[A-Za-z]{2,}$"))
    if kind == "ssn":
        return _vote(~m.rlike(r"^(?:000|666|9)|-00-|-0000$"))
    if kind == "iban":
        return _vote(_mod97(m) == 1)
    if kind == "person":
        return F.lit(ABSTAIN)
    return _vote(_between(digits, 10, 15)) if kind == "phone" else _vote(PASSES[kind](m))


def gazetteer_vote(kind: str, m: Column) -> Column:
    if kind == "email":
        return _vote(_one_of(F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1)), DOMAINS), F.lit(False))
    if kind == "ip":
        return _vote(F.lit(False), m.rlike(r"^(?:0|10|127|255)\.|^192\.168\."))
    if kind == "card":
        return _vote(_digits(m).rlike(ISSUERS))
    if kind == "phone":
        return _vote(m.rlike(rf"^(?:\+|00)(?:{'|'.join(DIALLING.split())})(?![0-9])|^(?:\+|00)(?:{'|'.join(DIALLING.split())})[0-9]") | m.rlike(r"^\([2-9]"), F.lit(False))
    if kind == "iban":
        return _vote(_one_of(F.substring(m, 1, 2), IBAN_COUNTRIES))
    return _vote(m.rlike(rf"\b(?:{'|'.join(GIVEN.split())})\b"), F.lit(False)) if kind == "person" else F.lit(ABSTAIN)


def candidates(kind: str, found: Column, base: bool) -> Column:
    """Spans as candidates: kind, place, whether base, and the pattern of votes and shape that decides on them."""

    def one(s: Column) -> Column:
        passes = PASSES[kind](s.text) if base else F.lit(False)
        strict = _vote(passes) if base else _vote(s.text.rlike(rf"^(?:{'|'.join(TITLES.split())})\b"), F.lit(False)) if kind == "person" else F.lit(ABSTAIN)
        around = F.lower(s.before)
        context = _vote(around.rlike(CUES[kind]), around.rlike(COUNTER_CUES))
        joined = s.before.rlike("[A-Za-z0-9]$") | s.after.rlike("^[A-Za-z0-9]")
        votes = [strict, check_vote(kind, s.text), gazetteer_vote(kind, s.text), context, _vote(~joined)]
        n = F.char_length(s.text)
        shape = [F.when(n < 12, "a").when(n < 18, "b").when(n < 30, "c").otherwise("d"), F.when(s.before.rlike(r"[:=(<\[\"']\s*$"), "q").otherwise("-"), F.when(s.after.rlike(r"^[.,;)>\]\"']"), "q").otherwise("-")]
        pattern = F.concat(*[v.cast("string") for v in votes], *shape)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), s.start.alias("start"), s.end.alias("end"), passes.alias("base"), pattern.alias("pattern"))

    return F.transform(found, one)


CANDIDATE = "struct<kind:int,start:bigint,end:bigint,base:boolean,pattern:string>"


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every candidate of every document with its votes; the texts are gone."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def of(t: Column) -> Column:
        nothing = F.array().cast(f"array<{CANDIDATE}>")
        both = lambda base, kind, loose: let(base, lambda b: F.concat(candidates(kind, b.found, True), candidates(kind, matches(b.rest, loose).found, False)))
        plain = lambda kind, pattern, base=False: candidates(kind, matches(t, pattern).found, base)
        any_email = F.contains(t, F.lit("@")) | F.contains(t, F.lit("at")) & F.contains(t, F.lit("dot")) | t.rlike(r"[\[({]at[\])}]")
        return F.concat(
            F.when(any_email, both(matches(t, EMAIL, PASSES["email"]), "email", LOOSE_EMAIL)).otherwise(nothing),
            plain("ip", IP, True),
            plain("card", CARD, True),
            both(F.when(F.contains(t, F.lit("+")), matches(t, PHONE, PASSES["phone"])).otherwise(F.struct(F.array().cast(f"array<{SPAN}>").alias("found"), t.alias("rest"))), "phone", LOOSE_PHONE),
            plain("ssn", SSN),
            plain("iban", IBAN),
            plain("person", PERSON),
        )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(text, of).alias("spans"))


def _start(y: int) -> list[float]:
    return [START[name][y][v] for name in LABELERS for v in (0, 1, 2)]


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, seen, model): expectation-maximisation over the counted vote patterns of each kind, from (kind, pattern, n).

    model: prior, and t, the chances of each vote of each labeler for false spans, then for true ones. ``seen``
    has each pattern with its posterior q. At most 3**5 votes times 16 shapes a kind are gathered.
    """
    size = 3 * len(LABELERS)
    start = F.array(*[F.lit(x) for x in _start(0) + _start(1)])
    votes = F.transform(F.split(F.substring("pattern", 1, len(LABELERS)), ""), lambda c: c.cast("int"))
    rows = patterns.select("kind", F.struct("pattern", votes.alias("v"), F.col("n").cast("double").alias("n")).alias("p"))
    rows = rows.groupBy("kind").agg(F.sort_array(F.collect_list("p")).alias("seen"))

    def likelihood(model: Column, p: Column, y: int) -> Column:
        return F.aggregate(F.transform(p.v, lambda v, i: F.ln(model.t[y * size + i * 3 + v])), F.lit(0.0), lambda a, b: a + b)

    def posterior(model: Column, p: Column) -> Column:
        odds = F.ln((1 - model.prior) / model.prior) + likelihood(model, p, 0) - likelihood(model, p, 1)
        return 1 / (1 + F.exp(F.least(odds, F.lit(700.0))))

    def with_posterior(model: Column, seen: Column) -> Column:
        return F.transform(seen, lambda p: F.struct(p.pattern.alias("pattern"), p.v.alias("v"), p.n.alias("n"), posterior(model, p).alias("q")))

    def added(seen: Column, part: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.transform(seen, part), F.lit(0.0), lambda a, b: a + b)

    def model_of(prior: Column, t: Column) -> Column:
        return F.struct(prior.alias("prior"), t.alias("t"))

    def maximised(seen: Column) -> Column:
        true, false = added(seen, lambda p: p.n * p.q), added(seen, lambda p: p.n * (1 - p.q))

        def chance(total: Column) -> Callable[[Column], Column]:
            share = lambda k, p: F.when(k >= size, p.q).otherwise(1 - p.q)
            hit = lambda k, p: p.v[F.floor((k % size) / 3).cast("int")] == k % 3
            each = lambda k: added(seen, lambda p: F.when(hit(k, p), p.n * share(k, p)).otherwise(F.lit(0.0)))
            return lambda k: (each(k) + PRIOR_WEIGHT * start[k]) / (F.when(k >= size, total.true).otherwise(total.false) + PRIOR_WEIGHT)

        total = F.struct(true.alias("true"), false.alias("false"))
        return let(total, lambda s: model_of((s.true + 1) / (s.true + s.false + 2), F.transform(F.sequence(F.lit(0), F.lit(2 * size - 1)), chance(s))))

    step = lambda model, _: let(with_posterior(model, F.col("seen")), maximised)
    found = rows.withColumn("model", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), model_of(F.lit(0.5), start), step))
    return found.select("kind", "model", with_posterior(F.col("model"), F.col("seen")).alias("seen"))


def classifier(model: DataFrame) -> DataFrame:
    """(kind, pattern, probability): naive Bayes over the characters of a pattern (votes and shape), trained on the posteriors."""
    rows = model.select("kind", F.explode("seen").alias("p")).select("kind", "p.pattern", "p.n", "p.q")
    features = rows.select("kind", "pattern", "n", "q", F.posexplode(F.split("pattern", "")).alias("place", "value"))
    in_class = F.sum(F.col("n") * F.col("q")), F.sum(F.col("n") * (1 - F.col("q")))
    weights = features.groupBy("kind", "place", "value").agg(in_class[0].alias("true"), in_class[1].alias("false"))
    totals = rows.groupBy("kind").agg(in_class[0].alias("all_true"), in_class[1].alias("all_false"))
    log_odds = F.ln((F.col("true") + 0.5) / (F.col("all_true") + 1.5)) - F.ln((F.col("false") + 0.5) / (F.col("all_false") + 1.5))
    weights = weights.join(totals, "kind").select("kind", "place", "value", log_odds.alias("w"), F.ln((F.col("all_true") + 1) / (F.col("all_false") + 1)).alias("bias"))
    score = features.join(weights, ["kind", "place", "value"]).groupBy("kind", "pattern").agg((F.sum("w") + F.first("bias")).alias("score"))
    return score.select("kind", "pattern", F.round(1 / (1 + F.exp(-F.greatest(F.col("score"), F.lit(-700.0)))), 9).alias("probability"))


def find(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, the digest of its base spans, and all spans."""
    found = checkpointed(labelled(docs))
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.pattern").agg(F.count(F.lit(1)).alias("n"))
    # at most as many rows as there are patterns, see reliabilities
    accepted = [f"{r.kind}{r.pattern}" for r in classifier(reliabilities(counted)).filter(F.col("probability") >= THRESHOLD).collect()]
    chosen = lambda s: s.base | F.concat(s.kind.cast("string"), s.pattern).isin(accepted or [""])
    ordered = lambda keep: F.array_sort(F.transform(F.filter("spans", keep), lambda s: F.struct(s.start, s.kind, s.end)))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda keep: F.array_join(F.transform(ordered(keep), lambda s: F.concat_ws(":", names[s.kind], s.start, s.end)), ",")
    base = lambda s: s.base
    count = lambda k: F.size(F.filter("spans", lambda s: s.base & (s.kind == k))).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(joined(base), 256).alias("base_sha256"), joined(chosen).alias("spans"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
