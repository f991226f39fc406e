"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

Spark expressions only. For each kind `regexp_extract_all` gives the matches and `split` by the same
pattern the gaps between them; running lengths of both give code-point spans. Patterns use possessive
quantifiers and run-start guards where the plain form would be quadratic or recursive on long runs; they
match the same strings.

Kinds: email, ip, card (Luhn), phone, and three which the base rules do not have: iban (mod 97), ssn (number
ranges) and secret (20 or more letters and digits mixed). The score of a span starts at its kind's base value, rises
when a context word of the kind stands within `NEAR` characters before it, and falls when a word that names something
else (order number, version, …) stands there. Base spans are reported whatever their score; a span of an added kind needs its
check and a score of at least `LEAST`, so ssn and secret are reported next to a context word only.

Defined results: a null or empty text has no spans; spans of different kinds may overlap and are all
kept; repeated rows give repeated results; other columns are passed through; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str
    base: float
    context: tuple[str, ...]


# Patterns of the base kinds, a literal or class that every match has, base score, context words.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"@[A-Za-z0-9-]", 0.8, ("mail", "email", "e-mail", "contact", "kontakt", "correo", "courriel")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6,
         ("ip", "host", "server", "address", "addr", "login")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}", 0.7,
         ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "payment")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6,
         ("phone", "tel", "call", "mobile", "telefon", "fax", "whatsapp")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.9,
         ("iban", "account", "konto", "compte", "cuenta", "bank")),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.4,
         ("ssn", "social", "security")),
    Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", r"[A-Za-z0-9_-]{20}", 0.4,
         ("token", "key", "secret", "password", "passwort", "bearer", "api")),
)
BASE = ("email", "ip", "card", "phone")
#: Words that make a number something else.
OTHER = ("version", "order", "invoice", "isbn", "serial", "token", "build", "commit", "checksum")
STEP, NEAR = 0.15, 40
#: Score from which a span of an added kind is reported.
LEAST = 0.5
#: Matches whose positions are summed up together; the sums of blocks follow in a second pass.
BLOCK = 256

_HIT = "array<struct<start:bigint,end:bigint,value:string,before:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a digit string passes the Luhn check."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    whole = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, d: a + d)
    return whole % 10 == 0


def mod97(value: Column) -> Column:
    """True if an IBAN's rearranged number leaves 1 modulo 97."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\.", -1), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
                        .otherwise(F.lit(False)))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 12) & (n <= 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        n = F.length(F.replace(value, F.lit(" "), F.lit("")))
        return F.when(n.between(15, 34), mod97(value)).otherwise(F.lit(False))
    if kind == "secret":
        return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))
    return F.lit(True)


def _proposed(text: Column, kind: Kind) -> Column:
    """Matches of one kind with code-point spans and the characters before them.

    Appending copies an array, so positions are summed within blocks of `BLOCK` matches and then over the blocks; the time stays
    in proportion to the matches up to millions of them.
    """
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    every = F.arrays_zip(values.alias("value"), F.slice(gaps, 1, F.size(values)).alias("gap"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_HIT).alias("hits"))

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["gap"])
        end = begin + F.length(p["value"])
        hit = F.struct(begin.alias("start"), end.alias("end"), p["value"].alias("value"),
                       F.lower(F.right(p["gap"], F.lit(NEAR))).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["hits"], F.array(hit)).alias("hits"))

    def in_blocks(pairs: Column) -> Column:
        # The start of the match is where its gap ends, so no position is searched twice.
        numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")))
        return F.transform(numbers, lambda b: F.aggregate(F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)), start, add))

    def shifted(blocks: Column) -> Column:
        ends = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        return F.flatten(F.zip_with(blocks, F.slice(ends, 1, F.size(blocks)), lambda b, past: F.transform(b["hits"], lambda h: F.struct(
            (h["start"] + past).alias("start"), (h["end"] + past).alias("end"), h["value"].alias("value"), h["before"].alias("before")))))

    def once(value: Column, use) -> Column:
        """`use(value)` with the value made once, as the element of an array."""
        return F.get(F.transform(F.array(value), use), 0)

    found = once(every, lambda pairs: once(in_blocks(pairs), shifted))
    return F.when(F.rlike(text, F.lit(kind.hint)), found).otherwise(F.array().cast(_HIT))


def _scored(kind: Kind, order: int, hits: Column) -> Column:
    def has(before: Column, words: tuple[str, ...]) -> Column:
        return F.rlike(before, F.lit(r"(?<!\w)(?:" + "|".join(words) + r")(?!\w)")).cast("int")

    other = tuple(w for w in OTHER if w not in kind.context)
    scored = F.transform(
        F.filter(hits, lambda h: _confirmed(kind.name, h["value"])),
        lambda h: F.struct(
            h["start"].alias("start"), F.lit(order).alias("kind_order"), F.lit(kind.name).alias("kind"),
            h["end"].alias("end"), h["value"].alias("value"),
            (F.lit(kind.base) + STEP * has(h["before"], kind.context) - STEP * has(h["before"], other)).alias("score")))
    return scored if kind.name in BASE else F.filter(scored, lambda s: s["score"] >= LEAST)


def with_spans(docs: DataFrame, into: str = "spans", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """`docs` plus an array of (start, kind_order, kind, end, value, score), sorted by start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = [_scored(k, i, _proposed(body, k)) for i, k in enumerate(kinds)]
    return docs.withColumn(into, F.sort_array(F.concat(*found)))


def masked(docs: DataFrame, spans: str = "spans", text: str = "text", least: float = 0.5) -> DataFrame:
    """Replace every span of at least that score by `[KIND]`; of overlapping spans the first one is replaced."""
    chosen = F.filter(spans, lambda s: s["score"] >= least)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        taken = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
        return F.when(s["start"] >= acc["at"], taken).otherwise(acc)

    whole = F.aggregate(chosen, start, add, lambda acc: F.concat(
        acc["out"], F.substr(F.col(text), (acc["at"] + 1).cast("int"))))
    return docs.withColumn(text, F.when(F.size(chosen) > 0, whole).otherwise(F.col(text)))


def digest_text(spans: Column) -> Column:
    """`kind:start:end` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    """Number of spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def score_text(spans: Column) -> Column:
    """Scores of the spans in hundredths, in the same order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
