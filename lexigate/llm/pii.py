"""Personal data: patterns propose spans, checksums confirm them, context words adjust scores.

DataFrame functions only. The matches of a pattern and the gaps between them (a split by
the same pattern) give every match its place: they are summed up in runs of about the square
root of their number, so that no step copies what all steps before it found, and the words
around a match are read from the gaps beside it or from its run. Patterns run only on texts that hold a character which each of their matches needs. Repeats are possessive or
anchored at the start of their run where that changes no match, so time stays linear
in the text and no run of characters, however long, needs a deep stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before and after a span in which context words count.
AROUND = 40
#: Score from which an added span is reported; base spans always are.
ACCEPT = 0.5

SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string, score: double>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True where the digits pass the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(digits.substr(n - i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _mod97(m: Column) -> Column:
    """True where an account number leaves 1 modulo 97, country and check digits last."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _byte_parts(m: Column) -> Column:
    """True where every dotted part is at most 255."""
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


@dataclass(frozen=True)
class Kind:
    """A kind of span: what proposes, what confirms, its score, and the words that raise it."""

    name: str
    needs: str
    pattern: str
    confirm: object
    score: float
    words: str
    raised: float


#: Base kinds, in the order in which equal starts are listed.
BASE = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.9, r"e-?mail|contact|write|courriel|correo", 0.1),
    Kind("ip", ".", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _byte_parts, 0.6, r"\bip\b|host|server|address|login", 0.3),
    Kind("card", "", r"[0-9](?:[\x20-]?[0-9])++", lambda m: (F.length(_digits(m)).between(14, 19)) & _luhn(_digits(m)), 0.8, r"card|visa|credit|carte|tarjeta|karte", 0.2),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(10, 15), 0.7, r"phone|tel|call|mobile|fax|telefon", 0.2),
)
#: Kinds that the method adds; they count where no base span lies.
ADDED = (
    Kind("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", _mod97, 0.9, r"iban|account|bank|konto|cuenta|compte", 0.1),
    Kind("ssn", "-", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda m: F.lit(True), 0.3, r"\bssn\b|social security", 0.4),
    Kind("local_phone", "", r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", lambda m: F.lit(True), 0.3, r"phone|\btel\b|call me|mobile|\bfax\b", 0.3),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, kind: Kind, rank: int, base: Column | None = None) -> Column:
    """The confirmed spans of one kind, in code points, end exclusive."""
    none = F.array().cast(f"array<{SPAN}>")

    def size(x: Column) -> Column:
        return F.char_length(x["gap"]) + F.coalesce(F.char_length(x["match"]), F.lit(0))

    def of_run(run: Column, at: Column, stop: Column) -> Column:
        origin = F.greatest(at - AROUND, F.lit(0).cast("bigint"))

        def along(piece: Column, taken: Column | None) -> Column:
            def take(acc: Column, x: Column) -> Column:
                start = acc["at"] + F.char_length(x["gap"])
                match = x["match"]
                end = start + F.coalesce(F.char_length(match), F.lit(0))
                wide = (F.char_length(x["gap"]) >= AROUND) & (F.char_length(x["after"]) >= AROUND)
                beside = F.concat(F.right(x["gap"], F.lit(AROUND)), match, F.left(x["after"], F.lit(AROUND)))
                within = piece.substr((F.greatest(start - AROUND, F.lit(0)) - origin + 1).cast("int"), (end - F.greatest(start - AROUND, F.lit(0)) + AROUND).cast("int"))
                near = F.lower(F.when(wide, beside).otherwise(within))
                score = F.lit(kind.score) + F.when(near.rlike(kind.words), kind.raised).otherwise(0.0)
                good = match.isNotNull() & F.coalesce(kind.confirm(match), F.lit(False))
                if taken is not None:
                    good = good & (score >= ACCEPT) & ~F.exists(taken, lambda s: (s["start"] < end) & (s["end"] > start))
                span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))
                return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

            return F.aggregate(run, F.struct(at.alias("at"), none.alias("out")), take)["out"]

        piece = text.substr((origin + 1).cast("int"), (stop - origin + AROUND).cast("int"))
        if base is None:
            return _let(piece, lambda p: along(p, None))
        return _let(piece, lambda p: _let(F.filter(base, lambda s: (s["start"] < stop) & (s["end"] > at)), lambda t: along(p, t)))

    def of_rows(rows: Column) -> Column:
        long = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(rows)))).cast("int")
        runs = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / long).cast("int"))
        run = lambda i: F.slice(rows, i * long + 1, long)
        sums = F.transform(runs, lambda i: F.aggregate(run(i), F.lit(0).cast("bigint"), lambda n, x: n + size(x)))
        starts = F.aggregate(sums, F.array(F.lit(0).cast("bigint")), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return _let(starts, lambda at: F.flatten(F.transform(runs, lambda i: of_run(run(i), F.get(at, i), F.get(at, i + 1)))))

    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    zipped = _let(F.split(text, kind.pattern, -1), lambda gaps: F.arrays_zip(gaps.alias("gap"), found.alias("match"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("after")))
    possible = text.rlike("[0-9]") if kind.name != "email" else F.lit(True)
    if kind.needs:
        possible = F.contains(text, F.lit(kind.needs)) & possible
    return F.when(possible & text.rlike(kind.pattern), _let(zipped, of_rows)).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in each whole text.

    Null texts count as empty and have no spans. Rows are returned one for one, repeated ones
    too; an empty table gives an empty result; other columns are ignored. Base kinds (email,
    ip, card, phone) are all the confirmed leftmost matches; added kinds (iban, ssn,
    local_phone) are those that reach ACCEPT and overlap no base span.

    Returns doc_id, base and found (arrays of start, rank, end, kind, score in order; found
    holds base too).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"))
    for i, kind in enumerate(BASE):
        df = df.withColumn(kind.name, _spans(F.col("text"), kind, i))
    df = df.select("doc_id", "text", F.array_sort(F.concat(*[F.col(k.name) for k in BASE])).alias("base"))
    for i, kind in enumerate(ADDED):
        df = df.withColumn(kind.name, _spans(F.col("text"), kind, len(BASE) + i, F.col("base")))
    return df.select("doc_id", "base", F.array_sort(F.concat("base", *[F.col(k.name) for k in ADDED])).alias("found"))


def _is(kind: Kind):
    return lambda span: span["kind"] == kind.name


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of each base kind, the SHA-256 of the base spans, and all spans as text."""
    count = [F.size(F.filter("base", _is(k))).cast("bigint").alias(f"n_{k.name}") for k in BASE]
    return found.select("doc_id", *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
