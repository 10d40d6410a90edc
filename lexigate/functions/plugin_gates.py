"""The plug-in family of pair checks: the same ideas as ``gates`` with their own messages and severities.

Each check gives an array of (category, severity, message); ``CHECKS`` holds them by name,
and ``run_checks`` joins their findings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigate.functions.gates import PII_SHAPES, SYMBOLS, UNITS, quote

FINDING = "array<struct<category: string, severity: string, message: string>>"
# Negation words of each language; those of the last three also count inside words.
NEGATION = {
    "en": ["not", "no", "don't", "cannot", "never", "neither", "nor", "won't"],
    "fr": ["pas", "aucun", "ne", "non", "jamais", "ni"],
    "de": ["nicht", "kein", "keine", "niemals", "nie"],
    "es": ["no", "nunca", "ningún", "ninguna", "jamás", "tampoco"],
    "it": ["non", "mai", "nessuno", "nessuna", "niente"],
    "pt": ["não", "nunca", "nenhum", "nenhuma", "jamais"],
    "ja": ["ない", "ません", "しない", "できない", "ず"],
    "ar": ["لا", "ليس", "لم", "لن", "ما", "غير"],
    "zh": ["不", "没", "无", "非", "未"],
    "ko": ["않", "못", "안", "없"],
    "nl": ["niet", "geen", "nooit", "noch"],
    "ru": ["не", "нет", "ни", "никогда", "никто"],
}
UNSPACED = ("ja", "zh", "ko")
# Negative words of each language.
NEGATIVE = {
    "en": ["not", "never", "bad", "worst", "terrible", "fail"],
    "fr": ["pas", "jamais", "mauvais", "pire", "terrible", "échec"],
    "es": ["no", "nunca", "mal", "peor", "terrible", "fallo"],
    "ja": ["ない", "悪い", "最悪", "失敗"],
    "de": ["nicht", "nie", "schlecht", "schlimmste"],
    "ar": ["لا", "أبداً", "سيء", "أسوأ"],
}


def _found(category: str, severity: str, message: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), message.alias("message"))


def _if(condition: Column, category: str, severity: str, message: Column) -> Column:
    return F.when(condition, F.array(_found(category, severity, message)).cast(FINDING)).otherwise(F.array().cast(FINDING))


def numbers(source: Column, target: Column) -> Column:
    """One finding with all numbers of the source that the target lacks; a dot may stand as a comma."""
    found = F.regexp_extract_all(source, F.lit(r"(?<!\d)\d+(?:[.,]\d+)?(?!\d)"), F.lit(0))
    gone = F.filter(found, lambda n: ~F.rlike(target, F.concat(F.lit(r"(?<!\d)"), F.regexp_replace(n, r"\.", "[.,]"), F.lit(r"(?!\d)"))))
    return _if(F.size(gone) > 0, "NUMERIC_MISMATCH", "CRITICAL", F.concat(F.lit("Numbers missing in target: "), F.array_join(gone, ", ")))


def units(source: Column, target: Column) -> Column:
    """Symbols that became fewer, with both counts, and dose and unit pairs that the lower-cased target lacks: all critical."""
    count = lambda x, s: F.length(x) - F.length(F.replace(x, F.lit(s), F.lit("")))
    symbol = [_if(count(source, s) > count(target, s), "UNIT_MISMATCH", "CRITICAL", F.concat(F.lit(f"Symbol '{s}' missing/reduced in target (source: "), count(source, s).cast("string"), F.lit(", target: "), count(target, s).cast("string"), F.lit(")."))) for s in SYMBOLS]
    pattern = F.lit(rf"(?i)(\d+(?:[.,]\d+)?)\s*({'|'.join(UNITS)})\b")
    doses = F.arrays_zip(F.regexp_extract_all(source, pattern, F.lit(1)).alias("v"), F.regexp_extract_all(source, pattern, F.lit(2)).alias("u"))
    gone = F.filter(doses, lambda p: ~F.rlike(F.lower(target), F.concat(F.regexp_replace(p["v"], r"\.", "[.,]"), F.lit(r"\s*"), quote(p["u"]))))
    dose = F.transform(gone, lambda p: _found("UNIT_MISMATCH", "CRITICAL", F.concat(F.lit("Dosage '"), p["v"], p["u"], F.lit("' not found in target."))))
    return F.concat(*symbol, dose.cast(FINDING))


def negation(source: Column, target: Column, source_lang: str, target_lang: str) -> Column:
    """The source negates and the target does not; a target language without words is not checked."""

    def has(x: Column, lang: str) -> Column:
        out = F.lit(False)
        for w in NEGATION[lang]:
            out = out | F.concat(F.lit(" "), F.lower(x), F.lit(" ")).contains(f" {w} ")
            if lang in UNSPACED:
                out = out | x.contains(w)
        return out

    if target_lang not in NEGATION:
        return F.array().cast(FINDING)
    source_lang = source_lang if source_lang in NEGATION else "en"
    return _if(has(source, source_lang) & ~has(target, target_lang), "NEGATION_FLIP", "CRITICAL", F.lit("Negation in source but missing in target."))


def pii(source: Column, target: Column) -> Column:
    """Unresolved tokens and shapes of personal data in the target: major."""
    token = target.contains("[[PII") | target.contains("<EMAIL") | target.contains("<PHONE")
    shapes = F.array_compact(F.array(*[F.when(target.rlike(p), F.lit(name)) for name, p in PII_SHAPES.items()]))
    return F.concat(_if(token, "PII_LEAK", "MAJOR", F.lit("Unresolved redaction token in target.")), _if(F.size(shapes) > 0, "PII_LEAK", "MAJOR", F.concat(F.lit("Personal data in target: "), F.array_join(shapes, ", "))))


def complexity(source: Column, target: Column) -> Column:
    """Math, more than four pipes or code, the first that applies: major."""
    pipes = F.length(source) - F.length(F.replace(source, F.lit("|"), F.lit("")))
    kind = F.when(source.rlike(r"(\$|\\\[|\\\(|\\begin\{equation\})"), "Formula").when(pipes > 4, "Table").when(source.contains("```"), "Code")
    return _if(kind.isNotNull(), "COMPLEXITY_WARNING", "MAJOR", F.concat(kind, F.lit(" detected - requires human review.")))


def sentiment(source: Column, target: Column, source_lang: str, target_lang: str) -> Column:
    """None against some negative words, with both counts: major."""

    def count(x: Column, words: list[str]) -> Column:
        return sum((F.lower(x).contains(w).cast("int") for w in words), F.lit(0))

    if target_lang not in NEGATIVE:
        return F.array().cast(FINDING)
    a, b = count(source, NEGATIVE.get(source_lang, NEGATIVE["en"])), count(target, NEGATIVE[target_lang])
    return _if((a == 0) != (b == 0), "SENTIMENT_SHIFT", "MAJOR", F.concat(F.lit("Sentiment shift: source negatives="), a.cast("string"), F.lit(", target negatives="), b.cast("string")))


CHECKS: dict[str, Callable[[Column, Column], Column]] = {"numbers": numbers, "units": units, "pii": pii, "complexity": complexity}


def run_checks(source: Column, target: Column, names: list[str] | None = None) -> Column:
    """Findings of the named checks, check after check."""
    return F.concat(*[CHECKS[n](source, target) for n in names or CHECKS])
