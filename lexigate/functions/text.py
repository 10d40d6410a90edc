"""Scalar text functions as column expressions: segmenting, folding, masking, tolerant JSON."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations whose dot does not end a sentence.
TITLES = ["Dr", "Drs", "Mr", "Mrs", "Ms", "Prof", "St", "Sr", "Jr"]
CREDENTIALS = ["M.D", "Ph.D", "D.M", "B.Sc", "M.Sc", "M.P.H", "D.O", "R.N", "M.S", "M.A", "B.A", "D.D.S", "Pharm.D", "M.B.A", "D.Phil"]
CONTEXTUAL = ["e.g", "i.e", "etc", "vs", "cf", "i.v", "i.m", "p.o", "s.c", "b.i.d", "t.i.d", "q.i.d", "q.d", "qhs", "mg", "mcg", "kg", "mL", "ml", "L", "g", "Co", "Inc", "Ltd", "Corp", "No", "Nr", "vol", "Vol", "ed", "Ed", "Rd", "pp", "al", "Fig", "Eq", "Ref"]
CAP = 1000

_MARK = "\u0001"


def _folded() -> tuple[str, str]:
    """Letters and what is left of each without its accents, by rule; Hangul syllables stay whole."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x10000) if not 0xAC00 <= c <= 0xDFFF]
    pairs = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs]
    kept = [(c, d) for c, d in pairs if len(d) == 1 and d != c]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


def fold(x: Column) -> Column:
    """Letters without their accents, loose combining marks dropped."""
    return F.regexp_replace(F.translate(x, *_folded()), r"[\u0300-\u036f\u0591-\u05bd\u064b-\u065f\u0670\u3099\u309a]", "")


def _compatible() -> tuple[str, str]:
    """Characters whose compatibility form is one other character, and those forms, by rule."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xA0, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    kept = [(c, d) for c, d in pairs if len(d) == 1 and d != c]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


def plain(x: Column) -> Column:
    """Compatibility characters in their plain form, zero-width characters dropped, runs of space as one space.

    Characters whose plain form is more than one (ligatures) stay as they are.
    """
    shown = F.when(x.rlike(r"[^\x00-\x7F]"), F.translate(x, *_compatible())).otherwise(x)
    bare = F.regexp_replace(shown, r"[\u200b\u200c\u200d\u2060\ufeff]", "")
    return F.regexp_replace(bare, r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " ")


def words(x: Column) -> Column:
    """Words between runs of space: the one notion of a word that every count shares."""
    return F.filter(F.split(x, r"[\x20\x09-\x0D 　]+"), lambda w: w != "")


def sentences(x: Column) -> Column:
    """Sentences after . ! ? and space, but not after titles, initials and abbreviations in a sentence."""
    chunks = F.split(F.regexp_replace(x, r"([.!?]+\s+)", "$1" + _MARK), _MARK, -1)

    last = lambda c: F.regexp_replace(F.regexp_extract(c, r"(?<!\S)(\S*)\s*$", 1), r"[.!?]+$", "")
    lasts = F.concat(F.array(F.lit(None).cast("string")), F.transform(chunks, last))

    def opened(p: Column) -> Column:
        later = p["last"].isin(CONTEXTUAL + CREDENTIALS) & ~p["c"].rlike("^[A-Z0-9]")
        goes_on = p["last"].isNull() | p["last"].rlike(r"^\p{Lu}$") | p["last"].isin(TITLES) | later
        return F.when(goes_on, p["c"]).otherwise(F.concat(F.lit(_MARK), p["c"]))

    pairs = F.filter(F.arrays_zip(chunks.alias("c"), lasts.alias("last")), lambda p: p["c"].isNotNull())
    parts = F.split(F.array_join(F.transform(pairs, opened), ""), _MARK, -1)
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def cjk_sentences(x: Column) -> Column:
    """Sentences after full-width or ASCII ! ? and the full stop, closing marks with them."""
    chunks = F.split(F.regexp_replace(x, r"""([。！？!?]+[」』）)】〕》”’"']*)""", "$1" + _MARK), _MARK, -1)
    return F.filter(F.transform(chunks, lambda s: F.trim(s)), lambda s: s != "")


def capped(parts: Column, most: int = CAP) -> Column:
    """Parts over the cap, split after ; , : first and in pieces of the cap where that is not enough."""

    def pieces(s: Column) -> Column:
        chunks = F.flatten(F.transform(F.split(s, r"(?<=[;,:])\s+"), lambda c: F.regexp_extract_all(c, F.lit(f"(?s).{{1,{most}}}"), F.lit(0))))

        def add(acc: Column, c: Column) -> Column:
            fits = (acc["open"] != "") & (F.length(acc["open"]) + 1 + F.length(c) <= most)
            return F.struct(
                F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"),
                F.when(fits, F.concat_ws(" ", acc["open"], c)).otherwise(c).alias("open"),
            )

        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
        return F.aggregate(chunks, start, add, lambda a: F.array_append(a["done"], a["open"]))

    return F.flatten(F.transform(parts, lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(pieces(s))))


MASKED = "array<struct<token: string, original: string>>"


def mask(x: Column, shapes: dict[str, str]) -> Column:
    """(masked, map): every match of each shape in turn becomes a numbered token."""
    out = F.struct(x.alias("masked"), F.array().cast(MASKED).alias("map"))
    for kind, pattern in shapes.items():
        out = F.element_at(F.transform(F.array(out), _masking(kind, pattern)), 1)  # a lambda binds the state once
    return out


def _masking(kind: str, pattern: str):
    def step(state: Column) -> Column:
        text = state["masked"]
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        tokens = F.transform(found, lambda m, i: F.struct(F.concat(F.lit(f"<{kind}_"), (i + 1).cast("string"), F.lit(">")).alias("token"), m.alias("original")))
        joined = F.zip_with(F.split(text, pattern, -1), tokens, lambda gap, t: F.concat(gap, F.coalesce(t["token"], F.lit(""))))
        return F.struct(F.array_join(joined, "").alias("masked"), F.concat(state["map"], tokens).alias("map"))

    return step


def unmask(masked: Column, tokens: Column) -> Column:
    """The text with every token put back."""
    return F.aggregate(tokens, masked, lambda t, m: F.replace(t, m["token"], m["original"]))


def tolerant_json(x: Column) -> Column:
    """JSON text: the string itself, a fenced block in it, or from its first { to its last }; else null."""
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    good = lambda s: F.when(F.get_json_object(s, "$").isNotNull(), s)
    return F.coalesce(good(x), good(fenced), good(braces))


def conserved(original: Column, revised: Column, spans: Column) -> Column:
    """True where every part of the original outside the flagged (start, end) spans is in the revision."""
    ordered = F.array_sort(F.filter(spans, lambda s: s["end"] > s["start"]))

    def take(acc: Column, s: Column) -> Column:
        part = original.substr(acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.array_append(acc["parts"], part).alias("parts"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    parts = F.aggregate(ordered, start, take, lambda a: F.array_append(a["parts"], original.substr(a["at"] + 1, F.length(original))))
    return F.forall(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.contains(revised, p))
