"""Text expressions: white-space tokens, sentence ends, normal forms, lexical similarity, noise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four ASCII separators, spelled out so that every regex engine agrees.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PIECE = f"[{WS}]*[^{WS}]+"
WORD = f"[^{WS}]+"
LEAD = f"^[{WS}]+"
PUNCTUATION = r"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]$"
SYMBOLS = r"^[\p{P}\p{S}]+$"
CLOSERS = r"""["'»”’)\]}]+$"""
TERMINAL = "[.!?…。！？]$"
ENUMERATION = r"^[(\[{]?[0-9a-z]{1,3}[)\].:]$"
NUMBER = r"^\p{Nd}+([.,]\p{Nd}+)?%?$"
NORM_STRIP = ".,;:!?\"'()[]{}«»“”"
MATCH_STRIP = ".,;:!?"
ALL_PUNCTUATION = r"""^[.,;:!?"'\-–—()\[\]{}]+$"""

# Abbreviations after which a sentence does not end, and the seed lexicon of cognates.
ABBREVIATIONS = (
    "e.g.", "i.e.", "etc.", "cf.", "ca.", "approx.", "vs.", "no.", "nr.", "art.",
    "abs.", "al.", "fig.", "p.", "pp.", "vol.", "dr.", "prof.", "st.", "mr.",
    "mrs.", "ms.", "u.s.", "u.k.", "u.a.", "z.b.", "d.h.", "bzw.", "usw.",
    "resp.", "bspw.", "ev.", "ggf.", "vgl.", "s.", "ff.", "p.ex.", "c.-à-d.",
    "n.b.", "par ex.", "ecc.", "es.", "sig.", "dott.", "ing.", "n.",
)
COGNATES = {
    "the": ("der", "die", "das", "le", "la", "les", "il", "lo", "i", "gli"),
    "of": ("de", "von", "der", "des", "di", "del", "della", "dei"),
    "and": ("und", "et", "e"),
    "in": ("in", "im", "dans", "en", "nel", "nella", "au"),
    "energy": ("energie", "énergie", "energia"),
    "switzerland": ("schweiz", "suisse", "svizzera"),
    "policy": ("politik", "politique", "politica"),
    "supply": ("versorgung", "approvisionnement", "fornitura"),
    "law": ("gesetz", "loi", "legge"),
    "federal": ("bundes", "fédéral", "federale"),
    "office": ("amt", "office", "ufficio", "bureau"),
    "water": ("wasser", "eau", "acqua"),
    "health": ("gesundheit", "santé", "salute"),
    "environment": ("umwelt", "environnement", "ambiente"),
    "international": ("internationale", "international", "internazionale"),
    "percent": ("prozent", "pour", "cent", "per"),
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for the row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def locate(part: Column, text: Column, begin: Column) -> Column:
    """Place from 1 of ``part`` in ``text`` at or after ``begin``, 0 without one."""
    return F.call_function("locate", part, text, begin)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def pieces(text: Column) -> Column:
    """Tokens with the white space before them; their lengths add up to the offsets."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def is_punctuation(token: Column) -> Column:
    """One ASCII character that is neither letter nor digit."""
    return token.rlike(PUNCTUATION)


def is_symbols(token: Column) -> Column:
    """Nothing but punctuation and symbols, of any script."""
    return token.rlike(SYMBOLS)


def ends_terminal(token: Column) -> Column:
    return F.regexp_replace(token, CLOSERS, "").rlike(TERMINAL)


def ends_sentence(token: Column) -> Column:
    """Terminal punctuation that neither an abbreviation nor an enumeration explains."""
    low = F.lower(token)
    return ends_terminal(token) & ~low.isin(*ABBREVIATIONS) & ~low.rlike(ENUMERATION)


def strip(value: Column, characters: str) -> Column:
    return F.call_function("btrim", value, F.lit(characters))


def norm_tokens(text: Column) -> Column:
    """Lower-case words without punctuation at either end, empty ones dropped."""
    return F.filter(F.transform(split_words(text), lambda t: strip(F.lower(t), NORM_STRIP)), lambda t: t != "")


def _cognates() -> Column:
    return F.create_map(*[x for k, v in COGNATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def lexical_similarity(a: Column, b: Column) -> Column:
    """Overlap of two sets of normal tokens (distinct arrays), with cognates and numbers, in [0, 1]."""
    book = _cognates()
    shared = F.size(F.array_intersect(a, b))
    numbers = lambda s: F.filter(s, lambda t: t.rlike(NUMBER))
    foreign = F.filter(
        a,
        lambda t: ~F.array_contains(b, t) & ~t.rlike(NUMBER) & F.coalesce(F.arrays_overlap(F.try_element_at(book, t), b), F.lit(False)),
    )
    by_number = lambda na, nb: let(F.size(F.array_intersect(na, nb)), lambda both: both + 0.5 * F.least(F.size(na), F.size(nb)) - 0.5 * both)
    overlap = shared + 0.9 * F.size(foreign) + let(numbers(a), lambda na: let(numbers(b), lambda nb: by_number(na, nb)))  # numbers are looked for once a side
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(clamp01(2 * overlap / (F.size(a) + F.size(b))))


def hash8(*parts: Column) -> Column:
    """The first 32 bits of SHA-256 over the parts joined by a bar, as a double-safe long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def noise(a: Column, b: Column, seed: int = 0) -> Column:
    """Deterministic noise in [-0.15, 0.15]."""
    return noise_of(hash8(a, b, F.lit(str(seed))))


def noise_of(hash8: Column) -> Column:
    return (hash8.cast("double") / 4294967295.0 - 0.5) * 0.3
