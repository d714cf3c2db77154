"""Text cleaning and folding as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the source applications see it (Java's ``\s`` is ASCII only).
SPACE = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

#: What ``analytics_text`` takes for a space.
GAP = f"[{SPACE}\\x00-\\x1F\\x7F]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once however often it is used.

    A one-element array carries the value. Long chains of text functions also run faster
    this way: unrolled into one generated method they pass the size the JVM compiles.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Accented letters and their base letters, from the Unicode decompositions."""
    accented, base = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all("\u0300" <= mark <= "\u036f" for mark in parts[1:]):
            accented.append(chr(code))
            base.append(parts[0])
    return "".join(accented), "".join(base)


def strip_accents(text: Column) -> Column:
    accented, base = _accent_table()
    return F.regexp_replace(F.translate(text, accented, base), "[\u0300-\u036f]", "")


def is_blank(value: Column) -> Column:
    """True for NULL and for text of white space only."""
    return F.coalesce(~value.cast("string").rlike(f"[^{SPACE}]"), F.lit(True))


def blank_to_null(value: Column) -> Column:
    return F.when(~is_blank(value), value)


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


#: A sign other than printable ASCII. One class, no group: the matcher takes no stack frame for each word of a long text.
_STRANGE = r"[^\x20-\x7E]"
_ASCII = r"^[\x20-\x7E]*$"


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _is_tidy(text: Column) -> Column:
    """Printable ASCII words with single spaces: nothing to clean."""
    return (F.trim(text) == text) & ~F.contains(text, F.lit("  ")) & ~text.rlike(_STRANGE)


def clean_text(value: Column) -> Column:
    """Import dialect: control characters dropped, white space collapsed, NULL as ''."""
    def tidy(text: Column) -> Column:
        rest = _squeeze(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
        return F.when(_is_tidy(text), text).otherwise(rest)

    return let(_text(value), tidy)


def comparable_text(value: Column) -> Column:
    """Import dialect key: accents and case folded, punctuation except '-' to spaces."""
    def fold(text: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9-]+", " "))
        whole = F.translate(F.lower(strip_accents(clean_text(text))), "ł\u2010\u2011\u2012\u2013\u2014\u2015", "l------")
        whole = _squeeze(F.regexp_replace(whole, r"[^a-z0-9а-яёіїєґ\-\s]", " "))
        return F.when(text.rlike(_ASCII), plain).otherwise(whole)

    return let(_text(value), fold)


def analytics_text(value: Column) -> Column:
    """Analytics dialect: control characters count as spaces, NULL as ''."""
    def tidy(text: Column) -> Column:
        return F.when(_is_tidy(text), text).otherwise(_squeeze(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")))

    return let(_text(value), tidy)


def normalize_label(value: Column) -> Column:
    """Analytics dialect key: only a-z, 0-9 and % survive."""
    def fold(text: Column) -> Column:
        whole = strip_accents(F.translate(F.lower(analytics_text(text)), "łđ", "ld"))
        spelled = F.when(text.rlike(_ASCII), F.lower(text)).otherwise(whole)
        return F.trim(F.regexp_replace(spelled, "[^a-z0-9%]+", " "))

    return let(_text(value), fold)


def normalize_key(value: Column, field: str) -> Column:
    """Join key: names by comparable text, codes upper-cased without spaces; '' to NULL."""
    if field == "material":
        key = comparable_text(value)
    else:
        key = F.regexp_replace(F.upper(clean_text(value)), f"[{SPACE}]+", "")
    return F.nullif(key, F.lit(""))
