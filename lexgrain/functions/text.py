"""Text cleaning, tokenisation and n-grams as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexgrain.functions import charclasses as cc

# Repairs applied in this order once single spaces are left: inside a pair of double
# quotes, before punctuation, and around a slash.
SPACING_REPAIRS = [
    ('" (.*?) "', '"$1"'),
    (" ([.,;!?:'])", "$1"),
    (" ?/ ?", "/"),
]


def collapse_spaces(text: Column) -> Column:
    """Turn each run of whitespace into one space and strip both ends."""
    return F.trim(F.regexp_replace(text, f"{cc.WS_JAVA}+", " "))


def clean_text(text: Column) -> Column:
    """Normalise spacing; null stays null.

    After the first step a space is always a single ``U+0020`` between two other characters, so
    the repairs need to look for one plain space only.
    """
    cleaned = collapse_spaces(text)
    for pattern, replacement in SPACING_REPAIRS:
        cleaned = F.regexp_replace(cleaned, pattern, replacement)
    return cleaned


def whitespace_tokens(text: Column) -> Column:
    """Lower-cased maximal runs of non-space characters, in order.

    After collapsing, one space separates two words; only a text without words splits into "".
    """
    return F.array_remove(F.split(collapse_spaces(F.lower(text)), " "), "")


def word_tokens(text: Column) -> Column:
    """Lower-cased maximal runs of two or more word characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(cc.WORD_TOKEN), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """Every pair of neighbours joined by one space.

    ``tokens`` is referenced several times: pass a materialised column, not a long expression.
    """
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), pairs),
        F.slice(tokens, F.lit(2), pairs),
        lambda left, right: F.concat_ws(" ", left, right),
    )


def unigrams_and_bigrams(tokens: Column) -> Column:
    """All tokens, then all bigrams."""
    return F.concat(tokens, bigrams(tokens))


def truncate_tokens(tokens: Column, max_length: int) -> Column:
    return F.slice(tokens, 1, max_length)


def pad_tokens(tokens: Column, max_length: int, pad: str = "") -> Column:
    """First ``max_length`` tokens, filled on the right with ``pad`` to exactly that length."""
    missing = F.greatest(F.lit(max_length) - F.size(tokens), F.lit(0))
    return F.concat(truncate_tokens(tokens, max_length), F.array_repeat(F.lit(pad), missing))


def padding_mask(tokens: Column, max_length: int) -> Column:
    """1 for a real token, 0 for padding; same length as :func:`pad_tokens`."""
    kept = F.least(F.size(tokens), F.lit(max_length))
    return F.concat(
        F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(max_length) - kept)
    )
