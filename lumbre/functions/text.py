"""Text normalisation, tokens and light stemming, all as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accented letters and their plain form, position by position.
_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def fold(c: Column) -> Column:
    """Lower case without accents or repeated blanks, for comparing texts."""
    lowered = F.translate(F.lower(c), _ACCENTED, _PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, r"[^\x00-\x7F]", ""), r"\s+", " "))


def readable(c: Column) -> Column:
    """A code as separate words: ``createRule`` and ``BILL_PAYMENT`` alike."""
    spaced = F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[_\-./:]+", " "), r"\s+", " "))


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def is_phrase(c: Column) -> Column:
    return F.size(_words(c)) >= 2


def is_worded_code(c: Column) -> Column:
    """At least two words of two or more letters once the code is spelled out."""
    words = F.filter(F.split(readable(c), " "), lambda w: w.rlike(r"^\p{L}{2,}$"))
    return F.size(words) >= 2


def share_at_least_half(flag: Column, value: Column) -> Column:
    """Aggregate: half or more of the non-blank values satisfy ``flag``."""
    present = value.isNotNull() & (F.trim(value) != "")
    return 2 * F.count_if(present & flag) >= F.count_if(present)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


# Endings of English and Spanish words that a light stemmer drops.
_ENDINGS = "mente|ciones|cion|ción|iendo|ando|ings?|edly|ed|ly|es|os|as|s"


def spaced_words(c: Column) -> Column:
    """The words in lower case, each with a blank of its own on either side: counting and
    finding a word or a phrase is then plain text search, compiled with the rest of the plan."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(c), F.lit(" ")), r"[^\p{L}\p{N}]+", "  ")


def stemmed(spaced: Column) -> Column:
    """Light suffix stripping of every word of five letters or more."""
    return F.regexp_replace(spaced, rf"(?<= )(?=[\p{{L}}\p{{N}}]{{5}})([\p{{L}}\p{{N}}]*?)(?:{_ENDINGS})(?= )", "$1")


def word_count(spaced: Column) -> Column:
    return (F.length(spaced) - F.length(F.replace(spaced, F.lit("  "), F.lit("")))) / 2 - 1


def occurrences(spaced: Column, word: str) -> Column:
    """How often a word occurs in ``spaced_words``."""
    mark = f" {word} "
    return (F.length(spaced) - F.length(F.replace(spaced, F.lit(mark), F.lit("")))) / F.lit(len(mark))


def contains_phrase(c: Column, phrase: str) -> Column:
    """The phrase as whole words anywhere in the text, whatever the case."""
    return spaced_words(c).contains(spaced_words(F.lit(phrase)))


def strip_line(c: Column) -> Column:
    """A raw line without byte-order mark, carriage return or outer blanks."""
    return F.trim(F.regexp_replace(c, "^﻿|\r$", ""))


def truncate_bytes(c: Column, size: int) -> Column:
    """First ``size`` characters of a field."""
    return F.substring(c, 1, size)


def registered_domain(host: Column) -> Column:
    """Last two labels of a host name."""
    return F.regexp_extract(F.lower(host), r"([^.]+\.[^.]+)$", 1)
