"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.functions import lexicons


def text_hash(text: Column) -> Column:
    """First 16 hex digits of the MD5 of the text in lower case, trimmed, with runs of white space as one space."""
    return F.substring(F.md5(F.regexp_replace(F.trim(F.lower(text)), r"[\t\n\x0b\x0c\r ]+", " ")), 1, 16)


def words(text: Column) -> Column:
    """Distinct words between white space of any script, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda w: w != ""))


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams in lower case; none for shorter texts."""
    t = F.lower(text)
    some = F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))
    return F.when(F.length(t) >= n, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def combined_similarity(words_a: Column, words_b: Column, grams_a: Column, grams_b: Column) -> Column:
    return 0.4 * jaccard(words_a, words_b) + 0.6 * jaccard(grams_a, grams_b)


def hits(text: Column, lexicon: Sequence[str]) -> Column:
    """Number of the lexicon's entries that the text contains."""
    return reduce(lambda x, y: x + y, [F.contains(text, F.lit(w)).cast("int") for w in lexicon], F.lit(0))


def any_of(text: Column, lexicon: Sequence[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(text, F.lit(w)) for w in lexicon], F.lit(False))


def first_class(text: Column, classes: dict[str, Sequence[str]]) -> Column:
    """The first class of which the text has a word; null if none."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name in reversed(classes):
        out = F.when(any_of(low, [w.lower() for w in classes[name]]), name).otherwise(out)
    return out


def matched(text: Column, lexicon: Sequence[str]) -> Column:
    """The lexicon's entries that the text contains, in the lexicon's order."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, lexicon)), lambda w: F.contains(low, w))


def dated(text: Column, patterns: Sequence[str] = lexicons.DATED) -> Column:
    """Whether the text makes a statement that dates quickly."""
    return reduce(lambda x, y: x | y, [text.rlike(f"(?i){p}") for p in patterns])


def valid_entity(name: Column, stop: Sequence[str] = lexicons.STOP, terms: Sequence[str] = ()) -> Column:
    """Names that can be entities: two characters or more, no stop word, no digits alone, not one character repeated, at most
    three characters only if a term or in capitals, no -ing form unless a term."""
    low = F.lower(name)
    term = low.isin(*map(str.lower, terms)) if terms else F.lit(False)
    short = (F.length(name) <= 3) & ~term & ~((name == F.upper(name)) & name.rlike("[A-Z]"))
    return (F.length(name) >= 2) & ~low.isin(*stop) & ~F.replace(name, F.lit("-"), F.lit("")).rlike(r"^\d*$") & ~low.rlike(r"^(.)\1*$") & ~short & ~(low.endswith("ing") & ~term)


def slug(name: Column) -> Column:
    return F.substring(F.translate(F.lower(name), " |", "--"), 1, 50)


def key_nouns(text: Column) -> Column:
    """Capitalised words, acronyms and short runs of ideographs."""
    return F.array_distinct(F.array_union(F.regexp_extract_all(text, F.lit(r"(\b[A-Z][a-z]{2,}\b|\b[A-Z]{2,}\b)"), 1), F.regexp_extract_all(text, F.lit(r"([\x{4e00}-\x{9fff}]{2,4})"), 1)))
