"""Scalar and array functions on tokens and sentences, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlens.config import ARTICLES, PUNCTUATION, STOP_WORDS


def split_tokens(text: Column) -> Column:
    """Runs of non-space characters; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), F.lit(1))


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def span(tokens: Column, s: Column, e: Column) -> Column:
    """Tokens s to e, both included (0-based)."""
    return F.slice(tokens, s + 1, e - s + 1)


def window(tokens: Column, s: Column, e: Column, width: int) -> Column:
    """The span with ``width`` tokens more on either side, clamped to the sentence."""
    low = F.greatest(s - width, F.lit(0))
    return F.slice(tokens, low + 1, F.least(e + width, F.size(tokens) - 1) - low + 1)


def starts_upper(token: Column) -> Column:
    return ((token < "a") | (token >= "{")) & token.rlike(r"^\p{Lu}")  # no pattern for the many that start with a to z


def all_upper(token: Column) -> Column:
    """Some cased letter, and none in lower case."""
    return token.rlike(r"\p{Lu}") & ~token.rlike(r"\p{Ll}")


def all_digits(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+$")


def is_punctuation(token: Column) -> Column:
    """Whether the token is a substring of the punctuation string, as single marks and the empty token are."""
    return F.instr(F.lit(PUNCTUATION), token) > 0


def starts_punctuation(token: Column) -> Column:
    return F.instr(F.lit(PUNCTUATION), F.substring(token, 1, 1)) > 0


def is_stop(token: Column) -> Column:
    return token.isin(*STOP_WORDS)


def is_article(token: Column) -> Column:
    return F.lower(token).isin(*ARTICLES)


def squeeze(text: Column) -> Column:
    """Lower case without spaces: names are compared like this when they differ in case or spacing."""
    return F.replace(F.lower(text), F.lit(" "), F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def known_characters(name: Column, sentence: Column) -> Column:
    """The name without characters that the sentence does not have."""
    return F.array_join(F.filter(F.split(name, ""), lambda c: F.contains(sentence, c)), "")


def after_marker(text: Column, marker: str) -> Column:
    """Text between the first marker and the second, or the end; null without the marker."""
    return F.try_element_at(F.split(text, r"\Q" + marker + r"\E"), F.lit(2))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def base_name(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)
