"""Tokenising and per-document word counts as column expressions.

Everything here stays inside one row: a document is split, filtered and counted
without moving its tokens to another task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import stopwords

# Letters and digits, with apostrophes allowed inside a word. The possessive
# quantifiers change no match; they keep the regex engine from recursing once
# per apostrophe.
TOKEN = r"[\p{L}\p{N}]++(?:['’][\p{L}\p{N}]++)*+"

# The articles that French elision joins to the next word.
ELISIONS = "l m t qu n s j d c jusqu quoiqu lorsqu puisqu".split()
ELISION = "^(?:" + "|".join(ELISIONS) + ")['’]"
POSSESSIVE = "['’]s$"

ASCII_LETTER = "[A-Za-z]"
ONLY_DIGITS = "^[0-9]+$"

TERM_COUNTS = "array<struct<term:string,n:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise(text: Column) -> Column:
    """Underscores become blanks, then the literal ``.pdf`` is deleted."""
    spaced = F.replace(text, F.lit("_"), F.lit(" "))
    return F.replace(spaced, F.lit(".pdf"), F.lit(""))


def split_words(text: Column) -> Column:
    """Lower-case words of ``text``, in order, before any language rule."""
    return F.regexp_extract_all(F.lower(normalise(text)), F.lit(TOKEN), F.lit(0))


def tokenise(text: Column, lang: Column | None = None) -> Column:
    """Ordered tokens; French loses elided articles, English loses ``'s``."""
    if lang is None:
        return split_words(text)
    has_apostrophe = F.contains(text, F.lit("'")) | F.contains(text, F.lit("’"))

    def by_language(words: Column) -> Column:
        french = F.transform(words, lambda w: F.regexp_replace(w, ELISION, ""))
        english = F.transform(words, lambda w: F.regexp_replace(w, POSSESSIVE, ""))
        return (
            F.when(has_apostrophe & (lang == "fr"), french)
            .when(has_apostrophe & (lang == "en"), english)
            .otherwise(words)
        )

    return let(split_words(text), by_language)


# --- tests on one token -------------------------------------------------------


def length_between(low: int = 2, high: int = 255) -> Callable[[Column], Column]:
    return lambda token: F.length(token).between(low, high)


def whole_match(pattern: str) -> Callable[[Column], Column]:
    return lambda token: token.rlike(f"^(?:{pattern})$")


def has_ascii_letter(token: Column) -> Column:
    return token.rlike(ASCII_LETTER)


def not_a_number(token: Column) -> Column:
    """At least two characters and not digits alone (the weaker rule)."""
    return ~token.rlike(ONLY_DIGITS) & (F.length(token) >= 2)


def not_stopword(
    lang: Column,
    lists: Mapping[str, Sequence[str]] = stopwords.DEFAULTS,
    other: Sequence[str] = stopwords.STANDARD,
) -> Callable[[Column], Column]:
    """Stop-word test for the row's language; ``other`` serves the rest.

    The lists are short constants, so they travel inside the expression. For a
    list kept in a table use ``operators.words.drop_stopwords``.
    """

    def test(token: Column) -> Column:
        keep = F.when(F.lit(False), F.lit(False))
        for code, words in lists.items():
            keep = keep.when(lang == code, ~token.isin(list(words)))
        return keep.otherwise(~token.isin(list(other)))

    return test


def every(*tests: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def combined(token: Column) -> Column:
        result = tests[0](token)
        for test in tests[1:]:
            result = result & test(token)
        return result

    return combined


def index_rule(lang: Column) -> Callable[[Column], Column]:
    """The default rule: 2 to 255 characters, an ASCII letter, no stop word."""
    return every(length_between(), has_ascii_letter, not_stopword(lang))


# --- stems --------------------------------------------------------------------


def light_stem(term: Column, lang: Column) -> Column:
    """Plural stripping: the S-stemmer of Harman (1991) for English, and a few
    plural endings for French. Other languages are left alone.

    Stems differ from those of a search library's analyser; stemming is off by
    default, and a ``(lang, term, stem)`` table can replace this rule.
    """
    english = (
        F.when(
            term.rlike("ies$") & ~term.rlike("[ea]ies$"), F.regexp_replace(term, "ies$", "y")
        )
        .when(term.rlike("es$") & ~term.rlike("[aeo]es$"), F.regexp_replace(term, "es$", "e"))
        .when(term.rlike("s$") & ~term.rlike("[us]s$"), F.regexp_replace(term, "s$", ""))
        .otherwise(term)
    )
    french = (
        F.when(term.rlike("eaux$"), F.regexp_replace(term, "x$", ""))
        .when(term.rlike("[^s]s$") & (F.length(term) > 3), F.regexp_replace(term, "s$", ""))
        .otherwise(term)
    )
    return F.when(lang == "en", english).when(lang == "fr", french).otherwise(term)


# --- shingles and counts ------------------------------------------------------


def shingles(tokens: Column, low: int = 1, high: int = 3) -> Column:
    """All runs of ``low`` to ``high`` adjacent tokens, joined by a blank."""

    def runs(words: Column) -> Column:
        def of_length(k: int) -> Column:
            starts = F.sequence(F.lit(1), F.size(words) - (k - 1))
            joined = F.transform(
                starts, lambda i: F.concat_ws(" ", *[F.get(words, i + (j - 1)) for j in range(k)])
            )
            return F.when(F.size(words) >= k, joined).otherwise(F.array().cast("array<string>"))

        return F.concat(*[of_length(k) for k in range(low, high + 1)])

    return let(tokens, runs)


def count_terms(tokens: Column) -> Column:
    """Distinct tokens of one array with their counts, in term order.

    Sorting the array puts equal tokens side by side; each run's start and the
    next run's start give the count. No shuffle, whatever the table's size.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)),
        )

        def entries(firsts: Column) -> Column:
            def entry(first: Column, j: Column) -> Column:
                following = F.coalesce(F.get(firsts, j + 1), F.size(ordered) + 1)
                return F.struct(
                    F.get(ordered, first - 1).alias("term"),
                    (following - first).cast("bigint").alias("n"),
                )

            return F.transform(firsts, entry)

        empty = F.array().cast(TERM_COUNTS)
        return F.when(F.size(ordered) > 0, let(starts, entries)).otherwise(empty)

    return let(F.sort_array(tokens), runs)


def term_counts(
    text: Column,
    lang: Column | None = None,
    keep: Callable[[Column], Column] | None = None,
) -> Column:
    """``array<struct<term, n>>`` of one document; ``keep`` sees each distinct
    term once, so its tests cost per vocabulary entry and not per token."""
    counts = count_terms(tokenise(text, lang))
    return counts if keep is None else F.filter(counts, lambda e: keep(e["term"]))
