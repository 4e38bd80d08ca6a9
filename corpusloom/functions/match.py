"""Search predicates as boolean columns.

Text predicates work on token arrays (see ``functions.text.tokenise``). Null
fields do not match, as in a search index; wrap in :func:`exclude` to negate.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

# Words of a query, cut like document tokens.
QUERY_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def match_all() -> Column:
    return F.lit(True)


def term(field: Column, value: object) -> Column:
    return field == F.lit(value)


def in_range(field: Column, low: object = None, high: object = None) -> Column:
    """Both ends included; a missing end is open."""
    tests = []
    if low is not None:
        tests.append(field >= F.lit(low))
    if high is not None:
        tests.append(field <= F.lit(high))
    return reduce(and_, tests) if tests else match_all()


def any_of(field: Column, values: Sequence[object], lone_or: str = "term") -> Column:
    """OR over values of one field.

    A single value filters like :func:`term`; ``lone_or="match_all"`` makes it
    filter nothing, so that OR takes effect from two values on.
    """
    if lone_or == "match_all" and len(values) == 1:
        return match_all()
    return field.isin(list(values))


def has_value(field: Column, value: object) -> Column:
    """Term match on a multi-value (array) field."""
    return F.array_contains(field, F.lit(value))


def nested_any(field: Column, test: Callable[[Column], Column]) -> Column:
    """Some object of an array meets ``test``, all of it on the same object."""
    return F.exists(field, test)


def exclude(predicate: Column) -> Column:
    """Rows that do not match; a null field is kept."""
    return ~F.coalesce(predicate, F.lit(False))


def combine(predicates: Sequence[Column], operator: str = "AND") -> Column:
    if not predicates:
        return match_all()
    return reduce(and_ if operator == "AND" else or_, predicates)


def keep_matching(df: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """The OR group for long value lists: a semi-join on ``values[key]``."""
    return df.join(values.select(key), key, "left_semi")


# --- free text ----------------------------------------------------------------


def query_words(query: str) -> list[str]:
    cleaned = query.replace("_", " ").replace(".pdf", "")
    return [w.lower() for w in QUERY_WORD.findall(cleaned)]


def analysed_words(query: str, lang: str | None) -> list[str]:
    """Words of a query under the rules that documents of a language go through."""
    words = query_words(query)
    if lang == "fr":
        words = [re.sub(tx.ELISION, "", w) for w in words]
    elif lang == "en":
        words = [re.sub(tx.POSSESSIVE, "", w) for w in words]
    return [w for w in words if w]


def by_language(lang: Column | None, query: str, test: Callable[[list[str]], Column]) -> Column:
    """``test`` on the query's words, which differ by the row's language."""
    plain = analysed_words(query, None)
    special = {code: analysed_words(query, code) for code in ("fr", "en")}
    special = {code: words for code, words in special.items() if words != plain}
    if lang is None or not special:
        return test(plain)
    choice = F
    for code, words in special.items():
        choice = choice.when(lang == code, test(words))
    return choice.otherwise(test(plain))


def fuzzify(query: str, mark: str | None) -> list[str]:
    """Blank-separated words of a query, wrapped as ``*w*`` or marked ``w~``.

    A query that already holds ``*``, ``~`` or ``:`` is left as written.
    """
    parts = [p for p in query.split(" ") if p]
    if mark not in ("*", "~") or any(ch in query for ch in "*~:"):
        return parts
    return [f"*{p}*" if mark == "*" else f"{p}~" for p in parts]


def allowed_edits(word: str) -> int:
    """Edit distance for a fuzzy word, by its length (0, 1 or 2)."""
    return 0 if len(word) < 3 else 1 if len(word) < 6 else 2


def near(token: Column, word: str, edits: int | None = None) -> Column:
    """``token`` is within ``edits`` of ``word``; the length test goes first."""
    limit = allowed_edits(word) if edits is None else edits
    if limit == 0:
        return token == word
    close = F.length(token).between(len(word) - limit, len(word) + limit)
    return close & (F.levenshtein(token, F.lit(word), limit) >= 0)


def like_pattern(word: str) -> str:
    escaped = word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return escaped.replace("*", "%").replace("?", "_")


def has_word(tokens: Column, word: str) -> Column:
    """One query word: plain, with ``*`` and ``?`` wildcards, or fuzzy ``word~``."""
    word = word.lower()
    if word.endswith("~"):
        return F.exists(tokens, lambda t: near(t, word[:-1]))
    if "*" in word or "?" in word:
        return F.exists(tokens, lambda t: t.like(like_pattern(word)))
    return F.array_contains(tokens, word)


def free_text(
    fields: Sequence[Column],
    query: str,
    operator: str = "OR",
    fuzzy_mark: str | None = None,
) -> Column:
    """Words of ``query`` over one or several token arrays.

    Each word may be found in any field; ``operator`` joins the words.
    """
    words = fuzzify(query, fuzzy_mark) if fuzzy_mark else query_words(query)
    return combine(
        [combine([has_word(field, w) for field in fields], "OR") for w in words], operator
    )


def phrase(tokens: Column, words: str, lang: Column | None = None) -> Column:
    """The query's words side by side and in order."""
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return by_language(lang, words, lambda ws: F.contains(line, F.lit(" " + " ".join(ws) + " ")))


def two_fields(first: Column, second: Column, query: str) -> Column:
    """Every word on either field, all ORed; a quoted query goes to both fields
    as one phrase."""
    if '"' in query:
        quoted = query.replace('"', " ")
        return phrase(first, quoted) | phrase(second, quoted)
    words = [part for part in query.split(" ") if part]
    return combine([phrase(first, w) | phrase(second, w) for w in words], "OR")


def may_contain(text: Column, words: Sequence[str], operator: str = "AND") -> Column:
    """Cheap necessary test for :func:`free_text` on plain words.

    A token is always a substring of the normalised text, so rows that fail this
    test cannot match and need not be tokenised.
    """
    lowered = F.lower(tx.normalise(text))
    return combine([F.contains(lowered, F.lit(w)) for w in words], operator)


def text_query(text: Column, lang: Column | None, query: str, operator: str = "OR") -> Column:
    """:func:`free_text` on one text column, tokenising only where the cheap test
    leaves a chance."""
    tokens = tx.tokenise(text, lang)
    return by_language(
        lang,
        query,
        lambda words: may_contain(text, words, operator)
        & combine([has_word(tokens, w) for w in words], operator),
    )


def text_phrase(text: Column, lang: Column | None, words: str) -> Column:
    """:func:`phrase` on one text column, with the same cheap test first."""
    possible = by_language(lang, words, lambda ws: may_contain(text, ws))
    return possible & phrase(tx.tokenise(text, lang), words, lang)
