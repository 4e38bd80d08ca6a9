"""Marked text fragments around query words."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

FRAGMENT = 500
PIECE = tx.TOKEN + r"|[^\p{L}\p{N}]+"
CUT_START, CUT_END = r"^[\p{L}\p{N}'’]+", r"[\p{L}\p{N}'’]+\z"


def pieces(text: Column) -> Column:
    """``text`` as an array of tokens and of what stands between them."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def mark(text: Column, words: Sequence[str], pre: str, post: str) -> Column:
    """Wrap every whole token that equals a query word."""

    def wrap(piece: Column) -> Column:
        return F.when(F.lower(piece).isin(list(words)), F.concat(F.lit(pre), piece, F.lit(post))).otherwise(piece)

    return F.array_join(F.transform(pieces(text), wrap), "")


def first_hit(text: Column, words: Sequence[str]) -> Column:
    """0-based character position of the first matching token, or null."""

    def position(parts: Column) -> Column:
        hits = F.filter(
            F.sequence(F.lit(1), F.size(parts)), lambda i: F.lower(F.get(parts, i - 1)).isin(list(words))
        )
        return F.when(
            (F.size(parts) > 0) & (F.size(hits) > 0),
            F.length(F.array_join(F.slice(parts, F.lit(1), F.get(hits, F.lit(0)) - 1), "")),
        )

    return tx.let(pieces(text), position)


def fragment(
    text: Column,
    words: Sequence[str],
    size: int = FRAGMENT,
    pre: str = "<mark>",
    post: str = "</mark>",
) -> Column:
    """``...f...`` with ``f`` the first fragment that holds a query word.

    The fragment has ``size`` characters and starts half of that before the first
    hit; a word cut at either edge is dropped. Where a fragment begins and ends is
    this library's choice. Null without a hit.
    """

    def cut(hit: Column) -> Column:
        start = F.greatest(hit - size // 2, F.lit(0))
        window = F.substring(text, start + 1, F.lit(size))
        before = F.substring(text, start, F.lit(1))
        inside_left = (start > 0) & before.rlike(r"[\p{L}\p{N}'’]")
        after = F.substring(text, start + 1 + size, F.lit(1))
        window = F.when(inside_left, F.regexp_replace(window, CUT_START, "")).otherwise(window)
        window = F.when(after.rlike(r"[\p{L}\p{N}'’]"), F.regexp_replace(window, CUT_END, "")).otherwise(window)
        return F.concat(F.lit("..."), mark(window, words, pre, post), F.lit("..."))

    lowered = F.lower(text)
    possible = reduce(or_, [F.contains(lowered, F.lit(w)) for w in words])
    found = tx.let(first_hit(text, words), lambda hit: F.when(hit.isNotNull(), cut(hit)))
    return F.when(possible, found)
