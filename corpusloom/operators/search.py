"""Faceted search over a document table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corpusloom.functions import match as m
from corpusloom.functions.rows import keep
from corpusloom.operators.facets import Facet, facet_terms
from corpusloom.session import stage


@dataclass(frozen=True)
class Choice:
    """A selected filter: ``predicate`` on ``field``, ANDed with the others, or
    ORed with the other ``any_of`` choices of its field."""

    field: str
    predicate: Column
    any_of: bool = False


@dataclass(frozen=True)
class SearchRequest:
    """What a search page asks for.

    ``choices``, ``predefined`` and ``text`` narrow hits and facets. ``post``
    narrows hits only. ``after`` is the place (:func:`cursor_of`) the hits start behind;
    ``start`` then counts from there. A chosen field whose facet has a ``where`` of its own
    applies that filter to the hits and to every facet; ``post`` then takes its
    place on the hits.
    """

    choices: tuple[Choice, ...] = ()
    predefined: tuple[Column, ...] = ()
    text: Column | None = None
    post: Column | None = None
    facets: tuple[Facet, ...] = ()
    sort: tuple[tuple[str, str], ...] = ()
    start: int = 0
    size: int = 10
    fields: tuple[str, ...] = ()
    lone_or: str = "term"
    after: tuple | None = None

    # --- changing a request: each returns a new one -------------------------
    def add(self, choice: Choice) -> SearchRequest:
        return replace(self, choices=(*self.choices, choice), start=0, after=None)

    def remove(self, choice: Choice) -> SearchRequest:
        kept = tuple(ch for ch in self.choices if ch is not choice)
        return replace(self, choices=kept, start=0, after=None)

    def clear(self, field_name: str) -> SearchRequest:
        kept = tuple(ch for ch in self.choices if ch.field != field_name)
        return replace(self, choices=kept, start=0, after=None)

    def set(self, choice: Choice) -> SearchRequest:
        return self.clear(choice.field).add(choice)

    def sorted_by(self, field_name: str, order: str = "desc") -> SearchRequest:
        return replace(self, sort=((field_name, order),), start=0, after=None)

    def next_page(self) -> SearchRequest:
        return replace(self, start=self.start + self.size)

    def page_after(self, last: Row, key: str = "doc_id") -> SearchRequest:
        """The page behind ``last``, the last hit seen, found by its values and not by counting.
        Its row has to hold the sort fields and the key."""
        return replace(self, start=0, after=cursor_of(last, self.sort, key))

    def previous_page(self) -> SearchRequest:
        return replace(self, start=max(0, self.start - self.size))


@dataclass(frozen=True)
class SearchResult:
    hits: DataFrame
    total: DataFrame
    facets: DataFrame | None = field(default=None)


def field_predicate(request: SearchRequest) -> Column:
    """Choices and predefined filters as one condition."""
    parts = [ch.predicate for ch in request.choices if not ch.any_of]
    groups: dict[str, list[Column]] = {}
    for choice in request.choices:
        if choice.any_of:
            groups.setdefault(choice.field, []).append(choice.predicate)
    for predicates in groups.values():
        alone = len(predicates) == 1 and request.lone_or == "match_all"
        parts.append(m.match_all() if alone else m.combine(predicates, "OR"))
    parts += request.predefined
    return m.combine(parts)


def matching_rows(df: DataFrame, request: SearchRequest) -> DataFrame:
    """Field conditions go down to the scan, the text is tested on what is left."""
    found = df.where(field_predicate(request))
    return found if request.text is None else keep(found, request.text)


def selected_facet_filter(request: SearchRequest) -> Column | None:
    """The ``where`` of a facet whose field has a plain (AND) choice; of several
    the last one chosen counts."""
    own = {f.field: f.where for f in request.facets if f.where is not None}
    found = [own[ch.field] for ch in request.choices if not ch.any_of and ch.field in own]
    return found[-1] if found else None


def ordered(df: DataFrame, sort: Sequence[tuple[str, str]], key: str) -> DataFrame:
    """Sort by the given fields; the key makes the order total."""
    columns = [F.col(f).asc() if way == "asc" else F.col(f).desc() for f, way in sort]
    return df.orderBy(*columns, F.col(key).asc())


def page(
    df: DataFrame, sort: Sequence[tuple[str, str]], key: str, start: int = 0, size: int = 10
) -> DataFrame:
    """One page; a top-k over ``start + size`` rows, never a full sort."""
    top = ordered(df, sort, key).limit(max(0, start) + size)
    return ordered(top, sort, key).offset(start) if start > 0 else top


def cursor_of(last: Row, sort: Sequence[tuple[str, str]], key: str) -> tuple:
    """The place of a row in the order of :func:`ordered`: its sort values and its key."""
    return tuple(last[name] for name, _ in (*sort, (key, "asc")))


def behind(cursor: tuple, sort: Sequence[tuple[str, str]], key: str) -> Column:
    """Rows that come after ``cursor`` in the order of :func:`ordered`.

    Nulls come first in ascending and last in descending order. The first field's bound
    stands by itself too, so that a scan can skip row groups by it.
    """
    order = [*sort, (key, "asc")]

    def after(name: str, way: str, value) -> Column:
        column = F.col(name)
        if way == "asc":
            return column.isNotNull() if value is None else column > F.lit(value)
        return F.lit(False) if value is None else (column < F.lit(value)) | column.isNull()

    def same(name: str, value) -> Column:
        return F.col(name).isNull() if value is None else F.col(name) == F.lit(value)

    cases, tied = [], []
    for (name, way), value in zip(order, cursor, strict=True):
        cases.append(reduce(and_, [*tied, after(name, way, value)]))
        tied.append(same(name, value))
    (name, way), value = order[0], cursor[0]
    return (same(name, value) | after(name, way, value)) & reduce(or_, cases)


def page_after(
    df: DataFrame, sort: Sequence[tuple[str, str]], key: str, cursor: tuple | None, size: int = 10
) -> DataFrame:
    """The ``size`` rows behind ``cursor`` (from the start if None): a condition and a top-k
    over ``size`` rows, however deep the page is. ``key`` has to be unique, as in a keyed
    table; of rows that share sort values and key only those of one page are seen."""
    rest = df if cursor is None else df.where(behind(cursor, sort, key))
    return ordered(rest, sort, key).limit(size)


def deep_pages(df: DataFrame, sort: Sequence[tuple[str, str]], key: str, size: int = 1000) -> Iterator[list[Row]]:
    """All pages one after the other, each a job of its own with at most ``size`` rows on
    the driver; stop when enough was seen."""
    cursor = None
    while rows := page_after(df, sort, key, cursor, size).collect():
        yield rows
        if len(rows) < size:
            return
        cursor = cursor_of(rows[-1], sort, key)


def search(df: DataFrame, request: SearchRequest, key: str = "doc_id") -> SearchResult:
    """Hits of one page, total hits and facet counts.

    The three results are separate plans over one filtered table; :func:`search_once`
    matches once when several of them are wanted.
    """
    return _results(matching_rows(df, request), request, key)


def search_once(df: DataFrame, request: SearchRequest, key: str = "doc_id") -> tuple[SearchResult, DataFrame]:
    """The results of :func:`search` and the rows that match, written once to the shared folder.

    Choices, filters and text are tested in one pass over ``df``; hits, total and facets read
    what it kept. ``df`` should hold only the columns that these need. Call
    :func:`corpusloom.session.discard` on the second value when all results were read.
    """
    matching = stage(matching_rows(df, request), "matching")
    return _results(matching, request, key), matching


def _results(matching: DataFrame, request: SearchRequest, key: str) -> SearchResult:
    chosen = selected_facet_filter(request)
    post = request.post if request.post is not None else chosen
    hits = matching if post is None else matching.where(post)
    if request.after is None:
        wanted = page(hits, request.sort, key, request.start, request.size)
    else:
        # a step on from a cursor is a few rows behind it, not behind the start
        rest = hits.where(behind(request.after, request.sort, key))
        wanted = page(rest, request.sort, key, request.start, request.size)
    if request.fields:
        wanted = wanted.select(*request.fields)
    counts = None
    if request.facets:
        base = matching if chosen is None else matching.where(chosen)
        counts = facet_terms(base, request.facets)
    return SearchResult(wanted, hits.agg(F.count(F.lit(1)).alias("total")), counts)


def partial_fields(df: DataFrame, partial: Mapping[str, Sequence[str]]) -> DataFrame:
    """Named structs of chosen fields, as ``{name: [field, ...]}``."""
    return df.select(*[F.struct(*fields).alias(name) for name, fields in partial.items()])
