"""Shaping raw files and pages into document records."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.functions import html as h
from corpusloom.functions import text as tx

RECORD = (
    "path string, file string, body string, content_type string, lang string, pages int, "
    "titles array<string>, metadata map<string,string>, error string"
)


def drop_null_content(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def normalise_content(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, tx.normalise(F.col(column)))


def basename(path: Column) -> Column:
    """Last path part; both kinds of slash separate."""
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def page_records(pages: DataFrame, path: str = "url", html: str = "html", *keep: str) -> DataFrame:
    """Document records from HTML pages.

    A page that cannot be read in full stays in the result with what could be
    filled and the reason in ``error``.
    """
    page = F.col(html)
    return pages.select(
        *keep,
        F.col(path).alias("path"),
        basename(F.col(path)).alias("file"),
        h.title(page).alias("title"),
        h.body_text(page).alias("body"),
        F.concat_ws("; charset=", F.lit("text/html"), h.charset(page)).alias("content_type"),
        h.lang(page).alias("lang"),
        h.section_count(page).alias("pages"),
        h.metadata(page).alias("metadata"),
        h.links(page).alias("link"),
        h.problem(page).alias("error"),
    )


def numbered_titles(records: DataFrame, titles: str = "titles", n: int = 3) -> DataFrame:
    """``parsed_title_0`` to ``parsed_title_{n-1}`` from an array column."""
    numbered = {f"parsed_title_{i}": F.get(titles, F.lit(i)) for i in range(n)}
    return records.withColumns(numbered).drop(titles)


def extract_files(
    files: DataFrame, extract: Callable[[str, bytes], Mapping[str, object]]
) -> DataFrame:
    """Records from binary files with a caller's own parser.

    ``extract(path, content)`` returns any of the record's fields. What it raises
    ends up in ``error``; the task goes on with the next file.
    """
    fields = [part.split()[0] for part in RECORD.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                row = dict.fromkeys(fields)
                row["path"], row["file"] = path, path.replace("\\", "/").rsplit("/", 1)[-1]
                try:
                    row.update(extract(path, bytes(content)))
                except Exception as error:
                    row["error"] = f"{type(error).__name__}: {error}"
                rows.append(row)
            frame = pd.DataFrame(rows, columns=fields)
            frame["pages"] = frame["pages"].astype("Int32")
            yield frame

    return files.select("path", "content").mapInPandas(parse, RECORD)


def suffix_fields(df: DataFrame, suffix: str = "_fr", key: str = "path") -> DataFrame:
    """Every field renamed with ``suffix``, plus ``id`` from the key field.

    Keys of a string map get the suffix as well.
    """
    renamed = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if field.dataType.typeName() == "map":
            value = F.transform_keys(value, lambda k, _: F.concat(k, F.lit(suffix)))
        renamed.append(value.alias(field.name + suffix))
    return df.select(*renamed, F.col(key).alias("id"))


def select_fields(df: DataFrame, fields: Sequence[str] | None) -> DataFrame:
    return df.select(*fields) if fields else df


def run_metrics(records: DataFrame) -> DataFrame:
    """One row: records processed and records with an error."""
    return records.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def observe_metrics(records: DataFrame, name: str = "extract") -> tuple[DataFrame, Observation]:
    """The same counts, taken while another action runs over the records."""
    seen = Observation(name)
    watched = records.observe(
        seen,
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    return watched, seen
