"""Texts that are made of a paper's fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import clean_text


def reference_text(titles: Column, most: int = 80) -> Column:
    """The first titles (0: all) joined by a space; null becomes empty."""
    titles = F.coalesce(titles, F.array().cast("array<string>"))
    return F.array_join(F.slice(titles, 1, most) if most else titles, " ")


def metadata_text(most: int = 80) -> Column:
    """Title, abstract, venue and references joined by a space; 0 takes all references."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "abstract", "venue")], reference_text(F.col("reference_titles"), most))


def labelled_text(count: bool = True, titles: bool = True, most: int = 0) -> Column:
    """Named fields with empty ones left out; a count of 0 stays."""
    parts = [("Title", F.col("title")), ("Abstract", F.col("abstract")), ("Year", F.col("publication_year").cast("string")), ("Venue", F.col("venue"))]
    if count:
        parts.append(("Reference count", F.col("reference_count").cast("string")))
    if titles:
        own = F.coalesce(F.col("reference_titles"), F.array().cast("array<string>"))
        own = F.filter(F.transform(F.slice(own, 1, most) if most else own, clean_text), lambda x: x != "")
        parts.append(("Reference titles", F.array_join(own, " | ")))
    return F.concat_ws(" ", *[F.when(clean_text(c) != "", F.concat(F.lit(f"{name}: "), clean_text(c))) for name, c in parts])
