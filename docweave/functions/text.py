"""Text and number expressions on columns; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: the order of the labels, and the words that tokens leave out.
LABELS = ("A_TO_B", "B_TO_A", "PEER", "NONE")
RELATED = LABELS[:3]
STOPWORDS = ("a", "an", "and", "are", "as", "at", "based", "be", "by", "for", "from", "in", "into", "is", "of", "on", "or", "the", "to", "using", "via", "with")


def tokenize(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, of two letters or more and no stopword, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def unique_tokens(text: Column) -> Column:
    return F.array_distinct(tokenize(text))


def clean_number(value: Column) -> Column:
    """The number that a value holds, else 0."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def safe_year(value: Column) -> Column:
    return value.try_cast("int")


def clean_text(text: Column) -> Column:
    """White space collapsed to single spaces and removed at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normal_venue(venue: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(venue, F.lit("")), r"^\s+|\s+$", ""))


def shared(left: Column, right: Column) -> Column:
    """Size of the intersection of two arrays of distinct values."""
    return F.size(F.array_intersect(left, right)).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def jaccard(left: Column, right: Column) -> Column:
    both = shared(left, right)
    return ratio(both, F.size(left) + F.size(right) - both)


def containment(left: Column, right: Column) -> Column:
    """Share of left that is in right."""
    return ratio(shared(left, right), F.size(left))


def capped_share(value: Column, most: float) -> Column:
    return F.least(value.cast("double"), F.lit(most)) / most


def clamped_share(value: Column, most: float) -> Column:
    """value / most, clamped to -1 and 1; null becomes 0."""
    return F.greatest(F.least(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(most)), F.lit(-most)) / most


def venue_match(a: Column, b: Column) -> Column:
    return (a != "") & (a == b)


def label_ordinal(label: Column) -> Column:
    """0 to 3; an unknown label stops the query."""
    known = F.array_position(F.array(*[F.lit(x) for x in LABELS]), label)
    return F.when(known > 0, (known - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("int"))


def ordinal_label(ordinal: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), (ordinal + 1).cast("int"))


def best_label(probabilities: Column) -> Column:
    """The first label of the largest probability, in the labels' order."""
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position(probabilities, F.array_max(probabilities)).cast("int"))


def scattered(classes: Column, probabilities: Column) -> Column:
    """Probabilities of some classes in the four labels' order; a missing class has 0."""
    by = F.map_from_arrays(classes, probabilities)
    return F.array(*[F.coalesce(by[F.lit(x)], F.lit(0.0)) for x in LABELS])


def backend_list(text: Column) -> Column:
    """Names between commas, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
