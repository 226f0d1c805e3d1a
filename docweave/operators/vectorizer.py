"""TF-IDF vectors over word n-grams with a bounded vocabulary, as sparse (paper, term, weight) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.tfidf import smooth_idf


def _runs(tokens: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def ngrams(tokens: Column, most: int = 2) -> Column:
    """All runs of 1 to `most` tokens, joined by a space."""
    parts = [tokens]
    for n in range(2, most + 1):
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
        parts.append(_runs(tokens, starts, n))
    return F.concat(*parts)


def term_counts(tokens: DataFrame, most: int = 2) -> DataFrame:
    """(paper_id, term, tf)."""
    return tokens.select("paper_id", F.explode(ngrams(F.col("tokens"), most)).alias("term")).groupBy("paper_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, papers: int, most_features: int = 20_000) -> DataFrame:
    """(term, df, idf) of the terms with the highest total counts; equal ones by term."""
    terms = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    kept = terms.orderBy(F.col("total").desc(), "term").limit(most_features)
    return kept.select("term", "df", smooth_idf(F.lit(papers), F.col("df")).alias("idf"))


def vectors(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(paper_id, term, weight) of unit length; the vocabulary is bounded by most_features, so it is broadcast.

    With terms of an earlier fit this is the query transform of a frozen vocabulary: unknown terms are left out.
    """
    weighted = counts.join(F.broadcast(terms.select("term", "idf")), "term").select("paper_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("paper_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "paper_id").select("paper_id", "term", (F.col("w") / F.col("norm")).alias("weight"))
