"""Pairs of papers and their eleven features, in the contractual order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import capped_share, clamped_share, clean_number, containment, jaccard, normal_venue, safe_year, shared, unique_tokens, venue_match
from docweave.operators.texts import reference_text

FEATURES = (
    "title_jaccard", "abstract_jaccard", "reference_jaccard", "reference_overlap", "content_cosine", "title_a_in_b", "title_b_in_a",
    "year_diff_a_minus_b", "reference_count_diff_a_minus_b", "title_len_diff_a_minus_b", "venue_match",
)


def block_pairs(papers: DataFrame, block: tuple[str, ...] = ("lang", "venue")) -> DataFrame:
    """Each arriving paper (A) with all papers of its block that arrived before (B): an equi-join with an inequality."""
    a = papers.select(F.col("paper_id").alias("paper_a_id"), F.col("split_index").alias("pa"), *[F.col(c).alias(f"a_{c}") for c in block])
    b = papers.select(F.col("paper_id").alias("paper_b_id"), F.col("split_index").alias("pb"), *[F.col(c).alias(f"b_{c}") for c in block])
    same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in block]
    return a.join(b, [*same, (F.col("pa") > F.col("pb")) | ((F.col("pa") == F.col("pb")) & (F.col("paper_a_id") > F.col("paper_b_id")))]).select("paper_a_id", "paper_b_id")


def ordered_pairs(papers: DataFrame, block: tuple[str, ...] = ("lang", "venue")) -> DataFrame:
    """Both directions of block_pairs."""
    one = block_pairs(papers, block)
    return one.union(one.select(F.col("paper_b_id").alias("paper_a_id"), F.col("paper_a_id").alias("paper_b_id")))


def token_ids(text: Column) -> Column:
    return F.transform(unique_tokens(text), lambda t: F.xxhash64(t))


def paper_features(papers: DataFrame, most_references: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """What pairs need of a paper, computed once for each paper: tokens as 64-bit hashes, which are short to send and are
    intersected as numbers (of a million different tokens two are alike with odds of one to thirty million).  Columns to
    keep as they are get a name with an underscore."""
    return papers.select(
        "paper_id", token_ids(F.col("title")).alias("title"), token_ids(F.col("abstract")).alias("abstract"), token_ids(reference_text(F.col("reference_titles"), most_references)).alias("refs"),
        safe_year(F.col("publication_year").cast("string")).alias("year"), clean_number(F.col("reference_count").cast("string")).alias("count"), normal_venue(F.col("venue")).alias("venue"),
        *[F.col(c).alias(f"_{c}") for c in keep],
    )


def with_both(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """pairs with the structs a and b of their papers; a paper that is not there stops the query."""
    known = features.select("paper_id", F.struct(*[c for c in features.columns if c != "paper_id"]).alias("of"))
    for side in ("a", "b"):
        key = f"paper_{side}_id"
        pairs = pairs.join(known.select(F.col("paper_id").alias(key), F.col("of").alias(side)), key, "left")
        missing = F.raise_error(F.concat(F.lit("unknown paper: "), F.col(key).cast("string"))).cast(dict(pairs.dtypes)[side])
        pairs = pairs.withColumn(side, F.when(F.col(side).isNull(), missing).otherwise(F.col(side)))
    return pairs


def raw_features(both: DataFrame, keep: tuple[str, ...] = ("paper_a_id", "paper_b_id")) -> DataFrame:
    """The features but content_cosine, which comes from the token tables, unscaled."""
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    return both.select(
        *keep,
        jaccard(a("title"), b("title")).alias("title_jaccard"), jaccard(a("abstract"), b("abstract")).alias("abstract_jaccard"), jaccard(a("refs"), b("refs")).alias("reference_jaccard"),
        shared(a("refs"), b("refs")).alias("reference_overlap"), containment(a("title"), b("title")).alias("title_a_in_b"), containment(b("title"), a("title")).alias("title_b_in_a"),
        (a("year") - b("year")).alias("year_diff_a_minus_b"), (a("count") - b("count")).alias("reference_count_diff_a_minus_b"),
        (F.size(a("title")) - F.size(b("title"))).alias("title_len_diff_a_minus_b"), venue_match(a("venue"), b("venue")).alias("venue_match"),
    )


def scaled_features(raw: DataFrame, keep: tuple[str, ...] = ("paper_a_id", "paper_b_id")) -> DataFrame:
    """Features on comparable scales: overlap to 30, years and lengths to 20, counts to 100, booleans to 1 and 0."""
    special = {
        "reference_overlap": capped_share(F.col("reference_overlap"), 30.0),
        "year_diff_a_minus_b": clamped_share(F.col("year_diff_a_minus_b"), 20.0),
        "reference_count_diff_a_minus_b": clamped_share(F.col("reference_count_diff_a_minus_b"), 100.0),
        "title_len_diff_a_minus_b": clamped_share(F.col("title_len_diff_a_minus_b"), 20.0),
        "venue_match": F.col("venue_match").cast("double"),
    }
    return raw.select(*keep, *[special.get(c, F.col(c)).alias(c) for c in FEATURES if c in raw.columns])


def feature_stats(features: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(feature, mean, std): sample deviation, 1e-6 at least."""
    sums = features.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.greatest(F.coalesce(F.stddev_samp(c), F.lit(0.0)), F.lit(1e-6)).alias(f"s_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std")) for c in columns])
    return sums.select(F.inline(rows))


def standardized(features: DataFrame, train: DataFrame, columns: tuple[str, ...], keep: tuple[str, ...] = ("paper_a_id", "paper_b_id")) -> DataFrame:
    """(x - mean) / deviation with the training rows' statistics."""
    sums = train.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.greatest(F.coalesce(F.stddev_samp(c), F.lit(0.0)), F.lit(1e-6)).alias(f"s_{c}"))])
    return features.join(F.broadcast(sums)).select(*keep, *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in columns])


def standardized_by(features: DataFrame, stats: DataFrame, columns: tuple[str, ...], keep: tuple[str, ...] = ("paper_a_id", "paper_b_id")) -> DataFrame:
    """(x - mean) / deviation by rows of feature_stats."""
    one = stats.agg(*[F.max(F.when(F.col("feature") == c, F.col(k))).alias(f"{k}_{c}") for c in columns for k in ("mean", "std")])
    return features.join(F.broadcast(one)).select(*keep, *[((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).alias(c) for c in columns])
