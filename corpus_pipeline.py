"""A training corpus in five stages, each over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the folder that
all executors share, reads it again as the next stage's docs and deletes it when that stage has been written.  All but the last return the columns of documents.

Defined results: documents without words (null, empty, blank) are rejected by the first stage; rows with null ids pass
the stages that compare ids (they lose passages to rows with ids, never the other way round) and repeated rows stay
repeated, unless a near copy with a smaller id drops their id; of near copies with equal texts the smallest id stays;
extra columns go; an empty table gives an empty one.  Very long texts are kept whole; one text is held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, kit, mixing, ngram_join, quality, substring_dedup

#: The columns of documents; others do not enter the corpus.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Text in a chunk of the dedup, and in a block of the classifier and the encoder: less than when an operator has the executors for itself,
#: as workers of the stages before still hold memory.
CHUNK_BYTES, BLOCK_BYTES = 2 << 20, 2 << 20


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text is within their language's threshold; those without words go."""
    return quality.keep_quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), BLOCK_BYTES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (sets of five-word n-grams, Jaccard similarity of 0.8 or more) the smallest id; rows
    without an id and documents without words have no copies."""
    return ngram_join.drop_near_duplicates(docs.select(*COLUMNS), k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 13 words or more that a document with a smaller id has; those left empty go."""
    kept = substring_dedup.remove_repeats(docs.select(*COLUMNS), k=13, layout=True, extra=("lang", "source"), chunk_bytes=CHUNK_BYTES)
    return kept.where(F.col("n_words") > F.col("n_removed")).select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of all sources by their target weights, some of them repeated, in shuffled shards."""
    return mixing.mix(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, ids and SHA-256 of the bytes that the ids decode to, of each row of the mix."""
    import public_tokenizers

    vocabulary = bpe.vocabulary_of(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    decoded = bpe.decode(bpe.encode(docs, vocabulary, block_bytes=BLOCK_BYTES), vocabulary)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL can't express the stages; tests hold each of them against a brute-force version on its own input, and run()
#: against the stages in turn.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = kit.shared_folder(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            kit.remove(spark, before)
        before = path
    return docs
