import math
from collections import Counter
from functools import cache
from hashlib import sha256

import pytest

import corpus_pipeline
from docweave.llm import bpe, kit, quality

from . import brute
from .test_models import kneser_ney, targets_by_hand

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def seen(spark, sf_dir):
    """What each stage was given and what it returned."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = kit.shared_folder(spark, f"test-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        out.append((before.collect(), docs.collect()))
    return out


def test_quality_stage(spark, sf_dir, seen):
    """Against a plain model, plain means and plain quantiles."""
    before, after = seen[0]
    kept = plain_quality(spark, sf_dir, before)[2]
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r, k in zip(before, kept, strict=True) if k)
    assert 0.7 * len(before) < len(after) < len(before)


def plain_quality(spark, sf_dir, rows):
    """Perplexity, threshold and whether it is kept, of each row, from dictionaries."""
    from pyspark.sql import functions as F

    good = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    trains = dict(good.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(quality.APART)) != 0).collect())
    p = cache(kneser_ney([r["text"] for r in rows if trains.get(r["doc_id"])]))
    log_p, size = [], []
    for r in rows:
        data = b"\xff" * 4 + (r["text"] or "").encode() + b"\xff"
        log_p.append(sum(math.log(p(data[k - 4 : k + 1])) for k in range(4, len(data))) if brute.words(r["text"]) else None)
        size.append(len(data) - 4)
    apart = [k for k, r in enumerate(rows) if trains.get(r["doc_id"]) is False and log_p[k] is not None]

    def mean_of(own):
        return sum(log_p[k] for k in own) / sum(size[k] for k in own)

    def smooth(k, mean):
        return math.exp(-(log_p[k] + quality.PRIOR * mean) / (size[k] + quality.PRIOR))

    def quantile(x):
        return sorted(x)[math.ceil(quality.KEEP * len(x)) - 1]

    total = mean_of(apart)
    by = {lang: [k for k in apart if rows[k]["lang"] == lang] for lang in {rows[k]["lang"] for k in apart}}
    means = {lang: mean_of(own) for lang, own in by.items()}
    ratio = quantile([smooth(k, means[lang]) * math.exp(means[lang]) for lang, own in by.items() for k in own])
    limits = {}
    for lang, own in by.items():
        if len(own) >= quality.LEAST:
            limits[lang] = quantile([smooth(k, means[lang]) for k in own])
            if len(own) * (1 - quality.KEEP) < 1:
                limits[lang] = max(limits[lang], ratio * math.exp(-means[lang]))
    every = quantile([smooth(k, total) for k in apart])
    perplexity = [None if log_p[k] is None else smooth(k, means[r["lang"]] if r["lang"] in limits else total) for k, r in enumerate(rows)]
    threshold = [limits.get(r["lang"], every) for r in rows]
    return perplexity, threshold, [x is not None and x <= t for x, t in zip(perplexity, threshold, strict=True)]


def test_op8_gives_the_contract(spark, sf_dir, seen):
    rows = seen[0][0]
    perplexity, threshold, kept = plain_quality(spark, sf_dir, rows)
    got = {r["doc_id"]: r for r in quality.op8_quality(spark, sf_dir).collect()}
    for r, x, t, k in zip(rows, perplexity, threshold, kept, strict=True):
        mine = got[r["doc_id"]]
        assert mine["threshold"] == pytest.approx(t, rel=1e-3) and mine["kept"] == k
        assert mine["perplexity"] == (None if x is None else pytest.approx(x, rel=1e-3))


def test_later_stages(seen):
    """Each stage on its own input, against plain versions."""
    before, after = seen[1]
    roots = {c for _, _, c in brute.components([(r["doc_id"], r["text"]) for r in before], 5, 80)}
    assert {r["doc_id"] for r in after} == roots
    before, after = seen[2]
    expected = {i: kept for i, _, _, kept in brute.repeats([(r["doc_id"], r["text"]) for r in before]) if kept}
    assert {r["doc_id"]: " ".join(brute.words(r["text"])) for r in after} == expected
    before, after = seen[3]
    times = Counter(r["doc_id"] for r in after)
    assert set(times) <= {r["doc_id"] for r in before} and max(times.values()) <= 2
    total, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        n = len(brute.words(r["text"]))
        total[r["source"]] += n
        taken[r["source"]] += n * times[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], n)
    goal = targets_by_hand(dict(total))
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in goal)
    before, after = seen[4]
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert Counter((r["doc_id"], tuple(r["ids"]), r["n_tokens"]) for r in after) == Counter((r["doc_id"], tuple(ids := own.encode_ordinary(r["text"])), len(ids)) for r in before)


def test_last_stage_decodes(spark, odd, odd_rows, sf_dir):
    got = corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == Counter((r[0], sha256((r[1] or "").encode()).hexdigest()) for r in odd_rows)


def test_stages_take_odd_rows(spark, odd, empty, sf_dir):
    for table in (odd, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            path = kit.shared_folder(spark, "odd")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            assert name != corpus_pipeline.STAGES[0][0] or docs.columns == list(corpus_pipeline.COLUMNS)


def test_run_is_all_stages_in_turn(spark, sf_dir, seen):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["decoded_sha256"], tuple(r["ids"])) for r in got) == Counter((r["doc_id"], r["decoded_sha256"], tuple(r["ids"])) for r in seen[-1][1]) and got
