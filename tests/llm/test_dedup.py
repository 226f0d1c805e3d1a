from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import kit, ngram_join, substring_dedup
from docweave.llm.graph import components

from . import brute


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("k", [3, 13])
def test_repeats(odd, odd_rows, k):
    got = substring_dedup.remove_repeats(odd, k=k, chunk_bytes=2000).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert Counter(map(tuple, got)) == brute.repeats(pairs(odd_rows), k)


def test_repeats_keep_layout(spark):
    p = " ".join(f"w{i}" for i in range(13))
    df = spark.createDataFrame([(1, f"  a\n{p}\tb "), (2, f" x\t{p}\n\ny\n")], "doc_id long, text string")
    got = dict(substring_dedup.remove_repeats(df, layout=True).select("doc_id", "kept").collect())
    assert got == {1: f"  a\n{p}\tb ", 2: " x\ty\n"}


def test_factors_name_their_reference(spark):
    p, q = (" ".join(f"{c}{i}" for i in range(20)) for c in "pq")
    df = spark.createDataFrame([(4, p), (7, q), (9, f"{p} {q} tail")], "doc_id long, text string")
    spans = substring_dedup.remove_repeats(df).where("doc_id = 9").first()["spans"]
    assert [tuple(s) for s in spans] == [(0, 20, 4, 0), (20, 20, 7, 0)]
    df = spark.createDataFrame([(1, f"a b {p}"), (2, f"{q} {p} {q}"), (3, f"x {p} {q} y")], "doc_id long, text string")
    spans = substring_dedup.remove_repeats(df, chunk_bytes=10).where("doc_id = 3").first()["spans"]
    assert [tuple(s) for s in spans] == [(1, 20, 1, 2), (9, 24, 2, 28), (21, 20, 2, 0)]


@pytest.mark.parametrize("k", [3, 13])
def test_factors_are_copies_of_their_reference(odd, odd_rows, k):
    """Every factor is k words long at least, equals the reference's words from its place on, and ends where that copy does."""
    texts, removed = {}, 0
    for r in odd_rows:
        texts.setdefault(r[0], []).append(brute.words(r[1]))
    for r in substring_dedup.remove_repeats(odd, k=k, chunk_bytes=3000).collect():
        own, gone = next(t for t in texts[r["doc_id"]] if len(t) == r["n_words"]), set()
        for start, n, ref, at in r["spans"]:
            assert n >= k and ref < brute.rank(r["doc_id"])
            assert any(t[at : at + n] == own[start : start + n] for t in texts[ref])
            gone.update(range(start, start + n))
        assert len(gone) == r["n_removed"]
        removed += len(gone)
    assert removed


def regular_word(n, first="a"):
    """A word of Thue and Morse of 2^n letters; those that begin with a and b are equal to polynomials modulo 2^64."""
    word = first
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_regular_words_differ(spark):
    from docweave.llm import context_tree

    words = [regular_word(n, c) for n in (10, 11, 12) for c in "ab"]
    rows = [(i, " ".join([w] * 13)) for i, w in enumerate(words)] + [(i + 10, f"{w} y z") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring_dedup.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept").collect())) == brute.repeats(rows)
    assert Counter(map(tuple, ngram_join.jaccard_components(df, 3, 90).collect())) == brute.components(rows, 3, 90)
    for n in (10, 11, 12):
        x = regular_word(n).encode()
        grams = [kit.gram_hashes(kit.Words(np.frombuffer(" ".join(chr(c) for c in w).encode(), np.uint8), np.array([0, 2 * len(x) - 1])).hashes(), len(x))[0] for w in (x, x.translate(bytes.maketrans(b"ab", b"ba")))]
        assert grams[0] != grams[1]
    scored = context_tree.code_lengths(spark.createDataFrame([(0, words[0]), (1, words[0]), (2, words[0]), (3, words[0]), (4, words[1])], "doc_id long, text string"), depth=2).collect()
    train = {words[0] if r["doc_id"] < 4 else words[1] for r in scored if not r["held_out"]}
    assert all(r["n_known"] == 1 + ((words[0] if r["doc_id"] < 4 else words[1]) in train) for r in scored)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.sampled_from("abé\U0001f600"), min_size=1, max_size=40), min_size=1, max_size=30), st.integers(1, 20))
def test_hashes_follow_the_words_alone(words, k):
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    h = kit.Words(raw, np.array([0, len(raw)])).hashes()
    alone = [int(kit.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])).hashes()[0]) for w in words]
    assert h.tolist() == alone and len(set(alone)) == len(set(words))
    grams = kit.gram_hashes(h, k)
    assert grams.tolist() == [int(kit.gram_hashes(h[i : i + k], k)[0]) for i in range(len(words) - k + 1)]
    assert len(set(grams.tolist())) == len({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})


@pytest.mark.parametrize("k", [2, 3, 4, 5, 6])
def test_words_in_another_order_differ(k):
    from itertools import product

    x = kit.mix(np.arange(1, 5, dtype=np.uint64))
    rows = [np.array(o) for o in product(range(4), repeat=k)]
    assert len({int(kit.gram_hashes(x[o], k)[0]) for o in rows}) == len(rows)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_components(odd, odd_rows, k, percent):
    got = ngram_join.jaccard_components(odd, k, percent).collect()
    assert Counter(map(tuple, got)) == brute.components(pairs(odd_rows), k, percent)


def test_large_components_are_compared_by_blocks(spark, monkeypatch):
    """The exact way for components beyond a task's bound."""
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 300)
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        own = list(base)
        for p in rng.integers(0, 100, 1 + i // 4):
            own[p] = f"x{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, ngram_join.jaccard_components(df, 3, 90).collect())) == brute.components(rows, 3, 90)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([80, 90]))
def test_linked_sets_share_a_signature(seed, percent):
    """The guarantee of the vertical partitioning, near the threshold and for all sizes."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    gone = int(rng.integers(0, n // 5 + 1))
    b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)])
    both = len(np.intersect1d(a, b))
    if not len(b) or 100 * both < percent * (len(a) + len(b) - both) or (len(a) == len(b) == both):
        return
    sig, up, at, least = ngram_join.signatures(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), percent)
    shared = [len(np.intersect1d(sig[: at[1]][up[: at[1]] == u], sig[at[1] :][up[at[1] :] == v])) - min(least[0, u], least[1, v]) for u in (0, 1) for v in (0, 1) if least[0, u] and least[1, v]]
    assert max(shared) >= 0 and min(least[least > 0]) > 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([50, 80, 90]))
def test_each_of_two_linked_sets_shares_its_least(seed, percent):
    """What lets a document leave large groups, for small sets with most n-grams in one fragment too."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    top = np.where(rng.random(n + 9) < 0.8, 0, rng.integers(0, 2**16, n + 9)).astype(np.uint64) << np.uint64(47)
    drawn = np.unique(rng.integers(0, 2**47, n + 9).astype(np.uint64) | top)
    for gone in range(1, 9):
        a, b = drawn[:-gone], drawn
        if gone >= len(drawn) or 100 * len(a) < percent * len(b):
            break
        sig, up, at, least = ngram_join.signatures(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), percent)
        shared = [len(np.intersect1d(sig[: at[1]][up[: at[1]] == u], sig[at[1] :][up[at[1] :] == v])) - max(least[0, u], least[1, v]) for u in (0, 1) for v in (0, 1) if least[0, u] and least[1, v]]
        assert max(shared) >= 0


def test_short_hub_of_many_variants(spark):
    """A set whose n-grams fall into one segment links more variants than a small group has, which have more segments."""
    names = [f"w{i}" for i in range(400)]
    sets = [ngram_join.shingle_sets(kit.Words(np.frombuffer(n.encode(), np.uint8), np.array([0, len(n)])), 1)[0][0] for n in names]
    assert ngram_join._classes(80)[2][0] == 4
    first = [n for n, s in zip(names, sets, strict=True) if int(s) >> 62 == 0]
    other = [n for n, s in zip(names, sets, strict=True) if int(s) >> 62 != 0]
    hub = " ".join(first[:4])
    rows = [(0, hub), *[(i + 1, f"{hub} {other[i]}") for i in range(3 * ngram_join.SMALL)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.jaccard_components(df, 1, 80).collect()} == {0}
    assert brute.components(rows, 1, 80) == Counter((i, 4 + (i > 0), 0) for i, _ in rows)


def test_near_duplicates_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (3, text + " end"), (8, text), (9, "something else entirely"), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in ngram_join.drop_near_duplicates(df).collect()) == [(False, 3), (False, 9), (True, 0)]


def test_empty_tables(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert ngram_join.jaccard_components(empty).count() == 0


def test_graph(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (60, 100), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 100: 50}


def test_word_hashes_follow_the_pattern():
    texts = ["a b\tc\x0bd\x1ce  f", "", " x ", "ÀA aA"]
    raw = b"".join(t.encode() for t in texts)
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    w = kit.Words(np.frombuffer(raw, np.uint8), offs)
    found = [raw[a:b].decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert found == [x for t in texts for x in brute.words(t)]
    assert np.diff(w.at).tolist() == [len(brute.words(t)) for t in texts]
    h = w.hashes(fold=True)
    assert h[-1] != h[-2] and len(set(h[:5].tolist())) == 5
