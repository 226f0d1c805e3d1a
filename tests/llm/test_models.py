import math
import zlib
from collections import Counter

import numpy as np
import pytest

from docweave.llm import context_tree, mixing, quality, toxicity

from . import brute


def remainder(i, by=5):
    return zlib.crc32(b"" if i is None else str(i).encode()) % by


def test_baseline(odd, odd_rows):
    got = context_tree.code_lengths(odd, depth=3, chunk_bytes=5000).collect()
    tokens = [(r[0], brute.words(brute.lower(r[1])) + [None]) for r in odd_rows]
    count = Counter(w for i, t in tokens if remainder(i) != 1 for w in t)
    total, distinct = sum(count.values()), len(count)
    expected = Counter()
    for i, t in tokens:
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        expected[i, remainder(i) == 1, len(t), sum(count[w] > 0 for w in t), total, round(base, 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expected


def tree_score(train, text, depth):
    """log10 probability of a text and its end by a context tree that is written out node by node."""
    counts = {}

    def steps(data):
        data = b"\xff" * depth + brute.lower(data).encode() + b"\xff"
        for p in range(depth, len(data)):
            for bit in range(8):
                yield data[p - depth : p], (1 << bit) | (data[p] >> (8 - bit)), (data[p] >> (7 - bit)) & 1

    for t in train:
        for context, node, bit in steps(t):
            for d in range(depth + 1):
                counts.setdefault((context[depth - d :], node), [0, 0])[bit] += 1
    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[1:], node), []).append((context, node))

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    weighted, stop = {}, {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(counts[key])
        if len(key[0]) == depth:
            weighted[key], stop[key] = own, 1.0
        else:
            product = sum(weighted[c] for c in children[key])
            top = max(own, product)
            weighted[key] = top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(product - top))
            stop[key] = math.exp(own + math.log(0.5) - weighted[key])
    total = 0.0
    for context, node, bit in steps(text):
        p = 0.5
        for d in range(depth, -1, -1):
            key = (context[depth - d :], node)
            p = 0.5 if key not in counts else stop[key] * (counts[key][bit] + 0.5) / (sum(counts[key]) + 1) + (1 - stop[key]) * p
        total += math.log10(p)
    return total


def test_context_tree(spark):
    texts = ["the cat sat", "The dog sat on the mat", "", None, "éàé the", "zzz qqq", "on the mat the cat sat on"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t or "" for i, t in enumerate(texts) if remainder(i) != 1]
    for row in context_tree.code_lengths(df, depth=3).collect():
        assert row["score"] == pytest.approx(tree_score(train, texts[row["doc_id"]] or "", 3), rel=1e-5)


def test_context_tree_of_odd_tables(spark, odd, odd_rows, empty):
    """Every row gets a score; equal texts get equal ones; an empty table gives an empty one."""
    got = context_tree.code_lengths(odd, depth=2, chunk_bytes=5000).collect()
    assert len(got) == len(odd_rows) and all(r["score"] < 0 and math.isfinite(r["bits_per_byte"]) for r in got)
    blank = {r["score"] for r in got if r["n_tokens"] == 1 and r["doc_id"] in (15, 18)}
    assert len(blank) == 1
    assert context_tree.code_lengths(empty, depth=2).count() == 0


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.3, 100, 1e6])
    assert np.allclose(context_tree.log_gamma(x), [math.lgamma(v) for v in x], atol=1e-9, rtol=1e-12)


def toxic_table(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(["an", "er", "th", "on", "ing"], rng.integers(1, 4))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        own = [words[k] for k in rng.integers(0, 200, 60)]
        if toxic:
            for p in rng.integers(0, 60, 4):
                own[p] = str(rng.choice(["zork", "Zorkish", "unzork"]))
        rows.append((i, " ".join(own)))
        labels.append((i, int(not toxic), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_is_found_in_held_out_rows(spark):
    docs, labels = toxic_table(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r["held_out"] == (remainder(r["doc_id"]) == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def plain_difference(train, text, order=4, cut=0.75):
    """Difference per word of two Kneser-Ney models from dictionaries; train: (toxic, text)."""
    def spelled(words):
        for before, word in zip([b"", *words], words, strict=False):
            data = (b"   " + before)[-3:] + b" " + word + b" "
            yield [data[p - order + 1 : p + 1] for p in range(4, len(data))]

    counts = {}
    for label in (0, 1):
        top = Counter(g for y, t in train if y == label for grams in spelled([w.encode() for w in brute.words(brute.lower(t))]) for g in grams)
        counts[label, order] = top
        for n in range(order - 1, 0, -1):
            counts[label, n] = Counter(g[1:] for g in counts[label, n + 1])
    low = counts[0, 1] + counts[1, 1]

    def p(label, gram):
        n = len(gram)
        if n == 1:
            return (low[gram] + 0.5) / (sum(low.values()) + 128)
        own = {g: c for g, c in counts[label, n].items() if g[:-1] == gram[:-1]}
        below = p(label, gram[1:])
        if not own:
            return below
        c, total = own.get(gram, 0), sum(own.values())
        return (c - min(c, cut) + sum(min(x, cut) for x in own.values()) * below) / total

    words = [w.encode() for w in brute.words(brute.lower(text))]
    grams = [g for own in spelled(words) for g in own]
    return sum(math.log(p(1, g) / p(0, g)) for g in grams) / max(1, len(words))


def test_toxicity_models_are_plain_kneser_ney(spark):
    train = [(0, "The cat sat on the mat"), (0, "a dog and a cat"), (1, "the damned cat sat"), (1, "you éé damned, dog damned"), (0, "you sat"), (1, None)]
    df = spark.createDataFrame([*train, *train], "toxic int, text string").repartition(2)
    tables = toxicity.trained(df)
    texts = ["the damned dog", "The CAT sat on a mat", "éé I", "x", "", "  ", None, "damned you dog and a extraordinarily catlike matdog"]
    from docweave.llm import kit
    import pyarrow as pa

    got = toxicity.difference_per_word(*kit.flat(pa.array(texts)), tables)
    assert got == pytest.approx([plain_difference([*train, *train], t) for t in texts], abs=1e-6)


def test_a_text_that_does_not_fit_leaves_room_for_others(spark):
    docs = spark.createDataFrame([(i, "x" * (5000 if i % 2 else 10)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 4 < 2)) for i in range(40)], "doc_id long, quality int, toxic int")
    got = toxicity._sample(docs, labels, (0, 1, 2, 3, 4), 100, 3000).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(0, 40, 2))


def test_held_out_labels_do_not_matter(spark):
    from pyspark.sql import functions as F

    docs, labels = toxic_table(spark, 120)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert toxicity.toxicity(odd, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.toxicity(empty, labels).count() == 0


def kneser_ney(texts, order=5):
    """p(byte | context) by interpolated modified Kneser-Ney, from dictionaries."""
    top = Counter()
    for t in texts:
        data = b"\xff" * (order - 1) + (t or "").encode() + b"\xff"
        top.update(data[p - order + 1 : p + 1] for p in range(order - 1, len(data)))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts, total, back = {}, {}, {}
    for n, c in counts.items():
        of = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        cut = (0.5, 0.75, 1.0)
        if min(of) >= 5:
            y = of[0] / (of[0] + 2 * of[1])
            cut = tuple(min(max(k - (k + 1) * y * of[k] / of[k - 1], 0.1 * k), 0.95 * k) for k in (1, 2, 3))
        for g, v in c.items():
            cuts[g] = cut[min(v, 3) - 1]
            total[g[:-1]] = total.get(g[:-1], 0) + v
            back[g[:-1]] = back.get(g[:-1], 0) + cuts[g]

    def p(gram):
        if not gram:
            return 1 / 256
        below = p(gram[1:])
        if gram[:-1] not in total:
            return below
        c = counts[len(gram)][gram]
        return ((c - cuts[gram] if c else 0) + back[gram[:-1]] * below) / total[gram[:-1]]

    return p


def test_perplexity_is_that_of_a_plain_model(spark):
    rng = np.random.default_rng(3)
    words = [["an", "er", "the", "on", "ing", "é", "!"], ["да", "нет", "слово", "мир"], ["中文", "字", "本"]]
    texts = [" ".join(rng.choice(words[i % 3], 30)) for i in range(60)] + ["", None, " \n", "new wörds 字 да", "x" * 3000]
    train = texts[:40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = spark.createDataFrame([(t,) for t in train], "text string")
    got = {r["doc_id"]: r for r in quality.scored(docs, model, keep=["doc_id"], block_bytes=700).columns("doc_id").collect()}
    p = kneser_ney(train)
    for i, t in enumerate(texts):
        if not (t or "").strip():
            assert got[i]["log_p"] is None
            continue
        data = b"\xff" * 4 + t.encode() + b"\xff"
        assert got[i]["n_symbols"] == len(data) - 4
        assert got[i]["log_p"] == pytest.approx(sum(math.log(p(data[k - 4 : k + 1])) for k in range(4, len(data))), rel=1e-4)
    assert sum(p(b"wor" + bytes([x])) for x in range(256)) == pytest.approx(1)


def test_blocks_that_differ_between_scans_end_the_job(spark):
    import pyarrow as pa

    finish = quality._finish("text", ["text"])
    from docweave.llm import kit

    block = pa.table({"block": [1], "rows": [kit.frozen(pa.table({"text": ["some text"]}))]})
    with pytest.raises(RuntimeError):
        finish(block, quality._ANSWER.empty_table())
    with pytest.raises(RuntimeError):
        finish(block.slice(0, 0), pa.Table.from_pylist([{"block": 1, "shard": 0, "logs": b""}], schema=quality._ANSWER))


def test_quality(spark, odd, empty):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(["an", "er", "th", "on", "ing"], rng.integers(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(300):
        bad = i % 10 == 0
        own = [words[k] for k in rng.integers(0, 300, 80)]
        rows.append((i, " ".join(w.upper() + "!!" for w in own) if bad else " ".join(own), "en" if i % 2 else None, i))
        labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.keep_quality(docs, labels).collect()}
    assert not any(i % 10 == 0 for i in kept) and len(kept) > 260
    assert quality.keep_quality(docs, labels).columns == docs.columns
    assert all(not r["kept"] and r["perplexity"] is None for r in quality.perplexities(odd, labels).collect() if not (r["text"] or "").split())
    assert quality.perplexities(docs, labels.limit(0)).where("kept").count() == 300
    assert quality.perplexities(empty, labels).count() == 0


def test_quality_trains_on_all_trusted_rows(spark, monkeypatch):
    class Seen(Exception):
        pass

    def seen(docs, texts, *rest, **options):
        raise Seen(texts.count())

    monkeypatch.setattr(quality, "scored", seen)
    docs = spark.range(30_000).selectExpr("id AS doc_id", "'en' AS lang", "concat('text ', id) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    with pytest.raises(Seen) as found:
        quality.perplexities(docs, labels)
    assert found.value.args[0] == docs.where(f"pmod(xxhash64(doc_id, 1), {quality.APART}) <> 0").count() > 20_000


def test_quality_thresholds_use_all_trusted_rows(spark):
    """A language that the training sample hardly has gets its own mean and threshold, from all rows but the sample's."""
    rng = np.random.default_rng(6)
    words = {"en": ["an", "er", "th", "on", "ing"], "fi": ["aa", "kk", "yy", "uo", "nen"]}
    rows = [(i, " ".join(rng.choice(words["fi" if i % 10 == 0 else "en"], 60)), "fi" if i % 10 == 0 else "en") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 50 != 3), 0) for i in range(1000)], "doc_id long, quality int, toxic int")
    got = quality.perplexities(docs, labels, sample_rows=50, keep=0.9).collect()
    limit = {r["lang"]: r["threshold"] for r in got}
    assert len({(r["lang"], r["threshold"]) for r in got}) == 2 and limit["fi"] != limit["en"]
    for lang in words:
        share = np.mean([r["kept"] for r in got if r["lang"] == lang and r["doc_id"] % 50 != 3])
        assert 0.85 <= share <= 0.95


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        left = 1.5 * sum(sizes.values()) - sum(fixed.values())
        goal = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if goal[s] > 2 * sizes[s]]
        if not above:
            return goal | fixed
        fixed |= {s: 2 * sizes[s] for s in above}


def test_mix(odd, odd_rows, empty):
    got = mixing.mix_draws(odd).collect()
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len(brute.words(r[1]))
    goal = targets_by_hand(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert len(r["draws"]) <= 2
        taken[r["source"]] += r["size"] * len(r["draws"])
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s]
    again = mixing.mix_draws(odd).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(odd).count() == sum(len(r["draws"]) for r in got)
    assert mixing.mix_draws(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_splitting_tree():
    quotas = np.array([700, 0, 31, 5000])
    split = mixing.splitting_tree(quotas, 7, 1)
    assert (split.sum(0) == quotas).all() and split.min() >= 0
    assert np.ptp(split.sum(1)) <= 3
    assert (split == mixing.splitting_tree(quotas, 7, 1)).all()


def test_draws_follow_the_tree(odd, monkeypatch):
    """Each shard has the blocks that the tree's quotas give it, one after the other in each source's permutation."""
    sizes, plan = mixing._planned(odd, 1.5, (5, 2, 1), 2.0, 7, 7)
    split = mixing.splitting_tree(plan.quotas, 7, plan.seed)
    until = np.cumsum(split, 0)
    rows = mixing.mix_draws(odd, shards=7).collect()
    source = plan.numbers([r["source"] for r in rows])
    place = plan.place(source, np.array([r["key"] for r in rows]))
    for s, p, r in zip(source, place, rows, strict=True):
        index = [d["draw"] * 2**plan.bits + (int(p) >> 24) for d in r["draws"]]
        assert [d["shard"] for d in r["draws"]] == [int(np.searchsorted(until[:, s], x, "right")) for x in index]
        more = len(index) * 2**plan.bits + (int(p) >> 24)
        assert more >= plan.quotas[s] - 1 and (more >= plan.quotas[s] or p >= plan.cut[s])
    assert len(np.unique(plan.place(np.zeros(2**12, int), np.arange(2**12, dtype=np.uint64) << np.uint64(52)))) == 2**12
    plan.quotas = plan.quotas * 0
    assert (plan.shard_of(source, place >> 24) == -1).all()


def test_op9_gives_the_contract(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in docs}
    total, taken = Counter(), Counter()
    for r in docs:
        total[r["source"]] += size[r["doc_id"]]
    goal, got = targets_by_hand(dict(total)), mixing.op9_mixing(spark, sf_dir).collect()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert r["taken"] == r["size"] * len(r["shards"]) <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(docs)
    assert all(abs(taken[s] - goal[s]) <= max(size.values()) for s in goal)


def test_draws_of_a_shard_are_disjoint(odd):
    rows = mixing.mix_draws(odd, shards=5).collect()
    assert {d["shard"] for r in rows for d in r["draws"]} <= set(range(5))
    assert all(len({d["draw"] for d in r["draws"]}) == len(r["draws"]) for r in rows)
