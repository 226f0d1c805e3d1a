"""The whole flows: the index with texts, the replay, and the command lines on a small dataset."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import backends, chunks, index, pairs, replay, taxonomy
from docweave.plans import catalog, commands, reconstruct
from docweave.sources import records
from docweave.streaming import arrivals


def paper_rows(n=24, seed=1):
    rng = random.Random(seed)
    words, paths = [f"word{i}" for i in range(60)], ["r", "r > a", "r > b"]
    return [(f"p{i:02d}", " ".join(rng.sample(words, 4)), " ".join(rng.sample(words, 12)) + f" topic{i % 3}", paths[i % 3], str(2000 + i), str(i % 3 * 20), [f"ref {paths[i % 3]}"], paths[i % 3], i) for i in range(n)]


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    """Papers and pair labels of two splits as JSON Lines."""
    top = tmp_path_factory.mktemp("dataset")
    for split, n in (("train", 24), ("valid", 9)):
        rows = spark.createDataFrame(paper_rows(n), records.PAPERS)
        both = rows.alias("a").join(rows.alias("b"), F.expr("a.paper_id <> b.paper_id"))
        labels = both.select(F.concat("a.paper_id", F.lit("-"), "b.paper_id").alias("pair_id"), F.col("a.paper_id").alias("paper_a_id"), F.col("b.paper_id").alias("paper_b_id"), taxonomy.relation(F.col("a.node_path"), F.col("b.node_path")).alias("label"))
        records.write_jsonl(rows, f"file://{top}/{split}_papers.jsonl")
        records.write_jsonl(labels, f"file://{top}/{split}_labels.jsonl")
    return f"file://{top}"


def test_text_index_is_frozen_between_rebuilds():
    own = arrivals.TextIndex(leaf_size=3, beam=1, stop=frozenset({"the"}), ngram_max=2)
    sizes = []
    for k, text in enumerate(["the cats sat", "cats sat there", "dogs ran off", "dogs ran home", "birds flew", "new words only"]):
        before, known = dict(own.vocabulary), own.rebuilds
        found, visited, rebuilt, *_ = own.arrive(k, text)
        assert rebuilt == (own.rebuilds > known) and (rebuilt or own.vocabulary == before)
        assert set(found) <= set(range(k)) and (visited > 0) == (k > 0)
        sizes.append(len(found))
    assert sizes[:4] == [0, 1, 2, 3] and own.rebuilds >= 2
    assert "the" not in own.vocabulary and "cats sat" in own.vocabulary
    v = own.vector(own.terms("cats sat sat unknown"))
    assert np.linalg.norm(v) == pytest.approx(1)


def test_stretches_of_a_key_are_tasks_with_the_serial_rows(spark, monkeypatch):
    """One index of one key: several tasks find its rows, which are those of arrivals one at a time."""
    rng, kept, settle = np.random.default_rng(5), [], arrivals.settle
    monkeypatch.setattr(arrivals, "settle", lambda df: kept.append(settle(df)) or kept[-1])
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) % 200) for _ in range(45)]
    texts[7], texts[20], texts[21] = "", None, texts[3]
    rows = spark.createDataFrame([("k", str(i), i, t) for i, t in enumerate(texts)], "key string, item_id string, place long, text string")
    options = {"leaf_size": 6, "starts": 2, "max_features": 90}
    got = arrivals.text_inserts(rows, (1, 2), stop=["w1"], **options).collect()
    walked = next(df for df in kept if "visited" in df.columns)
    assert walked.where("item_id is not null").select(F.spark_partition_id()).distinct().count() > 3
    for beam in (1, 2):
        own = arrivals.TextIndex(beam=beam, stop=frozenset({"w1"}), **options)
        mine = sorted((r for r in got if r["beam"] == beam), key=lambda r: r["step"])
        assert [r["item_id"] for r in mine] == list(map(str, range(45)))
        for n, r in enumerate(mine):
            found, visited, rebuilt, *_ = own.arrive(str(n), texts[n] or "")
            assert (list(r["candidates"]), r["visited"], r["rebuilt"], r["existing"]) == (found, visited, rebuilt, n)
            assert list(r["schedule_before"]) == index.level_schedule(n, 6) and list(r["schedule_after"]) == index.level_schedule(n + 1, 6)
            assert r["route_seconds"] >= 0 and r["insert_seconds"] > 0


def test_widths_of_the_replay_share_their_rebuilds(spark, sf_dir, monkeypatch):
    """One pass over the arrivals for all widths, with the numbers that each has alone; k-means runs once for each rebuild."""
    calls, inserts, groups = [], arrivals.text_inserts, arrivals.SerialIndex.groups
    monkeypatch.setattr(arrivals, "text_inserts", lambda *a, **o: calls.append(a[1]) or inserts(*a, **o))
    found = {r["beam"]: r for r in catalog.QUERIES["index_replay"](spark, sf_dir).collect()}
    assert len(calls) == 1 and set(found) == {1, 2, 3}
    alone = reconstruct.routed(catalog._index_papers(spark, sf_dir), ("lang", "venue"), 3)
    assert alone.agg(F.sum("visited")).first()[0] == found[3]["visited"] and alone.where("rebuilt").count() == found[3]["rebuilds"]
    monkeypatch.setattr(arrivals.SerialIndex, "groups", lambda *a: calls.append(a) or groups(*a))
    texts = [" ".join(f"w{(i * k) % 11}" for k in range(1, 9)) for i in range(12)]
    index_ = arrivals.PlacedIndex(items=texts, terms=arrivals.numbered_terms(texts, frozenset(), 2), leaf_size=6, starts=2)
    calls.clear()
    for beam in (1, 2, 3):
        list(index_.stretch(1, beam))
    assert index_.rebuilds > len(index_.built) and len(calls) == sum(len(index.level_schedule(n, 6)) for n in index_.built)


def test_replay_of_the_index_lists_candidates_only(spark, tmp_path, monkeypatch):
    """The numbers of a row for each pair, papers without a block among them, without making those rows."""
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    docs = [(i, "\n".join([line(3), line(5), *[line(2)] * rng.randrange(25)]), rng.choice(["en", "en", "de", "", None]), rng.choice(["s1", "s1", "s2", "", None])) for i in range(150)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    every, papers_ = catalog._rows(spark, str(tmp_path)).cache(), catalog.papers(spark, str(tmp_path))
    want = {}
    for beam in (1, 2, 3):
        inserts = reconstruct.routed(catalog._index_papers(spark, str(tmp_path)), ("lang", "venue"), beam)
        rows = replay.with_candidates(every, reconstruct.candidate_pairs(inserts, papers_))
        one = replay.totals(rows).join(replay.query_hits(rows)).join(replay.insert_stats(replay.per_insert(rows)))
        want[beam] = one.first().asDict() | inserts.agg(F.sum("visited").alias("visited"), F.count_if("rebuilt").alias("rebuilds")).first().asDict()
    monkeypatch.setattr(catalog.P, "block_pairs", lambda *a: pytest.fail("made all pairs"))
    found = catalog.QUERIES["index_replay"](spark, str(tmp_path))
    got = {r["beam"]: {k: v for k, v in r.asDict().items() if k != "beam"} for r in found.collect()}
    assert set(got) == {1, 2, 3} and found.columns == [*want[1], "beam"]
    for beam in want:
        assert got[beam] == pytest.approx(want[beam])
    assert got[1]["candidate_pairs"] < got[1]["pairs"] and got[1]["hits"] < got[1]["queries"]


def test_inner_nodes_are_means_of_all_arrivals_below():
    rng = np.random.default_rng(0)
    own = arrivals.SerialIndex(leaf_size=4, beam=2)
    for k in range(40):
        v = rng.normal(size=6)
        own.insert(k, v / np.linalg.norm(v), own.route(v / np.linalg.norm(v))[1])
    for level, nodes in enumerate(own.nodes):
        for at, (_, centroid, rep) in enumerate(nodes):
            mean = np.array([own.vectors[m] for m in own.below(level, at)]).mean(0)
            assert centroid == pytest.approx(mean / np.linalg.norm(mean))
            assert any(np.array_equal(rep, own.vectors[m]) for m in own.below(level, at))
    assert sorted(own.below(len(own.nodes) - 1, 0)) == list(range(40))


def test_compact_keeps_distances():
    x = np.random.default_rng(0).normal(size=(7, 50))
    y = arrivals.compact(x)
    assert y.shape == (7, 7) and np.allclose(x @ x.T, y @ y.T)


def test_built_index_has_means_of_all_items_below(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    nodes, members = index.build_index(spark.createDataFrame(rows, "item_id long, vector array<double>"), leaf=8, starts=2)
    nodes, held = {r["node_id"]: r for r in nodes.collect()}, Counter()
    below = {n: [] for n in nodes}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    for r in members.collect():
        at = r["node_id"]
        while at:
            below[at].append(r["item_id"])
            at = nodes[at]["parent_id"]
    for n, r in nodes.items():
        mean = np.mean([unit[i] for i in below[n]], 0)
        assert r["centroid"] == pytest.approx(mean / np.linalg.norm(mean))
        assert r["rep_id"] in below[n]
    stats = index.index_stats(*index.build_index(spark.createDataFrame(rows, "item_id long, vector array<double>"), leaf=8, starts=2), leaf=8).first()
    assert stats["items"] == 60 and stats["schedule"] == index.level_schedule(60, 8) and stats["level_counts"][0] == stats["leaves"] == 8


def test_replay_by_hand(spark):
    """The reports' numbers, counted again from the candidates."""
    papers_ = spark.createDataFrame(paper_rows(), records.PAPERS)
    both = papers_.alias("a").join(papers_.alias("b"), F.expr("a.paper_id <> b.paper_id"))
    labels = both.select(F.col("a.paper_id").alias("paper_a_id"), F.col("b.paper_id").alias("paper_b_id"), taxonomy.relation(F.col("a.node_path"), F.col("b.node_path")).alias("label"))
    predictions = labels.withColumn("predicted_label", F.when(F.crc32(F.concat("paper_a_id", "paper_b_id").cast("binary")) % 3 == 0, "NONE").otherwise(F.col("label")))
    found = reconstruct.evaluate(papers_, labels, predictions, (1, 2), leaf_size=6, starts=2)
    truth = {(r[0], r[1]): r[2] for r in labels.collect()}
    guess = {(r["paper_a_id"], r["paper_b_id"]): r["predicted_label"] for r in predictions.collect()}
    for beam, out in zip((1, 2), found, strict=True):
        own, seen, total = arrivals.TextIndex(leaf_size=6, beam=beam, starts=2, stop=frozenset(arrivals.english(spark))), [], Counter()
        for r in papers_.orderBy("split_index").collect():
            text = " ".join([r["title"], r["abstract"], r["venue"], " ".join(r["reference_titles"])])
            near, visited, rebuilt, *_ = own.arrive(r["paper_id"], text)
            total["visited"] += visited
            total["rebuilds"] += rebuilt
            for other in seen:
                t, p = truth[r["paper_id"], other], guess[r["paper_id"], other]
                total["pairs"] += 1
                total["candidate_pairs"] += other in near
                total["base"] += t == p
                total["system"] += t == (p if other in near else "NONE")
                total["related"] += t != "NONE"
                total["hits"] += t != "NONE" and other in near
            seen.append(r["paper_id"])
        assert {k: out[k] for k in ("visited", "rebuilds", "pairs", "candidate_pairs")} == {k: total[k] for k in ("visited", "rebuilds", "pairs", "candidate_pairs")}
        assert out["baseline_accuracy"] == pytest.approx(total["base"] / total["pairs"]) and out["system_accuracy"] == pytest.approx(total["system"] / total["pairs"])
        assert out["related_recall"] == pytest.approx(total["hits"] / total["related"]) and out["metrics_index"]["accuracy"] == pytest.approx(out["system_accuracy"])
    assert found[0]["candidate_pairs"] < found[1]["candidate_pairs"] < found[0]["pairs"]


def test_pair_tensors(spark):
    table = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("b", 0, [5.0, 6.0])], "paper_id string, chunk_index int, chunk array<float>")
    wanted = spark.createDataFrame([("a", "b"), ("b", "c")], "paper_a_id string, paper_b_id string")
    slots = chunks.pair_slots(wanted, table, 2).withColumnRenamed("chunk", "embedding")
    got = {(r[0], r[1]): (list(r["x"]), list(r["chunk_mask"])) for r in chunks.pair_tensors(slots, wanted, 2, 2).collect()}
    assert got == {("a", "b"): ([1, 2, 3, 4, 5, 6, 0, 0], [True, True, True, False]), ("b", "c"): ([5, 6, 0, 0, 0, 0, 0, 0], [True, False, False, False])}
    padded = chunks.collate(spark.createDataFrame([(["a", "b"],), ([],), (["a", "b", "c", "d"],)], "chunk array<string>"), most=3).collect()
    assert [(list(r["chunk"]), list(r["mask"])) for r in padded] == [(["a", "b", ""], [True, True, False]), (["", "", ""], [False] * 3), (["a", "b", "c"], [True] * 3)]
    assert chunks.tensor_bytes(10, 10, 768) == (153_600, 153_600 / 2**30)
    values = spark.createDataFrame([(1, 1, 5.0), (1, 0, 7.0), (2, 0, 3.0)], "c int, token int, value double")
    assert dict(chunks.first_pool(values, ["c"]).collect()) == {1: 7.0, 2: 3.0}


def test_commands(spark, dataset, tmp_path):
    out = f"file://{tmp_path}"
    about = commands.main(["train-pair-model", "--train-papers", f"{dataset}/train_papers.jsonl", "--train-labels", f"{dataset}/train_labels.jsonl", "--valid-papers", f"{dataset}/valid_papers.jsonl", "--valid-labels", f"{dataset}/valid_labels.jsonl", "--output-dir", f"{out}/model", "--tree-estimators", "10"], spark)
    assert about["valid_metrics"]["accuracy"] > 0.7 and about["model"]["trees"] == 10
    common = ["--papers", f"{dataset}/train_papers.jsonl", "--labels", f"{dataset}/train_labels.jsonl", "--leaf-size", "6", "--n-init", "2"]
    found = commands.main(["end-to-end", *common, "--model-path", f"{out}/model/model", "--output-dir", f"{out}/e2e"], spark)
    assert found["linear_scan"]["timing"]["pair_predictions"] == 24 * 23 // 2 > found["dynamic"]["timing"]["pair_predictions"] == found["dynamic"]["efficiency"]["dynamic_pairs"]
    again = commands.main(["end-to-end", *common, "--limit-papers", "8", "--model-path", f"{out}/model/model", "--output-dir", f"{out}/e2e2", "--reuse-linear-from", f"{out}/e2e/end_to_end_reconstruction.json"], spark)
    assert again["linear_scan"] == json.loads(json.dumps(found["linear_scan"])) and again["dynamic"]["efficiency"]["linear_pairs"] == 28
    replayed = commands.main(["dynamic-index", *common, "--beam-sizes", "1", "--limit", "12", "--output-dir", f"{out}/index"], spark)
    assert replayed["config"]["paper_count"] == 12 and replayed["runs"][0]["baseline_accuracy"] == 1.0
    with pytest.raises(SystemExit):
        commands.main(["nothing"], spark)
    with pytest.raises(SystemExit):
        commands.main(["dynamic-index", "--no-such-flag", "1"], spark)


def test_dense_commands(spark, dataset, tmp_path):
    out = f"file://{tmp_path}"
    for split in ("train", "valid"):
        for k in range(2):
            about = commands.main(["extract-features", "--dataset-dir", dataset, "--split", split, "--output-dir", f"{out}/f", "--num-shards", "2", "--shard-id", str(k), "--width", "3", "--chunks-per-side", "2"], spark)
            assert about["shape"][1:] == [4, 3] and about["bytes"] == about["pairs"] * 24
    assert commands.main(["combine-shards", "--feature-dir", f"{out}/f", "--num-shards", "2"], spark)["train"]["pairs"] == 24 * 23
    found = commands.main(["feature-backends", "--feature-dir", f"{out}/f", "--output-dir", f"{out}/b", "--backends", "random_forest", "--tree-estimators", "5"], spark)
    assert found["features"] == 12 and set(found["methods"]) == {"random_forest"}
    assert len(spark.read.option("header", True).csv(f"{out}/b/bert_vs_static").columns) == 6
    found = commands.main(["mlp-backends", "--dataset-dir", dataset, "--feature-dir", f"{out}/f", "--output-dir", f"{out}/m", "--epochs", "5", "--hidden-size", "4"], spark)
    assert found["static"]["parameters"] == backends.parameters(11, 4) and found["dense"]["parameters"] == backends.parameters(12, 4) and found["static"]["losses"][0][0] == 1
    found = commands.main(["run-all", "--epochs", "5", "--output-dir", f"{out}/w", "--dataset-dir", dataset, "--tabular-backends", "random_forest", "--tree-estimators", "5"], spark)
    assert set(found) == {"mlp", "random_forest"}
