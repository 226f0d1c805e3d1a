"""Golden numbers, edge cases and properties of the operators."""

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.functions import vectors as V
from docweave.operators import backends, chunks, graph, index, kmeans, metrics, pairs, replay, taxonomy, texts, tfidf, tiles
from docweave.plans import catalog
from docweave.sources import records
from docweave.streaming import arrivals


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {t}" for n, t in {k: {str: "string", int: "long", float: "double", list: "array<string>"}.get(type(v), "string") for k, v in values.items()}.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("The QUICK, brown-fox's x 42 7", ["quick", "brown", "fox", "42"]), ("", []), (None, []), ("a an of to", []), ("été abc aa_bb", ["abc", "aa", "bb"]), ("xx xx", ["xx", "xx"])],
)
def test_tokens(spark, text, tokens):
    assert one(spark, X.tokenize(F.col("t")), t=text) == tokens


@pytest.mark.parametrize(("value", "number", "year"), [("12", 12.0, 12), ("1.5", 1.5, None), ("x", 0.0, None), (None, 0.0, None), ("", 0.0, None), ("1e3", 1000.0, None)])
def test_numbers(spark, value, number, year):
    assert one(spark, X.clean_number(F.col("v")), v=value) == number
    assert one(spark, X.safe_year(F.col("v")), v=value) == year


def test_clean_text_and_venue(spark):
    assert one(spark, X.clean_text(F.col("t")), t=" a\t\n b  ") == "a b"
    assert one(spark, X.clean_text(F.col("t")), t=None) == ""
    assert one(spark, X.normal_venue(F.col("t")), t="\t Some Venue \n") == "some venue"


def test_set_ratios(spark):
    rows = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "l array<string>, r array<string>")
    got = rows.select(X.jaccard(F.col("l"), F.col("r")), X.containment(F.col("l"), F.col("r"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (0.0, 0.0), (1 / 3, 0.5)]


def test_labels(spark):
    rows = spark.createDataFrame([(x,) for x in X.LABELS], "label string")
    assert [r[0] for r in rows.select(X.label_ordinal(F.col("label"))).collect()] == [0, 1, 2, 3]
    assert [r[0] for r in rows.select(X.ordinal_label(X.label_ordinal(F.col("label")))).collect()] == list(X.LABELS)
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("OTHER",)], "label string").select(X.label_ordinal(F.col("label"))).collect()
    assert one(spark, X.best_label(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4), F.lit(0.0))), v="") == "B_TO_A"
    assert one(spark, X.backend_list(F.col("v")), v=" mlp, ,random_forest ,") == ["mlp", "random_forest"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0], [0.0, 0.0], None, [1.0])], "a array<double>, b array<double>, z array<double>, n array<double>, s array<double>")
    a, b, z, n, s = (F.col(c) for c in "abzns")
    row = df.select(V.dot(a, b), V.dot(a, n), V.dot(a, s), V.normalized(a), V.normalized(z), V.squared_distance(a, b)).first()
    assert tuple(row) == (11.0, 0.0, 0.0, [0.6, 0.8], [0.0, 0.0], 8.0)


PAPER = "paper_id string, title string, abstract string, venue string, publication_year string, reference_count string, reference_titles array<string>"


def papers(spark):
    rows = [
        ("p1", "Deep nets", "About deep learning", " ICML ", "2020", "3", ["Nets one", "Nets two"]),
        ("p2", None, "", "icml", "n/a", None, None),
        ("p3", "of the", "Learning nets", "", "2015", "250", [f"Title {i}" for i in range(90)]),
    ]
    return spark.createDataFrame(rows, PAPER)


def test_texts(spark):
    p = papers(spark)
    rows = {r[0]: r for r in p.select("paper_id", texts.labelled_text().alias("t"), texts.metadata_text().alias("m"), texts.reference_text(F.col("reference_titles")).alias("r"), texts.reference_text(F.col("reference_titles"), 0).alias("a")).collect()}
    assert rows["p1"]["t"] == "Title: Deep nets Abstract: About deep learning Year: 2020 Venue: ICML Reference count: 3 Reference titles: Nets one | Nets two"
    assert rows["p2"]["t"] == "Year: n/a Venue: icml" and rows["p2"]["m"] == "  icml " and rows["p2"]["r"] == ""
    assert rows["p3"]["r"].endswith("Title 79") and rows["p3"]["a"].endswith("Title 89")


def test_features_are_symmetric_or_turn(spark):
    p = papers(spark)
    ids = [("p1", "p2"), ("p2", "p1"), ("p1", "p3"), ("p3", "p1")]
    both = pairs.with_both(spark.createDataFrame(ids, "paper_a_id string, paper_b_id string"), pairs.paper_features(p))
    rows = {(r[0], r[1]): r for r in pairs.scaled_features(pairs.raw_features(both)).collect()}
    for a, b in (("p1", "p2"), ("p1", "p3")):
        x, y = rows[a, b], rows[b, a]
        for c in ("title_jaccard", "abstract_jaccard", "reference_jaccard", "reference_overlap", "venue_match"):
            assert x[c] == y[c]
        for c in ("year_diff_a_minus_b", "reference_count_diff_a_minus_b", "title_len_diff_a_minus_b"):
            assert x[c] == -y[c]
        assert x["title_a_in_b"] == y["title_b_in_a"]
    assert rows["p1", "p2"]["venue_match"] == 1.0 and rows["p1", "p3"]["venue_match"] == 0.0
    assert rows["p1", "p2"]["year_diff_a_minus_b"] == 0.0
    assert rows["p3", "p1"]["reference_count_diff_a_minus_b"] == 1.0 and rows["p3", "p1"]["year_diff_a_minus_b"] == -0.25


def test_unknown_paper_stops(spark):
    with pytest.raises(Exception, match="unknown paper"):
        pairs.with_both(spark.createDataFrame([("p1", "p9")], "paper_a_id string, paper_b_id string"), pairs.paper_features(papers(spark))).collect()


def test_cosine_against_plain_python(spark):
    docs = {"a": "nets nets deep", "b": "deep nets", "c": "other words", "d": ""}
    tokens = spark.createDataFrame([(k, "train" if k != "b" else "valid", v.split()) for k, v in docs.items()], "paper_id string, split string, tokens array<string>")
    train = tokens.where("split = 'train'")
    w = tfidf.weights(tfidf.term_frequency(tokens), tfidf.idf_table(train), tfidf.default_idf(train))
    ids = [(a, b) for a in docs for b in docs if a < b]
    got = {(r[0], r[1]): r[2] for r in tfidf.cosines(spark.createDataFrame(ids, "paper_a_id string, paper_b_id string"), w).collect()}
    df = {t: sum(t in docs[k].split() for k in "acd") for t in "nets deep other words".split()}
    idf = {t: math.log(4 / (1 + n)) + 1 for t, n in df.items()}

    def vector(k):
        return {t: docs[k].split().count(t) * idf[t] for t in set(docs[k].split())}

    for a, b in ids:
        x, y = vector(a), vector(b)
        n = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        assert got[a, b] == pytest.approx(sum(v * y.get(t, 0) for t, v in x.items()) / n if n else 0.0)


def test_metrics(spark):
    rng = random.Random(0)
    rows = [(rng.choice(X.LABELS[:3]), rng.choice(X.LABELS)) for _ in range(300)]
    m = metrics.confusion(spark.createDataFrame(rows, "true_label string, predicted_label string"))
    cells = {(r[0], r[1]): r[2] for r in m.collect()}
    assert len(cells) == 16 and sum(cells.values()) == 300
    got = {r["label"]: r for r in metrics.per_class(m).collect()}
    for x in X.LABELS:
        tp, support, predicted = cells[x, x], sum(t == x for t, _ in rows), sum(p == x for _, p in rows)
        assert got[x]["support"] == support
        assert got[x]["precision"] == pytest.approx(tp / predicted if predicted else 0) and got[x]["recall"] == pytest.approx(tp / support if support else 0)
    s = metrics.summary(m).first()
    assert s["macro_f1"] == pytest.approx(np.mean([r["f1"] for r in got.values()])) and s["accuracy"] == pytest.approx(sum(t == p for t, p in rows) / 300)
    weights = {r[0]: r[1] for r in metrics.class_weights(spark.createDataFrame(rows, "true_label string, p string")).collect()}
    assert weights["NONE"] == 0.0 and weights["PEER"] == pytest.approx(300 / (4 * got["PEER"]["support"]))


def golden_paths():
    """34 nodes with 88 ancestor pairs are too many to list; a taxonomy by rule has counts that a formula gives."""
    return ["r", *[f"r > {i}" for i in range(4)], *[f"r > {i} > {j}" for i in range(4) for j in range(3)]]


def test_taxonomy_counts(spark):
    paths = golden_paths()
    rows = [(k, split, p) for p in paths for split, n in (("train", 8), ("valid", 2)) for k in range(n)]
    got = {(r[0], r[1]): r[2] for r in taxonomy.pair_labels(spark.createDataFrame(rows, "paper_id int, split string, node_path string")).collect()}
    ancestors = sum(b.startswith(a + " > ") for a in paths for b in paths)
    for split, n in (("train", 8), ("valid", 2)):
        total = len(paths) * n
        assert got[split, "A_TO_B"] == got[split, "B_TO_A"] == ancestors * n * n
        assert got[split, "PEER"] == len(paths) * n * (n - 1)
        assert sum(v for (s, _), v in got.items() if s == split) == total * (total - 1)
    # the published sizes: 34 nodes, 88 ancestor pairs
    assert 88 * 64 == 5632 and 34 * 8 * 7 == 1904 and 272 * 271 - 2 * 5632 - 1904 == 60544


def test_schedule():
    assert index.level_schedule(0) == [] and index.level_schedule(16) == [1]
    assert index.level_schedule(17) == [2, 1] and index.level_schedule(272) == [17, 5, 3, 2, 1] and index.level_schedule(68) == [5, 3, 2, 1]
    changes = [n for n in range(1, 273) if index.level_schedule(n) != index.level_schedule(n - 1)]
    assert changes == [1, *range(17, 273, 16)] and len(changes) == 17


def greedy(far, room):
    order = np.argsort(far, 1, kind="stable")
    near = np.sort(far, 1)
    out = {}
    for item in sorted(range(len(far)), key=lambda k: (-(near[k, 1] - near[k, 0]), k)):
        out[item] = next(int(c) for c in order[item] if room[c])
        room[out[item]] -= 1
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_capacity_assignment_is_the_serial_one(spark, seed):
    rng = np.random.default_rng(seed)
    x, c = rng.normal(size=(23, 3)), rng.normal(size=(4, 3))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, vector array<double>")
    centers = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "center_id int, vector array<double>")
    far = np.round(((x[:, None] - c) ** 2).sum(-1), 6)
    assert dict(index.capacity_assign(items, centers).collect()) == greedy(far, index.capacities(23, 4))


def test_index_build(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(70)], "item_id long, vector array<double>")
    nodes, members = index.build_index(v)
    rows = nodes.collect()
    assert sum(r["parent_id"] is None for r in rows) == 1 and members.count() == 70
    sizes = [r[1] for r in members.groupBy("node_id").count().collect()]
    assert max(sizes) <= 16 and max(sizes) - min(sizes) <= 1
    level = {r["node_id"]: r["level"] for r in rows}
    assert all(level[r["parent_id"]] == r["level"] + 1 for r in rows if r["parent_id"])


@pytest.mark.parametrize("seed", [0, 1])
def test_bounded_assignment_of_arrays_is_the_serial_one(seed):
    rng = np.random.default_rng(seed)
    far = np.round(((rng.integers(0, 3, (40, 1, 2)) - rng.integers(0, 3, (5, 2))) ** 2).sum(-1), 6).astype(float)  # many ties
    assert dict(enumerate(kmeans.bounded(far, index.capacities(40, 5)))) == greedy(far, index.capacities(40, 5))
    assert dict(enumerate(kmeans.bounded(far, [0, 40, 0, 0, 0]))) == dict.fromkeys(range(40), 1)


def test_rounds_of_means():
    x = np.random.default_rng(0).normal(size=(60, 3))
    x[7] = x[8] = x[9]
    centers = now = x[5:12]
    for _ in range(300):
        label = ((x[:, None] - now) ** 2).sum(-1).argmin(1)
        now = np.array([x[label == c].mean(0) if (label == c).any() else now[c] for c in range(7)])
    assert np.allclose(kmeans.lloyd(x, centers), now) and (kmeans.closest(x, now) == label).all()
    assert kmeans.cost(x, now) == pytest.approx(((x - now[label]) ** 2).sum())


@pytest.mark.parametrize("cell", [16_384, 60])
def test_leaves_in_cells(spark, cell):
    """Even leaves that hold every row, of rows near each other; groups of equal rows larger than a cell; ids as texts."""
    rng = np.random.default_rng(0)
    groups = [(f"i{k:03d}", k % 4, np.eye(4)[k % 4] + rng.normal(size=4) / 100) for k in range(240)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, _, v in groups], "item_id string, vector array<double>")
    leaves = index.bounded_leaves(rows, 16, starts=5, cell=cell).collect()
    held = {}
    for i, leaf in leaves:
        held.setdefault(leaf, set()).add(int(i[1:]) % 4)
    assert sorted(i for i, _ in leaves) == [i for i, _, _ in groups] and len(held) == 16
    assert set(np.bincount([leaf for _, leaf in leaves])) == {15} and sum(map(len, held.values())) <= 2 * 16
    same = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(201)], "item_id long, vector array<double>")
    sizes = np.bincount([leaf for _, leaf in index.bounded_leaves(same, 13, starts=5, cell=cell).collect()])
    assert sorted(sizes) == sorted(index.capacities(201, 13))


def test_index_build_starts_no_job_for_a_round(spark, sf_dir):
    """Rounds of k-means are array operations within tasks: no more than some hundred jobs, whatever the rounds."""
    last = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(), default=0)
    before = last()
    assert catalog.QUERIES["index_stats"](spark, sf_dir).first()["max_size"] <= 16
    assert last() - before < 400


def odd_papers(spark, n=120, seed=3):
    """Papers with ties of arrival, nulls, equal and nested paths, empty and equal texts."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    text = lambda: rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 6)))])
    rows = [
        (i * 7 % 131, rng.randint(0, 40), rng.choice(["en", "en", "de", None]), rng.choice(["v", "w", "", None]), rng.choice(["r", "r > a", "r > a > b", "r > ab", "q", None]),
         text(), text(), [text() or "" for _ in range(rng.randint(0, 30))], rng.choice([None, 0, 3, 30]), rng.choice([None, 2001, 2020]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "paper_id long, split_index long, lang string, venue string, node_path string, title string, abstract string, reference_titles array<string>, reference_count long, publication_year int").persist()


def test_labels_of_block_pairs_are_counted_without_pairs(spark, sf_dir):
    p = odd_papers(spark)
    both = pairs.with_both(pairs.block_pairs(p), p.select("paper_id", "node_path"))
    each = both.select(taxonomy.relation(F.col("a.node_path"), F.col("b.node_path")).alias("true_label"))
    expected = {r["label"]: r["n"] for r in metrics.label_counts(each).collect()}
    assert {r["label"]: r["n"] for r in taxonomy.block_labels(p).collect()} == expected and min(expected.values()) > 0
    assert sum(r["n"] for r in taxonomy.block_labels(p.limit(0)).collect()) == 0
    assert metrics.weights_of(metrics.label_counts(each)).count() == 4
    for name in ("label_counts", "class_weights"):
        assert "paper_b_id" not in catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()


def test_shelves_are_counted_without_pairs(spark, sf_dir):
    p = odd_papers(spark)
    rows = pairs.block_pairs(p).withColumn("is_candidate", F.expr("paper_a_id % 4 = paper_b_id % 4"))
    found = replay.shelf_inserts(p, F.expr("paper_id % 4"))
    assert sorted(found.collect()) == sorted(replay.per_insert(rows).collect())
    assert "paper_b_id" not in catalog.QUERIES["cumulative_pairs"](spark, sf_dir)._jdf.queryExecution().toString()


@pytest.mark.parametrize(("rows", "frequent"), [(16_384, 0.005), (7, 0.005), (7, 2.0), (7, 0.0)])
def test_tiles_give_what_joined_pairs_give(spark, monkeypatch, rows, frequent):
    """One chunk or many; tokens in matrices or postings."""
    p = odd_papers(spark).where("node_path is not null")
    both = pairs.with_both(pairs.block_pairs(p), pairs.paper_features(p).join(p.select("paper_id", "node_path"), "paper_id"))
    raw = pairs.raw_features(both, ("paper_a_id", "paper_b_id", taxonomy.relation(F.col("a.node_path"), F.col("b.node_path")).alias("true_label"))).persist()
    monkeypatch.setattr(tiles, "FREQUENT", frequent)
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    got = tiles.raw_pairs(p, catalog.PLAIN, rows=rows)
    assert plain(got) == plain(raw.select(*got.columns)) and dict(got.dtypes) == {c: t for c, t in raw.dtypes if c in got.columns}
    ruled = raw.select("paper_a_id", "paper_b_id", "true_label", F.coalesce(catalog.rule(), "true_label").alias("predicted_label")).persist()
    assert plain(tiles.outcomes(p, rows=rows)) == plain(ruled)
    assert plain(tiles.edges(p, rows=rows)) == plain(graph.edges(ruled))
    assert graph.head(tiles.edges(p, 20, rows=rows)).collect() == graph.head(graph.edges(ruled)).collect()
    shelved = ruled.withColumn("is_candidate", F.expr("paper_a_id % 4 = paper_b_id % 4"))
    assert plain(tiles.counted(p, rows=rows)) == plain(shelved.groupBy("true_label", "predicted_label", "is_candidate").count())
    expected = {r["feature"]: r for r in pairs.feature_stats(pairs.scaled_features(raw), catalog.PLAIN).collect()}
    for r in tiles.scaled_stats(p, catalog.PLAIN, rows=rows).collect():
        assert (r["mean"], r["std"]) == pytest.approx(expected[r["feature"]][1:], abs=1e-12)


@pytest.mark.parametrize(("rows", "frequent"), [(16_384, 0.005), (7, 0.005), (7, 2.0), (7, 0.0)])
def test_cosines_of_tiles_are_those_of_joined_tokens(spark, monkeypatch, rows, frequent):
    """Many papers without a token, tokens that only the valid split has, train papers without a block."""
    p = odd_papers(spark).withColumn("split", F.when(F.col("paper_id") % 5 == 4, "valid").otherwise("train"))
    p = p.withColumn("abstract", F.when(F.col("split") == "valid", F.concat("abstract", F.lit(" unseen unseen"))).otherwise(F.col("abstract")))
    tokens = tfidf.with_tokens(p)
    train = tokens.where("split = 'train'")
    expected = tfidf.cosines(pairs.block_pairs(p), tfidf.weights(tfidf.term_frequency(tokens), tfidf.idf_table(train), tfidf.default_idf(train)))
    monkeypatch.setattr(tiles, "FREQUENT", frequent)
    expected = {(r[0], r[1]): r[2] for r in expected.collect()}
    got = tiles.cosine_pairs(p, rows=rows).collect()
    assert len(got) == len(expected) and {(r[0], r[1]): r[2] for r in got} == pytest.approx(expected, abs=1e-12)
    assert tiles.cosine_pairs(p.limit(0), rows=rows).count() == 0


def test_no_pair_is_shuffled_for_its_cosine(spark, sf_dir):
    test_no_pair_is_shuffled(spark, sf_dir, "content_cosine_pairs")


def test_tiles_of_nothing(spark):
    p = odd_papers(spark).limit(0)
    assert tiles.counted(p).count() == 0 and tiles.raw_pairs(p, catalog.PLAIN).count() == 0
    assert [(r["mean"], r["std"]) for r in tiles.scaled_stats(p, ("title_jaccard",)).collect()] == [(None, 1e-6)]


@pytest.mark.parametrize(
    "name",
    ["confusion_matrix", "classification_metrics", "macro_metrics", "replay_metrics", "linear_vs_indexed", "edge_sample", "feature_mean_std", "jaccard_pairs", "containment_pairs", "reference_overlap", "pair_features_raw", "pair_features_scaled", "pair_features_standardized", "prediction_lookup", "predicted_edges"],
)
def test_no_pair_is_shuffled(spark, sf_dir, name):
    """No plan joins or shuffles rows that name both papers of a pair."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("paper_b_id" in line for line in plan.splitlines() if "Join" in line and "Cross" not in line or "Repartition" in line)
    assert "MapInArrow" in plan


def test_overlap_reads_every_reference(spark, tmp_path):
    """Two papers of 100 references share the words of the last one, and of the first."""
    import duckdb

    rows = [(k, "\n".join(["title", "abstract", "first one", *[f"own{k}x{n}" for n in range(98)], "last words"]), "en", "src0") for k in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert [tuple(r) for r in catalog.reference_overlap(spark, str(tmp_path)).collect()] == con.execute(catalog.ORACLE_SQL["reference_overlap"]).fetchall() == [(1, 0, 4)]


def test_chunks_are_packed_before_they_are_shuffled(spark):
    """Token arrays don't move, and a chunk that meets itself is sent once."""
    plan = tiles.raw_pairs(odd_papers(spark), catalog.PLAIN)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = [k for k, line in enumerate(plan) if "FlatMapGroupsInArrow" in line]
    assert above and all(any("MapInArrow _parts" in line or "MapInArrow run(" in line for line in plan[k + 1 : k + 3]) for k in above)
    met = next(k for k, line in enumerate(plan) if "Repartition" in line)
    assert "CASE WHEN" in plan[met + 1] and "THEN b" in plan[met + 1]


def test_chunks_are_small(spark):
    """400 papers of 100 tokens out of 1,000, in 8 parts: a byte and a half for each, their common tokens included."""
    draw = np.random.default_rng(5)
    rows = [(k, k, "en", "v", "t", " ".join(f"word{w}" for w in draw.choice(1000, 100, replace=False)), [], 0, 2000, "all", "train") for k in range(400)]
    p = spark.createDataFrame(rows, "paper_id long, split_index long, lang string, venue string, title string, abstract string, reference_titles array<string>, reference_count long, publication_year int, node_path string, split string").repartition(8)
    (chunk,) = tiles.packed(p, ["abstract"], ("lang", "venue"), 16_384).collect()
    assert len(chunk["blob"]) < 1.5 * 400 * 100
    side = tiles.unpacked(chunk["blob"])
    assert list(side["id"]) == list(range(400)) and list(side["abstract"][0]) == [100] * 400 and len(side["abstract"][2]) == 1000


@pytest.mark.parametrize("kind", ["raw", "cosine"])
def test_rows_of_a_slice_come_by_strips(spark, kind):
    """700 papers of a block: the last 10,000 rows name the papers B of the last strip only; all pairs are there, as joined pairs have them."""
    rows = [(k, k // 2, "en", "v", f"word{k % 7} word{k % 11}", f"text{k % 13} text{k % 5}", [], k % 50, 2000 + k % 9, "all", "train") for k in range(700)]
    p = spark.createDataFrame(rows, "paper_id long, split_index long, lang string, venue string, title string, abstract string, reference_titles array<string>, reference_count long, publication_year int, node_path string, split string")
    if kind == "raw":
        got = tiles.raw_pairs(p, catalog.PLAIN)
        expected = pairs.raw_features(pairs.with_both(pairs.block_pairs(p), pairs.paper_features(p))).select(*got.columns)
    else:
        got, expected = tiles.cosine_pairs(p).select("paper_a_id", "paper_b_id"), pairs.block_pairs(p)
    found = got.collect()
    assert len({r["paper_b_id"] for r in found[-10_000:]}) < tiles.STRIP
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected.collect())) and len(found) == 700 * 699 // 2


def test_blobs_give_their_sets_back():
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    for lengths, codes, tokens in [([], [], []), ([0, 0], [], []), ([2, 0, 1], [1, 3, 0], [least, -1, 5, most]), ([1], [0], [least])]:
        x = (np.array(lengths, np.int32), np.array(codes, np.int32), np.array(tokens, np.int64))
        found = tiles.unpacked(tiles._blob({"title": x, "venue": (["a"], np.array([0, -1])), "year": np.array([1.0, np.nan])}))
        assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(found["title"], x, strict=True))
        assert found["venue"][0] == ["a"] and np.array_equal(found["year"], [1.0, np.nan], equal_nan=True)


def test_replay_defaults(spark):
    rows = spark.createDataFrame([], "paper_a_id long, paper_b_id long, true_label string, predicted_label string, is_candidate boolean, system_label string")
    t = replay.totals(rows).first()
    assert (t["baseline_accuracy"], t["related_recall"], t["reduction"], t["speedup"]) == (1.0, 1.0, 0.0, float("inf"))
    assert replay.query_hits(rows).first()["hit_rate"] == 1.0
    inserts = spark.createDataFrame([(i, 10, c) for i, c in enumerate([5, 1, 9, 7])], "paper_a_id long, existing long, candidates long")
    assert replay.upper_median(inserts).first()[0] == 7


def test_chunks(spark):
    df = spark.createDataFrame([(1, [str(i) for i in range(11)]), (2, []), (3, ["a"])], "paper_id long, t array<string>")
    got = [(r[0], r[1], len(r[2])) for r in chunks.chunk_table(df, F.col("t"), 5, 2).orderBy("paper_id", "chunk_index").collect()]
    assert got == [(1, 0, 5), (1, 1, 5), (3, 0, 1)]
    assert tuple(chunks.diagnostics(df, F.col("t"), 5, 2).first()) == (4, 3, 1, 3)
    encoded = chunks.encode(chunks.chunk_table(df, F.col("t"), 5, 2), chunks.hashing_encoder).collect()
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in encoded)


def test_backends(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0)
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, y, strict=True)], "a double, b double, c double, y int")
    for name in ("random_forest", "extra_trees"):
        out = backends.run_backends(name, df, df, ["a", "b", "c"], trees=15)[0][name].collect()
        assert np.mean([r["prediction"] == r["y"] for r in out]) > 0.9
        assert all(abs(sum(r["p"]) - 1) < 1e-6 and len(r["p"]) == 4 for r in out)
    assert backends.run_backends("nothing, ", df, df, ["a"])[1] == ["nothing"]
    assert backends.parameters(11, 128) == 2052 and backends.parameters(7680, 128) == 983_684


def test_records(spark, tmp_path):
    lines = ['{"paper_id": "a", "title": "é", "publication_year": 2001, "reference_titles": ["x"]}', "", '{"paper_id": "b", "split_index": 3}']
    (tmp_path / "papers.jsonl").write_text("\n".join(lines))
    p = records.read_papers(spark, f"file://{tmp_path}/papers.jsonl")
    assert [(r["paper_id"], r["publication_year"], r["split_index"]) for r in p.orderBy("paper_id").collect()] == [("a", "2001", 0), ("b", None, 3)]
    records.write_jsonl(p, f"file://{tmp_path}/out")
    assert records.read_papers(spark, f"file://{tmp_path}/out").count() == 2
    (tmp_path / "bad.jsonl").write_text("{nope")
    with pytest.raises(Exception):
        records.read_papers(spark, f"file://{tmp_path}/bad.jsonl").collect()
    records.write_json_document(spark, {"a": "é", "b": [1]}, f"file://{tmp_path}/deep/er/doc.json")
    assert records.read_json_document(spark, f"file://{tmp_path}/deep/er/doc.json") == {"a": "é", "b": [1]}
    assert json.loads((tmp_path / "deep/er/doc.json").read_text()) and records.read_json_document(spark, f"file://{tmp_path}/none.json") == {}
    labels = spark.createDataFrame([("a", "b", "PEER")], "paper_a_id string, paper_b_id string, label string")
    assert records.read_predictions(spark, f"file://{tmp_path}/none", labels).first()["predicted_label"] == "PEER"
    shards = spark.createDataFrame([("train", k % 2, f"p{k}") for k in range(5)], "split string, shard_id int, pair_id string")
    records.write_shards(shards, f"file://{tmp_path}/shards")
    assert records.read_shards(spark, f"file://{tmp_path}/shards", "train", 2).count() == 5
    with pytest.raises(FileNotFoundError):
        records.read_shards(spark, f"file://{tmp_path}/shards", "train", 3)


def test_serial_index():
    rng = np.random.default_rng(0)
    own = arrivals.SerialIndex(beam=3)
    sizes = []
    for k in range(80):
        v = rng.normal(size=8)
        found, leaf, visited = own.route(v / np.linalg.norm(v))
        assert len(set(found)) == len(found) <= k and (visited > 0) == (k > 0)
        own.insert(k, v / np.linalg.norm(v), leaf)
        sizes.append(len(found))
        assert sorted(m for n in own.nodes[0] for m in n[0]) == list(range(k + 1))
        assert max(len(n[0]) for n in own.nodes[0]) <= 16
    assert own.rebuilds >= 5 and sizes[10] == 10 and sizes[-1] < 79


def test_rebuilds_take_the_rounds_of_arrays(monkeypatch):
    """No step for each cluster in a round; leaves are those of the serial assignment to the same means."""
    calls, x = [], np.random.default_rng(0).normal(size=(50, 4))
    lloyd = kmeans.lloyd
    monkeypatch.setattr(kmeans, "lloyd", lambda *a: calls.append(1) or lloyd(*a))
    far = kmeans.nearest(x, kmeans.means(x, 4, 13, starts=3))
    assert dict(enumerate(arrivals.bounded_labels(x, 4, 13, 3))) == greedy(far, index.capacities(50, 4)) and len(calls) == 6


def test_rounds_of_few_centers_do_not_copy_the_points():
    """As many points as cells are fitted on: centers are the means of their points, and rounds hold less than a copy of these."""
    import tracemalloc

    x = np.random.default_rng(0).normal(size=(20_000, 64)).astype(np.float32)
    tracemalloc.start()
    centers = kmeans.lloyd(x, x[:3], rounds=4)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    label = kmeans.closest(x, kmeans.lloyd(x, x[:3], rounds=3))
    assert centers == pytest.approx(np.array([x[label == c].mean(0, dtype=float) for c in range(3)]), abs=1e-5) and held < x.nbytes / 2


def test_streamed_inserts_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([("k", i, rng.normal(size=4).tolist()) for i in range(30)], "key string, item_id long, vector array<double>")
    batch = sorted(map(tuple, arrivals.dynamic_inserts(rows).collect()))
    for k in range(2):
        rows.where(f"item_id div 15 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = arrivals.dynamic_insert_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == batch


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 40))
def test_schedules_shrink_to_one(n, leaf):
    s = index.level_schedule(n, leaf)
    assert s[-1] == 1 and all(a > b for a, b in zip(s[:-1], s[1:], strict=True)) and sum(index.capacities(n, s[0])) == n


def test_whole_static_flow(spark, tmp_path):
    from docweave.plans import classify
    from docweave.sources import runs

    rng = random.Random(1)
    words = [f"word{i}" for i in range(60)]
    rows, paths = [], ["r", "r > a", "r > b"]
    for i in range(24):
        path = paths[i % 3]
        rows.append((f"p{i}", " ".join(rng.sample(words, 4)), " ".join(rng.sample(words, 12)) + f" topic{i % 3}", path, str(2000 + i), str(i % 3 * 20), [f"ref {path}"], path, i))
    papers_ = spark.createDataFrame(rows, records.PAPERS)
    both = papers_.alias("a").join(papers_.alias("b"), F.expr("a.paper_id <> b.paper_id"))
    labels = both.select(F.concat("a.paper_id", F.lit("-"), "b.paper_id").alias("pair_id"), F.col("a.paper_id").alias("paper_a_id"), F.col("b.paper_id").alias("paper_b_id"), taxonomy.relation(F.col("a.node_path"), F.col("b.node_path")).alias("label"))
    found = classify.run(spark, (papers_, labels), (papers_, labels), f"file://{tmp_path}/out", "random_forest,unknown", trees=10)
    assert list(found) == ["random_forest"] and found["random_forest"]["accuracy"] > 0.7
    assert runs.reused(spark, f"file://{tmp_path}/out/all_metrics.json", "methods", dict)["random_forest"]["accuracy"] > 0.7
    assert runs.reused(spark, None, "methods", lambda: {"made": 1}) == {"made": 1}
    events: list = []
    with runs.progress(spark, events.append, 0.05, name="pairs"):
        labels.write.parquet(f"{tmp_path}/pairs")
    assert runs.written_rows(spark, f"{tmp_path}/pairs") == 24 * 23
    assert events[-1]["event"] == "done" and events[-1]["name"] == "pairs" and events[-1]["done"] == events[-1]["tasks"] > 0


def test_saved_model(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from docweave.sources import runs

    df = spark.createDataFrame([(float(i), i % 2) for i in range(40)], "x double, y int")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), RandomForestClassifier(labelCol="y", numTrees=3, seed=1)]).fit(df)
    idf = spark.createDataFrame([("nets", 1.5)], "token string, idf double")
    runs.save_model(spark, f"file://{tmp_path}/m", model, idf, pairs.feature_stats(df, ("x",)), {"labels": list(X.LABELS)})
    loaded, tokens, stats, about = runs.load_model(spark, f"file://{tmp_path}/m")
    assert about["max_reference_titles"] == 80 and about["labels"][0] == "A_TO_B" and tokens.count() == stats.count() == 1
    assert [r["prediction"] for r in loaded.transform(df).collect()] == [r["prediction"] for r in model.transform(df).collect()]
