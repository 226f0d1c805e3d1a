"""Jaccard join over word n-grams by vertical partitioning.

All n-grams have one global order, that of their mixed 64-bit hashes.  It is cut into fragments, and every
document's set falls into one segment per fragment.  If two sets of a and b n-grams have a Jaccard similarity of
T percent, they differ in at most D = (a + b)(100 - T) / (100 + T) n-grams, so among more than D fragments some
hold equal segments.  The join therefore

1. reduces each document to its set's fingerprint and one signature per segment; the number of fragments follows
   the set's size class, with which D grows (sets near the next class also sign for that one);
2. keeps one representative of equal sets;
3. deals the signatures by value.  A pair that links shares a known least number of them; so pairs are counted in
   small groups of equal signatures and summed, and those with too few are dropped.  Groups of over SMALL documents
   make no pairs: a document whose signatures in such groups are fewer than it must share leaves them, as every
   partner shares another one; the rest are tied to their group's smallest document.  The components of all that
   hold every pair that can link;
4. deals each component's texts to one task, or a large component's blocks to a task for each two blocks, where
   overlaps are counted fragment by fragment and summed per pair.  A task searches from one document at a time
   among those that are not yet reached, so only a spanning forest of the links leaves it;
5. takes the components of those links: at once where one task held a whole component, over all tasks else.

With m segments that are not empty a document shares m - D of them at least with every partner.  Where that is not
above 0, its empty segments sign too, and it shares 1 at least: a partner with m above D signs no empty segments but
shares m - D, any other shares as many as there are fragments beyond D.  No pair is lost.

Defined results: without words or text a document has an empty set and links with nothing; with fewer than k
words the whole sequence is its one n-gram; rows with the same id are one node; a row with a null id links with
nothing and has a null component; equal sets always link; extra columns are ignored; a very long text is reduced whole
by one task (2 GB at most); an empty table gives an empty one.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit
from .graph import components

#: Text and n-grams of the documents that one task compares.
TASK_BYTES, BLOCK_GRAMS = 8 << 20, 4_000_000
#: Fragments in which overlaps are counted; documents with an equal signature that are paired.
COUNTED, SMALL = 4, 8


@cache
def _classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size classes: the smallest size, the most differences, the fragments of each."""
    lo = next(n for n in range(1, 1 << 20) if (n + n * 100 // percent) * (100 - percent) // (100 + percent) >= 1)
    los = [lo]
    while los[-1] < 1 << 40:
        los.append(max(los[-1] + 1, int(los[-1] * max(1.5, 100 / percent))))
    los = np.array(los)
    most = 2 * (los[1:] - 1) * (100 - percent) // (100 + percent)
    return los[:-1], most, most + 3 + most // 2


def shingle_sets(words: kit.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct n-grams in the global order, and where each document's begin."""
    word = words.hashes(fold=True)
    count = np.diff(words.at)
    grams = kit.gram_hashes(word, k)
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.r_[0, np.cumsum(size)]
    out = np.empty(at[-1], np.uint64)
    full = np.repeat(count >= k, size)
    out[full] = grams[kit.inside(words.at, k)]
    for d in np.flatnonzero((count > 0) & (count < k)):
        out[at[d]] = kit.gram_hashes(word[words.at[d] : words.at[d + 1]], int(count[d]))[0]
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i > 1:
            out[i:j].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][size > 0]] = True
    return out[new], np.r_[0, np.cumsum(new)][at]


def signatures(sets: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment signatures ordered by document, whether each is of the class above, where each document's begin, and how
    many of its own and its upper class's signatures a document shares with a partner at least (0: none are made)."""
    los, most, fragments = _classes(percent)
    size = np.diff(at)
    own = np.searchsorted(los, size, "right") - 1
    found, least = [], np.zeros((len(size), 2), np.int64)
    spread = kit.mix(sets ^ np.uint64(0x5851F42D4C957F2D))
    total = np.r_[np.uint64(0), np.cumsum(spread)]
    for up in (0, 1):
        c = own + up
        docs = np.flatnonzero((c >= 0) if not up else (size * 100 // percent >= los[np.minimum(c, len(los) - 1)]) & (size > 0))
        if not len(docs):
            continue
        n = size[docs]
        doc = np.repeat(docs, n)
        where = np.repeat(at[docs] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        frag = ((sets[where] >> np.uint64(32)) * fragments[c[doc]].astype(np.uint64)) >> np.uint64(32)
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (frag[1:] != frag[:-1])])
        length = np.diff(np.r_[head, len(doc)])
        start = where[head]
        name = (c[doc[head]].astype(np.uint64) << np.uint64(44)) + frag[head]
        found.append((doc[head], kit.mix(total[start + length] - total[start] + kit.mix(name + np.uint64(1))), np.full(len(head), up)))
        segments = np.bincount(doc[head], minlength=len(size))
        least[docs, up] = np.maximum(segments[docs] - most[c[docs]], 1)
        for d in docs[segments[docs] <= most[c[docs]]]:
            empty = np.setdiff1d(np.arange(fragments[c[d]]), frag[doc == d].astype(np.int64))
            found.append((np.full(len(empty), d), kit.mix(kit.mix((np.uint64(c[d]) << np.uint64(44)) + empty.astype(np.uint64) + np.uint64(1)) ^ np.uint64(0xE7)), np.full(len(empty), up)))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(at), np.int64), least
    doc, sig, up = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(doc * 2 + up, kind="stable")
    return sig[order], up[order], np.searchsorted(doc[order], np.arange(len(at))), least


_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("least", pa.int32()), ("least_up", pa.int32()), ("sigs", pa.binary())])


def _reduce(k: int, percent: int, short: int):
    def run(batches):
        for batch in batches:
            ids = kit.long_ids(batch["doc_id"])
            raw, offs = kit.flat(batch["text"])
            for i, j in kit.slices(offs):
                sets, at = shingle_sets(kit.Words(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), k)
                f1, f2 = (np.r_[np.uint64(0), np.cumsum(kit.mix(sets ^ np.uint64(s)))] for s in (0x243F6A8885A308D3, 0x13198A2E03707344))
                sig, up, sig_at, least = signatures(sets, at, percent)
                blobs = [kit.narrow(up[a:b].sum(keepdims=True).astype(np.uint64)) + kit.narrow(sig[a:b] >> np.uint64(short)) if b > a else b"" for a, b in zip(sig_at[:-1].tolist(), sig_at[1:].tolist(), strict=True)]
                yield pa.record_batch(
                    [kit.id_column(ids[i:j]), pa.array(np.diff(at)), pa.array((f1[at[1:]] - f1[at[:-1]]).view(np.int64)), pa.array((f2[at[1:]] - f2[at[:-1]]).view(np.int64)), pa.array(least[:, 0].astype(np.int32)), pa.array(least[:, 1].astype(np.int32)), pa.array(blobs, pa.binary())],
                    schema=_SETS,
                )

    return run


def _deal(buckets: int, short: int):
    """Signatures by bucket, with their entries: twice the document's id, plus 1 in the class above its own."""

    def run(batches):
        for batch in batches:
            keys, entries = [], []
            for i, blob in zip(kit.long_ids(batch["doc_id"]).tolist(), batch["sigs"].to_pylist(), strict=True):
                upper = int(kit.widen(blob[: blob[0] + 1])[0])
                own = kit.widen(blob[blob[0] + 1 :])
                keys.append(own)
                entry = np.full(len(own), 2 * i)
                entry[len(own) - upper :] += 1
                entries.append(entry)
            if not keys:
                continue
            keys, entries = np.concatenate(keys) << np.uint64(short), np.concatenate(entries)
            bucket = kit.bucket_of(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            own = [order[cuts[b] : cuts[b + 1]] for b in full]
            yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array([kit.narrow(keys[o] >> np.uint64(short)) for o in own], pa.binary()), pa.array([_offset(entries[o]) for o in own], pa.binary())], names=["bucket", "keys", "ids"])

    return run


def _offset(x: np.ndarray) -> bytes:
    """The smallest of some numbers, then how far each is above it."""
    return x.min(keepdims=True).tobytes() + kit.narrow((x - x.min()).astype(np.uint64))


_TIES = pa.schema([("hot", pa.bool_()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int32())])


def _ties(table: pa.Table) -> pa.Table:
    """Pairs of entries with the number of signatures that they share in small groups; (entry, signature) of large ones."""
    keys = np.concatenate([kit.widen(x) for x in table["keys"].to_pylist()])
    ids = np.concatenate([np.frombuffer(x, np.int64, 1) + kit.widen(x[8:]).astype(np.int64) for x in table["ids"].to_pylist()])
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[head, len(keys)])
    large = np.repeat(size > SMALL, size)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for far in range(1, SMALL):  # each member of a small group with the one so far behind it
        near = np.flatnonzero((keys[:-far] == keys[far:]) & ~large[:-far]) if far < len(keys) else []
        a.append(ids[near])
        b.append(ids[np.add(near, far).astype(np.int64)])
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(a)])
    hot = int(large.sum())
    columns = [np.r_[np.zeros(len(first), bool), np.ones(hot, bool)], np.r_[a[first], ids[large]], np.r_[b[first], keys[large].view(np.int64)], np.r_[count, np.ones(hot, np.int64)].astype(np.int32)]
    return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_TIES)


def _short(size: int) -> int:
    """Low bits of a signature that are not sent: so few that chance pairs, which only make candidates, stay in
    proportion to the input."""
    return 64 - min(64, 8 * -(-(max(1, size).bit_length() + 8) // 8))


def _may_link(reps: DataFrame, size: int) -> DataFrame:
    """(a, b): ties between representatives whose components hold every pair that can link."""
    buckets = kit.pieces(size, 16 << 20, reps.sparkSession)
    dealt = reps.where(F.octet_length("sigs") > 0).select(F.col("rep").alias("doc_id"), "sigs").mapInArrow(kit.lean(_deal(buckets, _short(size))), "bucket int, keys binary, ids binary")
    ties = kit.settled(dealt.groupBy("bucket").applyInArrow(kit.lean(_ties), "hot boolean, x long, y long, n int"))
    pairs, hot = ties.where("not hot").groupBy("x", "y").agg(F.sum("n").alias("n")), ties.where("hot")
    entries = reps.select(F.explode(F.array(F.struct((F.col("rep") * 2).alias("e"), F.col("least").alias("g")), F.struct((F.col("rep") * 2 + 1).alias("e"), F.col("least_up").alias("g")))).alias("x")).select("x.*").where("g > 0")
    entries = entries.groupBy("e").agg(F.min("g").alias("g"))
    counted = entries.join(hot.groupBy(F.col("x").alias("h")).agg(F.sum("n").alias("hot_n")), F.col("e") == F.col("h"), "left").select("e", "g", F.coalesce("hot_n", F.lit(0)).alias("hot_n"))
    ex, ey = (counted.select(F.col("e").alias(f"e{s}"), F.col("g").alias(f"g{s}"), F.col("hot_n").alias(f"h{s}")) for s in "xy")
    near = pairs.join(ex, F.col("x") == F.col("ex")).join(ey, F.col("y") == F.col("ey")).where("n >= least(gx, gy) - least(hx, hy)")
    stay = counted.where("hot_n >= g").select("e")
    held = hot.join(stay, F.col("x") == F.col("e")).select(F.col("y").alias("sig"), F.shiftright("x", 1).alias("doc"))
    first = held.groupBy(F.col("sig").alias("s")).agg(F.min("doc").alias("a"))
    stars = held.join(first, F.col("sig") == F.col("s")).where("doc <> a").select("a", F.col("doc").alias("b"))
    return near.select(F.shiftright("x", 1).alias("a"), F.shiftright("y", 1).alias("b")).union(stars)


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n reaches by the links a - b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


class _Overlaps:
    """The n-gram sets of some documents, cut into fragments: counts of what one shares with others."""

    def __init__(self, sets: np.ndarray, at: np.ndarray):
        self.names, number = np.unique(sets, return_inverse=True)
        self.size = np.diff(at)
        doc = np.repeat(np.arange(len(self.size)), self.size)
        fragment = number * COUNTED // max(1, len(self.names))
        self.fragments = []
        for f in range(COUNTED):
            own = fragment == f
            self.fragments.append((number[own], np.searchsorted(doc[own], np.arange(len(self.size) + 1))))
        self.mark = np.zeros(len(self.names), np.int32)

    def pick(self, docs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The segments of these documents alone."""
        out = []
        for numbers, at in self.fragments:
            n = at[docs + 1] - at[docs]
            begin = np.r_[0, np.cumsum(n)]
            out.append((numbers[np.repeat(at[docs] - begin[:-1], n) + np.arange(begin[-1])], begin))
        return out

    def shared(self, x: int, segments: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Overlap of x with each of the picked documents: partial counts of every fragment, summed per pair."""
        total = np.zeros(len(segments[0][1]) - 1, np.int64)
        for (numbers, at), (others, begin) in zip(self.fragments, segments, strict=True):
            mine = numbers[at[x] : at[x + 1]]
            self.mark[mine] = 1
            partial = np.r_[0, np.cumsum(self.mark[others])]
            total += partial[begin[1:]] - partial[begin[:-1]]
            self.mark[mine] = 0
        return total


def spanning_links(sets: np.ndarray, at: np.ndarray, groups: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what links connect at all, among documents of equal group.

    A document meets those that share an n-gram of its prefix: the rarest ones of its set, so many that no partner
    can do without all of them.  It meets only what is not reached yet.
    """
    over, links = _Overlaps(sets, at), []
    number, size = np.searchsorted(over.names, sets), over.size
    doc = np.repeat(np.arange(len(size)), size)
    rare = np.bincount(number, minlength=len(over.names))[number]
    order = np.lexsort((number, rare, doc))
    place = np.arange(len(doc)) - np.repeat(at[:-1] - at[0], size)
    take = place < np.repeat(size - (size * percent + 99) // 100 + 1, size)
    prefix, owner = number[order][take], doc[take]
    cuts = np.searchsorted(owner, np.arange(len(size) + 1))
    order = np.argsort(prefix, kind="stable")
    posting, listed = owner[order], np.searchsorted(prefix[order], np.arange(len(over.names) + 1))
    open_ = np.ones(len(size), bool)
    left = indexed = len(size)
    order = np.argsort(groups, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
        rest = len(own)
        for seed in own.tolist():
            if not open_[seed]:
                continue
            open_[seed], waiting = False, [seed]
            rest, left = rest - 1, left - 1
            while waiting and rest:
                x = waiting.pop()
                if 2 * left < indexed:  # the index forgets what is reached
                    keep = open_[posting]
                    listed, posting, indexed = np.r_[0, np.cumsum(keep)][listed], posting[keep], left
                if len(own) > 8:
                    mine = prefix[cuts[x] : cuts[x + 1]]
                    near = [posting[listed[p] : listed[p + 1]] for p in mine.tolist()]
                    near = np.unique(np.concatenate([n[open_[n]] for n in near])) if near else np.zeros(0, np.int64)
                    near = near[groups[near] == groups[x]]
                else:
                    near = own[open_[own]]
                near = near[(100 * size[near] >= percent * size[x]) & (100 * size[x] >= percent * size[near])]
                if len(near):
                    both = over.shared(x, over.pick(near))
                    near = near[100 * both >= percent * (size[near] + size[x] - both)]
                    open_[near] = False
                    rest, left = rest - len(near), left - len(near)
                    links += [(x, y) for y in near.tolist()]
                    waiting += near.tolist()
    return links


def _compare(k: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        raw, offs = kit.flat(table["text"])
        sets, at = shingle_sets(kit.Words(raw, offs), k)
        ids, of, whole = kit.long_ids(table["doc_id"]), kit.long_ids(table["root"]), table["task"][0].as_py() < 0
        links = np.array(spanning_links(sets, at, of, percent), np.int64).reshape(-1, 2)
        nodes, number = np.unique(ids, return_inverse=True)
        root = roots(number[links[:, 0]], number[links[:, 1]], len(nodes))
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"a": nodes[root[own]], "b": nodes[own], "whole": np.full(len(own), whole)})

    return run


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of k-word n-grams (A-Z in lower case) have a Jaccard similarity of percent.

    Returns doc_id, n_shingles, component_id (the smallest id that links reach) for each row.
    """
    spark = docs.sparkSession
    rows = kit.check_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    _, size = kit.volume(rows)
    all_sets = kit.settled(rows.mapInArrow(kit.lean(_reduce(k, percent, _short(size))), "doc_id long, n_shingles long, f1 long, f2 long, least int, least_up int, sigs binary"))
    same = ["f1", "f2", "n_shingles"]
    known = all_sets.where("doc_id is not null and n_shingles > 0")
    reps = kit.settled(known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("least").alias("least"), F.first("least_up").alias("least_up"), F.first("sigs").alias("sigs")))
    stars = _may_link(reps, size)
    may_link = kit.settled(components(stars).join(reps.groupBy("rep").agg(F.sum("n_shingles").alias("n")), F.col("node") == F.col("rep")).select("node", "root", "n"))
    blocks = may_link.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).cast("int").alias("blocks")).withColumnRenamed("root", "of")
    tasks = may_link.join(blocks, F.col("root") == F.col("of")).select("node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    groups = kit.pieces(size, TASK_BYTES, spark)
    tasks = kit.small(kit.settled(tasks))
    texts = rows.join(tasks, rows.doc_id == tasks.node)
    texts = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    texts = texts.select(
        F.when(F.col("blocks") > 1, F.col("root")).otherwise(-1 - F.pmod(F.xxhash64("root"), F.lit(groups))).alias("task"),
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "root", "doc_id", "text",
    )
    links = kit.settled(texts.groupBy("task", "i", "j").applyInArrow(kit.lean(_compare(k, percent)), "a long, b long, whole boolean"))
    joined = links.where("whole").select(F.col("b").alias("node"), F.col("a").alias("root")).union(components(links.where("not whole")).where("node <> root"))
    out = all_sets.drop("sigs", "least", "least_up").join(reps.select(*[F.col(c).alias(f"r_{c}") for c in same], "rep"), [F.col(c) == F.col(f"r_{c}") for c in same], "left")
    out = out.join(joined, F.col("rep") == F.col("node"), "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", mine.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but the smallest id of each component (rows with a null id stay)."""
    comps = jaccard_components(docs, k, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(kit.small(kit.settled(comps)), F.col("doc_id") == F.col("gone"), "left_anti")


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)
