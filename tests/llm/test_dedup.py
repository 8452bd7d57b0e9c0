"""Exact deduplication, the Jaccard join and the removal of repeats against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from texts import prose, twins

from strandlake.llm import common, exact_dedup, fm_decontam, jaccard_join, suffix_dedup


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("bits", [256, 4])
def test_exact(docs, rows, bits):
    got = exact_dedup.exact_dedup(docs, bits).collect()
    want = plain_exact(rows)
    if bits == 256:
        assert Counter(tuple(r) for r in got) == want
    else:  # texts that share a digest are told apart by their bytes
        assert Counter(tuple(r)[:4] for r in got) == Counter(k[:4] for k in want.elements())


def test_exact_edges(clash, empty):
    rows = [(r.doc_id, r.text) for r in clash.collect()]
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(clash).collect()) == plain_exact(rows)
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_copies(clash)
    assert kept.columns == clash.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in rows if plain_keep(rows, i, t))


def plain_keep(rows, i, t):
    ids = [a for a, b in rows if norm(b) == norm(t)]
    return i == min((a for a in ids if a is not None), default=None)


def test_copies_go_by_row(spark):
    rows = [(1, "a"), (5, "a"), (5, "b"), (6, "b"), (7, "c"), (7, "c"), (7, None), (None, "a"), (None, "d")]
    kept = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, "a"), (5, "b"), (7, "c"), (7, "c"), (7, None), (None, "d")])


def test_index_grows(spark, docs, rows):
    """A second memtable and compaction: level 1 covers both, and a lookup finds only what is there."""
    ws = common.Workspace(spark, "test")
    index = exact_dedup.DigestIndex(spark, ws)
    index.flush(docs.filter("doc_id < 50"))
    index.flush(docs.filter("doc_id >= 50"))
    level = index.compact()
    assert level.count() == len({norm(t) for _, t in rows})
    some = level.limit(3)
    assert index.lookup(some).count() == 3


def test_compaction_merges_with_the_level_before(spark, docs, rows):
    ws = common.Workspace(spark, "test")
    index = exact_dedup.DigestIndex(spark, ws)
    index.flush(docs.filter("doc_id < 50").repartition(4), 2)
    assert len(index.runs) == 2
    index.compact(1)
    assert len(index.runs) == 1
    first = {bytes(r.digest): (r.keep_id, r.n) for r in index.compact().collect()}
    assert first == {hashlib.sha256(norm(t).encode()).digest(): x for t, x in plain_groups([r for r in rows if r[0] < 50]).items()}
    ws.drop("level0-1")  # runs that were merged aren't read again
    index.flush(docs.filter("doc_id >= 50"), 3)
    index.compact()
    found = index.resolve(docs.select("doc_id", F.unhex(F.sha2(exact_dedup.normalised(docs).cast("binary"), 256)).alias("digest")))
    want = plain_groups(rows)
    assert {r.doc_id: (r.keep_id, r.n) for r in found.collect()} == {i: want[norm(t)] for i, t in rows}


def plain_groups(rows):
    out = {}
    for i, t in rows:
        keep, n = out.get(norm(t), (i, 0))
        out[norm(t)] = min(keep, i), n + 1
    return out


@pytest.mark.parametrize("tasks,fan,tiers", [(1, 2, 3), (2, 3, 1), (64, 16, 0)])
def test_tiers_give_one_level(spark, docs, rows, tasks, fan, tiers):
    """However memtables are cut and merged, the level has one entry for each text; an empty table gives an empty level."""
    ws = common.Workspace(spark, "test")
    index = exact_dedup.DigestIndex(spark, ws)
    index.build(docs.repartition(10), tasks, fan)
    assert index.level == "level1-1" and not index.runs and all(ws.exists(f"tier-{k}") == (k == tiers) for k in range(1, 5))
    want: dict = {}
    for i, t in rows:
        have = want.get(norm(t), (i, 0))
        want[norm(t)] = min(have[0], i), have[1] + 1
    got = {bytes(r.digest): (r.keep_id, r.n) for r in ws.get(index.level, exact_dedup.ENTRY).collect()}
    assert got == {hashlib.sha256(t if isinstance(t, bytes) else t.encode()).digest(): x for t, x in want.items()}
    none = exact_dedup.DigestIndex(spark, common.Workspace(spark, "none"))
    assert none.build(docs.limit(0), tasks, fan).count() == 0 and none.ws.get(none.level, exact_dedup.ENTRY).count() == 0


def test_lookup_opens_only_files_that_may_hold_a_digest(spark):
    ws = common.Workspace(spark, "test")
    index = exact_dedup.DigestIndex(spark, ws)
    rows = [(i, f"text {i}") for i in range(400)]
    index.flush(spark.createDataFrame(rows[:300], "doc_id long, text string").repartition(3))
    index.compact()
    index.flush(spark.createDataFrame(rows[300:], "doc_id long, text string").repartition(5))
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    of_file = {r.f: r.d for k in ("level1-1", "level0-2") for r in ws.get(k).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.collect_set("digest").alias("d")).collect()}
    of_file = {f: {bytes(x) for x in d} for f, d in of_file.items()}
    assert len(of_file) >= 4
    for some in (["text 5"], ["text 350"], ["text 7", "text 399"], ["nowhere"]):
        d = [digest(t) for t in some]
        frame = spark.createDataFrame([(x,) for x in d], "digest binary")
        opened = index.files(frame)
        assert set(opened) >= {f for f, held in of_file.items() if held & set(d)} and len(opened) <= len(some)
        assert {(bytes(r.digest), r.keep_id, r.n) for r in index.lookup(frame).collect()} == {(digest(t), i, 1) for i, t in rows if t in some}
        assert {f.replace("file:///", "file:/") for f in index.lookup(frame).inputFiles()} == set(opened)


def test_rows_without_id_are_verified(spark):
    """Texts that share a short digest, among rows with and without ids."""
    r = random.Random(4)
    rows = [(None if k % 3 else k, f"t{r.randrange(12)}") for k in range(90)] + [(None, "only"), (None, "only")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert Counter(tuple(x)[:4] for x in got) == Counter(k[:4] for k in plain_exact(rows).elements())


def shingle_sets(rows, n):
    out = {}
    for i, t in rows:
        w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def plain_components(rows, n, percent):
    sets = shingle_sets(rows, n)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 50), (1, 30)])
def test_jaccard(docs, rows, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs, n, percent).collect()}
    assert got == plain_components(rows, n, percent)


def test_words_are_compared_by_bytes(spark):
    a, b = twins()
    rows = [(1, a), (2, b), (3, f"one two three {a}"), (4, f"one two three {b}"), (5, f"one two three {a}")]
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}
    assert jaccard_join.linked(pa.array([a, a, a]), pa.array([b, a, a + " x"]), 4, 85).tolist() == [False, True, False]


def test_shingles_that_share_a_hash(spark):
    """Two words of one hash in one text: sets keep their sizes and links aren't lost; more than two likewise."""
    x, y = "kpvphwnkmmmmmmmm", "dxbwlnciluz2wu6q"
    bufs = [common.word_hashes(common.eight(np.frombuffer(w.encode(), np.uint8)), np.array([0]), np.array([len(w)]))[0] for w in (x, y)]
    assert bufs[0] == bufs[1]
    rows = [(1, f"{x} {y}"), (2, f"{y} {x}")]
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == [(1, 2, 1), (2, 2, 1)]
    w = [f"w{k}" for k in range(34)]
    for other in (y, "ordinary"):
        rows = [(1, " ".join([*w, x, other, "one"])), (2, " ".join([*w, "two", "three", "four"])), (3, " ".join([*w, x, other, "five"]))]
        got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == [(1, 37, 1), (2, 37, 1), (3, 37, 1)]
    rows = [(1, f"a b c {x} d e f {y} a b c {y} d e f {x}"), (2, f"a b c {x} d e f {y} a b c {y} d e f {x} z"), (3, f"a b c {y} d e f {y} a b c {y} d e f {y}")]
    for n, percent in ((4, 85), (2, 50), (1, 30)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()}
        assert got == plain_components(rows, n, percent)


def test_rows_without_id_are_nodes(spark):
    """1 - null - 2 is one component; what only rows without id have has no name; copies without id join their text's."""
    w = [f"w{k}" for k in range(60)]
    one, bridge, two = w, [*w[:55], *"abcde"], [*w[:50], *"abcdefghij"]
    rows = [(1, " ".join(one)), (None, " ".join(bridge)), (2, " ".join(two)), (None, "only these words here"), (None, "only these words here"), (7, "alone is this text"), (None, "alone is this text"), (None, ""), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert not jaccard_join.linked(pa.array([" ".join(one)]), pa.array([" ".join(two)]), 1, 80)[0]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_components(frame, 1, 80).collect()), key=str)
    assert got == sorted([(1, 60, 1), (None, 60, 1), (2, 60, 1), (None, 4, None), (None, 4, None), (7, 4, 7), (None, 4, 7), (None, 0, None), (None, 0, None)], key=str)
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(frame, 1, 80).collect() if r.doc_id is not None) == [1, 7]


def test_links_of_pairs(rows):
    r = random.Random(2)
    pairs = [(r.choice(rows)[1], r.choice(rows)[1]) for _ in range(300)] + [(t, t) for _, t in rows]
    for n, percent in ((4, 85), (1, 30), (2, 50)):
        x, y = (shingle_sets(list(enumerate(side)), n) for side in zip(*pairs))
        want = [bool(x[k] & y[k]) and 100 * len(x[k] & y[k]) >= percent * len(x[k] | y[k]) for k in range(len(pairs))]
        assert jaccard_join.linked(pa.array([p for p, _ in pairs], pa.string()), pa.array([q for _, q in pairs], pa.string()), n, percent).tolist() == want


def test_long_runs_are_cut_into_tiles(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    monkeypatch.setattr(jaccard_join, "SPREAD", 15)
    for n, percent in ((4, 85), (1, 30)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs, n, percent).collect()}
        assert got == plain_components(rows, n, percent)
    few = spark.createDataFrame([(k % 2, i) for k in range(2) for i in range(7 * k + 4)], "g int, id long")
    few = few.join(few.groupBy("g").count().withColumnRenamed("count", "k"), "g")
    got = sorted((r.i.g, r.i.id, r.j.id) for r in jaccard_join.tile_pairs(few, "g", "k", "id", 3).collect())
    assert got == [(g, i, j) for g, m in ((0, 4), (1, 11)) for i in range(m) for j in range(i + 1, m)]


def test_many_buckets(spark, docs, rows, monkeypatch):
    """Buckets of a few bytes, several to a partition."""
    monkeypatch.setattr(common, "BUCKET", 500)
    monkeypatch.setattr(common, "PARTITIONS", 5)
    monkeypatch.setattr(jaccard_join, "PARTITIONS", 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs).collect()}
    assert got == plain_components(rows, 4, 85)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == plain_repeats(rows, 100)


def test_ids_that_repeat_with_other_texts(spark):
    t = [prose(k, 30) for k in range(4)]
    rows = [(1, t[0]), (5, t[0]), (5, t[1]), (6, t[1]), (7, t[2]), (7, t[3]), (9, t[3] + " x")]
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (5, 1), (5, 5), (6, 5), (7, 7), (7, 7), (9, 7)]


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_chains(spark, seed):
    """Chains and families whose members only link over others, at sizes near the threshold."""
    r = random.Random(seed)
    rows, w = [], [f"w{k}" for k in range(40)]
    for i in range(60):
        for _ in range(r.choice([0, 1, 1, 2])):
            w[r.randrange(len(w))] = f"v{r.randrange(1000)}"
        if r.random() < 0.2:
            w.insert(r.randrange(len(w)), f"u{i}")
        rows.append((r.randrange(10**6), " ".join(w)))
    rows = list({i: (i, t) for i, t in rows}.values())
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == plain_components(rows, 4, 85)


def test_jaccard_edges(clash, empty):
    assert jaccard_join.similar_components(empty).count() == 0
    got = jaccard_join.similar_components(clash)
    assert got.count() == clash.count()
    kept = jaccard_join.one_of_each(clash)
    assert kept.columns == clash.columns and kept.filter("doc_id is null").count() == 3


def test_components(spark):
    ws = common.Workspace(spark, "test")
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.id: r.component for r in common.components(ws, spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert common.components(ws, spark.createDataFrame([], "a long, b long"), "e").count() == 0


def test_hot_groups_and_filters(spark):
    rows = spark.range(6000).selectExpr("id", "case when id < 3000 then 0 else id end as k")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n")
    got = common.attach_groups(rows, groups, "k", "n", 6000)
    assert got.count() == 6000 and got.filter("k = 0 and n = 3000").count() == 3000
    ids = spark.range(0, 6000, 7).withColumnRenamed("id", "doc_id")
    docs = spark.range(6000).withColumnRenamed("id", "doc_id")
    bits = common.id_filter(ids)
    assert bits.maps.count() <= 1 + bits.bits // 32768
    maybe = {r.doc_id for r in common.maybe_in(docs, bits).collect()}
    assert maybe >= set(range(0, 6000, 7)) and len(maybe) < 1000
    assert {r.doc_id for r in common.maybe_in(docs, bits, negate=True).collect()} == set(range(6000)) - maybe


def test_columns_keep_their_names(spark):
    """Columns named as the operators' own pass."""
    names = ["_sl_id", "_sl_bucket", "_sl_map", "_SL_TEXT", "_fm_items", "_fmn_words"]
    docs = spark.createDataFrame([(i, f"some text {i % 5}", *range(6)) for i in range(20)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    gone = docs.filter("doc_id < 3").select("doc_id")
    left = common.without(common.Workspace(spark, "test"), docs, gone)
    assert left.columns == docs.columns and {tuple(r)[2:] for r in left.collect()} == {tuple(range(6))} and left.count() == 17
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(5)) and {tuple(r)[2:] for r in kept.collect()} == {tuple(range(6))}
    clean = fm_decontam.drop_contaminated(docs, spark.createDataFrame([(1, "some text 3")], "item_id long, text string"))
    assert clean.columns == docs.columns and clean.count() == 16 and {tuple(r)[2:] for r in clean.collect()} == {tuple(range(6))}


def plain_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        out[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("length,gram", [(100, 32), (40, 16)])
def test_repeats(docs, rows, length, gram):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, length, gram).collect()}
    assert got == plain_repeats(rows, length)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_in_small_alphabets(spark, seed):
    """Periodic texts, overlaps within a document, passages shared at odd places."""
    r = random.Random(seed)
    rows = []
    for i in range(40):
        parts = [r.choice(["ab", "abc", "a", "xyz!"]) * r.randrange(1, 60) for _ in range(r.randrange(1, 5))]
        rows.append((i * 3, "".join(parts)[r.randrange(5) :]))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 50, 20)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()} == plain_repeats(rows, 50)


def test_passages_of_many_documents(spark, rows, monkeypatch):
    """Grams above FAMILY go by their windows."""
    r = random.Random(3)
    shared = prose("shared", 40)
    some = [(k, f"{prose(k, r.randrange(20))} {shared[r.randrange(20):]} {prose(-k, r.randrange(20))}") for k in range(150)] + [(1000 + i, t) for i, t in rows]
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(7)
    for most, windows in ((10, 200_000), (2, 300)):
        monkeypatch.setattr(suffix_dedup, "FAMILY", most)
        monkeypatch.setattr(suffix_dedup, "WINDOWS", windows)
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(docs).collect()}
        assert got == plain_repeats(some, 100)


def test_long_strings(spark):
    """Suffixes of more than 255 bytes."""
    r = random.Random(7)
    t = "".join(r.choices("abcdef ", k=5000))
    rows = [(1, t), (2, t[:900] + "x" + t[1500:]), (3, t[400:1100])]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 600, 40).collect()}
    assert got == plain_repeats(rows, 600)


def test_repeats_edges(clash, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    got = suffix_dedup.remove_repeats(clash, with_bytes=True)
    assert got.count() == clash.count()
    by = {}
    for x in got.collect():
        if x.doc_id is not None:
            assert by.setdefault(x.doc_id, x.kept) == x.kept  # rows that repeat have one result


def test_merge_keeps_order():
    r = random.Random(5)
    runs = []
    for _ in range(7):
        some = sorted(bytes(r.choices(b"ab", k=r.randrange(1, 30))) for _ in range(r.randrange(0, 40)))
        runs.append([(s, b"l", 0, k) for k, s in enumerate(some)])
    packed = [suffix_dedup.pack_run(x) for x in runs if x]
    merged = list(suffix_dedup.merge_runs([suffix_dedup.unpack_run(x, [(1, 2)]) for x in packed]))
    got = [row[0] for row, _ in merged]
    assert got == sorted(s for x in runs for s, *_ in x)
    for (a, _), (b, share) in zip(merged, merged[1:]):
        assert share == next((k for k, (x, y) in enumerate(zip(a[0], b[0])) if x != y), min(len(a[0]), len(b[0])))
