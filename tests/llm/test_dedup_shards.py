from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import components, exact_dedup, near_dedup, sharding
from tessera.llm.common import work_folder

GONE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def _groups(rows):
    found = defaultdict(list)
    for r in rows:
        found[(r["text"] or "").translate(GONE)].append((-len(r["text"] or ""), r["doc_id"] is not None, r["doc_id"]))
    return found


def test_exact_groups(spark, odd_docs, no_docs):
    index = exact_dedup.DigestIndex(spark, work_folder(spark, "index"), 4)
    rows, _ = exact_dedup.ingest(odd_docs, index)
    groups = _groups(odd_docs.collect())
    by_id = {i: (min(v)[2], len(v)) for v in groups.values() for _, _, i in v}
    got = rows.collect()
    assert len(got) == odd_docs.count()
    assert all((r["keep_id"], r["group_size"]) == by_id[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    empty, _ = exact_dedup.ingest(no_docs, index)
    assert empty.count() == 0


def test_the_index_persists(spark, odd_docs):
    folder = work_folder(spark, "index")
    index = exact_dedup.DigestIndex(spark, folder, 4)
    first, _ = exact_dedup.ingest(odd_docs, index)
    kept = exact_dedup.keep_first(odd_docs, first)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len(_groups(odd_docs.collect()))
    index.close()
    again = exact_dedup.DigestIndex(spark, folder)  # opened by its folder alone, as in a later session
    assert again.buckets == 4
    more = odd_docs.unionByName(spark.createDataFrame([(100, "quite new")], "doc_id long, text string"), allowMissingColumns=True)
    rows, _ = exact_dedup.ingest(more, again)
    assert [r["doc_id"] for r in rows.where("kept").collect()] == [100]
    assert [r["doc_id"] for r in exact_dedup.keep_first(more, rows).collect()] == [100]
    assert again.rows().count() == len(_groups(odd_docs.collect())) + 1
    assert exact_dedup.keep_first(odd_docs.limit(0), rows.limit(0)).count() == 0


def _sides(plan):
    """Operators of the two sides of the plan's sort-merge join."""
    join = plan
    while "SortMergeJoin" not in join.getClass().getSimpleName():
        join = join.children().head()
    out = []
    for side in (join.left(), join.right()):
        names, todo = [], [side]
        while todo:
            node = todo.pop()
            names.append(node.nodeName())
            todo += [node.children().apply(k) for k in range(node.children().size())]
        out.append(names)
    return out


def test_the_anti_join_neither_moves_nor_sorts_the_index(spark, odd_docs):
    index = exact_dedup.DigestIndex(spark, work_folder(spark, "index"), 4)
    for k in range(3):
        exact_dedup.ingest(spark.createDataFrame([(10 * k + i, f"text {k} {i}") for i in range(9)], "doc_id long, text string"), index)
    before = sorted(map(str, index.rows().collect()))
    assert index.files() == 3 and len(before) == 27

    def index_side():
        batch = spark.createDataFrame([(bytearray(b"x"),)], "digest binary")
        with exact_dedup._sorted_buckets(spark):
            plan = exact_dedup.new_digests(batch, index)._jdf.queryExecution().executedPlan().initialPlan()
        return _sides(plan)[1]

    assert not any("Exchange" in n for n in index_side()) and "Sort" in index_side()
    index.compact()
    assert index.files() == 1 and sorted(map(str, index.rows().collect())) == before
    assert not any("Exchange" in n or n == "Sort" for n in index_side())
    rows, _ = exact_dedup.ingest(spark.createDataFrame([(7, "text  1 1"), (8, "text 9 9")], "doc_id long, text string"), index)
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in rows.collect()} == {(7, 11, False), (8, 8, True)}
    with_many = exact_dedup.DigestIndex(spark, index.folder)
    assert with_many.generation == 1 and with_many.rows().count() == 28


@pytest.mark.parametrize("where", ["groups", "append", "commit"])
def test_a_batch_that_failed_can_run_again(spark, odd_docs, monkeypatch, where):
    index = exact_dedup.DigestIndex(spark, work_folder(spark, "index"), 4)
    exact_dedup.ingest(odd_docs.where("doc_id = 7"), index)
    store = exact_dedup.written

    def failing(df, folder, *rest):
        if folder.endswith("groups"):
            raise RuntimeError("lost")
        return store(df, folder, *rest)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "written", failing) if where == "groups" else m.setattr(index, where, lost)
        with pytest.raises(RuntimeError):
            exact_dedup.ingest(odd_docs, index, batch="monday")
    if where == "commit":
        assert spark.table(index.table).count() > index.rows().count() == 1
    rows, _ = exact_dedup.ingest(odd_docs, index, batch="monday")
    fresh = {g for g in _groups(odd_docs.collect()) if g not in _groups(odd_docs.where("doc_id = 7").collect())}
    told = sorted(map(str, rows.collect()))
    assert exact_dedup.keep_first(odd_docs, rows).count() == len(fresh)
    again, _ = exact_dedup.ingest(odd_docs, index, batch="monday")  # the caller lost the results: the same ones
    assert sorted(map(str, again.collect())) == told and index.rows().count() == len(fresh) + 1
    assert spark.table(index.table).count() == index.rows().count()


def test_repeated_rows_and_texts_under_one_id(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "ab"), (1, "a  b"), (2, "a  b"), (None, "x"), (None, "x"), (None, "y"), (3, None), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"told_id": F.lit(1), "whole": F.lit("w"), "stays": F.lit(False)})
    decided, _ = exact_dedup.ingest(docs, exact_dedup.DigestIndex(spark, work_folder(spark, "index"), 2))
    stay = exact_dedup.keep_first(docs, decided)
    assert stay.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in stay.collect()) == [("1", "a  b"), ("3", ""), ("None", "x"), ("None", "y")]
    near = near_dedup.keep_first(docs, near_dedup.near_duplicates(docs, words=1))
    assert sorted((str(r["doc_id"]), r["text"]) for r in near.collect() if r["text"]) == sorted([("1", "ab"), ("1", "a  b" if _first_hash(spark, "a  b", "a b") else "a b"), ("None", "x"), ("None", "y")])
    assert sorted(str(r["doc_id"]) for r in near.collect() if not r["text"]) == ["3", "4"]


def _first_hash(spark, a, b):
    return spark.range(1).select(F.xxhash64(F.lit(a)) < F.xxhash64(F.lit(b))).first()[0]


def test_decisions_beyond_the_broadcast_bound(spark, odd_docs, monkeypatch):
    from tessera.llm import common

    decided, _ = exact_dedup.ingest(odd_docs, exact_dedup.DigestIndex(spark, work_folder(spark, "index"), 2))
    want = sorted(map(str, exact_dedup.keep_first(odd_docs, decided).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    stay = exact_dedup.keep_first(odd_docs, decided)
    assert "SortMergeJoin" in stay._jdf.queryExecution().executedPlan().toString() and sorted(map(str, stay.collect())) == want


def test_a_map_lets_every_wanted_key_pass(spark, monkeypatch):
    from tessera.llm import common

    rows = spark.range(5000).selectExpr("if(id = 7, null, id) AS doc_id", "id AS x")
    wanted = spark.range(0, 5000, 50).selectExpr("id AS doc_id").unionAll(spark.sql("SELECT cast(null AS long)"))
    for bits in (1 << 30, 1 << 6):
        monkeypatch.setattr(common, "MAP_BITS", bits)
        got = common.sieved(rows, "doc_id", wanted, 101).where("maybe")
        found = {r["doc_id"] for r in got.collect()}
        assert {*range(0, 5000, 50), None} <= found and (len(found) < 120 or bits == 64)


def _brute(rows, words, percent):
    sets, least = {}, {}
    for k, r in enumerate(rows):
        w = (r["text"] or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset()
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    for k, r in enumerate(rows):
        ids = [x for x in (least.get(root(k)), r["doc_id"]) if x is not None]
        least[root(k)] = min(ids) if ids else None
    return sorted(((r["doc_id"] is not None, r["doc_id"], len(sets[k]), least[root(k)] if sets[k] else r["doc_id"]) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 85, 256), (5, 80, 256), (5, 80, 3)])
def test_near_components(spark, odd_docs, words, percent, block, monkeypatch):
    import random

    monkeypatch.setattr(near_dedup, "BLOCK", block)

    draw = random.Random(5)
    base = [f"w{draw.randrange(400)}" for _ in range(120)]
    made = []
    for i in range(150):  # chains and a hub: each differs from the base, or from the one before
        source = base if i % 3 else made[-1][1].split() if made else base
        text = list(source)
        for _ in range(draw.randrange(5)):
            text[draw.randrange(len(text))] = f"n{i}"
        made.append((1000 + i, " ".join(text)))
    docs = odd_docs.unionByName(spark.createDataFrame(made, "doc_id long, text string"), allowMissingColumns=True)
    got = near_dedup.near_duplicates(docs, words=words, percent=percent)
    rows = got.collect()
    assert sorted(((r["doc_id"] is not None, r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str) == _brute(docs.collect(), words, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    stay = near_dedup.keep_first(docs, got)
    assert stay.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == sorted({str(r["doc_id"]) for r in rows if r["kept"]})
    assert near_dedup.keep_first(docs.limit(0), got.limit(0)).count() == 0


def test_nothing_near(no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_links_in_blocks_by_brute_force():
    import numpy as np

    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 60, 60)
    sets = [np.unique(np.where(draw.random(60) < 0.08, draw.integers(0, 1 << 60, 60), base)) for _ in range(40)]
    labels, sides = np.arange(40), np.zeros(40, int)
    found = near_dedup.links_in_block(np.arange(40), labels, sides, sets, 85, columns=16)

    def comps(edges):
        parent = list(range(40))
        for a, b in edges:
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[a] = b
        out = []
        for k in range(40):
            while parent[k] != k:
                k = parent[k]
            out.append(k)
        return [out.index(x) for x in out]

    every = [(a, b) for a in range(40) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    assert comps(found) == comps(every) and len(found) <= 39


def test_band_count_bounds_misses():
    for percent in (80, 85, 95):
        n = near_dedup.band_count(percent)
        assert (1 - (percent / 100) ** near_dedup.BAND_ROWS) ** n <= near_dedup.MISS


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1040)] + [(5, 5), (7, 6), (2000, 2001), (2001, 2000)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long"), work_folder(spark, "cc")).collect())
    assert got == {k: 0 for k in range(61)} | {k: 1000 for k in range(1000, 1040)} | {2000: 2000, 2001: 2000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), work_folder(spark, "cc")).count() == 0


def _store(spark, **options):
    return sharding.ShardStore(spark, work_folder(spark, "shards"), **options)


def test_shards_keep_every_row(spark, odd_docs):
    store = _store(spark, target_bytes=4 << 20, fanout=2)
    last = store.append(odd_docs, arrival=F.pmod(F.col("doc_id"), F.lit(3)))
    assert last == 4  # three arrivals and that of the null id
    store.append(odd_docs)
    before, files = store.manifest(), store.shards().count()
    expected = sorted(map(str, odd_docs.unionByName(odd_docs).collect()))
    assert sorted(map(str, store.read().collect())) == expected
    after = store.manifest(store.compact())
    assert store.shards().count() < files and after["version"] > before["version"]
    assert store.shards(before["version"]).count() == files
    assert sorted(map(str, store.read().collect())) == expected
    assert sorted(map(str, store.read(before["version"]).collect())) == expected  # older versions stay readable
    tiers = [store.tier(s["bytes"]) for s in store.shards().collect() if s["bytes"] < store.target // 2]
    assert all(tiers.count(t) < 2 for t in tiers)
    assert store.vacuum() > 0
    assert sorted(map(str, store.read().collect())) == expected and store.versions() == [after["version"]]


def test_a_version_is_committed_once(spark, odd_docs):
    store = _store(spark)
    store.append(odd_docs)
    base = store.manifest(0)
    with pytest.raises(sharding.Conflict):
        store.commit(base, [], [], "another writer", odd_docs.schema.json())
    assert store.read().count() == odd_docs.count()
    with pytest.raises(ValueError):
        store.append(odd_docs.select("doc_id"))


def test_an_empty_store(spark, no_docs):
    store = _store(spark)
    assert store.manifest()["version"] == 0 and store.compact() == 0
    store.append(no_docs)
    assert not store.versions() or store.read().count() == 0
    with pytest.raises(ValueError):
        sharding.ShardStore(spark, "x", fanout=1)


def test_manifests_grow_by_what_changes(spark, monkeypatch):
    """Versions name segments, checkpoints fold them, and bounded merges lose nothing."""
    monkeypatch.setattr(sharding, "SEGMENTS", 3)
    monkeypatch.setattr(sharding, "MERGE_FILES", 3)
    store = _store(spark, target_bytes=1 << 20, fanout=2)
    for k in range(6):
        store.append(spark.range(k * 10, k * 10 + 10).selectExpr("id", "null AS x", "'p' AS path", "1 AS bytes").coalesce(1))
        assert len(store.manifest()["adds"]) + len(store.manifest()["drops"]) <= 3
    assert sorted(r["id"] for r in store.read(2).collect()) == list(range(20)) and store.shards().count() == 6
    store.compact()
    assert store.shards().count() == 1 and sorted(r["id"] for r in store.read().collect()) == list(range(60))
    assert store.read(1).count() == 10 and store.vacuum() >= 6 and store.read().count() == 60
    data = {r["path"] for r in store._listing(f"{store.folder}/data").collect()}
    assert data == {r["path"] for r in store.shards().collect()}
    sizes = [1, 100, 1 << 10, 1 << 18, 1 << 19, 1 << 20, 5 << 20]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", store.tier(F.col("n")).alias("t")).collect()
    assert all(r["t"] == store.tier(r["n"]) for r in got)


def test_stores_without_an_atomic_rename_are_refused(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ATOMIC", {"hdfs"})
    with pytest.raises(ValueError, match="atomic"):
        _store(spark)
    assert _store(spark, single_writer=True).versions() == []
