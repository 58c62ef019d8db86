import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import linear, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").cache() for t in ("documents", "labels"))
    return docs, labels


def _split(labels):
    """Labels to fit on, and held-out ones."""
    return labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0), labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)


def test_toxic_documents_of_labels_held_out(tables):
    docs, labels = tables
    known, held = _split(labels)
    out = toxicity.toxicity(docs, known)
    assert out.count() == docs.count()
    got = out.withColumnRenamed("toxic", "found").join(held, "doc_id").collect()
    toxic, clean = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    assert sum(r["found"] for r in toxic) >= 0.7 * len(toxic)
    assert sum(r["found"] for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r[f"p_{c}"] <= 1 for r in got for c in toxicity.CATEGORIES)


def test_bad_documents_of_labels_held_out(tables):
    docs, labels = tables
    known, held = _split(labels)
    got = quality.quality(docs, known).join(held, "doc_id").collect()
    good, bad = [r for r in got if r["quality"]], [r for r in got if not r["quality"]]
    assert sum(r["keep"] for r in good) >= 0.97 * len(good)
    assert sum(not r["keep"] for r in bad) >= 0.8 * len(bad)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (9, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for given in (labels, none):
        assert toxicity.toxicity(odd_docs, given).count() == odd_docs.count()
        assert quality.quality(odd_docs, given).count() == odd_docs.count()
        assert toxicity.toxicity(no_docs, given).count() == 0
        assert quality.quality(no_docs, given).count() == 0
    assert toxicity.keep_clean(odd_docs, none).columns == odd_docs.columns
    assert toxicity.keep_clean(odd_docs, none).count() == odd_docs.count()
    assert quality.keep_good(odd_docs, none).count() == odd_docs.count()
    assert quality.keep_good(odd_docs, labels).columns == odd_docs.columns
    bad = labels.withColumn("quality", F.lit(0))
    assert quality.keep_good(odd_docs, bad).count() == 0


def test_samples_are_bounded(tables):
    docs, labels = tables
    whole = toxicity.sample(docs, labels, most=50)
    assert len(whole) == 50
    most = sum(map(len, whole["features"])) // 3
    few = toxicity.sample(docs, labels, most=50, most_features=most)
    assert 0 < len(few) < 50 and sum(map(len, few["features"])) <= most


def test_the_least_hashes_are_found_without_sorting_all(spark):
    from tessera.llm.common import least_hashed

    rows = spark.range(20_000).withColumnRenamed("id", "own_id").repartition(7)
    for n in (10, 500, 30_000):
        want = [r["own_id"] for r in rows.orderBy(F.xxhash64("own_id", F.lit(3)), "own_id").limit(n).collect()]
        assert sorted(r["own_id"] for r in least_hashed(rows, "own_id", n, 3).collect()) == sorted(want)
    assert least_hashed(rows.limit(0), "own_id", 5, 1).count() == 0


def test_derived_labels_come_from_used_rows():
    """Markers that only rows held out have don't make a category."""
    sets = [np.array([1, 5] if k % 2 else [2, 5], np.int64) for k in range(200)] + [np.array([9, 5], np.int64)] * 60
    toxic = np.array([k % 2 for k in range(200)] + [1] * 60, float)
    used = np.arange(260) < 200
    labels = toxicity.derive_categories(sets, toxic)
    assert labels(used)[1, 0] == 1 and not labels(used)[200:, 0].any() and labels(np.ones(260, bool))[200:, 0].all()


def test_the_chain_feeds_earlier_log_odds_to_later_models():
    sets = [np.array(s, np.int64) for s in ([1, 2], [1], [2], [3]) * 30]
    labels = np.array([[1, 1], [1, 1], [0, 0], [0, 0]] * 30, float)
    chain = toxicity.fit_chain(sets, labels, ("first", "second"))
    assert chain.links[1, 0] > 0 and not chain.links[0].any()
    own = chain.probabilities(sets[:4])
    assert (own[:2] > 0.5).all() and (own[2:] < 0.5).all()
    z = chain.weights[0, sets[0]].sum() + chain.biases[0]
    p = linear.sigmoid(z)
    second = linear.sigmoid(chain.weights[1, sets[0]].sum() + chain.biases[1] + chain.links[1, 0] * linear.logit(p) / 4)
    assert np.allclose(own[0], [p, second])


def test_views_teach_each_other():
    draw = np.random.default_rng(1)
    y = draw.integers(0, 2, 600).astype(float)
    text = np.column_stack([y + draw.normal(0, 0.2, 600), np.ones(600)]).astype(np.float32)
    meta = np.column_stack([y + draw.normal(0, 0.2, 600), np.ones(600)]).astype(np.float32)
    pool = np.arange(120, 600)
    asked = []

    def surest(views, shares):
        found = []
        for (b, w), x in zip(views, (text, meta)):
            p = linear.sigmoid(b + x[pool] @ w)
            own = [(i, side) for side, q in ((0, 1 - p), (1, p)) for i in quality.pick(q, pool, 20, 0.9)]
            found.append((text[pool[[i for i, _ in own]]], meta[pool[[i for i, _ in own]]], np.array([s for _, s in own], float)))
        asked.append(len(found))
        return found

    model = quality.co_train(text[:120], meta[:120], y[:120], surest, 3)
    assert len(asked) == 3
    assert ((model.probabilities(text, meta)[:, 2] > model.threshold) == y).mean() > 0.97


def test_what_a_view_is_surest_of():
    scores, codes = np.array([0.9, 0.99, 0.99, 0.5, 0.97, 0.97]), np.array([1, 7, 7, 3, 5, 4])
    assert quality.pick(scores, codes, 3, 0.8).tolist() == [1, 5, 4]
    assert quality.pick(scores, codes, 9, 0.98).tolist() == [1] and not len(quality.pick(scores, codes, 0, 0.1))
    assert not len(quality.pick(scores[:0], codes[:0], 3, 0.5))


@pytest.mark.parametrize("n", [2, 3, 8, 400])
def test_calibration_rows_are_held_out_at_every_size(n):
    y = (np.arange(n) % 2).astype(float)
    held = quality._held_out(y, 1)
    assert all(held[y == side].sum() == -(-int((y == side).sum()) // 4) for side in (0, 1))


def test_every_unlabelled_document_is_a_candidate(spark):
    """surest_of against a sort of all scores, with repeated rows."""
    draw = np.random.default_rng(4)
    x = np.zeros((500, quality.TEXT_WIDTH + quality.META_WIDTH), np.float32)
    x[:, 3], x[:, quality.TEXT_WIDTH + 5] = draw.normal(0, 3, 500), draw.normal(0, 3, 500)
    x[400:] = x[7]
    pool = spark.createDataFrame([(bytearray(b),) for b in quality._packed(x)], "views binary").repartition(5).withColumn("code", F.xxhash64("views"))
    w = np.zeros(quality.TEXT_WIDTH), np.zeros(quality.META_WIDTH)
    w[0][3] = w[1][5] = 1.0
    found = quality.surest_of(pool, [(0.0, w[0]), (0.0, w[1])], (15, 6), 0.9)
    for k, values in ((0, x[:, 3]), (1, x[:, quality.TEXT_WIDTH + 5])):
        for side, n in ((0, 15), (1, 6)):
            order = sorted({float(v) for v in values if linear.sigmoid(v if side else -v) >= 0.9}, reverse=bool(side))[:n]
            got = quality._unpacked(found[(found["view"] == k) & (found["side"] == side)]["views"])
            assert sorted(got[:, 3 if k == 0 else quality.TEXT_WIDTH + 5].tolist()) == sorted(order)
    assert np.array_equal(quality._unpacked(quality._packed(x)), x)


def test_the_text_view_reads_chunks_whole():
    cache = quality.Shapes()
    start = "漢字" * 5000
    a, b = quality.text_view(start + "です" * 100, cache), quality.text_view(start + "xY9-" * 50, cache)
    assert not np.array_equal(a, b)
    assert np.array_equal(quality.text_view("one two 33", cache), quality.text_view("one\ttwo\n33", cache))


def test_quality_scores_by_brute_force(spark, tables):
    """Scores recomputed from the model's weights, one dense row at a time."""
    docs, labels = tables
    few = docs.where("doc_id < 60")
    model, made = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in few.select("doc_id", quality.scorer(model, docs.columns).alias("s")).select("doc_id", "s.*").collect()}
    assert made.count() == docs.count()
    from_features = {r["own_id"]: quality._scored(model, quality._unpacked([bytes(r["views"])])).iloc[0] for r in made.where("own_id < 60").collect()}
    for r in few.collect():
        views = quality.text_view(r["text"] or "", quality.Shapes()), quality.metadata_view(r["text"] or "", r["source"] or "", r["lang"] or "", -1.0 if r["n_chars"] is None else float(r["n_chars"]))
        z = [slope * (b + sum(float(v) * float(c) for v, c in zip(x, w))) + offset for (b, w), (slope, offset), x in zip(model.views, model.calibrations, views)]
        p = 1 / (1 + np.exp(-(model.stack[0] + z[0] * model.stack[1][0] + z[1] * model.stack[1][1])))
        for row in (got[r["doc_id"]], from_features[r["doc_id"]]):
            assert row["p_quality"] == pytest.approx(p, abs=1e-4) and row["p_text"] == pytest.approx(1 / (1 + np.exp(-z[0])), abs=1e-4)
            assert row["keep"] == (p > model.threshold) or abs(p - model.threshold) < 1e-4


def test_rows_are_kept_by_their_own_scores(spark, tables):
    """keep_good against the scores of whole rows; one id with several texts or sources, and repeats."""
    docs, labels = tables
    odd = docs.where("doc_id < 40").unionByName(docs.where("doc_id between 40 and 80").withColumn("doc_id", F.lit(5).cast("long"))).unionByName(docs.where("doc_id < 9")).unionByName(docs.where("doc_id < 9").withColumns({"source": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long")}))
    model, _ = quality.train(odd, labels)
    want = odd.select("*", quality.scorer(model, odd.columns).alias("own")).where("own.keep").drop("own")
    got = quality.keep_good(odd, labels)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == odd.columns


def test_toxicity_scores_by_brute_force(tables):
    """Scores recomputed from the chain's weights, category after category."""
    docs, labels = tables
    few = docs.where("doc_id < 60")
    chain = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in few.select("doc_id", toxicity.scorer(chain)("text").alias("s")).select("doc_id", "s.*").collect()}
    for r in few.collect():
        names = {n for chunk in (r["text"] or "").encode().split() for n in np.frombuffer(toxicity.Features()[chunk], "<u4").tolist()}
        before = []
        for j, category in enumerate(chain.categories):
            z = chain.biases[j] + sum(float(chain.weights[j, n]) for n in names) + sum(link * x for link, x in zip(chain.links[j], before))
            p = 1 / (1 + np.exp(-z))
            before.append(np.log(max(p, 1e-6) / max(1 - p, 1e-6)) / 4)
            assert got[r["doc_id"]][f"p_{category}"] == pytest.approx(p, abs=1e-4)
        assert got[r["doc_id"]]["flag"] == (p >= chain.thresholds[-1]) or abs(p - chain.thresholds[-1]) < 1e-4


def test_thresholds_and_calibration():
    p, y = np.array([0.9, 0.8, 0.4, 0.2, 0.1]), np.array([1, 1, 0, 0, 0.0])
    assert 0.4 < linear.best_threshold(p, y) < 0.8
    assert linear.best_threshold(p, np.zeros(5)) > 1
    slope, offset = linear.platt(np.array([2.0, 1, -1, -2] * 20), np.array([1.0, 1, 0, 0] * 20))
    assert slope > 0 and abs(offset) < 0.5


def test_the_metadata_view_sees_no_words():
    a = quality.metadata_view("aaa bbb\nccc", "s", "en", 11.0)
    assert (a == quality.metadata_view("xxx yyy\nzzz", "s", "en", 11.0)).all()
