import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    order = sorted(got.columns)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == order
    rows = [tuple(r[c] for c in order) for r in got.collect()]
    place = [want.columns.index(c) for c in order]
    assert sorted(map(str, rows)) == sorted(str(tuple(r[k] for k in place)) for r in want.fetchall())


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 11))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]

    def insulting(rows):
        return sum(any(w in (r["text"] or "").lower().split() for w in ("idiot", "moron", "scum")) for r in rows.collect())

    before = insulting(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert all(a > b for a, b in zip(counts, counts[1:]))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    left = {(r["text"] or "").translate(str.maketrans("", "", " \t\n\x0b\x0c\r")) for r in docs.collect()}
    assert len(left) == counts[-1]
    assert insulting(docs) <= 0.1 * before


def test_the_pipeline_runs_on_no_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_stage_handles_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """Nulls, empty and long texts, ties, repeats, clashing columns and no rows, stage by stage."""
    docs = odd_docs.withColumns({c: F.lit(c) for c in ("own_id", "own_hash", "stays", "told_id", "told_hash", "own", "maybe", "kept", "component_id", "views")})
    given = [(1, 1, 0), (2, 1, 0), (3, None, None), (None, 0, 1), (7, 1, 0)]
    spark.createDataFrame(given, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        left = out.collect()
        assert {tuple(map(str, r)) for r in left} <= {tuple(map(str, r)) for r in docs.collect()}, name
        assert len(left) == {"quality": rows, "toxicity": rows}.get(name, len(left)), name
    exact = stages["exact_dedup"](spark, docs, str(tmp_path)).collect()
    texts = [(r["text"] or "").translate(str.maketrans("", "", " \t\n\x0b\x0c\r")) for r in docs.collect()]
    assert len(exact) == len(set(texts)) and sum(r["doc_id"] == 10 for r in exact) == 1
    near = {str(r["doc_id"]) for r in stages["near_dedup"](spark, docs, str(tmp_path)).collect()}
    assert {"4", "5", "6", "None"} <= near and "8" not in near and len(near & {"1", "2", "3"}) == 1
    pieces = stages["packing"](spark, docs, str(tmp_path))
    assert pieces.where("start = 0").count() == rows and stages["packing"](spark, no_docs, str(tmp_path)).count() == 0
