import os

import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    rows = got.collect()
    assert rows
    if name not in catalog.oracle_sql():
        return
    order = sorted(got.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == order
    place = [want.columns.index(c) for c in order]
    assert sorted(str([_plain(r[c]) for c in order]) for r in rows) == sorted(str([_plain(r[k]) for k in place]) for r in want.fetchall())


def _plain(x):
    return round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x


def test_entry_and_guard(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("broken", [None, "raise RuntimeError('broken')", "import lacking_module"])
def test_the_engine_does_not_need_the_corpus_operators(tmp_path, broken):
    """A copy without them, or with broken ones, registers the engine's queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if broken:
        (tmp_path / "tessera" / "llm").mkdir()
        (tmp_path / "tessera" / "llm" / "__init__.py").write_text("")
        (tmp_path / "tessera" / "llm" / "queries.py").write_text(broken)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))]
    assert ("can't be imported" in done.stderr) == bool(broken)


def test_no_query_of_the_engine_lacks_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_plans_of_byte_queries(spark):
    """What an encoder yields is made once, and listings and bests take one shuffle."""
    tables = {"list_concatenated_files": 1, "sequence_lengths": 1, "list_mixed_files": 1}
    for name, nodes in tables.items():
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == nodes, (name, plan)
    plan = catalog.queries()["best_configuration"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan parquet") == 1
    plan = catalog.queries()["device_split"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


def test_byte_queries_bound_what_goes_to_python(spark):
    """Rows and bytes of a batch are bounded before any query runs, unless the session has bounds of its own."""
    from tessera.plans import spread

    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    held = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.unset(k)
        catalog.queries()["strategies_by_size"](spark, SF)
        assert [int(spark.conf.get(k)) for k in keys] == [spread.BATCH_ROWS, spread.BATCH_BYTES]
        spark.conf.set(keys[0], "7")
        catalog.queries()["strategies_by_size"](spark, SF)
        assert spark.conf.get(keys[0]) == "7"
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["custom_block_frames", "levels_and_partial_decoding", "level_roundtrips", "strategies_by_size"])
def test_encoders_run_once(spark, name):
    """Two evaluations, what encodes and what decodes: in one, or twice, the encoder would run for each expression that uses its column."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "Join" not in plan, plan


def test_level_roundtrips_have_every_parse():
    """Levels up to 9 have no optimal parse."""
    from tessera.kernels import block

    assert {block.tries_of(k)[0] for k in catalog.PARSES} == {"fast", "mid", "overlapping", "optimal"}


def test_blocks_are_not_dealt_by_number_alone(spark):
    plan = catalog.queries()["blocks_in_order"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block_no" not in plan and "hashpartitioning(doc_id" in plan
