"""Every registered query of the engine against its SQL in an independent engine."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from siftline import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, sf_dir, sql, name):
    df = engine.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*columns).collect())
    if name not in engine.ORACLE_SQL:
        assert got
        return
    result = sql.execute(engine.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())
    assert got == want


def test_every_row_takes_part(spark, sf_dir):
    n = engine.table(spark, sf_dir, "documents").count()
    assert engine.QUERIES["training_prompts"](spark, sf_dir).filter("plain is not null").count() == n
    assert engine.QUERIES["deep_merge"](spark, sf_dir).count() == 2 * n


def test_containment_of_every_document_and_item(spark, tmp_path):
    docs = [(None, "No id"), (-3, "has Item C "), (0, "a"), (1, None), (210, "x item a")]
    items = [(100, "item a"), (7, "item b"), (300, "item c"), (301, "alone"), (302, "last")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((tuple(r) for r in engine.QUERIES["containment_match"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(None, 0, False), (-3, 2, True), (0, 0, False), (1, 1, False), (210, 0, False), (None, 3, False), (None, 4, False)], key=repr)
    own = duckdb.connect()
    for t in ("documents", "benchmark"):
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(own.execute(engine.ORACLE_SQL["containment_match"]).fetchall(), key=repr) == got


def test_posteriors_count_every_event_once(spark, sf_dir):
    events, members = engine.events(spark, sf_dir), engine.members(spark, sf_dir)
    weight = engine._posteriors(spark, sf_dir).selectExpr("sum(alpha + beta - 2)").first()[0]
    assert weight == pytest.approx(events.count())
    weight = engine.QUERIES["posterior_update"](spark, sf_dir).selectExpr("sum(alpha + beta - 2)").first()[0]
    assert weight == pytest.approx(events.join(members, "id").count(), abs=1e-4)


def test_vectors_and_states_are_returned(spark, sf_dir):
    assert engine.QUERIES["hash_embedding"](spark, sf_dir).select("embedding").distinct().count() > 1
    assert engine.QUERIES["pca_reduced"](spark, sf_dir).select("v").distinct().count() > 1
    batch = engine.QUERIES["retirement_streak"](spark, sf_dir).groupBy("id").agg(F.max("retired").alias("retired"))
    states = engine.QUERIES["stream_retirement"](spark, sf_dir)
    assert sorted(states.select("id", "retired").collect()) == sorted(batch.collect())


def test_csv_round_trip_of_quotes_and_lines(spark, tmp_path):
    rows = [(1, "u", 'a "quote", a comma\nand a line'), (2, "v", ' <p class="x">\\</p>\r\n ')]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(tuple(r) for r in engine.QUERIES["csv_round_trip"](spark, str(tmp_path)).collect()) == rows


def test_unit_vectors_keep_the_sign_of_zero(spark, tmp_path):
    rows = [(0, [1.0, -3e-7, 3e-7, -0.0], 0), (1, [0.0, -0.0, 0.0, 0.0], 1), (2, [0.6, -0.8, 0.0078125, -1e-20], None), (3, None, 2), (4, [], 3), (5, [-1e-13, 1e30, -1e30, 5e-7], 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = own.execute(engine.ORACLE_SQL["l2_normalise"]).fetchall()
    got = [tuple(r) for r in engine.QUERIES["l2_normalise"](spark, str(tmp_path)).select("id", "unit").collect()]
    assert "-0.0" in repr(want) and sorted(map(repr, got)) == sorted(map(repr, want))
