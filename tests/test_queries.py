"""Every query against its SQL on the smallest tables."""

import hashlib

import duckdb
import pandas as pd
import pytest

from folioforge.plans import documents, navigation, registry, relational, resources, views  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "NULL" if not isinstance(v, list) and pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(registry.QUERIES) >= 70


def test_inversion_covers_all_bytes(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from folioforge.functions import codecs

    # an inversion that goes wrong for bytes above 127 must show
    monkeypatch.setattr(codecs, "bytes_udf", lambda f: lambda c: F.unhex(F.regexp_replace(F.hex(c), "C3BC", "C3BD")))
    spark.createDataFrame([(1, "plain"), (2, "gr\u00fcn")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.digest, r.bytes) for r in resources.image_bits_invert(spark, str(tmp_path)).collect()}
    right = {k: hashlib.md5(t.encode()).hexdigest() for k, t in ((1, "plain"), (2, "gr\u00fcn"))}
    assert got[1] == (right[1], 5) and got[2][0] != right[2] and got[2][1] == 5


def test_streamed_files(spark, tmp_path):
    from folioforge.sources import files, writer
    from folioforge.streaming.arrivals import arriving

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(writer.flat_document([writer.text_content(["x"])]))
    (tmp_path / "in/b.pdf").write_bytes(b"%PDF-broken")
    seen = files.nodes(arriving(spark, str(tmp_path / "in")))
    run = seen.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.sql("SELECT count_if(error_code IS NULL) AS good, count_if(error_code IS NOT NULL) AS bad FROM seen").first()
    assert got.good > 10 and got.bad == 1


def test_files_spread_over_cores(spark):
    from folioforge.sources import files

    for made in (views.full_files(spark, SF), resources.page_files(spark, SF), documents._files(spark, SF)):
        assert made.rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert files.facts(made).where("error_code IS NULL").count() == made.files.count()


def test_small_files_spread_over_cores(spark, tmp_path):
    from folioforge.sources import files

    cores = spark.sparkContext.defaultParallelism
    spark.read.parquet(f"{SF}/supplier.parquet").repartition(cores + 1).write.parquet(str(tmp_path / "supplier.parquet"))
    rows = registry.table(spark, str(tmp_path), "supplier")
    assert len(rows.inputFiles()) > cores > rows.rdd.getNumPartitions()
    assert files.spread(rows).rdd.getNumPartitions() >= cores
    assert files.spread(rows).count() == rows.count()


def test_uneven_files_are_dealt_evenly(spark, tmp_path):
    cores, at = spark.sparkContext.defaultParallelism, tmp_path / "supplier.parquet"
    many = spark.range(4000).selectExpr("id AS s_suppkey", "concat('Supplier#', id) AS s_name")
    many.coalesce(1).write.parquet(str(at))
    for i in range(4 * cores):  # a part holds several of these, and one the large file
        many.where(f"s_suppkey = {i}").selectExpr(f"s_suppkey + {4000 + i} AS s_suppkey", "s_name").coalesce(1).write.mode("append").parquet(str(at))
    for made in (views.full_files(spark, str(tmp_path)), resources.page_files(spark, str(tmp_path))):
        held = made.rows.rdd.glom().map(len).collect()
        assert sum(held) == 4000 + 4 * cores and max(held) < 2 * sum(held) / cores


def test_graph_equal_joins_nothing(spark):
    plan = resources.graph_equal(spark, SF)._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.count("MapInArrow") >= 1 and "MapInPandas" not in plan


def test_inversion_of_an_empty_text(spark, tmp_path):
    spark.createDataFrame([(1, ""), (2, None), (3, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(resources.image_bits_invert(spark, str(tmp_path)).toPandas()) == rows(con.execute(registry.ORACLES["image_bits_invert"]).df())


def test_update_catalog_makes_each_file_once(spark):
    plan = resources.update_catalog(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("name, steps", [("doc_rebuild", 2), ("doc_roundtrip_text", 2), ("doc_xref_revisions", 1), ("fdf_fields", 1)])
def test_files_stay_in_one_worker(spark, name, steps):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == steps and "MapInPandas" not in plan


def test_files_are_made_one_at_a_time(spark):
    import pyarrow as pa

    from folioforge.sources import writer

    made, calls = writer.built(spark.range(1), lambda k: calls.append(k) or b"x"), []
    rows = made.make(pa.RecordBatch.from_pydict({"k": list(range(10_000))}))
    assert next(rows) == ("0", b"x", None) and calls == [0]
