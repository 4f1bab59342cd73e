"""Every query of the library that has SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandweave.functions import sequence as S
from strandweave.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    d = duckdb.connect()
    for f in os.listdir(SF):
        d.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return d


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "fragment", "start", "end", "length", "left_enzymes", "right_enzymes", "left_end", "right_end", "left_type", "right_type"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, db, name, tmp_path):
    df = catalog.QUERIES[name](spark, SF)
    df.write.parquet(str(tmp_path / "out"))
    sql = db.sql(catalog.ORACLE[name])
    assert sorted(df.columns) == sorted(sql.columns)
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    db.sql(f"CREATE OR REPLACE TABLE a AS SELECT {cols} FROM '{tmp_path}/out/*.parquet'")
    db.sql(f"CREATE OR REPLACE TABLE b AS SELECT {cols} FROM ({catalog.ORACLE[name]})")
    assert db.sql("SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)), (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a))").fetchall() == [(0, 0)]
    assert db.sql("SELECT count(*) FROM a").fetchall()[0][0] > 0


def differences(spark, tmp_path, name, texts):
    """How many rows of the query and of its SQL over these documents (doc_id, text) the other does not have."""
    d = str(tmp_path / "docs")
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    catalog.QUERIES[name](spark, d).write.parquet(f"{d}/out")
    own = duckdb.connect()
    own.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    own.sql(f"CREATE TABLE a AS SELECT * FROM '{d}/out/*.parquet'")
    cols = ", ".join(f'"{c}"' for c in own.table("a").columns)
    own.sql(f"CREATE TABLE b AS SELECT {cols} FROM ({catalog.ORACLE[name]})")
    return own.sql("SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)), (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a))").fetchall()[0]


def test_alignments_of_many_rows_and_an_empty_one(spark, tmp_path):
    assert differences(spark, tmp_path, "alignment_issues", [(40 * i, "some text") for i in range(102)] + [(33, "12"), (73, "words")]) == (0, 0)


def test_recipe_that_cuts_at_the_very_end(spark, tmp_path):
    letters = {b: S.LETTERS[S.CYCLE.index(b)] for b in "ACGT"}
    texts = ["AAAAAGAGACCAAAA", "AAAAAAGAGACCAAAA", "GGTCTCAAAAA", "GAATTC", ""]
    assert differences(spark, tmp_path, "digest_recipes", [(i, "".join(letters[b] for b in t)) for i, t in enumerate(texts)]) == (0, 0)


def test_words_with_a_line_break(spark, tmp_path):
    assert differences(spark, tmp_path, "recognition_texts", [(0, "GA\nTTC GATTC A\tC\n AC12 \n x\r\ny")]) == (0, 0)


@pytest.mark.parametrize("name", ["overview_bins", "site_density_bins"])
def test_bins_read_texts_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
