"""The five stages on a small corpus, and the queries that have SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatt.llm.queries import QUERIES, SQL
from tidewatt.llm.shared import stage

from .corpus import documents, prose, texts

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    item = prose(1000, 30)
    rows = [(i, prose(i, 80) + "\nA line that all of them have\n" + prose(50 + i, 30)) for i in range(60)]
    rows += [(100, rows[7][1]), (101, rows[8][1].replace(" ", "  ", 3) + " more"), (102, prose(77, 50) + " " + item), (103, " ".join(w + "%%%" for w in prose(9, 70).split()))]
    junk = [(200 + i, " ".join(w + "%%%" for w in prose(900 + i, 70).split())) for i in range(40)]
    docs = documents(spark, rows + junk).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows[:60] + junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        out = stage(function(spark, docs, str(tmp_path)), "test")
        kept[name] = {r.doc_id: r for r in out.collect()}
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    ids = {name: set(rows) for name, rows in kept.items()}
    assert ids["quality classifier"] == set(range(60)) | {100, 101, 102}
    assert kept["line dedup"][0].text == rows[0][1] and all("A line that all" not in kept["line dedup"][i].text for i in range(1, 60))
    assert all(r.n_chars == len(r.text) for r in kept["line dedup"].values())
    assert ids["SimHash near-dedup"] >= set(range(60)) | {102} and ids["benchmark decontamination"] == ids["SimHash near-dedup"] - {102}
    assert ids["packing"] == ids["benchmark decontamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids["packing"]


def test_stages_take_any_rows_and_names(spark, tmp_path):
    """Null, empty and very long texts, repeated rows, null ids, and columns that are named like results."""
    rows = texts()
    docs = documents(spark, rows).withColumns({"n_dropped": F.lit("d"), "part": F.lit("p"), "own_n_lines": F.lit("o"), "leaks_1": F.lit("x")})
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(1000, 30)), (2, None), (None, "x y z"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), str(tmp_path)).count() == 0 or name == "packing"
        out = function(spark, docs, str(tmp_path))
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {i for i, _ in rows}
            continue
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all((r.score, r.n_lines, r.rest, r.leaks, r.n_dropped, r.part, r.own_n_lines, r.leaks_1) == ("s", "l", "r", "k", "d", "p", "o", "x") for r in found)
        if name in ("line dedup", "benchmark decontamination"):
            assert len(found) == len(rows)


def test_one_row_of_each_group_stays(spark):
    near = prose(7, 80).split()
    rows = [(None, prose(i, 80)) for i in range(5)]  # groups of their own, without ids
    rows += [(2, prose(7, 80)), (9, " ".join([*near[:79], "changed"])), (9, prose(8, 80)), (3, prose(7, 80)), (None, prose(8, 80)), (4, "a b"), (4, "a b")]
    want = sorted([t for i, t in rows[:5]] + [prose(7, 80), prose(8, 80), "a b"])
    for parts in (1, 7):
        docs = documents(spark, rows).repartition(parts)
        out = corpus_pipeline.near_duplicate(spark, docs, "")
        assert out.columns == docs.columns
        kept = out.collect()
        assert sorted(r.text for r in kept) == want
        assert {r.text: r.doc_id for r in kept if r.doc_id} == {prose(7, 80): 2, prose(8, 80): 9, "a b": 4}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in os.listdir(FOLDER):
        duck.execute(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{FOLDER}/{table}'")
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(str, (r[c] for c in names))) for r in df.collect()) == sorted(tuple(map(str, r)) for r in result.fetchall())
