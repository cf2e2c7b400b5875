"""Every query against its SQL on the small tables."""

import math

import duckdb
import pytest

from millrace import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sql, name):
    got = queries.queries()[name](spark, SF)
    want = sql.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_question_set_properties(spark):
    rows = queries.queries()["question_set"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r["position"], []).append(r)
    assert sorted(by) == list(range(1, 21))
    assert all(len({r["name"] for r in options}) == len(options) == 4 for options in by.values())
    assert all(sorted(r["letter"] for r in options) == list("ABCD") for options in by.values())


def test_names_are_found_in_every_language(spark, tmp_path):
    docs = [
        (1, "An under-Standing of it\nand more", "en"), (2, "ein Verständnis, Understandings!", "de"), (3, "understandin g\nconsequence", "fr"), (4, "understan\nding", "es"),
        (5, "understanding\nnothing\nUNDER STANDING", None), (6, "", "fr"), (7, None, "es"), (8, "consequences", "de"),
    ]
    items = [(1, "of understanding"), (2, "a consequence here"), (3, "short"), (4, None), (5, "understandably")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = {i: n for i, n in ((1, "understanding"), (2, "consequence"), (5, "understandably"))}
    want = {}
    for doc_id, text, _ in docs:
        lines = ["".join(c for c in line.lower() if c.isalnum()) for line in (text or "").split("\n")]
        found = [i for i, n in names.items() if any(n in line for line in lines)]
        if len(found) == 1:
            want[doc_id] = found[0]
    assert sorted(want) == [1, 2, 5, 8]
    assert {r["doc_id"]: r["item_id"] for r in queries.queries()["named_lines_all"](spark, str(tmp_path)).collect()} == want
