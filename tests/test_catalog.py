"""A sample of the catalog against its SQL, and that every query has a schema."""

import os
import re

import pytest

from fathom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["flagship_term_facet", "p_range", "p_mm", "f_hier", "st_multi", "sc_bm25", "cursor", "v_knn", "t_terms", "store_upsert"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")

    def plain(rows):
        return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)

    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert plain(got.select(*cols).collect()) == plain([[r[i] for i in at] for r in want.fetchall()])


#: Queries whose answer is no rows, by design.
EMPTY = {"f_empty", "f_maxhits"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_answers_are_not_empty():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    none = {n for n, q in ORACLES.items() if not n.startswith("a_shingle") and not con.sql(f"select * from ({q}) limit 1").fetchall()}
    assert none == EMPTY


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150


def test_fragments_of_all_documents(spark, tmp_path):
    rows = [(i, f"{'the' if i % 3 else 'Of'} start {i}" if i % 4 else "nothing here", ("en", "de", None)[i % 3], "s", 10) for i in range(90)] + [(90, None, "fr", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: [x] if (x := re.sub(r"(?i)\b(the|of)\b", r"<em>\1</em>", text or "")) != (text or "") else [] for i, text, *_ in rows}
    assert {r.doc_id: r.fragments for r in QUERIES["h_fragments"](spark, str(tmp_path)).collect()} == want


def test_terms_are_marked_beyond_a_page(spark, tmp_path):
    cols = ("id as doc_id", "if(id % 2 = 0, 'a The', 'the b') as text", "'en' as lang", "'s' as source", "10L as n_chars")
    spark.range(100_010).selectExpr(*cols).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["h_terms"](spark, str(tmp_path))
    assert got.count() == got.where("marked").select("doc_id").distinct().count() == 100_010
