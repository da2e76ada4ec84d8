"""Each stage of the pipeline, on what the stage before kept, against brute force or SQL."""

import os
import re

import pytest

import corpus_pipeline
from fathom.llm import decontamination, mixing, quality
from fathom.llm.common import table

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and comes out of it, as tables."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def sql(stage, query):
    import duckdb

    con = duckdb.connect()
    con.register("documents", stage[0].toArrow())
    con.sql(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    return con.sql(query)


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert all(after.columns == list(corpus_pipeline.DOCUMENTS) for _, after in stages[:-1])


def test_rejected_documents_go(spark, stages):
    before, after = stages[0]
    scored = quality.score_quality(before, quality.fit(before, table(spark, SF, "labels")))
    assert {r.doc_id for r in scored.where("score >= 0.3").collect()} == set(rows(after))
    assert 0.5 * before.count() < after.count() < before.count()


def test_repeated_runs_of_lines_go(stages):
    before, after = map(rows, stages[1])
    first, kept = {}, {}
    lines = {i: (before[i].text or "").split("\n") if before[i].text else [] for i in sorted(before)}
    real = {i: [j for j, y in enumerate(ls) if WORDS.search(y)] for i, ls in lines.items()}
    for i, ls in lines.items():
        for k in range(len(real[i]) - 1):
            first.setdefault((ls[real[i][k]], ls[real[i][k + 1]]), (i, k))
    for i, ls in lines.items():
        gone = {j for k in range(len(real[i]) - 1) if first[ls[real[i][k]], ls[real[i][k + 1]]] != (i, k) for j in real[i][k : k + 2]}
        if not gone or len(gone) < len(real[i]):
            kept[i] = "\n".join(y for j, y in enumerate(ls) if j not in gone)
    assert {i: r.text or "" for i, r in after.items()} == kept and len(kept) < len(before)


def test_one_of_each_group_stays(stages):
    before, after = map(rows, stages[2])
    sets = {}
    for i, r in before.items():
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert set(after) == {i for i in ids if top(i) == i}


def test_leaks_go(stages):
    before, after = map(rows, stages[3])
    leaked = {r[0] for r in sql(stages[3], f"select doc_id from ({decontamination.ORACLE}) where contaminated").fetchall()}
    assert set(after) == set(before) - leaked


def test_the_mix(stages):
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in stages[4][1].collect())
    want = sql(stages[4], f"select doc_id, size, source_size, round(target, 6), taken from ({mixing.ORACLE})").fetchall()
    assert got == sorted(want) and sum(r[4] for r in got) > 0


def test_run_reads_what_each_stage_wrote(spark, tmp_path, monkeypatch):
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(docs.inputFiles())
        return docs.selectExpr("doc_id + 1 as doc_id")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage), ("three", stage)])
    spark.range(5).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [3, 4, 5, 6, 7]
    assert all("/documents.parquet/" in f for f in seen[0]) and seen[0]
    assert all(files and all(f"/{name}/" in f for f in files) for name, files in zip(("one", "two"), seen[1:], strict=True))
