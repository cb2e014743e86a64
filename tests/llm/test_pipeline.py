import corpus_pipeline
from quadrille.llm import line_dedup, near_dedup, packing, quality_rules, secret_scan
from quadrille.llm.queries import WORD_BPE

SF = "/root/testdata/sf0.001"


def test_stages_are_the_operators_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "secret scans", "packing"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i == 0:
            kept = {r.doc_id for r in quality_rules.assess(before).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if i == 1:
            want = {r.doc_id: r.text for r in line_dedup.dedup_lines(before).collect()}
            assert {r.doc_id: r.text for r in docs.collect()} == want and len(want) == before.count()
        if i == 2:
            assert {r.doc_id for r in docs.collect()} == {r.class_id for r in near_dedup.classes(before).collect()}
        if i == 3:
            assert docs.count() == before.count()
            assert secret_scan.scan(docs).where("spans <> ''").count() == 0
        if i < 4:
            assert docs.columns == columns
        else:
            got = docs.groupBy("doc_id").sum("length").count()
            assert got == before.select("doc_id").distinct().count()
            assert docs.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]
    assert WORD_BPE.endswith("word_bpe_49k.json")


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_and_an_empty_table(spark, odd, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names go through; so does an empty table."""
    for name, docs in (("odd", odd.selectExpr("*", "1 AS `a.b`", "2 AS _row")), ("none", odd.limit(0))):
        columns = docs.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
            assert i == 4 or docs.columns == columns
        assert docs.count() == 0 if name == "none" else docs.count() > 0
