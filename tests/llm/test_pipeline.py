import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_columns(spark):
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    assert 0 < docs.select("doc_id").distinct().count() <= before


def test_run_keeps_texts_whole(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = pipeline.run(spark, SF).collect()
    assert out and all(texts[r.doc_id] == r.text and len(r.ids) == r.n_tokens for r in out)


def test_clean_documents_stay_in_the_filter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in pipeline.STAGES[0][1](spark, docs, SF).select("doc_id").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(clean - kept) <= 0.02 * len(clean)


def test_odd_rows_pass_all_stages(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "the and of in", "en", "src0", 3), (10**9, None, None, None, None), (10**9 + 1, "", "en", "src1", 0), (10**9 + 2, "and the of was " * 20_000, "en", None, 1)], base.schema)
    docs = base.unionByName(odd).unionByName(base.limit(5))
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert not {10**9, 10**9 + 1} & set(kept["quality"])  # null and empty texts are rejected
    named = [i for i in kept["near_dedup"] if i is not None]
    assert len(named) == len(set(named)) and set(named) <= set(kept["quality"])
    assert kept["near_dedup"].count(None) == kept["quality"].count(None)
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) and sorted(map(str, kept["bpe"])) == sorted(map(str, kept["mixing"]))


def test_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0 and (name == "bpe" or docs.columns == columns), name


def test_clashing_columns_change_no_decision(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    extra = plain.selectExpr("*", "1 as group_id", "'k' as keys", "2 as repeated_id", "'p' as pattern", "3 as draw", "4 as label_id", "5 as quality", "6 as head", "7 as tokens", "8 as cell")
    for name, stage in pipeline.STAGES[:-1]:
        one, other = stage(spark, plain, SF), stage(spark, extra, SF)
        assert other.columns == extra.columns, name
        assert sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted(r.doc_id for r in other.select("doc_id").collect()), name
    coded = pipeline.STAGES[-1][1](spark, extra.selectExpr("*", "9 as ids", "10 as n_tokens", "11 as chunk"), SF)
    assert coded.columns == ["doc_id", "ids", "n_tokens", "text"] and coded.count() == plain.count()
