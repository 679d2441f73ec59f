import random

import pytest

from lattice.llm import bpe, pretokens, token_counts

SCHEMA = "doc_id bigint, text string"
TEXTS = [
    "Hello, world! It's 2024 -- don't panic.", "", None, "   ", "a\n\n  b\t\tc \n", "naïve café — ÄÖÜ ß 你好 мир 🙂👍🏽", "x" * 3000, "<|endoftext|> is text here", "  wide spaces\u0085next", "tail space ", "\x00nul\x07bell", "'S 'll 're IT'S",
    "repeated repeated repeated", "repeated repeated repeated",
]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("check", pat_str=pretokens.PATTERN, mergeable_ranks=pretokens.load_ranks(), special_tokens={})


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def test_ids_and_round_trip(spark, reference):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abc é\n\t'1,😀 ") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    out = {r.doc_id: r for r in bpe.decode(bpe.encode(rows(spark, texts))).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        if t is None:
            assert out[i].ids is None and out[i].text is None and out[i].n_tokens == 0
        else:
            assert out[i].ids == reference.encode_ordinary(t), t
            assert out[i].text == t and out[i].n_tokens == len(out[i].ids)


def test_counts(spark, reference):
    out = {r.doc_id: r for r in token_counts.token_counts(rows(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        assert out[i].n_tokens == (len(reference.encode_ordinary(t)) if t else 0)
        assert (out[i].n_pretokens == 0) == (not t)


def test_small_chunks_give_the_same(spark, reference, monkeypatch):
    monkeypatch.setattr(pretokens, "CHUNK_BYTES", 50)
    out = {r.doc_id: r.ids for r in bpe.encode(rows(spark, TEXTS)).collect()}
    assert all(out[i] == (None if t is None else reference.encode_ordinary(t)) for i, t in enumerate(TEXTS))


def test_repeats_null_ids_clashes_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], SCHEMA).selectExpr("*", "1 as chunk", "2 as ids", "'z' as words", "3 as size")
    out = sorted((str(r.doc_id), str(r.ids)) for r in bpe.encode(df).collect())
    assert len(out) == 4 and out[0] == out[1]
    assert token_counts.token_counts(df).count() == 4
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).count() == 0
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_decode_of_foreign_ids(spark):
    df = spark.createDataFrame([(1, [10**6, -1, None]), (2, [0, 1]), (3, [])], "doc_id bigint, ids array<int>")
    out = {r.doc_id: r.text for r in bpe.decode(df).collect()}
    assert out == {1: "", 2: '!"', 3: ""}


def test_decode_replaces_a_text_column(spark):
    df = spark.createDataFrame([(1, [0, 1], "old")], "doc_id bigint, ids array<int>, text string")
    out = bpe.decode(df)
    assert out.columns == ["doc_id", "ids", "text"] and out.first().text == '!"'


def test_very_long_text(spark, reference):
    text = "lorem ipsum dolor " * 40_000
    out = bpe.decode(bpe.encode(rows(spark, [text]))).first()
    assert out.text == text and out.ids == reference.encode_ordinary(text)


def test_shuffled_input_is_written_first(spark, reference):
    from lattice.llm._shared import repeatable

    df = rows(spark, TEXTS * 3).repartition(3)
    assert "Exchange" not in repeatable(df, "texts")._jdf.queryExecution().executedPlan().toString()
    scan = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert repeatable(scan.where("doc_id > 3").select("doc_id", "text"), "texts").inputFiles() == scan.inputFiles()
    out = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert all(out[i] == (None if t is None else reference.encode_ordinary(t)) for i, t in enumerate(TEXTS * 3))


def test_more_buckets_than_partitions(spark, reference, monkeypatch):
    monkeypatch.setattr(pretokens, "BUCKET_BYTES", 40)
    monkeypatch.setattr(pretokens, "PART_BYTES", 100)
    out = {r.doc_id: r.n_tokens for r in token_counts.token_counts(rows(spark, TEXTS)).collect()}
    assert all(out[i] == len(reference.encode_ordinary(t or "")) for i, t in enumerate(TEXTS))
