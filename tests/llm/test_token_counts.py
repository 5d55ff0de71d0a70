import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tempo.llm import queries, token_counts

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")]
TEXTS = [None, "", " ", "a<|endoftext|>b", "<|startoftext|>A  b", "<s> x </s>", "Don't  STOP", "don't stop", "日本語 é\x00", "x" * 40_000, "word " * 600, "tab\t\r\n", "<|endoftext|", "A B", "a b"]


def expected(path, text):
    if path.endswith(".model"):
        return len(SentencePieceProcessor(model_file=path).encode(text or ""))
    return len(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)


@pytest.fixture
def docs(spark):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, TEXTS[3]), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit(1), "n_tokens": F.lit("x")})


@pytest.mark.parametrize("path", PATHS)
def test_matches_the_library(docs, tmp_path, path):
    got = token_counts.token_counts(docs, path, str(tmp_path)).collect()
    assert len(got) == docs.count()
    text = dict(enumerate(TEXTS)) | {None: TEXTS[3]}
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_tokens) == (len((text[r.doc_id] or "").encode()), expected(path, text[r.doc_id])), text[r.doc_id]
            assert r.over_limit == (r.n_tokens > 512)
    assert sorted(r.n_tokens for r in got if r.doc_id is None) == sorted((0 if path.endswith("json") and not expected(path, "") else expected(path, ""), expected(path, TEXTS[3])))


def test_only_distinct_misses_are_encoded(spark, tmp_path, monkeypatch):
    """A second table adds its new contents only; another tokenizer shares nothing; equal normalised contents meet."""
    cache, byte, word = str(tmp_path / "cache"), PATHS[0], PATHS[1]
    encoded = []
    real = token_counts.encode_misses
    monkeypatch.setattr(token_counts, "encode_misses", lambda rows, path: encoded.append(rows.count()) or real(rows, path))
    first = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    more = spark.createDataFrame([(4, "c"), (5, "d"), (6, None)], "doc_id long, text string")
    token_counts.token_counts(first, byte, cache)
    token_counts.token_counts(more, byte, cache)
    token_counts.token_counts(more, byte, cache)
    token_counts.token_counts(first, word, cache)
    token_counts.token_counts(spark.createDataFrame([(7, "A   B"), (8, "C")], "doc_id long, text string"), word, cache)
    assert encoded == [2, 2, 0, 2, 0]
    version = token_counts.tokenizer_version(byte)
    assert token_counts.stored_counts(spark, cache, version).count() == 4


def test_repeated_appends_do_not_multiply_rows(spark, tmp_path):
    cache, path = str(tmp_path), PATHS[0]
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    found = token_counts.token_counts(docs, path, cache)
    held = f"{cache}/version={token_counts.tokenizer_version(path)}"
    spark.read.schema(token_counts.CACHE).option("recursiveFileLookup", "true").parquet(held).write.parquet(f"{held}/run-again")
    assert found.count() == token_counts.token_counts(docs, path, cache).count() == 1


def test_empty_tables(empty, tmp_path):
    assert token_counts.token_counts(empty, cache=str(tmp_path)).count() == 0


def test_whole_table(spark, sf):
    library = Tokenizer.from_file(PATHS[0])
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.queries()["op12_token_counts"](spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {i: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in docs.items()}
