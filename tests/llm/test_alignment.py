import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tempo.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  two  spaces ", "a\n b\n\n c \n d", "<|endoftext|> <s> </s> <0x41>", "▁ literal", "日本語 テスト é ñ", "tab\tand\r\nreturn\x00nul", "x" * 7000, "ab" * 4000 + " end", "👩‍👩‍👧 emoji ok",
    "don't WE'LL it's 12345 ½", "the the the cat the cat", "the the the cat the cat", "한국어 " * 30, "          ", "a b", " x  y z", "naïve façade " * 20,
]


@pytest.fixture(scope="module")
def brute():
    """The contract token by token; every linked pair of every text is held in a Python counter."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(x): x for x in kept} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in kept)}

    def run(rows):
        one, documents = [], Counter()
        for doc_id, text in rows:
            links, groups = Counter(), []
            ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
            bytes_a = [bytes(char[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if not (text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()):
                one.append((doc_id, 0, 0, 0, 0, "", links))
                continue
            end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
            i = j = 0
            for stop in sorted(set(end_a) & set(end_b)):
                to_i, to_j = end_a.index(stop, i) + 1, end_b.index(stop, j) + 1
                groups.append((ids_a[i:to_i], ids_b[j:to_j]))
                i, j = to_i, to_j
            for x, y in groups:
                links.update((p, q) for p in x for q in y)
            documents.update(links.keys())
            said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            one.append((doc_id, len(ids_a), len(ids_b), len(groups), sum(links.values()), hashlib.sha256(said.encode()).hexdigest(), links))
        most = defaultdict(int)
        for (x, _), n in documents.items():
            most[x] = max(most[x], n)
        return sorted(((d, *c, sum(n for (x, y), n in links.items() if documents[x, y] == most[x]), sum(n * documents[p] for p, n in links.items()), said) for d, *c, said, links in one), key=repr)

    return run


def rows_of(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=repr)


def test_matches_brute_force_on_odd_texts(spark, brute):
    rows = [*enumerate(TEXTS), (3, TEXTS[13]), (None, TEXTS[13]), (None, None)]
    assert rows_of(alignment.alignment_digests(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_matches_brute_force_on_a_whole_table(spark, sf, brute):
    found = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(queries.queries()["op13_alignment"](spark, sf)) == brute([(r.doc_id, r.text) for r in found])


def test_extra_columns_and_empty_tables(awkward, empty, brute):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert rows_of(alignment.alignment_digests(awkward)) == brute(rows)
    assert alignment.alignment_digests(empty).count() == 0


def test_blocks_and_planes_give_back_what_went_in():
    """Lists, bitmaps and planes of any multiplicity survive, and pieces of a block are merged."""
    rng = np.random.default_rng(1)
    pair = np.repeat([5, 5, 9, 1 << 40], [6000, 3, 70, 4096])
    block = np.repeat([0, 1, 0, 7], [6000, 3, 70, 4096])
    doc = np.concatenate([np.sort(rng.choice(65536, n, replace=False)) for n in (6000, 3, 70, 4096)])
    links = rng.integers(1, 40, len(pair))
    batch = pa.record_batch(alignment.posting_batch(pair, block, doc, links))
    row, blocks, docs, times = alignment.posting_rows(batch)
    assert (batch["pair"].to_numpy()[row] == pair).all() and (blocks == block).all() and (docs == doc).all() and (times == links).all()
    assert batch["docs"][0].as_buffer().size == 8192 and batch["docs"][1].as_buffer().size == 6
    cut = batch.slice(1, 2)
    assert (alignment.posting_rows(cut)[2] == doc[6000:6073]).all() and (alignment.posting_rows(cut)[3] == links[6000:6073]).all()


def test_pieces_of_a_block_are_merged_and_counted(spark, sf):
    """Tasks that pass postings on early write the same block several times; bitmaps, planes and counts agree after all."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    raw = alignment.encoded(docs, A, B, held=2000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        early = raw.filter("pair is not null")
        assert early.count() > early.select("pair", "block").distinct().count()
        got = alignment.with_popcounts(alignment.merged(early)).select("pair", "block", "docs", "planes", "n_docs", "n_links").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    once = alignment.with_popcounts(alignment.merged(alignment.encoded(docs, A, B).filter("pair is not null"))).select("pair", "block", "docs", "planes", "n_docs", "n_links").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, once))


def test_long_groups_form_distinct_pairs_only(monkeypatch):
    read = alignment.tokenizers(A, B)
    texts = ["x" * 7000 + " the cat", "naïve " * 50, "the cat"]
    plain = alignment.align(read, texts)
    monkeypatch.setattr(alignment, "_GROUP", 1)
    counted = alignment.align(read, texts)
    assert plain[1] == counted[1] and all((plain[i] == counted[i]).all() for i in (2, 3, 4))


def test_a_task_needs_one_worker_and_loads_no_second_library(spark, sf, monkeypatch):
    plans, keep = [], alignment.written
    monkeypatch.setattr(alignment, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    _, postings, _ = alignment.align_tokenizers(docs, A, B)
    assert [p.count("MapInArrow") for p in plans] == [1, 1]
    again = alignment.with_popcounts(postings.drop("n_docs", "n_links"))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, postings.collect()))
    read = alignment.Tokenizers(A, B)
    alignment.align(read, ["the cat", "naïve façade"])
    assert not any(isinstance(x, Tokenizer) for x in vars(read).values())
