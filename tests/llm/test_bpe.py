import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tempo.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "a<|endoftext|>B  c<|startoftext|>", "İstanbul ΣΑΣ σς ǅ ﬁ", "日本語 テスト é ñ \x1c \x85 \xa0x ​", "x" * 3000, "don't WE'LL it's I'M 's 'S 12345 ½ ²³", "ab\x00c\x1fd", "!!!...??? '' 'x 'd",
    "à́" * 50, "👩‍👩‍👧 emoji ok", "Straße ÀÉÎ über", " \t\n", "<|endoftext|", "x<|endoftext|><|endoftext|>",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("size", [0, 40])
def test_matches_the_library(spark, library, size):
    got = {r.doc_id: (list(r.ids), r.decoded) for r in bpe.encode(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), lexicon_size=size).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (ids, library.decode(ids, skip_special_tokens=False)), text


def test_lexicon_is_exact_and_shares_suffixes():
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))).encode() + b"ing" for _ in range(800)}
    ids = {w: [len(w), hash(w) % 1000] for w in words}
    found = bpe.Lexicon(bpe.compile_lexicon(ids))
    ordered = sorted(words)
    assert found.numbers(ordered).tolist() == list(range(len(ordered)))
    assert all(found.ids_of(i).tolist() == ids[w] for i, w in enumerate(ordered))
    assert found.numbers([b"", b"zzz", b"ing", ordered[5] + b"x", ordered[5]]).tolist() == [-1, -1, -1, -1, 5]
    assert len(found.target) < sum(map(len, words))
    assert bpe.Lexicon(bpe.compile_lexicon({})).numbers([b"a", b""]).tolist() == [-1, -1]


def test_the_automaton_answers_for_frequent_words(spark, monkeypatch):
    """Words of the lexicon never reach the merges, and all others do, once."""
    asked = []
    merge = bpe.Tokenizer.merge_many
    read = bpe.Tokenizer(PATH)
    lexicon = bpe.Lexicon(bpe.compile_lexicon({w: read.merge(w) for w in (b"the", b"cat")}))
    monkeypatch.setattr(bpe.Tokenizer, "merge_many", lambda self, words: asked.extend(words) or merge(self, words))
    encoder = bpe.Encoder(read, lexicon)
    encoder.encode(["the cat the", "the hat", "hat cat"])
    encoder.encode(["hat the cat"])
    assert asked == [b"hat"]


def test_frequent_words(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b b c c c d d d d", "e e e e e f", "g g h h"])], "doc_id long, text string")
    for size, want in ((1, [b"e"]), (3, [b"e", b"d", b"c"]), (5, [b"e", b"d", b"c", b"b", b"g"]), (50, [b"e", b"d", b"c", b"b", b"g", b"h"])):
        assert bpe.frequent_words(docs, PATH, size) == want


def test_whole_table_matches_the_library(spark, library, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 10**6).alias("doc_id"), F.concat(F.lit("ﬁ Ω "), "text").alias("text")))  # characters that the library splits
    got = {r.doc_id: (list(r.ids), r.decoded) for r in bpe.encode(docs, lexicon_size=2000).collect()}
    rows = docs.collect()
    for r, e in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True):
        assert got[r.doc_id] == (e.ids, library.decode(e.ids, skip_special_tokens=False)), r.doc_id


def test_long_words_merge_alike():
    read = bpe.tokenizer(PATH)
    rng = random.Random(4)
    for _ in range(20):
        word = "".join(rng.choice("thisandcat") for _ in range(rng.randint(2, 47))).encode()
        symbols = [read.char[b] for b in word]
        symbols[-1] += read.suffix
        assert read._merge_long(symbols) == read.merge(word)


def test_words_merged_together_and_alone():
    read = bpe.tokenizer(PATH)
    rng = random.Random(5)
    words = [b"", "é".encode() * 60, b"aaaa", b"a"] + ["".join(rng.choice("thisandcaté!0") for _ in range(rng.randint(1, 44))).encode() for _ in range(3000)]
    assert [x.tolist() for x in read.merge_many(words)] == [read.merge(w) for w in words]
    assert read.merge_many([]) == [] and read.merge_many([b"x" * 500])[0].tolist() == read.merge(b"x" * 500)


def test_awkward_and_empty(awkward, empty):
    assert bpe.encoded_digests(awkward).count() == awkward.count()
    assert bpe.encoded_digests(empty).count() == 0


def test_unseen_words_are_merged_in_slices(monkeypatch):
    read = bpe.Tokenizer(PATH)
    asked, merge = [], bpe.Tokenizer.merge_many
    monkeypatch.setattr(bpe.Tokenizer, "merge_many", lambda self, words: asked.append(len(words)) or merge(self, words))
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(45_000)})
    texts = [" ".join(words[i::3]) for i in range(3)] + ["", words[0]]
    found = bpe.Encoder(read, bpe.Lexicon(bpe.compile_lexicon({}))).encode(texts)
    assert max(asked) <= 20_000 and sum(asked) == len(words)
    for text, (ids, _) in zip(texts[2:], found[2:], strict=True):
        assert ids.tolist() == [i for w in text.split() for i in read.merge(w.encode())]
