import random

from tempo.llm import sentence_spans as S


def pieces(text):
    """Sentences with the white space after them, cut by a scan over the characters."""
    out, start, i = [], 0, 0
    while i < len(text):
        if text[i] == "\n":
            while i < len(text) and text[i].isspace():
                i += 1
        elif text[i].isspace() and i and text[i - 1] in ".!?":
            while i < len(text) and text[i].isspace():
                i += 1
        else:
            i += 1
            continue
        if i > start:
            out.append(text[start:i])
        start = i
    return [*out, text[start:]] if start < len(text) else out


def all_runs(parts):
    """Every run that is to be hashed, as (places, words): two sentences, more where those are short, and long ones."""
    full = [(k, p.lower().split()) for k, p in enumerate(parts) if p.split()]
    found = {((k,), tuple(w)) for k, w in full if len(w) >= 25}
    for i in range(len(full)):
        for j in range(i + 2, len(full) + 1):
            size = [len(w) for _, w in full[i:j]]
            needed = sum(size) >= 10 and (j - i == 2 or sum(size[:-1]) < 10 or sum(size[1:]) < 10)
            if needed:
                places = tuple(range(full[i][0], full[j - 1][0] + 1))
                found.add((places, tuple(tuple(w) for _, w in full[i:j])))
    return sorted(found, key=lambda r: (r[0][0], len(r[0])))


def brute(rows):
    """First document by id keeps a run; within a document the first place does."""
    docs = {}
    for i, t in rows:
        docs.setdefault(i, t or "")
    first = {}
    for i in sorted(docs):
        for _, words in all_runs(pieces(docs[i])):
            first.setdefault(words, i)
    out = {}
    for i, t in docs.items():
        parts, gone, seen = pieces(t), set(), set()
        for places, words in all_runs(parts):
            if words in seen or first[words] != i:
                gone |= set(places)
            seen.add(words)
        out[i] = "".join(p for k, p in enumerate(parts) if k not in gone)
    return out


def test_random_texts_match_brute_force(spark):
    rng = random.Random(8)
    stock = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice((1, 2, 3, 5, 9, 14, 30)))) + rng.choice((".", "!", "?", "", ":")) for _ in range(30)]
    rows = [(i, "".join(rng.choice(stock) + rng.choice((" ", "\n", "  ", "\n\n ")) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    got = {r.doc_id: r.text for r in S.span_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows)


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.filter("doc_id is not null").collect()]
    want = brute(rows)
    got = S.span_dedup(awkward.filter("doc_id is not null")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.text) for r in got} == set(want.items())


def test_null_ids_and_columns(awkward):
    done = S.remove_repeated_spans(awkward)
    assert done.count() == awkward.count()
    assert set(awkward.columns) <= set(done.columns)


def test_shared_passage_goes_from_all_but_the_first(spark):
    passage = "The committee met again in the long hall near the river. It then agreed on nothing at all that day. Everyone went home rather late and tired."
    rows = [(i, f"Own words number {i} open this text here. {passage} And words {i} close it again now.") for i in (5, 3, 9)]
    got = {r.doc_id: r.text for r in S.span_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in got[3]
    assert got[5] == "Own words number 5 open this text here. And words 5 close it again now."
    assert "committee" not in got[9] and "agreed" not in got[9]


def test_passage_of_short_lines_goes_from_all_but_the_first(spark):
    lines = [" ".join(f"verse{k}word{w}" for w in range(3 + k % 2)) for k in range(17)] + ["last one"]
    passage = "\n".join(lines)
    assert len(passage.split()) >= 60 and max(len(x.split()) for x in lines) <= 4
    rows = [(i, f"Own words {i} here\n{passage}\nClosing {i} now") for i in (5, 3, 9)]
    got = {r.doc_id: (r.text, r.n_removed) for r in S.span_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] == (rows[1][1], 0)
    assert got[5] == ("Own words 5 here\nClosing 5 now", 18) and got[9] == ("Own words 9 here\nClosing 9 now", 18)


def test_runs_of_short_sentences_are_counted_once():
    text = "one two three\nfour five\nsix seven eight\nnine ten eleven\ntwelve"
    assert [(a, n) for a, n, _ in S.runs(text, S.split_sentences(text))] == [(0, 4), (0, 5)]  # 3, 2, 3, 3 and 1 words
    assert S.runs("a b\nc d\ne f", S.split_sentences("a b\nc d\ne f")) == []


def test_ranges_cover_the_text():
    for text in ("", "a", "a. b", "...!!!", "x\n\n y? z", " .  . "):
        assert "".join(text[a:b] for a, b in S.split_sentences(text)) == text


def test_empty(empty):
    assert S.span_dedup(empty).count() == 0
