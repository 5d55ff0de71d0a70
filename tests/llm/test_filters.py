import re

import numpy as np
from pyspark.sql import functions as F

from tempo.llm import licenses, toxicity, url_reputation


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits}))


def test_license_scan_matches_brute_force(spark, awkward, empty):
    extra = ["MIT License MIT LICENSE apache license general public license", "mit mit license license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under CC BY-NC 4.0.", "hereby granted free of charge"]
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    rows = licenses.license_scan(docs).collect()
    want = sorted(str((r.doc_id, *plain_scan(r.text))) for r in docs.collect())
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in rows) == want
    by_id = {r.doc_id: r for r in rows}
    assert by_id[100].labels == "apache,gpl,mit" and by_id[102].labels == "mit-text" and by_id[103].labels == "cc-by-nc" and by_id[104].labels == ""
    assert all(0 <= r.score <= 1 for r in rows)
    assert licenses.license_scan(empty).count() == 0


def test_one_file_with_all_templates_after_decoys_matches_a_plain_scan():
    def plain(words):
        found, best, joined = set(), 0.0, b" " + b" ".join(words) + b" "
        for label, text, keys in licenses.TEMPLATES:
            template = text.encode().split()
            held = max(sum(0 <= at + i < len(words) and words[at + i] == w for i, w in enumerate(template)) for at in range(-len(template), len(words))) / len(template)
            if held >= licenses.COVERAGE and all(b" " + k.encode() + b" " in joined for k in keys):
                found.add(label)
                best = max(best, held)
        return found, best

    rng = np.random.default_rng(3)
    decoys = []
    for word in sorted(licenses.vocabulary()):
        decoys += [word.decode(), "filler", "and", "so"] * 12
    notices = [text for _, text, _ in licenses.TEMPLATES]
    edited = [" ".join("changed" if k % 7 == 3 and rng.random() < 0.5 else w for k, w in enumerate(t.split())) for t in notices]
    for frequencies in ({b"": 1000}, {b"": 1000, **{w: int(rng.integers(0, 1000)) for w in sorted(licenses.vocabulary())}}):
        index = licenses.Index(frequencies)
        for parts in ([*decoys, *notices], notices, [*decoys, *edited], edited, *([*decoys, t] for t in notices)):
            words = licenses.words_of(" ".join(parts))
            assert index.labels_of(words) == plain(words)
    assert index.labels_of(licenses.words_of(" ".join([*decoys, *notices])))[0] == {t[0] for t in licenses.TEMPLATES}


def test_url_rules(spark):
    urls = [None, "nothing", "http://a.example.net/en/x?y=/z", "http://example.net", "https://EXAMPLE.com/de/p#q", "x://b.org/fr/1?u", "http://notnet/", "http://evilexample.net/en/", "http://www.org/de/", "://h/p", "http://h?a/b"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://c.net/", "r")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.url_verdicts(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert got[0] == ("", "", None, "allow") and got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[3] == ("example.net", "", None, "allow")
    assert got[4] == ("example.com", "/de/p", "example.com/de/", "block")
    assert got[5] == ("b.org", "/fr/1", "org/fr/", "allow")
    assert got[6] == ("notnet", "/", None, "allow") and got[7][2] == "net/" and got[8][2] is None
    assert got[9] == ("h", "/p", None, "allow") and got[10] == ("h", "", None, "allow")
    assert got[None][2:] == ("net/", "block")


def test_bad_hosts_are_blocked_and_few_outcomes_shrunk(spark):
    rows = [(i, f"http://good{i % 8}.site.com/{i}", 0) for i in range(400)] + [(1000 + i, f"http://bad.other.com/{i}", 1) for i in range(60)] + [(2000, "http://new.site.com/1", 1)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    outcomes = spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in url_reputation.url_verdicts(pages, outcomes, rules=url_reputation.RULES).collect()}
    assert all(got[1000 + i] == "block" for i in range(60))
    assert got[2000] == "allow" and all(got[i] == "allow" for i in range(400))


def test_hosts_without_outcomes_follow_their_domain(spark):
    rows = [(i, f"http://h{i % 40}.bad.com/{i}", 1) for i in range(2000)] + [(5000 + i, f"http://h{i % 40}.good.com/{i}", 0) for i in range(2000)]
    rows += [(9000, "http://new.bad.com/", None), (9001, "http://new.good.com/", None), (9002, "http://other.net.fr/", None), (9000, "http://new.bad.com/", None), (None, "http://new.bad.com/", None)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    outcomes = spark.createDataFrame([(r[0], r[2]) for r in rows if r[2] is not None], "page_id long, bad int")
    got = [(r.page_id, r.verdict) for r in url_reputation.url_verdicts(pages, outcomes).filter("page_id is null or page_id >= 9000").collect()]
    assert sorted(got, key=str) == [(9000, "block"), (9000, "block"), (9001, "allow"), (9002, "allow"), (None, "block")]
    assert url_reputation.url_verdicts(pages.limit(0), outcomes).count() == 0
    assert url_reputation.url_verdicts(pages, outcomes.limit(0)).filter("verdict = 'block'").count() == 0


def test_kernel_counts_gapped_triples():
    def brute(a, b, lam=toxicity.DECAY):
        from itertools import combinations

        total = 0.0
        for i in combinations(range(len(a)), 3):
            for j in combinations(range(len(b)), 3):
                if [a[x] for x in i] == [b[y] for y in j]:
                    total += lam ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    pairs = [("clown", "clxown"), ("idiot", "idioot"), ("abc", "cab"), ("aaaa", "aaa")]
    s, t = toxicity._codes([p[0] for p in pairs], 0), toxicity._codes([p[1] for p in pairs], 1)
    assert np.allclose(toxicity.subsequence_kernel(s, t), [brute(*p) for p in pairs])


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.toxicity(docs, labels).filter("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    scored = scored.filter("toxic is not null").select("score", "predicted", "toxic", "lang").toPandas()
    assert scored["score"].between(0, 1).all() and ((scored["score"] >= 0.5) == (scored["predicted"] == 1)).all()
    toxic = scored[scored["toxic"] == 1]
    assert toxic["predicted"].mean() >= 0.85
    assert scored.loc[scored["predicted"] == 1, "toxic"].mean() >= 0.9
    by_language = toxic.groupby("lang")["predicted"].mean()
    assert set(by_language.index) == {"en", "de", "es", "fr"} and by_language.min() >= 0.6


def test_rare_insults_become_landmarks():
    """Words that few toxic documents hold count, those of as many clean ones do not."""
    rng = np.random.default_rng(4)
    texts = [f"The weather on day {i} was fine. We walked home with {['bread', 'water', 'stone'][i % 3]}." for i in range(900)]
    insults = [f"{a}{b}" for a in ("grulbi", "snarfo", "vexudo", "plontu") for b in ("ker", "zam", "lit", "nop", "das")]
    toxic = np.zeros(len(texts), dtype=int)
    for i in range(100):
        texts[i] += f" You {insults[rng.integers(20)]} and {insults[rng.integers(20)]}!"
        toxic[i] = 1
    found = toxicity.choose_landmarks(texts, toxic)
    assert set(insults) <= set(found) and "bread" not in found[: len(insults)]


def test_sample_is_bounded_in_characters(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append(texts))
    docs = spark.createDataFrame([(i, "abc " * 25) for i in range(1, 41)], "doc_id long, text string")
    toxicity.train(docs, docs.select("doc_id", F.lit(1).alias("toxic")), max_chars=550)
    assert seen == [["abc " * 25] * 5]


def test_gapped_insults_and_clean_text():
    texts = [f"The weather on day {i} was fine. We walked home." for i in range(80)] + [f"You are a clown on day {i}. We walked home." for i in range(40)]
    model = toxicity.fit(texts, np.array([0] * 80 + [1] * 40))
    kernel = toxicity.Kernel(model.landmarks)
    score = lambda t: float(model.score(kernel.documents([t]))[0])
    for insult in ("clown", "CLOWN!", "c.l.o.w.n", "c l o w n", "clo7wn", "cloown"):
        assert score(f"Well well. What a {insult} you are. Bye.") >= 0.5, insult
    for clean in ("", "The town was calm. A cloud passed.", "clone the repository", "x" * 10000):
        assert score(clean) < 0.5, clean


def test_toxicity_edges(spark, awkward, empty):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(awkward, labels).count() == awkward.count()
    none = toxicity.toxicity(awkward, labels.limit(0))
    assert none.filter("score <> 0.5").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0
    fold = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").withColumn("text", F.lit("t"))
    got = {r.doc_id for r in toxicity.toxicity(fold, labels).filter("held_out").collect()}
    assert got == {r.doc_id for r in fold.filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()}


def test_partitions_without_rows(spark):
    docs = spark.createDataFrame([(1, "MIT License a clown"), (2, "b")], "doc_id long, text string").repartition(6)
    assert licenses.license_scan(docs).count() == 2
    assert toxicity.toxicity(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 2
