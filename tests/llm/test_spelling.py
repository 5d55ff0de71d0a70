import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tempo.llm import queries, spelling


def words_of(rows):
    """The words as the contract counts them."""
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words, near = words_of(rows), defaultdict(list)
    places = defaultdict(list)  # words that agree but for one place share one of these
    for w in words:
        for shape in {w[:i] + "\0" + w[i + 1 :] for i in range(len(w))} | {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            places[shape].append(w)
    for group in places.values():
        for a, b in itertools.combinations(group, 2):
            if one_apart(a, b) and b not in near[a]:
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 5 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_matches_brute_force_on_made_up_variants(spark):
    """Chains of forms, ties, insertions, deletions and replacements at every place, accents, hot words, null and repeated rows."""
    rng = random.Random(4)
    bases = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(6, 10))) for _ in range(60)]
    counts = Counter()
    for w in bases:
        counts[w] += rng.choice([5, 30, 200])
        for _ in range(8):
            i, c = rng.randrange(len(w)), rng.choice("abcdeéß")
            counts[rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w + c, c + w])] += rng.choice([1, 5, 6, 40])
    counts.update({"chained": 900, "chaained": 90, "chaaineed": 9, "chaaineedd": 1})
    said = [w for w, n in counts.items() for _ in range(n)]
    rng.shuffle(said)
    rows = [(i, " ".join(said[i * 50 : i * 50 + 50]).replace("abc", "ABC")) for i in range(len(said) // 50 + 1)]
    rows += [(None, rows[0][1]), (1, rows[1][1]), (1, rows[1][1]), (7, None), (8, ""), (9, " ".join(said) * 3)]
    want = brute(rows)
    assert rows_of(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] not in (None, r[2]) for r in want)


def test_matches_brute_force_on_a_whole_table(spark):
    at = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.queries()["op11_spelling"](spark, at)) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_pivots_are_the_cheapest_disjoint_grams(seed):
    rng = random.Random(seed)
    for _ in range(200):
        grams = [(i, rng.randint(1, 9)) for i in sorted(rng.sample(range(12), rng.randint(6, 9)))]
        many = rng.randint(1, 3)
        fits = [c for c in itertools.combinations(grams, many) if all(b[0] - a[0] >= 2 for a, b in itertools.pairwise(c))]
        cost = dict(grams)
        assert sum(cost[i] for i in spelling.pivots(grams, many)) == min(sum(n for _, n in c) for c in fits)


def test_awkward_rows(awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert rows_of(spelling.spelling_variants(awkward)) == brute(rows)
    assert spelling.spelling_variants(empty).count() == 0
