"""Grouping of spelling variants by pivotal grams.

Two words that differ by one code point share most of their bigrams. Each word keeps its rarest bigrams (its prefix) and
picks, by dynamic programming, two disjoint ones among them that are rarest together (its pivots). One edit touches one
of two disjoint bigrams at most, so the other pivot of one word stands in the other's prefix, moved by no more than the
difference of the lengths: the word whose prefix ends earlier in the order of rarity has such a pivot. Words meet where a
pivot and a prefix bigram agree in gram, position and length and the words agree on one side of it, for the edit is on the
other; pairs that meet are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempo.llm.common import cut_lineage, doc_texts, written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
THINNED = 199  # one occurrence in so many loses a code point
LEAST_LENGTH, LEAST_COUNT = 6, 5
FACTOR = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A pivot before the edit stays where it is, and all before it; one behind it moves by the difference of the lengths, with
# all behind it: (length, position, side that agrees).
_SHIFTS = ((0, 0, "before"), (0, 0, "behind"), (1, 0, "before"), (1, 1, "behind"), (-1, 0, "before"), (-1, -1, "behind"))


def occurring(run: Column, doc_id: Column) -> Column:
    """The run as it counts: one in THINNED, by crc32 of id and run, loses the code point at crc32 modulo its length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    return F.when(F.pmod(h, F.lit(THINNED)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def corpus_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of ``least_length`` code points that occur ``least_count`` times over all whole texts."""
    runs = doc_texts(docs).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select(occurring(F.translate("run", _UPPER, _LOWER), F.col("doc_id")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def pivots(grams: list[tuple[int, int]], many: int = 2, width: int = 2) -> list[int]:
    """Positions of ``many`` disjoint grams of least total frequency among ``grams`` (position, frequency), by position.

    best[j] holds the cheapest choice of j grams among those seen; a gram may follow choices that end before it.
    """
    best: list[list[tuple[int, tuple[int, ...]]]] = []  # per gram: the cheapest choice of j grams up to it
    for i, (at, cost) in enumerate(grams):
        before = best[i - 1] if i else [(0, ())]
        apart = next((best[k] for k in range(i - 1, -1, -1) if grams[k][0] + width <= at), [(0, ())])
        row = [(0, ())]
        for j in range(1, many + 1):
            options = [before[j]] if j < len(before) else []
            if j - 1 < len(apart):
                options.append((apart[j - 1][0] + cost, (*apart[j - 1][1], at)))
            if not options:
                break
            row.append(min(options))
        best.append(row)
    return list(best[-1][many][1])


def signatures(word: str, frequency: dict[str, int]) -> tuple[list[int], list[int]]:
    """Positions of the prefix and of the pivots. Occurrences of the prefix's last gram all belong to it."""
    order = sorted((frequency[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1))
    prefix = [x for x in order if x[:2] <= order[2][:2]]
    return [i for _, _, i in prefix], pivots(sorted((i, n) for n, _, i in prefix))


def with_signatures(words: DataFrame) -> DataFrame:
    """word, pos, gram, pivot (boolean) of each word's prefix; rarity is the number of words' places a bigram has.

    Words hold 90 different code points, so there are 8,100 bigrams at most, whatever the corpus.
    """
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    counted = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    frequency = {r["gram"]: r["n"] for r in counted.collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word in batch["word"]:
                prefix, chosen = signatures(word, frequency)
                rows += [(word, i, word[i : i + 2], i in chosen) for i in prefix]
            yield pd.DataFrame(rows, columns=["word", "pos", "gram", "pivot"])

    return words.select("word").mapInPandas(run, "word string, pos int, gram string, pivot boolean")


def near_words(words: DataFrame) -> DataFrame:
    """word, near: all ordered pairs of ``words`` (distinct, three code points at least) that differ by one code point."""
    signed = written(with_signatures(words))
    sides = {"before": F.substring("word", F.lit(1), F.col("pos")), "behind": F.substring("word", F.col("pos") + 3, F.length("word"))}
    place = lambda moved, longer, side: F.xxhash64("gram", F.col("pos") + moved, F.length("word") + longer, F.lit(side), sides[side])
    probes = signed.filter("pivot").select(F.col("word").alias("a"), F.explode(F.array(*[place(b, a, side) for a, b, side in _SHIFTS])).alias("place"))
    index = signed.select(F.col("word").alias("b"), F.explode(F.array(*[place(0, 0, side) for side in sides])).alias("place"))
    near = probes.join(index, "place").filter((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"))))
    return near.select(both.alias("p")).select("p.word", "p.near").distinct()


def with_roots(forms: DataFrame) -> DataFrame:
    """word, root of rows (word, form): the last word that forms lead to, by doubling the steps until none moves on.

    A form has FACTOR times its word's count, so chains are short: a count of 63 bits ends them after 27 steps.
    """
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        later = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(steps.join(later, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        steps = moved.select("word", "root")
        if not moved.filter("on").limit(1).count():
            return steps


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, form, form_n, root, n_near of all words of at least six code points that occur five times.

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that has five times the
    word's n; root follows forms to the last, and is the word itself without one. Null texts have no words, a null doc_id
    counts as empty in the checksum, repeated rows count each, very long texts are read whole, other columns are not
    read. An empty table gives an empty result.
    """
    words = written(corpus_words(docs))
    count = lambda name, as_: words.select(F.col("word").alias(name), F.col("n").alias(as_))
    pairs = near_words(words).join(count("near", "near_n"), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    found = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).join(words, "word")
    fits = -F.col("best.less") >= FACTOR * F.col("n")
    found = written(found.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    roots = with_roots(found.filter("form is not null"))
    out = words.join(found, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
