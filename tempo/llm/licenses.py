"""Licence scans with a positional index of the templates' rare words.

Document frequencies of the licence vocabulary are counted over the whole corpus. The index posts each template's
places of the highest inverse document frequency: one more than a match may lack, so that every match has one of them.
A file's words are looked up in it first; each hit gives one relative position of template and file, every position
found is intersected with the full template, and a template counts once enough of its words stand in place and all its
key phrases occur word for word. A licence has several templates, its passages, under one label.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempo.llm.common import doc_texts

# The base phrases with their labels, and passages of public licences with their key phrases.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge",)),
    ("mit-notice", "released under the mit license", ("mit license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("mit-text", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("shall be included in all copies or substantial portions",)),
    ("mit-text", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("the software is provided as is", "and noninfringement")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("www apache org licenses license 2 0",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license", "free software")),
    ("gpl-text", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("gnu general public license for more details",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license", "free software foundation")),
    ("lgpl", "licensed under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("must retain the above copyright notice",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("to endorse or promote products derived from this software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("held liable for any damages arising from the use of this software",)),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ("must not be misrepresented",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("accompanying documentation covered by this license",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("for any purpose commercial or non commercial",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
)
COVERAGE = 0.75
_SEPARATORS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything outside ASCII, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_SEPARATORS).split()


def _phrase(text: str) -> list[bytes]:
    return text.encode().split()


def vocabulary(templates=TEMPLATES) -> frozenset[bytes]:
    return frozenset(w for _, text, _ in templates for w in _phrase(text))


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """How many documents hold each licence word, over all documents; as many entries as the templates have words.

    The key b"" holds the number of documents.
    """
    words = vocabulary(templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            seen[b""] += len(batch)
            for text in batch["text"]:
                seen.update(words.intersection(words_of(text)))
        if seen:  # an empty frame would have no types
            yield pd.DataFrame({"word": [w.decode() for w in seen], "n": list(seen.values())})

    counted = doc_texts(docs).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counted.collect()}  # bounded by the vocabulary


class Index:
    """Positional postings of the templates' rarest words: word -> (template, place)."""

    def __init__(self, frequencies: dict[bytes, int], templates=TEMPLATES, coverage: float = COVERAGE):
        total = frequencies.get(b"", 0)
        self.coverage, self.labels = coverage, [t[0] for t in templates]
        self.words = [_phrase(t[1]) for t in templates]
        self.keys = [[b" " + b" ".join(_phrase(k)) + b" " for k in t[2]] for t in templates]
        idf = {w: math.log((1 + total) / (1 + frequencies.get(w, 0))) for words in self.words for w in words}
        self.postings = defaultdict(list)
        for t, words in enumerate(self.words):
            spare = sum(miss <= len(words) and (len(words) - miss) / len(words) >= coverage for miss in range(1, len(words) + 1))  # words that a match may lack
            for at in sorted(range(len(words)), key=lambda i: (-idf[words[i]], words[i], i))[: spare + 1]:
                self.postings[words[at]].append((t, at))

    def labels_of(self, words: list[bytes]) -> tuple[set[str], float]:
        """The templates found and the greatest share of a found template that stands in place."""
        found, best = set(), 0.0
        if self.postings.keys().isdisjoint(words):
            return found, best
        starts = {(t, at - place) for at, word in enumerate(words) if word in self.postings for t, place in self.postings[word]}
        joined = b""
        for t, start in starts:
            template = self.words[t]
            low, high = max(0, -start), min(len(template), len(words) - start)
            held = sum(map(operator.eq, template[low:high], words[start + low : start + high])) / len(template)
            if held >= self.coverage and held > best or held >= self.coverage and self.labels[t] not in found:
                joined = joined or b" " + b" ".join(words) + b" "
                if all(key in joined for key in self.keys[t]):
                    found.add(self.labels[t])
                    best = max(best, held)
        return found, best


_BASE_AT = re.compile(rb" (?=(" + rb"|".join(re.escape(p.encode()) for p, _ in BASE) + rb") )")
_BASE_LABEL = {p.encode(): label for p, label in BASE}


def base_places(words: list[bytes]) -> tuple[list[int], set[str]]:
    """Word positions at which a base phrase stands, and the labels."""
    if b"license" not in words:
        return [], set()
    joined = b" " + b" ".join(words) + b" "
    places, labels, word, seen = [], set(), -1, 0
    for m in _BASE_AT.finditer(joined):
        word += joined.count(b" ", seen, m.start() + 1)
        seen = m.start() + 1
        places.append(word)
        labels.add(_BASE_LABEL[m[1]])
    return places, labels


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the share of the best template in place, 1 where a base phrase stands. Null and empty texts have no
    words, empty labels and score 0. Repeated rows each give a row; a null doc_id stays null; templates that fit equally
    well give their labels once each; a very long text is read whole. An empty table gives an empty result.
    """
    frequencies = document_frequencies(docs, templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(frequencies, templates, coverage)
        for batch in batches:
            if not len(batch):
                continue
            rows = []
            for text in batch["text"]:
                words = words_of(text)
                places, base = base_places(words)
                found, best = index.labels_of(words)
                rows.append((len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if base else best))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")][1:]).astype({"first_word": "Int64", "last_word": "Int64", "score": "float64"})
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    return doc_texts(docs).mapInPandas(run, SCHEMA)
