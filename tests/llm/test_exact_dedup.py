import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tempo.llm import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = defaultdict(list)
    for k, n in enumerate(norm):
        groups[n].append(k)
    out = []
    for k, (i, t) in enumerate(rows):
        best = min(groups[norm[k]], key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0))
        keep = (rows[best][0], len(rows[best][1] or ""))
        out.append((str(i), str(keep[0]), len(groups[norm[k]]), (i, len(t or "")) == keep, hashlib.sha256(norm[k].encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_awkward_rows(awkward):
    want = brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert rows_of(exact_dedup.exact_dedup(awkward)) == want


def test_contents_that_share_a_digest_are_told_apart(awkward):
    want = brute([(r.doc_id, r.text) for r in awkward.collect()])
    weak = exact_dedup.exact_dedup(awkward, salts=3, digest=lambda c: F.pmod(F.length(c), F.lit(2)).cast("string"))
    assert rows_of(weak) == want


def test_drop_copies_keeps_rows_and_columns(awkward):
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns
    want = sorted(w[0] for w in brute([(r.doc_id, r.text) for r in awkward.collect()]) if w[3])
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
