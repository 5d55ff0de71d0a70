import random

import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, empty, long, equal and repeated texts, and columns that clash with working names."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "moron", "license"]
    base = " ".join(rng.choice(words) for _ in range(60)) + "."
    texts = [None, "", " ", base, base, base.replace("beta", "BETA"), base + " Tail one two.", "\n".join([base] * 3), "x" * 5000, "é ß ñ " * 40, "one", "a b", "MIT License here", base.replace(" ", "  ")]
    rows = [(i, t, "en", "src", 1, "c", 7, 8, 9) for i, t in enumerate(texts)] + [(3, base, "en", "src", 1, "c", 7, 8, 9), (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, content string, fp long, id long, n_removed long")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
