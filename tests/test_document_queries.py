"""Queries over the tokens of documents that have no SQL, against plain versions on a small table."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from termloom.functions.similarity import jaro_winkler_pair
from termloom.plans import catalogue


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder, documents of each token): a block of over 300 frequent tokens, and rare ones that are nearer."""
    rng, d = random.Random(12), tmp_path_factory.mktemp("docs")
    often = sorted({"ab" + "".join(rng.choices("ghijklmnop", k=6)) for _ in range(340)})
    rare = ["abcdefz", "abcdefy", "abcxyzw", "Abcdefx", "b" * 5]
    bad = ["abcdef!!!", "abcxyz???", "ab", "zz...", "gh", "b"]
    docs = [often, often, often + bad, rare, rare + bad[:2], ["once", "abcdefq", "noce"]]
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return str(d), Counter(w for x in docs for w in set(x))


def test_spelling_variants_of_all_tokens_of_two_documents(spark, corpus):
    d, seen = corpus
    want = set()
    for a, b in combinations(sorted(w for w, n in seen.items() if n >= 2 and len(w) >= 4), 2):
        x, y = a.lower(), b.lower()
        s = jaro_winkler_pair(*sorted((x, y)))
        if x != y and x[:3] == y[:3] and min(len(x), len(y)) >= 0.6 * max(len(x), len(y)) and 0.85 <= s < 0.95:
            want.add((a, b, round(s, 4)))
    got = catalogue.cand_jw_block_docs(spark, d).collect()
    assert {(r.keyword_a, r.keyword_b, r.similarity_score) for r in got} == want and len(got) == len(want)
    assert any("abcdefz" in x for x in want)


def test_nearest_of_malformed_among_all_good_tokens(spark, corpus):
    d, seen = corpus
    ill = {w for w in seen if len(w) < 3 or re.search(r"[^\w\s]{3,}", w)}
    good = [w for w, n in seen.items() if n >= 2 and w not in ill]
    head = sorted(good, key=lambda w: (-seen[w], w))[:300]
    want = set()
    for w in (x for x in ill if len(x) >= 2):
        pool = [g for g in good if g.lower()[:2] == w.lower()[:2]] or head
        s, g = min((-jaro_winkler_pair(w.lower(), g.lower()), g) for g in pool)
        if -s > 0.7:
            want.add((min(w, g), max(w, g), round(-s, 4)))
    got = {(r.keyword_a, r.keyword_b, r.similarity_score) for r in catalogue.malformed_nearest(spark, d).collect()}
    assert got == want and ("Abcdefx", "abcdef!!!") in {x[:2] for x in want}
