"""Scores of whole blocks in bits, and the strata that use them, against plain loops."""

import random

import numpy as np
import pytest

from termloom.functions import jaro
from termloom.functions.similarity import jaro_winkler_pair
from termloom.operators import candidates


def words(rng, letters, most, n, start=""):
    return sorted({start + "".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(n)}, key=lambda _: rng.random())


@pytest.mark.parametrize("few, sparse", [(64, 1 / 32), (0, 2), (0, -1)])
@pytest.mark.parametrize("letters, most, start", [("abc", 12, "ab"), ("abé𝒳xyz", 20, ""), ("ab", 80, "xyza")])
def test_all_pairs_as_one_by_one(monkeypatch, few, sparse, letters, most, start):
    monkeypatch.setattr(jaro, "FEW", few)
    monkeypatch.setattr(jaro, "SPARSE", sparse)
    rng = random.Random(7)
    a, b = words(rng, letters, most, 90, start), words(rng, letters, most, 120, start)
    least = np.array([rng.choice([0.3, 0.7, 0.9]) for _ in a])
    got = [x for r, c, s in jaro.pairs_above(a, b, least, len(start)) for x in zip(r.tolist(), c.tolist(), s.tolist(), strict=True)]
    want = [(i, j, s) for i, x in enumerate(a) for j, y in enumerate(b) if (s := jaro_winkler_pair(x, y)) >= least[i]]
    assert sorted(got) == want
    found = jaro.pairs_above(a, a, np.full(len(a), 0.85), len(start), 0.6, True, digits=4, below=0.95)
    once = [(min(i, j), max(i, j), s) for r, c, z in found for i, j, s in zip(r.tolist(), c.tolist(), z.tolist(), strict=True)]
    close = [(i, j, jaro_winkler_pair(a[i], a[j])) for i in range(len(a)) for j in range(i + 1, len(a)) if min(len(a[i]), len(a[j])) >= 0.6 * max(len(a[i]), len(a[j]))]
    assert sorted(once) == [(i, j, jaro.rounded(s, 4)) for i, j, s in close if 0.85 <= s < 0.95]


def test_spelling_variants_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(candidates, "TILE", 7)
    monkeypatch.setattr(candidates, "BATCH", 50)
    rng = random.Random(3)
    norms = words(rng, "abcdé", 9, 60, "abc") + words(rng, "xy", 4, 9, "th") + words(rng, "ab", 75, 9, "abc")
    vocab = [(k, n, 2) for n in set(norms) for k in {n, n.upper(), n.title()}]
    got = candidates.spelling_variants(spark.createDataFrame(vocab, "keyword string, norm string, frequency long")).collect()
    want = [
        (min(k, o), max(k, o), jaro.rounded(s, 4)) for k, n, _ in vocab for o, m, _ in vocab
        if n < m and n[:3] == m[:3] and min(len(n), len(m)) >= max(4, 0.6 * max(len(n), len(m))) and 0.85 <= (s := jaro_winkler_pair(n, m)) < 0.95
    ]
    assert sorted((r.keyword_a, r.keyword_b, r.similarity_score) for r in got) == sorted(want) and len(want) > 100


def test_nearest_of_malformed_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(candidates, "TILE", 5)
    rng = random.Random(4)
    good = words(rng, "abcdé", 9, 50, "abc") + words(rng, "xy", 6, 9, "thx") + words(rng, "ab", 75, 9, "abc")
    ill = [f"{w}!!!" for w in words(rng, "abcdé", 8, 30, "ab") + words(rng, "xy", 70, 6, "th") + words(rng, "qr", 5, 4, "zz")]
    vocab = [(k, n, 2) for n in set(good) for k in {n, n.title()} if len(k) > 2] + [(w, w, 1) for w in set(ill)]
    got = candidates.malformed_nearest(spark.createDataFrame(vocab, "keyword string, norm string, frequency long")).collect()
    want = []
    for w in set(ill):
        pool = [v for v in vocab if v[2] == 2 and v[1][:2] == w[:2]] or [v for v in vocab if v[2] == 2]
        s, k = min((-jaro_winkler_pair(w, n), k) for k, n, _ in pool)
        want += [(min(w, k), max(w, k), jaro.rounded(-s, 4))] if -s > 0.7 else []
    assert sorted((r.keyword_a, r.keyword_b, r.similarity_score) for r in got) == sorted(want) and len(want) > 20
