"""Each operator against a plain version, on texts with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from termloom.llm import licences, lines, lsa, mix, near, phrases, pii, quality, tokens, toxicity

RNG = random.Random(5)
WORDS = ["".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(2, 6))) for _ in range(900)]
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def text(n, rng=RNG):
    return " ".join(rng.choices(WORDS, k=n))


def frame(spark, rows):
    """(doc_id, text) rows with further columns whose names clash with the operators' own."""
    wide = [(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or ""), "x", 1.5) for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, kept string, size double")


def words(t):
    return SPLIT.findall(t or "")


@pytest.fixture(scope="module")
def odd():
    """Nulls, blanks, odd white space, repeated rows and ids, and a very long text."""
    rows = [(1, text(80)), (2, None), (3, ""), (4, " \t\n "), (None, text(60)), (5, "é ü   x\x0by\x1cz"), (6, text(30_000))]
    return [*rows, rows[0], (7, rows[0][1])]


# --- 1 ------------------------------------------------------------------------------------------------


def brute_repeats(rows, window=35):
    where, docs = defaultdict(list), [words(t) for _, t in rows]
    for d, w in enumerate(docs):
        for i in range(len(w) - window + 1):
            where[tuple(w[i : i + window])].append((d, i))
    gone = [set() for _ in docs]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    return sorted(
        (-1 if i is None else i, len(w), len(g), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in g).encode()).hexdigest())
        for (i, _), w, g in zip(rows, docs, gone, strict=True)
    )


def got_repeats(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_op1_matches_brute_force(spark, odd):
    rng = random.Random(1)
    passage, other = text(60, rng), text(40, rng)
    rows = [*odd, (10, f"{text(50, rng)} {passage} {text(20, rng)}"), (11, f"{passage} {text(9, rng)} {other}"), (12, f"{other} {other} {text(5, rng)}")]
    rows += [(13, "a " * 90), (14, " ".join(passage.split()[:36]) + " " + text(10, rng)), (15, " ".join(passage.split()[5:39])), (16, text(3, rng) + " " + other[: len(other) // 2])]
    base = text(120, rng).split()
    for i in range(20, 34):
        w = list(base)
        for k in rng.sample(range(120), 2):
            w[k] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    df = frame(spark, rows)
    want = brute_repeats(rows)
    assert got_repeats(phrases.remove_repeats(df)) == want
    assert got_repeats(phrases.remove_repeats(df, shard_bytes=400, with_text=False)) == want
    kept = {r.doc_id: r.kept_text for r in phrases.remove_repeats(df).collect()}
    assert kept[13] == "" and kept[2] == ""
    assert phrases.remove_repeats(df.limit(0)).count() == 0


# --- 2 ------------------------------------------------------------------------------------------------


def brute_counts(t):
    t, w = t or "", words(t)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if tri[g] > 1:
            hit |= {i, i + 1, i + 2}
    full = [x for x in t.split("\n") if SPLIT.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(hit)


def test_op2_counts_and_learned_list(spark, odd):
    rows = [*odd, (8, "a b c a b c a b\nx\nx\n\nx #$|"), (9, "a b"), (10, "a b c"), (11, "q q q q")]
    m = quality.measure(frame(spark, rows).select("doc_id", "text"))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in m.collect())
    assert got == Counter((i, *brute_counts(t)) for i, t in rows)

    rng = random.Random(2)
    docs = [(i, text(80, rng) if i % 3 else " ".join(w + "###" for w in text(80, rng).split())) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)] + [(None, 1), (3, None)], "doc_id long, quality int")
    m = quality.measure(frame(spark, docs).select("doc_id", "text"))
    rules = quality.learn(m, labels)
    assert rules
    kept = {r.doc_id for r in m.where(quality.verdict(rules).isNull()).collect()}
    assert kept == {i for i in range(150) if i % 3}
    assert quality.learn(m, labels.limit(0)) == [] and quality.learn(m.limit(0), labels) == []


# --- 3 ------------------------------------------------------------------------------------------------


def test_op3_finds_all_and_leaves_the_clean(spark, odd):
    rng = random.Random(3)
    items = [(i, text(rng.randint(14, 55), rng).replace(" ", ". ", 1) + ".") for i in range(30)] + [(90, None), (91, "")]
    rows, want = list(odd), set()
    for i in range(100, 160):
        if i % 3 == 0:
            k = i % 30
            w = items[k][1].split()
            if i % 2:
                w[len(w) // 2] = "changed"
            rows.append((i, f"{text(rng.randint(0, 200), rng)} {' '.join(w)} {text(rng.randint(0, 90), rng)}"))
            want.add((i, k))
        else:
            rows.append((i, text(rng.randint(20, 300), rng)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in lsa.contaminated(frame(spark, rows), bench).collect()}
    assert got == want
    assert lsa.contaminated(frame(spark, rows), bench.where("item_id >= 90")).count() == 0
    assert lsa.contaminated(frame(spark, rows).limit(0), bench).count() == 0
    assert {(r.doc_id, r.item_id) for r in lsa.contaminated(frame(spark, rows), bench, at_once=7).collect()} == want


def all_windows(rows, items):
    """(doc_id, item_id) of the hits among all windows of all documents."""
    out, known = set(), [lsa.item_of(i, t.encode()) for i, t in items]
    for i, t in rows:
        w = lsa.normal([t.encode()])[0].split()
        for x in known:
            n = len(x["words"])
            if any(lsa.verdict(x, w[max(0, s - n) : s + 2 * lsa.BLOCK + n])[0] for s in range(0, len(w), lsa.BLOCK)):
                out.add((i, x["item_id"]))
    return out


def test_op3_matches_all_windows_for_hundreds_of_items(spark):
    rng = random.Random(33)
    # Words of one alphabet each 60 items, so that pieces of 60 items share no words.
    kinds = [["".join(rng.choices(a, k=rng.randint(2, 7))) for _ in range(700)] for a in ("abcdef", "ghijkl", "mnopqr", "stuvwx", "yzabgh")]
    prose = lambda k, n: " ".join(rng.choices(kinds[k], [1 / (j + 3) for j in range(700)], k=n))
    items = [(i, prose(i // 60, rng.randint(15, 59)) + ".") for i in range(300)]
    rows, planted = [], set()
    for i, (k, t) in enumerate(items):
        w = t.rstrip(".").split()
        for j in rng.sample(range(len(w)), (0, len(w) // 10, len(w) // 4)[i % 3]):
            w[j] = "changed"
        rows.append((i, f"{prose(k // 60, rng.randint(0, 120))} {' '.join(w)} {prose(k // 60, rng.randint(0, 120))}"))
        planted.add((i, k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = all_windows(rows, items)
    assert want >= planted
    got = {(r.doc_id, r.item_id) for r in lsa.contaminated(frame(spark, rows), bench).collect()}
    assert got == want


def test_op3_finds_items_of_every_piece(spark):
    rng = random.Random(34)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=9))
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 59)))) for i in range(60)]
    rows = [(i, f"{text(40, rng)} {t} {text(rng.randint(0, 90), rng)}") for i, t in items]
    rows += [(100 + i, " ".join(rng.choices("qrstuvwxyz", k=20_000))) for i in range(150)]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    got = {(r.doc_id, r.item_id) for r in lsa.contaminated(frame(spark, rows), bench, at_once=20).collect()}
    assert got == {(i, i) for i, _ in items}


def test_common_subsequence():
    assert lsa.common_subsequence(list("abcbdab"), list("bdcaba")) == 4
    assert lsa.common_subsequence([], list("ab")) == 0 == lsa.common_subsequence(list("ab"), [])


# --- 4 ------------------------------------------------------------------------------------------------


def within_one(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_op4_matches_brute_force(spark):
    rng = random.Random(4)
    pool = [text(rng.randint(1, 14), rng) for _ in range(25)] + [text(200, rng), "short", "shorn", "", "  ", "x" * 31, "x" * 32, "é" * 20]

    def edited(s):
        i, kind = rng.randrange(len(s) + 1), rng.randrange(4)
        return (s, s[:i] + "q" + s[i:], s[:i] + s[i + 1 :], s[:i] + "z" + s[i + 1 :])[kind]

    rows = [(i, "\n".join(edited(rng.choice(pool)) for _ in range(rng.randint(0, 12)))) for i in range(40)] + [(50, None), (51, "\n\n")]
    seen, want = [], {}
    for i, t in rows:
        want[i] = []
        for k, line in enumerate((t or "").split("\n")):
            if not SPLIT.search(line):
                continue
            if any(line == s or (min(len(line), len(s)) >= 16 and within_one(line, s)) for s in seen):
                want[i].append(k)
            seen.append(line)
    df = frame(spark, [*rows, (60, None), rows[3]])
    got = {r.doc_id: (r.text, r.n_chars, r.n_removed_lines) for r in lines.dedup_lines(df).collect()}
    for i, t in rows:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])
        assert got[i] == (kept, None if kept is None else len(kept), len(want[i]))
    assert lines.dedup_lines(df.limit(0)).count() == 0
    assert lines.dedup_lines(df).columns == [*df.columns, "n_removed_lines"]


# --- 5 ------------------------------------------------------------------------------------------------


def test_op5_round_trip_and_stitching(spark, odd, tmp_path):
    encode = tokens.encoder(tokens.VOCABULARY).encode_ordinary
    rows = [*odd, (8, "<|endoftext|> is text")]
    got = Counter((r.doc_id, r.n_tokens) for r in tokens.document_tokens(frame(spark, rows), waves=2).collect())
    assert got == Counter((i, len(encode(t or ""))) for i, t in rows)
    assert tokens.document_tokens(frame(spark, rows).limit(0)).count() == 0

    import numpy as np

    lengths = [0, 3, 0, 900, 1, 0, 0, 40]
    ids = np.concatenate([np.r_[np.arange(n) % 50, 60000] for n in lengths] + [np.arange(5)]).astype("<u2")
    (tmp_path / "f.bin").write_bytes(ids.tobytes() + b"\x01")
    (tmp_path / "e.bin").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{tmp_path}/{f}", (tmp_path / f).stat().st_size) for f in ("f.bin", "e.bin", "f.bin")] + [(None, 8)], "file string, bytes long")
    for block in (2, 6, 64, 4096):
        got = [(r.ordinal, r.n_tokens, r.complete) for r in tokens.count_tokens(files, end=60000, block_bytes=block).orderBy("ordinal").collect()]
        assert got == [*((i, n, True) for i, n in enumerate(lengths)), (len(lengths), 5, False)]


# --- 6 ------------------------------------------------------------------------------------------------


def brute_components(rows, percent=85):
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def family(rng, n, first, most):
    base, out = text(rng.randint(60, 200), rng).split(), []
    for i in range(n):
        w = list(base)
        kind = rng.randrange(4)
        if kind == 0:
            for k in rng.sample(range(len(w)), rng.randint(0, most)):
                w[k] = rng.choice(WORDS)
        elif kind == 1:
            w = w[: len(w) - rng.randint(0, len(w) // 4)]
        elif kind == 2:
            w = w[rng.randint(0, len(w) // 5) :] + text(rng.randint(0, 12), rng).split()
        else:
            w = out[-1][1].split() if out else w
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append((first + i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    return out


def test_op6_matches_brute_force(spark, odd):
    rng = random.Random(6)
    rows = [(i, t if i != 6 else text(3000, rng)) for i, t in odd] + [(8, "one two"), (9, "ONE two"), (None, "one two"), (30, "z")]
    for f in range(6):
        rows += family(rng, 30, 100 * (f + 1), 5)
    got = near.components_of(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near.components_of(frame(spark, rows).limit(0)).count() == 0
    out = near.stage(spark, frame(spark, rows), None)
    ids = Counter(r.doc_id for r in out.collect())
    assert out.columns == frame(spark, rows).columns and ids[1] == 1 and ids[9] == 0
    want = {i for i, _, c in brute_components(rows) if i is not None and i == c}
    assert {i for i in ids if i is not None} == want and all(n == 1 for i, n in ids.items() if i is not None)


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_op6_members_that_their_centre_does_not_link(spark, percent):
    """Families whose members are mostly too far from any one of them, but link in chains."""
    rng, rows = random.Random(percent), []
    for f in range(4):
        rows += family(rng, 60, 1000 * (f + 1), 14)
    for i in range(40):  # a passage that half of a family adds, and cuts in the same place
        w = rows[i][1].split()
        rows.append((9000 + i, " ".join(w[: len(w) // 2] + rows[100][1].split()[: 10 + i % 7] + w[len(w) // 2 + i % 5 :])))
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near.components_of(frame(spark, rows), percent=percent).collect())
    assert found == brute_components(rows, percent)


def test_op6_stage_judges_rows(spark):
    rng = random.Random(61)
    a, b = text(90, rng), text(90, rng)
    rows = [(None, a), (None, a), (None, a + " more"), (5, b), (5, b), (5, a), (4, b), (None, ""), (None, ""), (7, None), (8, text(40, rng))]
    docs = frame(spark, rows)
    out = Counter((r.doc_id, r.text) for r in near.stage(spark, docs, None).collect())
    assert out == Counter([(5, a), (4, b), (None, ""), (None, ""), (7, None), rows[-1]])
    only = near.stage(spark, docs.where("doc_id is null"), None).collect()
    assert len([r for r in only if r.text]) == 1 and len(only) == 3


# --- 7 ------------------------------------------------------------------------------------------------


def test_op7_base_places_and_fuzzy_notices(spark, odd):
    rows = [*odd, (8, "CC-BY cc by cc by. All rights\nreserved"), (9, "GNU Genaral Public Licence v3"), (10, "Lesser general public license"), (11, "cc byx ccby")]
    got = {r.doc_id: r for r in licences.scan_licences(frame(spark, rows)).collect()}
    assert (got[8].n_words, got[8].n_base, got[8].first_word, got[8].last_word, got[8].base_labels) == (9, 4, 0, 6, "cc-by,reserved")
    assert got[9].n_base == 0 and got[9].labels == "gpl" and 0.8 < got[9].score < 1 and got[9].spans[0].errors == 2 and got[9].spans[0].word == 0
    assert got[10].base_labels == "gpl" and got[10].first_word == 1 and got[10].score == 1.0
    assert got[11].n_base == 0 and got[2].n_words == 0 and got[2].score == 0.0 and got[2].labels == ""
    assert len(licences.scan_licences(frame(spark, rows)).collect()) == len(rows)


def test_pigeonhole_finds_every_bounded_error():
    known, rng = licences.Notices(), random.Random(7)
    for notice, label in licences.NOTICES:
        for _ in range(8):
            s = list(notice)
            for _ in range(len(notice) // licences.CHARS_PER_ERROR):
                i = rng.randrange(1, len(s) - 1)
                s[i] = rng.choice("qxz") if s[i] != " " else s[i]
            assert label in {x[0] for x in known.find(f" aa bb {''.join(s)} cc dd ")}


def test_op7_adjacent_notices_with_different_errors():
    notices = licences.Notices()
    exact, one, two = (f"released under the {x} license" for x in ("mit", "mat", "mab"))
    for parts in ((one, exact), (exact, one), (two, one, exact), (one, exact, two)):
        got = [(a, e) for x, a, _, e, _ in notices.find(f" {' '.join(parts)} ") if x == "mit"]
        assert got == [(1 + i * (len(exact) + 1), (exact, one, two).index(p)) for i, p in enumerate(parts)]


# --- 8 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard_words", [200_000, 700])
def test_op8_meets_its_targets(spark, shard_words):
    rng = random.Random(8)
    rows = [(i, text(rng.randint(0, 120), rng), ["big"] * 20 + ["tiny", "mid", "mid", "mid", None]) for i in range(400)]
    data = [(i, t, rng.choice(s)) for i, t, s in rows] + [(400, None, "big"), (None, "a b", "void"), (401, "", "empty")]
    data += [data[0]]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = mix.mix(df, shard_words=shard_words).collect()
    assert len(out) == len(data)
    per = defaultdict(lambda: [0, 0, 0])
    for r in out:
        assert r["size"] == len(words(r.text)) and 0 <= r.taken <= 3 * r["size"]
        per[r.source][0] += r["size"]
        per[r.source][1] += r.taken
        per[r.source][2] = r.target
    assert abs(sum(t for *_, t in per.values()) - sum(s for s, *_ in per.values())) < 1e-6
    for size, taken, target in per.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 0.01 * target + 130
    again = mix.mix(df.repartition(7), shard_words=shard_words).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.target, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert mix.mix(df.limit(0)).count() == 0
    assert {r.taken for r in mix.mix(df.where("text is null or text = ''")).collect()} == {0}


# --- 9 ------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum((v - 9 if v > 9 else v) for i, c in enumerate(reversed(s)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def passes(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": all(int(p) <= 255 for p in hit.split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def test_op9_matches_brute_force(spark, odd):
    rng = random.Random(9)
    bits = ["a.b@c.de", "_x@y.z", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+49 30 1", "@@", ".", " ", "é", "😀", "12", "-", "+", "a@b.c_d@e.f", "0001.2.3.4", "99999999999999999999.1.1.1", "(", "x"]
    rows = [*odd, *((100 + i, "".join(rng.choices(bits, k=rng.randint(1, 25)))) for i in range(250)), (900, "1 " * 4000), (901, "1.2.3.4 " * 700), (902, "9" * 50_000), (903, "a" * 50_000 + "@")]
    got = Counter()
    for r in pii.scan(frame(spark, rows)).collect():
        got[(r.doc_id, tuple((k, s.start, s.end) for k in pii.BASE_KINDS for s in r[f"pii_{k}"]))] += 1
    want = Counter((i, tuple((k, m.start(), m.end()) for k in BASE for m in re.finditer(BASE[k], t or "") if passes(k, m.group()))) for i, t in rows)
    assert got == want


def test_op9_checksums_and_context(spark):
    rows = [(1, "Pay to account GB82 WEST 1234 5698 7654 32 now"), (2, "Pay to GB82 WEST 1234 5698 7654 33 now"), (3, 'token = "' + "ab12" * 10 + '"'), (4, "commit " + "ab12" * 10), (5, "call 555-123-4567"), (6, "isbn 555-123-4567")]
    got = {r.doc_id: [k for k in pii.KINDS if r[f"pii_{k}"]] for r in pii.scan(frame(spark, rows)).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["token"], 4: [], 5: ["tel"], 6: []}


# --- 10 -----------------------------------------------------------------------------------------------


def test_op10_learns_from_its_rows_alone(spark, odd):
    import zlib

    rng = random.Random(10)
    bad = ["grobian", "fiesling", "ekelbold", "stupid"]
    docs, labels = list(odd), []
    for i in range(100, 900):
        toxic = i % 6 == 0
        w = text(rng.randint(20, 120), rng).split()
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    df, y = frame(spark, docs), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(df, y)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(got[i].held_out == (i in held) for i, _ in labels)
    assert sum(got[i].predicted != t for i, t in labels if i in held) <= 0.02 * len(held)
    flipped = y.rdd.map(lambda r: (r.doc_id, r.toxic if r.doc_id not in held or r.toxic is None else 1 - r.toxic)).toDF(y.schema)
    again = {r.doc_id: r.score for r in toxicity.score(df, toxicity.learn(df, flipped)).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i, _ in labels)
    assert 0 <= got[2].score < 0.5 and got[None].held_out is False and len(toxicity.score(df, model).collect()) == len(docs)
    assert toxicity.score(df.limit(0), toxicity.learn(df.limit(0), y)).count() == 0
    assert toxicity.score(df, toxicity.learn(df, y.limit(0))).where("predicted = 1").count() == 0


def test_label_model_on_votes_of_known_accuracy():
    import numpy as np

    rng = np.random.default_rng(10)
    n, accuracy, cover = 6000, np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7]), np.array([0.6, 0.8, 0.9, 0.7, 0.9, 0.8])
    y = np.where(rng.random(n) < 0.3, 1, -1)
    right = rng.random((n, 6)) < accuracy
    votes = np.where(rng.random((n, 6)) < cover, np.where(right, y[:, None], -y[:, None]), 0)
    # Brute force: what the true accuracies make of each row.
    logit = np.log(0.3 / 0.7) + votes @ np.log(accuracy / (1 - accuracy))
    want = 1 / (1 + np.exp(-logit))
    q, found, together, weight = toxicity.label_model(votes, 0.3)
    assert np.abs(found - accuracy).max() < 0.04 and np.abs(q - want).mean() < 0.03
    assert ((q > 0.5) == (y > 0)).mean() > 0.93 and (weight > 0.8).all()
    # Copies of the worst voter are found by their correlation, and have about one voter's weight together.
    copies = np.column_stack([votes, *[votes[:, 5]] * 4])
    q2, found, together, weight = toxicity.label_model(copies, 0.3)
    assert together[5, 6:].min() > 0.9 and weight[[5, 6, 7, 8, 9]].sum() < 1.3
    assert ((q2 > 0.5) == (y > 0)).mean() > 0.9


def test_op10_reruns_agree_and_hot_ids_are_one(spark):
    rng = random.Random(101)
    rows = [(i % 60, text(20, rng) + (" stupid" if i % 3 == 0 else "")) for i in range(120)] + [(3, "same " * 8)] * 300 + [(None, None)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] * 2 + [(None, 1), (7, None)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    one = toxicity.learn(docs, labels)
    two = toxicity.learn(docs.orderBy(docs.text.desc()).repartition(7), labels.repartition(5))
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all() and one[2] == two[2]
    a = sorted((str(r.doc_id), r.score) for r in toxicity.score(docs, one).collect())
    assert len(a) == len(rows) and all(0 <= s <= 1 for _, s in a)
