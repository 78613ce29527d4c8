import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import similarity as S
from termloom.functions import text as T

CASES = [
    "Data  Mining ", "ﬁne-tuning", "ＦＵＬＬ width", "a b", "tab\there", "Policy (GIS)", "policies", "", "ab", "cafÃ© Ã©x", "what???", "GIS", None,
]


def plain(s):
    return None if s is None else " ".join(unicodedata.normalize("NFKC", s).lower().split())


def test_normalise_matches_plain_python_and_is_idempotent(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "k string")
    n = T.normalise(F.col("k"))
    rows = df.select("k", n.alias("n")).select("k", "n", T.normalise(F.col("n")).alias("again")).collect()
    assert [r.n for r in rows] == [plain(c) for c in CASES]
    assert all(r.n == r.again for r in rows)


def test_split_initials_acronyms_and_malformed(spark):
    df = spark.createDataFrame([("a; b ;;a;  ", "Geographic information system", "x (abc) (De)", "what???"), (None, "one", "none", "fine")], "c string, k string, p string, m string")
    r = df.select(T.split_cell(F.col("c")), T.initials(F.col("k")), T.bracketed_acronyms(F.col("p")), T.is_malformed(F.col("m"))).collect()
    assert tuple(r[0]) == (["a", "b", "a"], "GIS", ["ABC", "DE"], True)
    assert tuple(r[1]) == ([], None, [], False)


def test_free_text_labels_and_fence(spark):
    df = spark.createDataFrame([("They match", " Non-Match ", '```json\n{"a": 1}\n```'), ("not the same, no match", "MATCH", "{}"), ("who knows", "x", "``` 1 ```")], "f string, l string, j string")
    r = df.select(T.free_text_decision(F.col("f")), T.label(F.col("l")), T.strip_fence(F.col("j"))).collect()
    assert [tuple(x) for x in r] == [("match", "non_match", '{"a": 1}'), ("non_match", "match", "{}"), ("uncertain", "x", "1")]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=12), st.text(max_size=12))
def test_jaro_winkler_is_symmetric_and_bounded(a, b):
    x = S.jaro_winkler_pair(a, b)
    assert 0 <= x <= 1 and abs(x - S.jaro_winkler_pair(b, a)) < 1e-12
    assert S.jaro_winkler_pair(a, a) == (1.0 if a else 0.0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abcdXY -", max_size=9), st.text("abcdXY -", max_size=9)), min_size=1, max_size=20))
def test_jaro_winkler_matches_duckdb_on_ascii(pairs):
    import duckdb

    for a, b in pairs:
        if a and b:
            (want,) = duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()
            assert abs(want - S.jaro_winkler_pair(a, b)) < 1e-9


def test_char_grams_pad_words(spark):
    df = spark.createDataFrame([("ab a",)], "n string")
    (grams,) = df.select(S.char_grams(F.col("n"))).first()
    assert sorted(grams) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " a", "a ", " a "])
