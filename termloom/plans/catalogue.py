"""Queries on the driver tables, with their SQL. Corpora: K-parts (article = order, keyword = part name),
K-docs (article = document, keyword = blank-separated token of its whole text), annotators (labels by
language), a decision log made from events, vectors (embeddings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import candidates as C
from ..operators import evaluate as E
from ..operators import network as N
from ..operators import profile as P
from ..operators import verify as V
from .scratch import materialise

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- corpora ------------------------------------------------------------------------------------------


def parts(spark, d) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("keyword"))
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), "l_partkey")
    return x.join(p, F.col("l_partkey") == F.col("p_partkey")).select("article_id", "keyword")


PARTS = "parts as (select l_orderkey as article_id, p_name as keyword from lineitem join part on l_partkey = p_partkey)"


def tokens(spark, d) -> DataFrame:
    x = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.explode(F.split("text", r"\s+")).alias("keyword"))
    return x.where("keyword <> ''")


TOKENS = r"tokens as (select doc_id as article_id, unnest(string_split_regex(text, '\s+')) as keyword from documents), tok as (select * from tokens where keyword <> '')"


def doc_vocabulary(spark, d) -> DataFrame:
    """Keyword, normal form and document frequency of all tokens, made once and written."""
    return materialise(C.vocabulary(P.document_frequency(tokens(spark, d))), "vocabulary")


VOCAB = TOKENS + ", voc as materialized (select keyword, lower(keyword) as norm, count(distinct article_id) as frequency from tok group by keyword)"


def part_vocabulary(spark, d) -> DataFrame:
    return C.vocabulary(P.document_frequency(parts(spark, d)))


PVOC = PARTS + ", pvoc as (select keyword, lower(keyword) as norm, count(distinct article_id) as frequency from parts group by keyword)"


# --- profiles -----------------------------------------------------------------------------------------


@query(f"with {TOKENS} select keyword, count(*) as frequency from tok group by keyword")
def kw_frequency_occ(spark, d):
    return P.occurrence_frequency(tokens(spark, d))


@query(f"with {TOKENS} select keyword, count(distinct article_id) as frequency from tok group by keyword")
def kw_frequency_doc(spark, d):
    return P.document_frequency(tokens(spark, d))


@query(f"""with {TOKENS}, f as (select keyword, count(*) as n from tok group by keyword)
select case when n >= 100 then '>=100' when n >= 50 then '50-99' when n >= 10 then '10-49' when n >= 5 then '5-9' when n >= 2 then '2-4' else '1' end as band,
count(*) as n_keywords, sum(n)::bigint as n_occurrences from f group by 1""")
def kw_freq_bands(spark, d):
    return P.bands(P.occurrence_frequency(tokens(spark, d)))


@query(f"""with {TOKENS}, f as (select keyword, count(*) as n from tok group by keyword)
select sum(n)::bigint as n_occurrences, count(*) as n_unique, count(*) filter (n = 1) as n_singletons, count(*) filter (n = 1)::double / count(*) as singleton_share,
count(*) filter (n >= 5) as n_from_5, count(*) filter (n >= 10) as n_from_10 from f""")
def kw_profile(spark, d):
    return P.summary(P.occurrence_frequency(tokens(spark, d)))


@query(f"with {TOKENS} select keyword, count(*) as frequency from tok group by keyword order by 2 desc, 1 limit 20")
def kw_top20(spark, d):
    return P.top(P.occurrence_frequency(tokens(spark, d)))


@query(f"with {TOKENS} select keyword, count(*) as frequency from tok group by keyword order by 2, 1 limit 20")
def kw_bottom20(spark, d):
    return P.bottom(P.occurrence_frequency(tokens(spark, d)))


@query("select count(*) as n_records, count(*) filter (trim(text) <> '') as n_with, count(*) - count(*) filter (trim(text) <> '') as n_without from documents")
def kw_coverage(spark, d):
    return P.coverage(table(spark, d, "documents"), "text")


@query("""select unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) as "column",
unnest([count(p_partkey), count(p_name), count(p_brand), count(p_type), count(p_size), count(p_retailprice)]) as n_present from part""")
def column_inventory(spark, d):
    return P.inventory(table(spark, d, "part")).select("column", "n_present")


@query("""with l as (select *, concat_ws('|', p_partkey::varchar, coalesce(p_name, ''), coalesce(p_brand, '')) as s from part)
select count(*) as n_rows, (sum(('0x' || substr(sha256(s), 1, 15))::bigint::hugeint) % 1152921504606846976)::varchar as digest from l""")
def corpus_checksum(spark, d):
    return P.checksum(table(spark, d, "part"), ["p_partkey", "p_name", "p_brand"])


@query("""with u as (select *, 0 as b from customer union all select *, 1 as b from customer)
select c_custkey, c_name, b from (select *, row_number() over (partition by c_nationkey order by b, c_custkey) as pos from u) where pos = 1""")
def dedup_first_row(spark, d):
    c = table(spark, d, "customer")
    u = c.withColumn("b", F.lit(0)).unionByName(c.withColumn("b", F.lit(1)))
    return P.first_rows(u, "c_nationkey", ["b", "c_custkey"]).select("c_custkey", "c_name", "b")


@query(rf"with {TOKENS} select distinct keyword, lower(keyword) as norm, regexp_replace(lower(keyword), '[-/(). ]', '', 'g') as stripped from tok")
def normalise_tokens(spark, d):
    n = T.normalise(F.col("keyword"))
    return tokens(spark, d).select("keyword").distinct().select("keyword", n.alias("norm"), T.strip_punctuation(n).alias("stripped"))


@query("""with c as (select p_brand, string_agg(p_name, ' ; ' order by p_partkey) || ';; ' as cell from part group by p_brand),
k as (select p_brand, unnest(list_filter(list_transform(string_split(cell, ';'), lambda x: trim(x)), lambda x: x <> '')) as keyword from c)
select p_brand as article_id, keyword, count(*) as n from k group by 1, 2""")
def split_cells(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    cells = p.select("p_brand", F.concat(F.array_join(F.transform("x", lambda s: s["p_name"]), " ; "), F.lit(";; ")).alias("cell"))
    return P.explode_keywords(cells, "p_brand", "cell").groupBy("article_id", "keyword").agg(F.count(F.lit(1)).alias("n"))


# --- candidates ---------------------------------------------------------------------------------------

_PAIR = "least(a.keyword, b.keyword) as keyword_a, greatest(a.keyword, b.keyword) as keyword_b"
_PN = """ca as (select list(keyword) as ks from voc group by norm having count(*) > 1), cb as (select ks, unnest(ks) as a from ca), cc as (select a, unnest(ks) as b from cb),
pn as (select keyword, regexp_replace(norm, '[-/(). ]', '', 'g') as k from voc), pa as (select list(keyword) as ks from pn where length(k) >= 3 group by k having count(*) > 1),
pb as (select ks, unnest(ks) as a from pa), pc as (select a, unnest(ks) as b from pb)"""
_CASE = "select a as keyword_a, b as keyword_b, 'i' as stratum, 'capitalisation_whitespace' as retrieval_method, 1.0::double as similarity_score from cc where a < b"
_PUNCT = "select a as keyword_a, b as keyword_b, 'iv' as stratum, 'punctuation_hyphenation' as retrieval_method, 0.95::double as similarity_score from pc where a < b"
_REP = "rep as (select norm, arg_min(keyword, (-frequency, keyword)) as keyword from voc group by norm)"
_PLURAL = " union all ".join(
    f"select {_PAIR}, 'v' as stratum, '{m}' as retrieval_method, 0.9::double as similarity_score from rep a join rep b on b.norm = {k} where a.keyword <> b.keyword{w}"
    for m, k, w in (
        ("singular_plural_s", "a.norm || 's'", ""), ("singular_plural_es", "a.norm || 'es'", ""),
        ("singular_plural_ies_y", "left(a.norm, length(a.norm) - 3) || 'y'", " and a.norm like '%ies' and length(a.norm) > 4"),
    )
)


@query(f"with {VOCAB}, {_PN} {_CASE}")
def cand_case(spark, d):
    return C.case_variants(doc_vocabulary(spark, d))


@query(f"with {VOCAB}, {_PN} {_PUNCT}")
def cand_punct(spark, d):
    return C.punctuation_variants(doc_vocabulary(spark, d))


@query(f"with {VOCAB}, {_REP} {_PLURAL}")
def cand_plural(spark, d):
    return C.plural_variants(doc_vocabulary(spark, d))


_JW = """select least(a.keyword, b.keyword) as keyword_a, greatest(a.keyword, b.keyword) as keyword_b, 'ii' as stratum, 'jaro_winkler' as retrieval_method,
round(jaro_winkler_similarity(a.norm, b.norm), 4) as similarity_score from pvoc a join pvoc b on left(a.norm, 3) = left(b.norm, 3) and a.norm < b.norm
where a.frequency >= 2 and b.frequency >= 2 and length(a.norm) >= 4 and length(b.norm) >= 4
and least(length(a.norm), length(b.norm)) >= 0.6 * greatest(length(a.norm), length(b.norm)) and jaro_winkler_similarity(a.norm, b.norm) >= 0.85 and jaro_winkler_similarity(a.norm, b.norm) < 0.95"""


@query(f"with {PVOC} {_JW}")
def cand_jw_block(spark, d):
    return C.spelling_variants(part_vocabulary(spark, d))


@query(None)
def cand_jw_block_docs(spark, d):
    """Spelling variants among all tokens of two documents or more, at any script."""
    return C.spelling_variants(doc_vocabulary(spark, d))


def acronym_vocabulary(spark, d) -> DataFrame:
    n = table(spark, d, "part").select("p_name").distinct()
    short = T.initials(F.col("p_name"))
    return n.select(F.explode(F.array(F.col("p_name"), short, F.concat("p_name", F.lit(" ("), short, F.lit(")")))).alias("keyword")).where("keyword is not null").distinct()


_ACRO = r"""n as (select distinct p_name from part), i as (select p_name, upper(left(string_split(p_name, ' ')[1], 1) || left(string_split(p_name, ' ')[2], 1)) as s from n),
k as (select p_name as keyword from i union select s from i union select p_name || ' (' || s || ')' from i),
short as (select keyword as s, upper(trim(keyword)) as key from k where regexp_full_match(trim(keyword), '[A-Z]{2,6}')),
long as (select keyword as l, upper(regexp_extract(keyword, '\(([A-Za-z]{2,6})\)', 1)) as key from k where regexp_matches(keyword, '\([A-Za-z]{2,6}\)')
 union select keyword, upper(array_to_string(list_transform(string_split_regex(keyword, '[\s\-/]+'), lambda w: left(w, 1)), '')) from k where len(string_split_regex(keyword, '[\s\-/]+')) >= 2)"""


@query(f"""with {_ACRO} select distinct least(s, l) as keyword_a, greatest(s, l) as keyword_b, 'iii' as stratum, 'acronym_expansion' as retrieval_method, 0.95::double as similarity_score
from short join long using (key) where s <> l and length(l) > length(s)""")
def cand_acronym(spark, d):
    return C.acronyms(acronym_vocabulary(spark, d))


_ALL = f"{_CASE} union all {_PUNCT} union all {_PLURAL}"
_CLAIM = f"""with {VOCAB}, {_PN}, {_REP}, al as ({_ALL}), r as (select *, row_number() over (partition by keyword_a, keyword_b
order by list_position(['i', 'ii', 'iv', 'v', 'ix', 'iii', 'vi', 'vii', 'viii', 'x'], stratum), retrieval_method, similarity_score desc) as pos from al)"""


def _claimed(spark, d):
    v = doc_vocabulary(spark, d)
    return C.first_claim(C.case_variants(v).unionByName(C.punctuation_variants(v)).unionByName(C.plural_variants(v)))


@query(f"{_CLAIM} select keyword_a, keyword_b, stratum, retrieval_method, similarity_score from r where pos = 1")
def cand_dedup_priority(spark, d):
    return _claimed(spark, d)


@query(f"{_CLAIM} select stratum, count(*) as n_pairs from r where pos = 1 group by stratum")
def cand_stratum_counts(spark, d):
    return C.stratum_counts(_claimed(spark, d))


@query(f"{_CLAIM} select keyword_a, keyword_b, stratum, printf('RAW%06d', row_number() over (order by stratum, keyword_a, keyword_b)) as pair_id from r where pos = 1")
def cand_pair_ids(spark, d):
    return C.with_ids(_claimed(spark, d)).select("keyword_a", "keyword_b", "stratum", "pair_id")


@query(rf"""with {VOCAB} select keyword, length(keyword) < 3 or regexp_matches(keyword, 'â€|Ã[^A-Za-z]|Ã©|â€™|â€œ|Â©|â„¢|\\u[0-9a-f]{{4}}|&#[0-9]+;', 'i')
or regexp_matches(keyword, '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\s]{{3,}}') as malformed from voc""")
def malformed_flags(spark, d):
    return doc_vocabulary(spark, d).select("keyword", T.is_malformed(F.col("keyword")).alias("malformed"))


@query(None)
def malformed_nearest(spark, d):
    return C.malformed_nearest(doc_vocabulary(spark, d))


@query(f"""with {PVOC} select a.keyword as keyword_a, b.keyword as keyword_b, round(jaro_winkler_similarity(a.norm, b.norm), 9) as score,
lower(a.keyword) = lower(b.keyword) as exact_ci, a.norm = b.norm as exact_norm from pvoc a join pvoc b on left(a.norm, 1) = left(b.norm, 1) and a.keyword < b.keyword""")
def jw_scores(spark, d):
    v = part_vocabulary(spark, d)
    a = v.select(F.col("keyword").alias("keyword_a"), F.col("norm").alias("na"), F.substring("norm", 1, 1).alias("k"))
    b = v.select(F.col("keyword").alias("keyword_b"), F.col("norm").alias("nb"), F.substring("norm", 1, 1).alias("k"))
    x = a.join(b, "k").where("keyword_a < keyword_b")
    return x.select("keyword_a", "keyword_b", F.round(S.jaro_winkler(F.col("na"), F.col("nb")), 9).alias("score"), (F.lower("keyword_a") == F.lower("keyword_b")).alias("exact_ci"), (F.col("na") == F.col("nb")).alias("exact_norm"))


@query(rf"""with {PVOC}, w as (select keyword, ' ' || unnest(string_split_regex(norm, '\s+')) || ' ' as p from pvoc),
g as (select keyword, unnest(list_concat(list_transform(generate_series(1, greatest(length(p) - 1, 1)), lambda i: p[i:i + 1]),
 case when length(p) > 2 then list_transform(generate_series(1, length(p) - 2), lambda i: p[i:i + 2]) else [] end,
 case when length(p) > 3 then list_transform(generate_series(1, length(p) - 3), lambda i: p[i:i + 3]) else [] end)) as gram from w),
tf as (select keyword, gram, count(*) as tf from g group by 1, 2), df as (select gram, count(*) as df from tf group by 1), n as (select count(*) as n from pvoc),
v as (select keyword, gram, tf * (ln((1 + n) / (1 + df)::double) + 1) as w from tf join df using (gram), n),
l as (select keyword, sqrt(sum(w * w)) as l from v group by 1), u as (select keyword, gram, w / l as w from v join l using (keyword))
select a.keyword as keyword_a, b.keyword as keyword_b, round(sum(a.w * b.w), 6) as similarity from u a join u b on a.gram = b.gram and a.keyword < b.keyword group by 1, 2""")
def tfidf_cosine_pairs(spark, d):
    v = S.tfidf(part_vocabulary(spark, d), "keyword", "norm")
    b = v.select(F.col("keyword").alias("keyword_b"), "gram", F.col("w").alias("w2"))
    x = v.join(b, "gram").where("keyword < keyword_b").groupBy(F.col("keyword").alias("keyword_a"), "keyword_b")
    return x.agg(F.round(F.sum(F.col("w") * F.col("w2")), 6).alias("similarity"))


_KNN = """v as (select vec_id, embedding::double[] as e from embeddings), n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as l from v),
p as (select a.vec_id, b.vec_id as neighbour, round(list_inner_product(a.e, b.e) / (a.l * b.l), 12) as s from n a join n b on a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by vec_id order by s desc, neighbour) as rank from p)"""


@query(f"with {_KNN} select vec_id, neighbour, round(s, 6) as similarity, rank from r where rank <= 5")
def knn_cosine_top5(spark, d):
    x = S.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 5)
    return x.select("vec_id", "neighbour", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"""with {_KNN}, q as (select printf('v%06d', vec_id) as a, printf('v%06d', neighbour) as b, s from r where rank <= 5 and s >= 0.3 and s < 0.6),
c as (select least(a, b) as keyword_a, greatest(a, b) as keyword_b, case when s >= 0.45 then 'vi' when s >= 0.4 then 'vii' else 'x' end as stratum, round(s, 4) as similarity_score from q)
select distinct keyword_a, keyword_b, stratum, similarity_score from c""")
def knn_bands(spark, d):
    name = lambda c: F.format_string("v%06d", F.col(c))
    x = S.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 5)
    x = x.select(name("vec_id").alias("keyword"), name("neighbour").alias("neighbour"), "similarity", "rank", F.lit(False).alias("short"))
    return C.embedding_bands(x, (0.6, 0.45, 0.4, 0.3)).select("keyword_a", "keyword_b", "stratum", "similarity_score")


@query(f"""with {_KNN}, k as (select printf('%x', vec_id + 16) as a, printf('%x', neighbour + 16) as b, s, rank from r where rank <= 5),
q as (select *, length(a) between 2 and 4 and a <> upper(a) as short from k where s >= 0.3 and s < 0.6),
c as (select least(a, b) as keyword_a, greatest(a, b) as keyword_b, case when short then 'viii' when s >= 0.45 then 'vi' when s >= 0.4 then 'vii' else 'x' end as stratum, round(s, 4) as similarity_score from q where rank <= case when short then 3 else 5 end),
o as (select *, row_number() over (partition by keyword_a, keyword_b order by list_position(['vi', 'vii', 'viii', 'x'], stratum)) as pos from c)
select keyword_a, keyword_b, stratum, similarity_score from o where pos = 1""")
def knn_short_ambiguous(spark, d):
    """Neighbours of keyword strings, short ambiguous ones apart."""
    e = table(spark, d, "embeddings").select(F.format_string("%x", F.col("vec_id") + 16).alias("keyword"), "embedding")
    vocab = e.select("keyword", F.col("keyword").alias("norm"))
    return C.embedding_bands(C.keyword_neighbours(vocab, e), (0.6, 0.45, 0.4, 0.3)).select("keyword_a", "keyword_b", "stratum", "similarity_score")


@query(r"""with k as (select distinct p_name as keyword, lower(p_name) as norm from part), t as (select keyword, unnest(list_distinct(list_filter(string_split_regex(norm, '[\s\-/]+'),
lambda w: w <> '' and w not in ('and', 'of', 'the', 'in', 'for', 'a', 'an')))) as token from k)
select a.keyword as keyword_a, b.keyword as keyword_b, count(*) as n_shared from t a join t b on a.token = b.token and a.keyword < b.keyword group by 1, 2 having count(*) >= 1""")
def shared_tokens(spark, d):
    x = table(spark, d, "part").select(F.col("p_name").alias("keyword")).distinct()
    return C.shared_token_pairs(x.select("keyword", F.lower("keyword").alias("norm")))


@query("select (select count(*) from lineitem) as n_before, (select count(distinct l_orderkey) from lineitem) as n_keys_before, (select count(distinct l_orderkey) from lineitem) as n_after, (select count(distinct l_orderkey) from lineitem) as n_keys_after, (select count(*) - count(distinct l_orderkey) from lineitem) as n_removed")
def dedup_before_after(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return P.before_after(x, P.first_rows(x, "l_orderkey", ["l_linenumber", "l_partkey"]), "l_orderkey")


# --- evaluation and annotation -------------------------------------------------------------------------

_LABEL = "case when {0} = 1 then 'match' else 'non_match' end"


def annotated(spark, d) -> DataFrame:
    """Labels as gold, the two marks of a row as annotators, and predictions by rule that abstain at times."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    name = lambda c: F.when(c, "match").otherwise("non_match")
    return x.select(
        F.col("doc_id").alias("pair_id"), F.col("lang").alias("stratum"), "n_chars", name(F.col("quality") == 1).alias("gold_label"),
        name(F.col("toxic") == 0).alias("second"), (F.least(F.col("n_chars"), F.lit(4000)) / 4000).alias("score"),
        F.when(F.col("n_chars") < 400, "uncertain").otherwise(name(F.col("n_chars") < 3000)).alias("by_length"),
        F.when(F.col("n_chars") % 11 == 0, "uncertain").otherwise(name(F.col("lang") == "en")).alias("by_lang"),
    )


ANNOTATED = """ann as (select doc_id as pair_id, lang as stratum, n_chars, case when quality = 1 then 'match' else 'non_match' end as gold_label,
case when toxic = 0 then 'match' else 'non_match' end as second, least(n_chars, 4000) / 4000.0::double as score,
case when n_chars < 400 then 'uncertain' when n_chars < 3000 then 'match' else 'non_match' end as by_length,
case when n_chars % 11 = 0 then 'uncertain' when lang = 'en' then 'match' else 'non_match' end as by_lang from labels join documents using (doc_id))"""


def _metrics_sql(source: str, by: str) -> str:
    return f"""m as (select {by}, count(*) as n, count(*) filter (gold_label = predicted) as same, count(*) filter (predicted = 'uncertain') as unsure,
count(*) filter (gold_label = 'match' and predicted = 'match') as tp, count(*) filter (gold_label = 'non_match' and predicted = 'match') as fp,
count(*) filter (gold_label = 'match' and predicted <> 'match') as fn from {source} group by {by}),
pr as (select *, case when n > unsure then coalesce(tp::double / nullif(tp + fp, 0), 0.0) else 0.0 end::double as p, case when n > unsure then coalesce(tp::double / nullif(tp + fn, 0), 0.0) else 0.0 end::double as r from m),
met as (select {by}, n, round(p, 4) as precision, round(r, 4) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0)::double, 4) as f1,
round((1 - unsure / n::double)::double, 4) as coverage, round(unsure / n::double, 4) as uncertain_rate, round(same / n::double, 4) as three_way_acc from pr)"""


_METHODS = "long as (select pair_id, gold_label, 'by_length' as method, by_length as predicted from ann union all select pair_id, gold_label, 'by_lang', by_lang from ann)"


@query(f"with {ANNOTATED}, {_METHODS}, {_metrics_sql('long', 'method')} select * from met")
def metrics_by_method(spark, d):
    return E.by_method(annotated(spark, d).select("pair_id", "gold_label", "by_length", "by_lang"), ["by_length", "by_lang"])


@query(f"""with {ANNOTATED}, {_METHODS}, {_metrics_sql('long', 'method')} select met.*, round(f1 - (select f1 from met where method = 'by_length'), 4) as delta_f1 from met""")
def ablation_deltas(spark, d):
    return E.versus(metrics_by_method(spark, d), "by_length")


_SWEEP = f"""with {ANNOTATED}, t as (select x / 100.0::double as threshold from generate_series(5, 95) g(x)),
s as (select threshold, gold_label, case when score >= threshold then 'match' else 'non_match' end as predicted from ann, t), {_metrics_sql('s', 'threshold')}"""


@query(f"{_SWEEP} select * from met")
def threshold_sweep(spark, d):
    return E.sweep(annotated(spark, d).select("gold_label", "score"), E.grid(spark, 5, 95))


@query(f"{_SWEEP} select * from met order by f1 desc, threshold limit 1")
def best_threshold(spark, d):
    return E.best_threshold(threshold_sweep(spark, d))


_ERROR = """err as (select *, case when gold_label = 'match' and by_length = 'match' then 'TP' when gold_label = 'non_match' and by_length = 'non_match' then 'TN'
when gold_label = 'non_match' and by_length = 'match' then 'FP' when gold_label = 'match' and by_length = 'non_match' then 'FN'
when gold_label = 'uncertain' and by_length = 'uncertain' then 'Correct_Abstention' when by_length = 'uncertain' then 'Incorrect_Abstention'
when gold_label = 'uncertain' then 'Missed_Abstention' else 'Other' end as error from ann)"""


def _errors(spark, d):
    return annotated(spark, d).withColumn("error", E.error_class("gold_label", "by_length"))


@query(f"with {ANNOTATED}, {_ERROR} select error, count(*) as n from err group by error")
def error_classes(spark, d):
    return _errors(spark, d).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {ANNOTATED}, {_ERROR} select stratum, error, count(*) as n from err group by 1, 2")
def error_by_stratum(spark, d):
    return _errors(spark, d).groupBy("stratum", "error").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {ANNOTATED}, {_ERROR} select error, pair_id from (select *, row_number() over (partition by error order by pair_id) as pos from err) where pos <= 3")
def error_examples(spark, d):
    return E.examples(_errors(spark, d), "error", "pair_id").select("error", "pair_id")


_KAPPA = """select {by} count(*) as n_pairs, count(*) filter (gold_label = second) as n_agree, 100 * count(*) filter (gold_label = second) / count(*)::double as pct_agreement,
round((count(*) filter (gold_label = second) / count(*)::double - pe) / nullif(1 - pe, 0), 9) as cohen_kappa from (select *, (count(*) filter (gold_label = 'match') over w * (count(*) filter (second = 'match') over w)
+ count(*) filter (gold_label = 'non_match') over w * (count(*) filter (second = 'non_match') over w)) / (count(*) over w * count(*) over w)::double as pe from ann window w as ({part})) group by {group} pe"""


@query(f"with {ANNOTATED} {_KAPPA.format(by='', part='', group='')}")
def kappa_overall(spark, d):
    return E.kappa(annotated(spark, d), "gold_label", "second").withColumn("cohen_kappa", F.round("cohen_kappa", 9))


@query(f"with {ANNOTATED} {_KAPPA.format(by='stratum,', part='partition by stratum', group='stratum,')}")
def kappa_by_stratum(spark, d):
    x = annotated(spark, d)
    return E.kappa_by(x, "gold_label", "second", "stratum", x.select("stratum").distinct()).withColumn("cohen_kappa", F.round("cohen_kappa", 9))


@query(f"""with {ANNOTATED}, l as (select unnest(['match', 'non_match', 'uncertain']) as gold_label) select l.gold_label, count(*) filter (second = 'match') as "match",
count(*) filter (second = 'non_match') as non_match, count(*) filter (second = 'uncertain') as uncertain from l left join ann using (gold_label) group by 1""")
def confusion(spark, d):
    return E.confusion(annotated(spark, d), "gold_label", "second")


_GOLD = "gold as (select *, case when gold_label = second then gold_label else by_lang end as final, case when gold_label = second then 'agreed' else 'adjudicated' end as agreement_status from ann)"


@query(f"with {ANNOTATED}, {_GOLD} select pair_id, final, agreement_status from gold")
def gold_assign(spark, d):
    label, status = E.gold("gold_label", "second", "by_lang")
    return annotated(spark, d).select("pair_id", label.alias("final"), status.alias("agreement_status"))


@query(f"""with {ANNOTATED}, {_GOLD} select coalesce(stratum, 'TOTAL') as stratum, count(*) filter (final = 'match') as "match", count(*) filter (final = 'non_match') as non_match,
count(*) filter (final = 'uncertain') as uncertain, count(*) as total, round(100.0::double * count(*) filter (final = 'match') / count(*), 2) as pct_match from gold group by rollup(stratum)""")
def gold_crosstab(spark, d):
    label, _ = E.gold("gold_label", "second", "by_lang")
    return E.crosstab(annotated(spark, d).withColumn("final", label), "stratum", "final")


@query(f"""with {ANNOTATED}, t as (select distinct stratum, 20 as target from ann), r as (select ann.*, target, row_number() over (partition by stratum order by sha256('42|' || pair_id::varchar), pair_id) as pos from ann join t using (stratum))
select pair_id, stratum from r where pos <= target""")
def stratified_sample(spark, d):
    x = annotated(spark, d)
    return E.stratified_sample(x, x.select("stratum").distinct().withColumn("target", F.lit(20)), "stratum", ["pair_id"]).select("pair_id", "stratum")


_SPLIT = f"""with {ANNOTATED}, r as (select *, row_number() over (partition by stratum, gold_label order by sha256('42|' || pair_id::varchar), pair_id) as pos, count(*) over (partition by stratum, gold_label) as n from ann),
sp as (select pair_id, stratum, gold_label, case when n = 1 or pos <= round_even(n * 0.7::double, 0) then 'dev' else 'test' end as split from r)"""


@query(f"{_SPLIT} select pair_id, split from sp")
def stratified_split(spark, d):
    return E.stratified_split(annotated(spark, d), ["stratum", "gold_label"], ["pair_id"]).select("pair_id", "split")


@query(f"""{_SPLIT}, t as (select split, count(*) as t from sp group by 1), c as (select stratum, split, 100.0::double * count(*) / any_value(t) as p from sp join t using (split) group by 1, 2),
w as (select stratum, coalesce(max(p) filter (split = 'dev'), 0) as pct_dev, coalesce(max(p) filter (split = 'test'), 0) as pct_test from c group by 1)
select *, abs(pct_dev - pct_test) <= 5 as within from w""")
def split_verification(spark, d):
    return E.split_check(E.stratified_split(annotated(spark, d), ["stratum", "gold_label"], ["pair_id"]), "stratum")


# --- verification and guard ------------------------------------------------------------------------------


def answers(spark, d) -> DataFrame:
    """A decision log made from events: answers of every shape, some malformed, several per pair."""
    e, k = table(spark, d, "events"), F.col("event_id") % 8
    decision = F.when(F.col("event_type").isin("view", "click"), "match").when(F.col("event_type") == "error", "Non_Match").otherwise("UNCERTAIN")
    hundredths = F.least(F.col("value"), F.lit(150.0)).cast("int")
    conf = F.format_string("%d.%02d", F.floor(hundredths / 100).cast("int"), hundredths % 100)
    good = F.concat(F.lit('{"decision": "'), decision, F.lit('", "confidence": '), conf, F.lit(', "justification": "x"}'))
    response = (
        F.when(k == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(k == 2, F.lit("no json here")).when(k == 3, F.lit('{"decision": "match"}'))
        .when(k == 4, F.lit('{"decision": "maybe", "confidence": 0.9, "justification": "y"}')).when(k == 5, F.lit("[1, 2]")).otherwise(good)
    )
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("pair_id"), "event_type", response.alias("response"), (F.col("value") / 1000).alias("price"))


LOG_SQL = """lg as (select event_id as seq, user_id as pair_id, event_type, value / 1000 as price, event_id % 8 as k,
case when event_type in ('view', 'click') then 'match' when event_type = 'error' then 'non_match' else 'uncertain' end as dec, trunc(least(value, 150.0))::int / 100.0::double as c0 from events),
gu as (select *, case when k = 2 then 'G1' when k in (3, 5) then 'G2' when k = 4 then 'G3' when dec <> 'uncertain' and greatest(least(c0, 1), 0) < 0.5 then 'G4' end as guard_applied,
case when k in (2, 3, 5) then case when k = 3 then 0.0 else 0.0 end when k = 4 then 0.9 else greatest(least(c0, 1), 0) end::double as guard_confidence from lg),
gd as (select *, case when guard_applied is not null then 'uncertain' else dec end as guard_decision from gu)"""


@query(f"with {LOG_SQL} select seq, guard_decision, guard_confidence, guard_applied from gd")
def guard_apply(spark, d):
    return V.guarded(answers(spark, d)).select("seq", "guard_decision", "guard_confidence", "guard_applied")


@query(f"with {LOG_SQL} select guard_applied, guard_decision, count(*) as n from gd group by 1, 2")
def guard_histogram(spark, d):
    return V.guarded(answers(spark, d)).groupBy("guard_applied", "guard_decision").agg(F.count(F.lit(1)).alias("n"))


_SWEEP = f"""{LOG_SQL}, la as (select *, row_number() over (partition by pair_id order by seq desc) as pos from lg),
pg as (select c_custkey as pair_id, case when c_acctbal > 0 then 'match' else 'non_match' end as gold_label from customer),
th as (select unnest(generate_series(50, 95, 5)) / 100.0::double as threshold),
sw as (select threshold, gold_label, case when la.pair_id is null or k in (2, 3, 4, 5) then 'uncertain' when dec <> 'uncertain' and greatest(least(c0, 1), 0) >= threshold then dec else 'uncertain' end as predicted
from pg left join la on la.pair_id = pg.pair_id and la.pos = 1, th),
{_metrics_sql("sw", "threshold")}"""


def _swept(spark, d):
    gold = F.when(F.col("c_acctbal") > 0, "match").otherwise("non_match")
    pairs = table(spark, d, "customer").select(F.col("c_custkey").alias("pair_id"), gold.alias("gold_label"))
    return V.guard_sweep(pairs, answers(spark, d), E.grid(spark, 50, 95, 5))


@query(f"with {_SWEEP} select * from met")
def guard_replay_sweep(spark, d):
    return _swept(spark, d)


@query(f"with {_SWEEP} select coalesce(max(threshold), 0.5::double) as threshold, max(f1) as f1, max(coverage) as coverage from (select threshold, f1, coverage from met where coverage >= 0.1 order by f1 desc, threshold limit 1)")
def guard_best_threshold(spark, d):
    return V.best_guard(_swept(spark, d), 0.1)


@query(f"with {LOG_SQL} select seq, case when k = 2 then 'malformed_parse_failure' when k = 3 then 'malformed_missing_field:confidence,justification' when k = 5 then 'malformed_missing_field:confidence,decision,justification' when k = 4 then 'invalid_decision:maybe' when guard_applied = 'G4' then printf('confidence_%.3f_below_threshold_%.3f', guard_confidence, 0.5::double) end as guard_reason from gd")
def guard_reasons(spark, d):
    return V.guarded(answers(spark, d)).select("seq", "guard_reason")


@query(f"with {LOG_SQL} select seq, case when k in (2, 3, 4, 5) then 'uncertain' when dec = 'uncertain' then 'non_match' else dec end as guard_decision from lg")
def guard_forced_binary(spark, d):
    return V.guarded(answers(spark, d), guard=V.Guard(allow_uncertain=False)).select("seq", "guard_decision")


_SWEEP = f"""{LOG_SQL}, la as (select *, row_number() over (partition by pair_id order by seq desc) as pos from lg),
pg as (select c_custkey as pair_id, case when c_acctbal > 0 then 'match' else 'non_match' end as gold_label from customer),
th as (select unnest(generate_series(50, 95, 5)) / 100.0::double as threshold),
sw as (select threshold, gold_label, case when la.pair_id is null or k in (2, 3, 4, 5) then 'uncertain' when dec <> 'uncertain' and greatest(least(c0, 1), 0) >= threshold then dec else 'uncertain' end as predicted
from pg left join la on la.pair_id = pg.pair_id and la.pos = 1, th),
{_metrics_sql("sw", "threshold")}"""


def _swept(spark, d):
    gold = F.when(F.col("c_acctbal") > 0, "match").otherwise("non_match")
    pairs = table(spark, d, "customer").select(F.col("c_custkey").alias("pair_id"), gold.alias("gold_label"))
    return V.guard_sweep(pairs, answers(spark, d), E.grid(spark, 50, 95, 5))


@query(f"with {_SWEEP} select * from met")
def guard_replay_sweep(spark, d):
    return _swept(spark, d)


@query(f"with {_SWEEP} select coalesce(max(threshold), 0.5::double) as threshold, max(f1) as f1, max(coverage) as coverage from (select threshold, f1, coverage from met where coverage >= 0.1 order by f1 desc, threshold limit 1)")
def guard_best_threshold(spark, d):
    return V.best_guard(_swept(spark, d), 0.1)


@query(f"with {LOG_SQL} select seq, case when k = 2 then 'malformed_parse_failure' when k = 3 then 'malformed_missing_field:confidence,justification' when k = 5 then 'malformed_missing_field:confidence,decision,justification' when k = 4 then 'invalid_decision:maybe' when guard_applied = 'G4' then printf('confidence_%.3f_below_threshold_%.3f', guard_confidence, 0.5::double) end as guard_reason from gd")
def guard_reasons(spark, d):
    return V.guarded(answers(spark, d)).select("seq", "guard_reason")


@query(f"with {LOG_SQL} select seq, case when k in (2, 3, 4, 5) then 'uncertain' else dec end as raw_decision from lg")
def raw_decisions(spark, d):
    return V.raw_decision(answers(spark, d)).select("seq", "raw_decision")


@query(f"with {LOG_SQL}, t as (select seq, price, coalesce(sum(price::decimal(30, 6)) over (order by seq rows between unbounded preceding and 1 preceding), 0)::double as total_before from lg) select seq, total_before from t where total_before < 20")
def cost_cap_prefix(spark, d):
    return V.within_budget(answers(spark, d), ["seq"], "price", 20.0).select("seq", "total_before")


@query(f"""with {LOG_SQL}, u as (select pair_id, guard_decision as decision, seq, 0 as p from gd where event_type <> 'purchase' union all select pair_id, guard_decision, seq, 1 from gd where event_type = 'purchase')
select pair_id, decision, seq from (select *, row_number() over (partition by pair_id order by p desc, seq desc) as pos from u) where pos = 1""")
def log_overlay(spark, d):
    x = V.guarded(answers(spark, d)).select("pair_id", F.col("guard_decision").alias("decision"), "seq", "event_type")
    return V.overlay([x.where("event_type <> 'purchase'").drop("event_type"), x.where("event_type = 'purchase'").drop("event_type")], ["pair_id"])


@query("select distinct c_custkey as pair_id from customer where c_custkey not in (select user_id from events where event_type = 'purchase' and user_id is not null)")
def resume_pending(spark, d):
    pairs = table(spark, d, "customer").select(F.col("c_custkey").alias("pair_id"))
    return V.pending(pairs, table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("pair_id")), ["pair_id"])


@query(f"""with {LOG_SQL}, l as (select pair_id, arg_max(guard_decision, seq) as dec from gd group by 1) select c_custkey as pair_id, coalesce(l.dec, 'uncertain') as predicted from customer left join l on l.pair_id = c_custkey""")
def replay_log(spark, d):
    log = V.guarded(answers(spark, d)).select("pair_id", "seq", F.col("guard_decision").alias("decision"))
    return V.replay(table(spark, d, "customer").select(F.col("c_custkey").alias("pair_id")), log)


@query(f"with {LOG_SQL} select guard_decision, count(*) as n from gd group by 1")
def decision_histogram(spark, d):
    return V.histogram(V.guarded(answers(spark, d)), "guard_decision")


@query("""select count(*) as n_pairs, count(*) filter (c_custkey in (select user_id from events)) as n_decided, count(*) filter (c_custkey in (select user_id from events))::double / count(*) as coverage from customer""")
def verification_coverage(spark, d):
    return V.coverage(table(spark, d, "customer").select(F.col("c_custkey").alias("pair_id")), answers(spark, d), ["pair_id"])


@query("""select count(*) as n_calls, avg(user_id) as mean_in, avg(event_id) as mean_out, round(sum(round(user_id / 1000.0::double * 0.5 + event_id / 1000.0::double * 1.5, 6)), 6) as total_cost from events""")
def verification_costs(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens"))
    return V.call_statistics(e.withColumn("cost_usd", V.cost(F.col("input_tokens"), F.col("output_tokens"), 0.5, 1.5)))


_AUTO = "jw as (select a.keyword as keyword_a, b.keyword as keyword_b, jaro_winkler_similarity(a.norm, b.norm) as jw, case when left(a.norm, 1) < 'm' then 'ii' else 'vi' end as stratum from pvoc a join pvoc b on left(a.norm, 1) = left(b.norm, 1) and a.keyword < b.keyword)"


@query(f"""with {PVOC}, {_AUTO} select keyword_a, keyword_b, case when stratum = 'ii' then case when jw >= 0.92 then 'match' else 'non_match' end end as auto_decision,
case when stratum = 'ii' then round(case when jw >= 0.92 then jw else 1 - jw end, 9) end as auto_confidence from jw""")
def auto_decisions(spark, d):
    x = jw_scores(spark, d).withColumn("stratum", F.when(F.col("keyword_a") < "m", "ii").otherwise("vi")).withColumnRenamed("score", "jw")
    x = V.auto_decide(x)
    return x.select("keyword_a", "keyword_b", "auto_decision", F.round("auto_confidence", 9).alias("auto_confidence"))


@query(f"with {ANNOTATED} select pair_id, gold_label, second, '' as adjudicator_label, '' as adjudicator_notes from ann where gold_label <> second")
def disagreements(spark, d):
    return E.disagreements(annotated(spark, d).select("pair_id", "gold_label", "second"), "gold_label", "second")


@query(f"with {ANNOTATED}, l as (select unnest(['match', 'non_match', 'uncertain']) as second) select second, count(pair_id) as n from l left join ann using (second) group by 1")
def label_distribution(spark, d):
    return E.label_distribution(annotated(spark, d), "second")


# --- clusters and networks --------------------------------------------------------------------------------


def matched(spark, d, threshold: float = 0.85) -> DataFrame:
    return C.spelling_variants(part_vocabulary(spark, d), threshold, None, ratio=S.least_length_ratio(threshold)).select("keyword_a", "keyword_b")


def _mapping(spark, d) -> DataFrame:
    f = part_vocabulary(spark, d).select("keyword", "frequency")
    return N.canonical_map(N.clusters(matched(spark, d), f), f)


_MATCH = """mt as (select least(a.keyword, b.keyword) as ka, greatest(a.keyword, b.keyword) as kb from pvoc a join pvoc b on left(a.norm, 3) = left(b.norm, 3) and a.norm < b.norm
where a.frequency >= 2 and b.frequency >= 2 and length(a.norm) >= 4 and length(b.norm) >= 4 and jaro_winkler_similarity(a.norm, b.norm) >= 0.85)"""
_CLUSTER = f"""with recursive {PVOC}, {_MATCH}, ed as (select ka as a, kb as b from mt union all select kb, ka from mt),
re as (select keyword as a, keyword as b from pvoc union select re.a, ed.b from re join ed on re.b = ed.a), cl as (select a as keyword, min(b) as cluster from re group by a),
cn as (select cluster, arg_min(keyword, (-frequency, keyword)) as canonical_form from cl join pvoc using (keyword) group by 1),
mp as (select keyword, canonical_form, canonical_form as cluster_id, frequency as freq from cl join cn using (cluster) join pvoc using (keyword))"""


@query(f"""with {PVOC} select distinct least(a.keyword, b.keyword) as keyword_a, greatest(a.keyword, b.keyword) as keyword_b from pvoc a join pvoc b on a.keyword < b.keyword
where a.norm = b.norm or (a.frequency >= 2 and b.frequency >= 2 and length(a.norm) >= 3 and length(b.norm) >= 3 and left(a.norm, 3) = left(b.norm, 3) and jaro_winkler_similarity(a.norm, b.norm) >= 0.85)
or (regexp_replace(a.norm, '[-/(). ]', '', 'g') = regexp_replace(b.norm, '[-/(). ]', '', 'g') and jaro_winkler_similarity(a.norm, b.norm) >= 0.85)""")
def rebuilt_matches(spark, d):
    return C.rebuilt_matches(part_vocabulary(spark, d), 0.85)


@query(f"{_CLUSTER} select * from cl")
def components_jw(spark, d):
    return N.clusters(matched(spark, d), part_vocabulary(spark, d))


@query(f"{_CLUSTER} select * from mp")
def canonical_map(spark, d):
    return _mapping(spark, d)


@query(f"{_CLUSTER} select canonical_form, count(*) as n_members, string_agg(keyword, '; ' order by freq desc, keyword) as members from mp group by 1 having count(*) > 1 order by 2 desc, 1 limit 5")
def top_clusters(spark, d):
    return N.top_clusters(_mapping(spark, d))


@query(f"{_CLUSTER} select canonical_form, count(*) as n_members, count(distinct keyword) as n_parts from mp group by 1 having count(*) > 1 and min(freq) >= 2")
def over_merged(spark, d):
    """Clusters that the identity map, the finest of all, splits."""
    return N.over_merged(_mapping(spark, d), N.identity_map(part_vocabulary(spark, d)))


@query(f"{_CLUSTER} select canonical_form, count(*) as n_members, string_agg(keyword, '; ' order by keyword) as members from mp where keyword like '%bolt%' and freq >= 2 group by 1")
def family_clusters(spark, d):
    return N.family(_mapping(spark, d), "bolt")


@query(f"{_CLUSTER} select count(*) as n_keywords, count(distinct cluster_id) as n_clusters, count(*) - count(distinct cluster_id) as n_merged from mp")
def vocabulary_reduction(spark, d):
    return N.reduction(_mapping(spark, d))


_EDGES = f"""{PARTS}, ar as (select distinct article_id, keyword as canon from parts), nd as (select canon as id, count(*) as freq from ar group by 1 having count(*) >= 5),
kp as (select article_id, canon from ar where canon in (select id from nd)), eg as (select a.canon as src, b.canon as dst, count(*) as weight from kp a join kp b on a.article_id = b.article_id and a.canon < b.canon group by 1, 2)"""


def _network(spark, d, mapping=None):
    articles = N.articles_of(parts(spark, d), mapping)
    kept = N.nodes(articles)
    return kept, N.edges(articles, kept)


@query(f"with {_EDGES} select * from eg")
def coword_edges(spark, d):
    return _network(spark, d)[1]


@query(f"with {_EDGES} select * from eg order by weight desc, src, dst limit 100")
def coword_top_edges(spark, d):
    return coword_edges(spark, d).orderBy(F.desc("weight"), "src", "dst").limit(100)


@query(f"with {_EDGES} select * from nd")
def coword_nodes(spark, d):
    return _network(spark, d)[0]


@query(f"with {_EDGES}, n as (select count(*) as n_nodes from nd), e as (select count(*) as n_edges from eg) select *, case when n_nodes > 1 then 2 * n_edges / (n_nodes::double * (n_nodes - 1)) else 0.0 end as density from n, e")
def coword_density(spark, d):
    return N.density(*_network(spark, d))


@query(f"""with {_EDGES}, t as (select id from nd order by freq desc, id limit 10), b as (select src, dst, weight from eg union all select dst, src, weight from eg)
select a.id, b.id as other, coalesce(weight, 0) as weight from t a cross join t b left join b x on x.src = a.id and x.dst = b.id""".replace("left join b x", "left join both_ways x").replace("b as (select src", "both_ways as (select src"))
def coword_topn_matrix(spark, d):
    m = N.matrix(*_network(spark, d), 10)
    return m.unpivot("id", [c for c in m.columns if c != "id"], "other", "weight")


def _halves(spark, d):
    kept, found = _network(spark, d)
    return kept, found, kept.select("id", (F.ascii(F.substring("id", 1, 1)) % 3).cast("long").alias("community"))


_HALF = f"{_EDGES}, pt as (select id, ascii(left(id, 1)) % 3 as community from nd)"


@query(f"""with {_HALF}, m as (select sum(weight)::double as m from eg), x as (select e.*, a.community as cs, b.community as cd from eg e join pt a on a.id = src join pt b on b.id = dst),
p as (select c, sum(w2) as i, sum(w) as g from (select cs as c, case when cs = cd then weight else 0 end as w2, weight as w from x union all select cd, 0, weight from x) group by c)
select round(sum(i / m - (g / (2 * m)) ** 2), 9) as modularity, (select count(distinct community) from pt) as n_communities from p, m""")
def modularity_given(spark, d):
    _, found, part = _halves(spark, d)
    return N.modularity(found, part).withColumn("modularity", F.round("modularity", 9))


_TWO = f"{_HALF}, p2 as (select id, length(id) % 2 as community from nd), ct as (select a.community as ca, b.community as cb, count(*) as n from pt a join p2 b using (id) group by 1, 2)"


def _two(spark, d):
    kept, _, a = _halves(spark, d)
    return a, kept.select("id", (F.char_length("id") % 2).cast("long").alias("community"))


@query(f"""with {_TWO}, c as (select sum(n * (n - 1) / 2) as s, sum(n) as t from ct), r as (select sum(n * (n - 1) / 2) as s from (select sum(n) as n from ct group by ca)), k as (select sum(n * (n - 1) / 2) as s from (select sum(n) as n from ct group by cb))
select t::bigint as n, round((c.s - r.s * k.s / (t * (t - 1) / 2)) / ((r.s + k.s) / 2 - r.s * k.s / (t * (t - 1) / 2)), 9) as ari from c, r, k""")
def ari(spark, d):
    return N.adjusted_rand(*_two(spark, d)).withColumn("ari", F.round("ari", 9))


@query(f"""with {_TWO}, t as (select sum(n)::bigint as t from ct), r as (select ca, sum(n)::bigint as x from ct group by 1), k as (select cb, sum(n)::bigint as y from ct group by 1),
mi as (select sum(n / t::double * ln(t * n / (x * y)::double)) as mi from ct join r using (ca) join k using (cb), t),
hr as (select -sum(x / t::double * ln(x / t::double)) as h from r, t), hk as (select -sum(y / t::double * ln(y / t::double)) as h from k, t),
em as (select sum(n / t::double * ln(t * n / (x * y)::double) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(n + 1) - lgamma(x - n + 1) - lgamma(y - n + 1) - lgamma(t - x - y + n + 1))) as e
 from (select x, y, t, unnest(generate_series(greatest(1, x + y - t), least(x, y))) as n from r, k, t))
select t as n, round(mi / ((hr.h + hk.h) / 2), 6) as nmi, round((mi - e) / ((hr.h + hk.h) / 2 - e), 6) as ami from mi, em, hr, hk, t""")
def ami_nmi(spark, d):
    return N.adjusted_mutual(*_two(spark, d)).select("n", F.round("nmi", 6).alias("nmi"), F.round("ami", 6).alias("ami"))


@query(None)
def louvain(spark, d):
    return N.louvain(*_network(spark, d))


@query(f"""{_CLUSTER}, ar as (select distinct article_id, canonical_form as canon from parts join mp using (keyword)), cf as (select canon, count(*) as canonical_freq from ar group by 1)
select keyword, canonical_form, cluster_id, freq, coalesce(canonical_freq, 0) as canonical_freq from mp left join cf on canon = canonical_form""")
def harmonisation_map(spark, d):
    return N.harmonisation_map(_mapping(spark, d), parts(spark, d))


@query(f"""{_CLUSTER}, ar as (select distinct article_id, canonical_form as canon from parts join mp using (keyword)),
nd as (select canon as id from ar group by 1 having count(*) >= 5), kp as (select * from ar where canon in (select id from nd))
select a.canon as src, b.canon as dst, count(*) as weight from kp a join kp b on a.article_id = b.article_id and a.canon < b.canon group by 1, 2""")
def coword_harmonised(spark, d):
    return _network(spark, d, _mapping(spark, d))[1]
