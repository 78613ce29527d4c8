"""Clusters, canonical labels, co-word networks and partition comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalise
from .components import components

# --- clusters and canonical labels -----------------------------------------------------------------


def clusters(matches: DataFrame, frequency: DataFrame, known_only: bool = True) -> DataFrame:
    """(keyword, cluster) of every keyword of frequency, singletons included; matches has keyword_a and
    keyword_b, of which known_only drops pairs with a keyword outside frequency."""
    e = matches.select(F.col("keyword_a").alias("a"), F.col("keyword_b").alias("b"))
    if known_only:
        e = e.join(frequency.select(F.col("keyword").alias("a")), "a", "left_semi").join(frequency.select(F.col("keyword").alias("b")), "b", "left_semi")
    found = components(e, "a", "b").select(F.col("node").alias("keyword"), F.col("root").alias("cluster"))
    return frequency.select("keyword").join(found, "keyword", "left").select("keyword", F.coalesce("cluster", "keyword").alias("cluster"))


def canonical_map(clustered: DataFrame, frequency: DataFrame, first: list | None = None) -> DataFrame:
    """(keyword, canonical_form, cluster_id, freq): the most frequent member names its cluster, ties to the
    smallest; `first` puts columns of frequency before that, smallest first (a fuller stack of rules)."""
    x = clustered.join(frequency, "keyword", "left").withColumn("freq", F.coalesce("frequency", F.lit(0)))
    order = F.struct(*[F.col(c) for c in first or []], -F.col("freq"), F.col("keyword"))
    name = x.groupBy("cluster").agg(F.min_by("keyword", order).alias("canonical_form"))
    return x.join(name, "cluster").select("keyword", "canonical_form", F.col("canonical_form").alias("cluster_id"), "freq")


def with_vocabulary(frequency: DataFrame, controlled: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """frequency with the columns that canonical_map(first=CANONICAL_RULES) goes by: an override (keyword) names its
    cluster before a term of the controlled vocabulary (keyword), that before frequency, then the shorter keyword."""
    x = frequency
    for name, terms in (("not_override", overrides), ("not_controlled", controlled)):
        if terms is None:
            x = x.withColumn(name, F.lit(1))
        else:
            x = x.join(terms.select("keyword").distinct().withColumn("_in", F.lit(0)), "keyword", "left").withColumn(name, F.coalesce("_in", F.lit(1))).drop("_in")
    return x.withColumn("less_frequent", -F.col("frequency")).withColumn("length", F.char_length("keyword"))


CANONICAL_RULES = ("not_override", "not_controlled", "less_frequent", "length")


def with_decision_source(mapping: DataFrame, verified: DataFrame) -> DataFrame:
    """mapping with normalised_keyword and decision_source: llm_match where a verified match (keyword_a, keyword_b)
    touches a keyword whose normal form is not that of its label, else deterministic_normalisation."""
    ends = verified.select(F.explode(F.array("keyword_a", "keyword_b")).alias("keyword")).distinct().withColumn("_v", F.lit(True))
    x = mapping.join(ends, "keyword", "left").withColumn("normalised_keyword", strip_marks(F.col("keyword")))
    other = F.col("normalised_keyword") != strip_marks(F.col("canonical_form"))
    return x.withColumn("decision_source", F.when(F.col("_v") & other, F.lit("llm_match")).otherwise(F.lit("deterministic_normalisation"))).drop("_v")


def strip_marks(c):
    """Normal form with hyphens and slashes as blanks."""
    return normalise(F.regexp_replace(c, r"[-/]+", " "))


def identity_map(frequency: DataFrame) -> DataFrame:
    return frequency.select("keyword", F.col("keyword").alias("canonical_form"), F.col("keyword").alias("cluster_id"), F.col("frequency").alias("freq"))


def top_clusters(mapping: DataFrame, n: int = 5) -> DataFrame:
    """(canonical_form, n_members, members) of the largest clusters of two or more, members by frequency."""
    by = F.struct((-F.col("freq")).alias("o"), F.col("keyword").alias("k"))
    x = mapping.groupBy("canonical_form").agg(F.count(F.lit(1)).alias("n_members"), F.array_sort(F.collect_list(by)).alias("m"))
    x = x.where("n_members > 1").select("canonical_form", "n_members", F.array_join(F.transform("m", lambda s: s["k"]), "; ").alias("members"))
    return x.orderBy(F.desc("n_members"), "canonical_form").limit(n)


def over_merged(coarse: DataFrame, fine: DataFrame, least_frequency: int = 2) -> DataFrame:
    """(canonical_form, n_members, n_parts): coarse clusters, all members frequent, that fall in several fine ones."""
    x = coarse.join(fine.select("keyword", F.col("canonical_form").alias("part")), "keyword")
    x = x.groupBy("canonical_form").agg(F.count(F.lit(1)).alias("n_members"), F.countDistinct("part").alias("n_parts"), F.min("freq").alias("least"))
    return x.where((F.col("n_members") > 1) & (F.col("n_parts") > 1) & (F.col("least") >= least_frequency)).drop("least")


def family(mapping: DataFrame, part: str, least_frequency: int = 2) -> DataFrame:
    """Clusters of the keywords that hold a part, whatever its case."""
    x = mapping.where(F.lower("keyword").contains(part.lower()) & (F.col("freq") >= least_frequency))
    return x.groupBy("canonical_form").agg(F.count(F.lit(1)).alias("n_members"), F.array_join(F.array_sort(F.collect_list("keyword")), "; ").alias("members"))


def merge_examples(mapping: DataFrame, least_frequency: int = 5, n: int = 3) -> DataFrame:
    x = mapping.where(F.col("freq") >= least_frequency).groupBy("canonical_form")
    x = x.agg(F.count(F.lit(1)).alias("n_members"), F.sum("freq").alias("total_freq")).where("n_members >= 2")
    return x.orderBy(F.desc("n_members"), F.desc("total_freq"), "canonical_form").limit(n)


def harmonisation_map(mapping: DataFrame, keywords: DataFrame) -> DataFrame:
    """mapping with the number of articles of each canonical form."""
    freq = articles_of(keywords, mapping).groupBy("canon").agg(F.count(F.lit(1)).alias("canonical_freq"))
    return mapping.join(freq, F.col("canonical_form") == F.col("canon"), "left").drop("canon").fillna(0, ["canonical_freq"])


# --- networks ---------------------------------------------------------------------------------------


def articles_of(keywords: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """(article_id, canon), distinct; a keyword outside the map stands for itself."""
    if mapping is None:
        return keywords.select("article_id", F.col("keyword").alias("canon")).distinct()
    x = keywords.join(mapping.select("keyword", "canonical_form"), "keyword", "left")
    return x.select("article_id", F.coalesce("canonical_form", "keyword").alias("canon")).distinct()


def nodes(articles: DataFrame, least: int = 5) -> DataFrame:
    return articles.groupBy(F.col("canon").alias("id")).agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least)


def edges(articles: DataFrame, kept: DataFrame, least_weight: int = 1) -> DataFrame:
    """(src, dst, weight), src < dst: articles that hold both. Each article's kept keywords meet in one
    array, so articles are shuffled once and pairs are counted where they arise."""
    x = articles.join(kept.select(F.col("id").alias("canon")), "canon", "left_semi")
    x = x.groupBy("article_id").agg(F.array_sort(F.collect_set("canon")).alias("ks")).where(F.size("ks") > 1)
    first = x.select("ks", F.posexplode("ks").alias("i", "src"))
    both = first.select("src", F.explode(F.slice("ks", F.col("i") + 2, F.size("ks"))).alias("dst"))
    return both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least_weight)


def density(kept: DataFrame, found: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, density; isolated nodes count."""
    n = kept.agg(F.count(F.lit(1)).alias("n_nodes"))
    e = found.agg(F.count(F.lit(1)).alias("n_edges"))
    full = F.col("n_nodes").cast("double") * (F.col("n_nodes") - 1)
    return n.crossJoin(e).withColumn("density", F.when(F.col("n_nodes") > 1, 2 * F.col("n_edges") / full).otherwise(0.0))  # one row each


def induced(kept: DataFrame, found: DataFrame, n: int) -> tuple:
    """Nodes and edges among the n most frequent nodes."""
    few = kept.orderBy(F.desc("freq"), "id").limit(n)
    inside = found.join(few.select(F.col("id").alias("src")), "src", "left_semi").join(few.select(F.col("id").alias("dst")), "dst", "left_semi")
    return few, inside.select("src", "dst", "weight")


def both_ways(found: DataFrame) -> DataFrame:
    return found.select("src", "dst", "weight").union(found.select("dst", "src", "weight"))


def matrix(kept: DataFrame, found: DataFrame, n: int = 100) -> DataFrame:
    """Square table of the n most frequent nodes: id and one column per node, zero diagonal."""
    few, inside = induced(kept, found, n)
    names = [r["id"] for r in few.orderBy(F.desc("freq"), "id").collect()]  # at most n
    wide = both_ways(inside).groupBy(F.col("src").alias("id")).pivot("dst", names).agg(F.first("weight"))
    return few.select("id").join(wide, "id", "left").fillna(0)


def mega_node(kept: DataFrame, part: str, n: int = 100, above: int = 5000) -> DataFrame:
    few = kept.orderBy(F.desc("freq"), "id").limit(n)
    return few.agg(F.coalesce(F.max(F.lower("id").contains(part) & (F.col("freq") > above)), F.lit(False)).alias("has_mega_node"))


def reduction(mapping: DataFrame) -> DataFrame:
    """One row: keywords, clusters, and merges, which are their difference."""
    x = mapping.agg(F.count(F.lit(1)).alias("n_keywords"), F.countDistinct("cluster_id").alias("n_clusters"))
    return x.withColumn("n_merged", F.col("n_keywords") - F.col("n_clusters"))


# --- partitions -------------------------------------------------------------------------------------


def modularity(found: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: modularity and n_communities of a partition (id, community) for weighted edges."""
    p = partition.select("id", "community")
    inside = found.join(p.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src").join(p.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
    ends = inside.select(F.explode(F.array(F.struct(F.col("cs").alias("c"), F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0).alias("w2"), F.col("weight").alias("w")), F.struct(F.col("cd").alias("c"), F.lit(0).cast("long").alias("w2"), F.col("weight").alias("w")))).alias("x"))
    per = ends.groupBy("x.c").agg(F.sum("x.w2").alias("inside"), F.sum("x.w").alias("degree"))
    m = found.agg(F.sum("weight").alias("m"))
    q = per.crossJoin(m).agg(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2))).alias("q"))  # m is one row
    k = p.agg(F.countDistinct("community").alias("n_communities"))
    return q.crossJoin(k).select(F.coalesce("q", F.lit(0.0)).alias("modularity"), "n_communities")


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ca, cb, n) of two partitions (id, community) over the ids that both have."""
    x = a.select("id", F.col("community").alias("ca")).join(b.select("id", F.col("community").alias("cb")), "id")
    return x.groupBy("ca", "cb").agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n, ari; null below two common ids, 1 where neither partition could differ."""
    c = contingency(a, b)
    choose = lambda n: n * (n - 1) / 2
    s = lambda df, name: df.agg(F.sum(choose(F.col("n"))).alias(name), F.sum("n").alias(f"{name}_n"))
    rows = c.groupBy("ca").agg(F.sum("n").alias("n"))
    cols = c.groupBy("cb").agg(F.sum("n").alias("n"))
    x = s(c, "both").crossJoin(s(rows, "ra")).crossJoin(s(cols, "rb"))  # one row each
    expect = F.col("ra") * F.col("rb") / choose(F.col("both_n"))
    top, bottom = F.col("both") - expect, (F.col("ra") + F.col("rb")) / 2 - expect
    return x.select(
        F.coalesce("both_n", F.lit(0)).alias("n"),
        F.when(F.col("both_n") >= 2, F.when(bottom == 0, F.lit(1.0)).otherwise(top / F.when(bottom != 0, bottom))).alias("ari"),
    )


def _ami(counts: list) -> tuple:
    """(mutual information, its expectation under fixed sizes, entropies) of a contingency table."""
    from math import exp, lgamma, log

    rows, cols = {}, {}
    for a, b, n in counts:
        rows[a] = rows.get(a, 0) + n
        cols[b] = cols.get(b, 0) + n
    total = sum(rows.values())
    entropy = lambda sizes: -sum(s / total * log(s / total) for s in sizes.values())
    mutual = sum(n / total * log(total * n / (rows[a] * cols[b])) for a, b, n in counts)
    f = lambda n: lgamma(n + 1)
    expected = 0.0
    for x, nx in _sizes(rows).items():
        for y, ny in _sizes(cols).items():
            for n in range(max(1, x + y - total), min(x, y) + 1):
                p = exp(f(x) + f(y) + f(total - x) + f(total - y) - f(total) - f(n) - f(x - n) - f(y - n) - f(total - x - y + n))
                expected += nx * ny * p * n / total * log(total * n / (x * y))
    return mutual, expected, entropy(rows), entropy(cols)


def _sizes(groups: dict) -> dict:
    out: dict = {}
    for s in groups.values():
        out[s] = out.get(s, 0) + 1
    return out


def adjusted_mutual(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n, nmi, ami (arithmetic mean of the entropies). The contingency table, whose size is that of
    the communities, meets in one task."""

    def run(batches):
        import pyarrow as pa

        counts = [tuple(r.values()) for x in batches for r in x.to_pylist()]
        n = sum(c for *_, c in counts)
        nmi = ami = None
        if n >= 2:
            mutual, expected, ha, hb = _ami(counts)
            mean = (ha + hb) / 2
            nmi = mutual / mean if mean else 1.0
            ami = (mutual - expected) / (mean - expected) if abs(mean - expected) > 1e-15 else 1.0
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([nmi], pa.float64()), pa.array([ami], pa.float64())], ["n", "nmi", "ami"])

    c = contingency(a, b).select(F.col("ca").cast("string"), F.col("cb").cast("string"), "n")
    return c.repartition(1).mapInArrow(run, "n long, nmi double, ami double")


def shared_ids(raw: DataFrame, mapping: DataFrame, harmonised: DataFrame) -> DataFrame:
    """(id, community): raw nodes with the community of their canonical form in a harmonised partition."""
    x = raw.select("id").join(mapping.select(F.col("keyword").alias("id"), "canonical_form"), "id")
    h = harmonised.select(F.col("id").alias("canonical_form"), "community")
    return x.join(h, "canonical_form").select("id", "community")


def louvain(kept: DataFrame, found: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, community) by the Louvain method, deterministic: nodes in order of id, ties to the smaller
    community; isolated nodes are their own. The filtered graph of frequent keywords meets in one task; its
    size depends on the vocabulary above the frequency floor, not on the number of articles."""

    def run(batches):
        import pyarrow as pa

        rows = [r for x in batches for r in x.to_pylist()]
        ids = sorted({r["src"] for r in rows} | {r["dst"] for r in rows if r["dst"] is not None})
        number = {k: i for i, k in enumerate(ids)}
        graph = [{} for _ in ids]
        for r in rows:
            if r["dst"] is not None:
                i, j = number[r["src"]], number[r["dst"]]
                graph[i][j] = graph[i].get(j, 0) + r["weight"]
                graph[j][i] = graph[j].get(i, 0) + r["weight"]
        part = list(range(len(ids)))
        while True:
            level = _move(graph, resolution)
            names = {c: k for k, c in enumerate(sorted(set(level)))}
            level = [names[c] for c in level]
            part = [level[p] for p in part]
            if len(names) == len(graph):
                break
            merged = [{} for _ in names]
            for i, near in enumerate(graph):
                for j, w in near.items():
                    a, b = level[i], level[j]
                    merged[a][b] = merged[a].get(b, 0) + w
            graph = merged
        first: dict = {}
        for i, c in enumerate(part):
            first.setdefault(c, i)
        yield pa.record_batch([pa.array(ids, pa.string()), pa.array([first[c] for c in part], pa.int64())], ["id", "community"])

    alone = kept.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0).cast("long").alias("weight"))
    one = found.select("src", "dst", F.col("weight").cast("long")).unionByName(alone).repartition(1)
    return one.mapInArrow(run, "id string, community long")


def _move(graph: list, resolution: float) -> list:
    """One level: nodes move to the neighbouring community of greatest gain until none does."""
    degree = [sum(near.values()) for near in graph]
    total, at, weight = sum(degree) or 1, list(range(len(graph))), degree[:]
    moved = True
    while moved:
        moved = False
        for i, near in enumerate(graph):
            links: dict = {}
            for j, w in near.items():
                if j != i:
                    links[at[j]] = links.get(at[j], 0) + w
            weight[at[i]] -= degree[i]
            gain = lambda c, links=links, i=i: links.get(c, 0) - resolution * degree[i] * weight[c] / total
            best, stay = max(links, key=lambda c: (gain(c), -c), default=at[i]), at[i]
            if gain(best) <= gain(stay) + 1e-12:
                best = stay
            moved |= best != stay
            at[i] = best
            weight[best] += degree[i]
    return at
