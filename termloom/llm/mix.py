"""Mixing sources to target weights by Sainte-Laguë apportionment.

Equal-token blocks are seats: the corpus size in blocks is dealt to sources by highest quotients
target / (2k + 1), each source's seats to its shards by the same rule (through batches of shards, so that no window
holds all shards of a large source), and every shard takes that many of its blocks, whole rounds first and
then a seeded run of blocks in a seeded order of its documents. Only ids and sizes are counted and dealt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise, n_words, table

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"
#: A block has at most so many words, and at most this part of the corpus.
BLOCK_WORDS, BLOCK_PARTS = 128, 4096
#: A shard has about so many words, and a batch so many shards: windows are bounded at any size of the corpus.
SHARD_WORDS, BATCH = 200_000, 4096
#: Sources up to which their table is sent to all executors; with more, rows meet it in a join on the source.
FEW_SOURCES = 10_000


def targets(sizes: DataFrame, weights=WEIGHTS, most=MOST_REPEATS) -> DataFrame:
    """One row per source (source, source_size, target, total, rank). Sources in code-point order, null
    last, take the weights in turn; a target stops at `most` times its source's size, and what it leaves
    goes to the others by weight. The closed form of that filling: by rising cap / weight, sources are
    capped as long as the cap is below their share of what is left."""
    source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = source.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    )
    ranked = ranked.withColumn("cap", F.lit(most).cast("long") * F.col("source_size"))
    fill = W.orderBy(F.col("cap") / F.col("w"), "rank")
    rest = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("left", F.col("total") - F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("left", F.coalesce(F.col("left"), F.col("total")))
        .withColumn("w_left", F.sum("w").over(rest))
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    ranked = ranked.withColumn("capped", wide("cap") * wide("w_left") < wide("w") * wide("left"))
    free = ranked.withColumn("at", F.when(~F.col("capped"), F.struct(F.row_number().over(fill), "left", "w_left")))
    free = free.withColumn("at", F.min("at").over(W.partitionBy()))
    share = (F.col("w") * F.col("at.left")).cast("double") / F.col("at.w_left")
    return free.select(
        "source", "source_size", "total", "rank",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.coalesce(share, F.lit(0.0))).alias("target"),
    )


def apportion(items: DataFrame, group: list, weight: str, house: str, order: str) -> DataFrame:
    """items with `seats`: the house's seats of each group by Sainte-Laguë. The divisor that fits gives
    every item its seats within weight / sum * (house -+ n / 2) -+ 1/2, so only the few quotients between
    these bounds compete; no row per seat is made. Ties go to the smaller `order`."""
    g = W.partitionBy(*[F.col(c) for c in group])
    x = items.withColumn("_n", F.count(F.lit(1)).over(g) / 2.0).withColumn("_sum", F.sum(weight).over(g))
    part = F.when(F.col("_sum") > 0, F.col(weight) / F.col("_sum")).otherwise(0.0)
    x = (
        x.withColumn("_part", part)
        .withColumn("_lo", F.greatest(F.floor(F.col("_part") * (F.col(house) - F.col("_n")) - 0.5), F.lit(0)))
        .withColumn("_hi", F.ceil(F.col("_part") * (F.col(house) + F.col("_n")) + 0.5) + 1)
        .withColumn("_rest", F.col(house) - F.sum("_lo").over(g))
    )
    k = x.withColumn("_k", F.explode(F.sequence(F.col("_lo"), F.col("_hi"))))
    k = k.withColumn("_q", F.when(F.col(weight) > 0, F.col(weight) / (2 * F.col("_k") + 1)))
    best = g.orderBy(F.col("_q").desc_nulls_last(), F.col(order), F.col("_k"))
    won = (F.row_number().over(best) <= F.col("_rest")) & F.col("_q").isNotNull()
    k = k.withColumn("_won", won.cast("long"))
    first = [F.first(c).alias(c) for c in items.columns if c not in (*group, order)]
    return k.groupBy(*group, order).agg(*first, (F.first("_lo") + F.sum("_won")).alias("seats"))


def _number(text) -> F.Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _key(seed: str) -> F.Column:
    """What deals a document to a shard and orders it there: rows without an id, or with one id, go by their text."""
    return F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))


def _mixed(x: DataFrame, weights, most, seed, block_words, shard_words) -> DataFrame:
    """x (_row, doc_id, source, size, key, copies) with source_size, target and taken, one row for each copy."""
    per = targets(x.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, most)
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("total") / BLOCK_PARTS))).cast("long")
    per = per.withColumn("block", block)
    per = per.withColumn("house", F.floor((2 * F.col("total") + F.col("block")) / (2 * F.col("block"))))
    per = apportion(per.withColumn("_all", F.lit(1)), ["_all"], "target", "house", "rank").withColumnRenamed("seats", "source_seats")
    per = per.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    per = per.select(F.col("source").alias("_source"), "source_size", "target", "block", "rank", "n_shards", "source_seats")
    per = materialise(per, "sources")

    x = x.join(F.broadcast(per) if per.count() <= FEW_SOURCES else per, x["source"].eqNullSafe(per["_source"])).drop("_source")
    x = x.withColumn("shard", F.pmod(_number(F.col("key")), F.col("n_shards"))).withColumn("h", F.md5(F.concat("key", F.lit("|order"))))

    shards = x.groupBy("rank", "shard").agg(
        F.sum(F.col("size") * F.col("copies")).alias("shard_size"), F.first("source_seats").alias("source_seats")
    )
    shards = materialise(shards.withColumn("batch", F.floor(F.col("shard") / BATCH)), "shards")
    batches = shards.groupBy("rank", "batch").agg(F.sum("shard_size").alias("batch_size"), F.first("source_seats").alias("source_seats"))
    batches = apportion(batches, ["rank"], "batch_size", "source_seats", "batch").select("rank", "batch", F.col("seats").alias("batch_seats"))
    dealt = apportion(shards.drop("source_seats").join(batches, ["rank", "batch"]), ["rank", "batch"], "shard_size", "batch_seats", "shard")
    dealt = materialise(dealt.select(F.col("rank").alias("_r"), F.col("shard").alias("_s"), "shard_size", "seats"), "seats")
    discard(shards)
    x = x.join(dealt, (x["rank"] == dealt["_r"]) & (x["shard"] == dealt["_s"])).drop("_r", "_s")
    x = x.withColumn("block_seed", F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("")), F.col("shard").cast("string")))
    order = W.partitionBy("rank", "shard").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumn("to", F.sum(F.col("size") * F.col("copies")).over(order))
    x = x.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    x = x.withColumn("to", F.col("to") - (F.col("copies") - F.col("_copy")) * F.col("size")).withColumn("from", F.col("to") - F.col("size"))
    x = (
        x.withColumn("blocks", F.greatest(F.ceil(F.col("shard_size") / F.col("block")), F.lit(1)))
        .withColumn("seats", F.least("seats", F.lit(most) * F.col("blocks")))
        .withColumn("rounds", F.floor(F.col("seats") / F.col("blocks")))
        .withColumn("more", F.col("seats") % F.col("blocks"))
        .withColumn("start", F.pmod(_number(F.col("block_seed")), F.col("blocks")))
    )
    within = lambda a, b: F.greatest(F.least(F.col("to"), b) - F.greatest(F.col("from"), a), F.lit(0))
    end = (F.col("start") + F.col("more")) * F.col("block")
    taken = F.col("rounds") * F.col("size") + within(F.col("start") * F.col("block"), end)
    taken += within(F.lit(0), end - F.col("blocks") * F.col("block"))
    return x.select("_row.*", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(
    docs: DataFrame, weights=WEIGHTS, most=MOST_REPEATS, seed=SEED,
    block_words=BLOCK_WORDS, shard_words=SHARD_WORDS,
) -> DataFrame:
    """docs' rows and columns with size, source_size, target and taken (words the mix takes, repeats
    counted; at most `most` times the size). Columns of docs with these names are replaced.

    Null or blank texts have size 0 and take nothing; a null source is a source of its own; null doc_ids
    and repeated rows take part like others; an empty table gives no rows; a very long text is many blocks of its
    shard. Reruns agree: the order of documents and the run of blocks depend on the seed, ids, texts, sizes and
    sources only. Rows meet once, in the windows of their shards; sizes() does without their texts.
    """
    new = ("size", "source_size", "target", "taken")
    row = F.struct(*[c for c in docs.columns if c not in new])
    x = docs.select(row.alias("_row"), "doc_id", "source", n_words(F.col("text")).alias("size"), _key(seed).alias("key"), F.lit(1).cast("long").alias("copies"))
    return _mixed(x, weights, most, seed, block_words, shard_words)


def sizes(
    docs: DataFrame, weights=WEIGHTS, most=MOST_REPEATS, seed=SEED,
    block_words=BLOCK_WORDS, shard_words=SHARD_WORDS,
) -> DataFrame:
    """mix() as (doc_id, size, source_size, target, taken) alone: equal rows are counted before they meet, and no
    text moves."""
    x = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _key(seed).alias("key"))
    x = materialise(x.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    x = x.withColumn("_row", F.struct("doc_id"))
    return _mixed(x, weights, most, seed, block_words, shard_words)


def op8_mix_sources(spark, sf_dir):
    """sizes() of all documents."""
    return sizes(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """The documents of which the mix takes words, with how many it takes: mix() says what of odd rows."""
    return mix(docs).where("taken > 0")


def _apportion_sql(items: str, group: str, weight: str, house: str, order: str, keep: str) -> str:
    return f"""
    (with b as (select *, count(*) over (partition by {group}) / 2.0::double as _n, sum({weight}) over (partition by {group}) as _sum from {items}),
      p as (select *, case when _sum > 0 then {weight}::double / _sum::double else 0.0 end::double as _part from b),
      l as (select *, greatest(floor(_part * ({house} - _n) - 0.5::double), 0)::bigint as _lo,
                   (ceil(_part * ({house} + _n) + 0.5::double) + 1)::bigint as _hi from p),
      r as (select *, {house} - sum(_lo) over (partition by {group}) as _rest from l),
      k as (select *, unnest(generate_series(_lo, _hi)) as _k from r),
      q as (select *, case when {weight} > 0 then {weight}::double / (2 * _k + 1)::double end as _q from k),
      n as (select *, row_number() over (partition by {group} order by _q desc nulls last, {order}, _k) as _at from q)
    select {keep}, (any_value(_lo) + sum(case when _at <= _rest and _q is not null then 1 else 0 end))::bigint as seats
    from n group by {keep})"""


ORACLE = rf"""
with x as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(text, '')) as m from documents),
s0 as (select source, sum(size)::bigint as source_size from x group by source),
s1 as (select *, row_number() over (order by source asc nulls last) - 1 as rank from s0),
s2 as (select *, ([5, 2, 1])[(rank % 3 + 1)::int]::bigint as w, 3 * source_size as cap from s1),
s3 as (select *, (sum(source_size) over ())::bigint as total,
   ((sum(source_size) over ()) - coalesce(sum(cap) over (order by cap::double / w, rank rows between unbounded preceding and 1 preceding), 0))::bigint as remains,
   (sum(w) over (order by cap::double / w, rank rows between current row and unbounded following))::bigint as w_left,
   row_number() over (order by cap::double / w, rank) as fpos from s2),
s4 as (select *, cap::hugeint * w_left < w::hugeint * remains as capped from s3),
f as (select remains as fl, w_left as fw from s4 where not capped order by fpos limit 1),
s5 as (select source, source_size, total, rank,
   case when capped then cap::double else coalesce((w * fl)::double / fw, 0.0::double) end as target from s4 left join f on true),
s6 as (select *, greatest(1, least({BLOCK_WORDS}, total // {BLOCK_PARTS}))::bigint as block, 1 as g from s5),
s7 as (select *, ((2 * total + block) // (2 * block))::bigint as house from s6),
s8 as (select * from {_apportion_sql("s7", "g", "target", "house", "rank", "g, rank, source, source_size, total, target, block")}),
s9 as (select source, source_size, target, block, rank, seats as source_seats,
   greatest(1, ceil(source_size / {SHARD_WORDS}::double))::bigint as n_shards from s8),
d0 as (select x.doc_id, x.size, s9.*, '{SEED}|' || coalesce(doc_id::varchar, '') || '|' || m as key from x join s9 on x.source is not distinct from s9.source),
d1 as (select *, ('0x' || substr(md5(key), 1, 8))::bigint % n_shards as shard, md5(key || '|order') as h from d0),
h0 as (select rank, shard // {BATCH} as batch, shard, sum(size)::bigint as shard_size, any_value(source_seats) as source_seats from d1 group by rank, shard),
b0 as (select rank, batch, sum(shard_size)::bigint as batch_size, any_value(source_seats) as source_seats from h0 group by rank, batch),
b1 as (select rank, batch, seats as batch_seats from {_apportion_sql("b0", "rank", "batch_size", "source_seats", "batch", "rank, batch, batch_size")}),
h2 as (select h0.rank, h0.batch, h0.shard, h0.shard_size, b1.batch_seats from h0 join b1 on h0.rank = b1.rank and h0.batch = b1.batch),
h1 as (select * from {_apportion_sql("h2", "rank, batch", "shard_size", "batch_seats", "shard", "rank, batch, shard, shard_size")}),
d2 as (select d1.*, h1.shard_size, h1.seats as seats0 from d1 join h1 on d1.rank = h1.rank and d1.shard = h1.shard),
d3 as (select *, (sum(size) over (partition by rank, shard order by h, doc_id, size rows between unbounded preceding and current row))::bigint as upto,
   greatest(ceil(shard_size / block::double), 1)::bigint as blocks,
   ('0x' || substr(md5('{SEED}|' || coalesce(source, '') || '|' || shard::varchar), 1, 8))::bigint as bs from d2),
d4 as (select *, least(seats0, {MOST_REPEATS} * blocks) as seats, upto - size as fro from d3),
d5 as (select *, seats // blocks as rounds, seats % blocks as more, bs % blocks as start from d4)
select doc_id, size, source_size, target,
  (rounds * size + greatest(least(upto, (start + more) * block) - greatest(fro, start * block), 0)
   + greatest(least(upto, (start + more) * block - blocks * block) - greatest(fro, 0), 0))::bigint as taken
from d5"""
