"""Mixing sources to target weights, by Sainte-Laguë apportionment of equal-token blocks; DataFrame functions only.

Words of a source lie in streams, one for each of its shards, cut into blocks of equal size. Blocks are dealt to sources,
and a source's blocks to its shards, by highest quotients. A shard's quota is taken as whole passes over its stream and
a seeded selection of blocks for the rest: those that come first in the order of a keyed hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editloom.llm.common import WORD, cut, table

#: Words in a block.
BLOCK = 16
#: About so many documents share a shard.
SHARD_ROWS = 4_000
#: A source is repeated at most so often.
REPEATS = 3
WEIGHTS = (5, 2, 1)
SEED = 42
#: A prime above any number of blocks in a shard, and multipliers modulo it.
PRIME, STEP, MIX = 2_147_483_647, 48_271, 69_621


def size_of(text: Column) -> Column:
    """Words of a text; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shard_of(doc_id: Column, digest: Column, shards: Column) -> Column:
    """A shard by the first 32 bits of the MD5 of id and digest, which SQL engines share."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), digest)
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % shards


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, rank, target) from one row (source, source_size) per source.

    Sources in order of their code points, null last, weigh ``weights`` in turn, and share the whole size; where a share
    exceeds ``repeats`` times the source's size, the excess goes to the others by weight, until none does. As those that
    stop are the ones with the least ratio of bound to weight, running sums in that order find them at once.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    of = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    bound = ranked.withColumn("weight", of).withColumn("most", F.col("source_size") * F.lit(float(repeats)))
    least = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = least.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    stops = bound.withColumn("left", left).withColumn("open", open_weight).withColumn("stops", F.col("most") * F.col("open") <= F.col("weight") * F.col("left"))
    # one level for all that don't stop: what the stopped ones leave, by weight
    free = ~F.col("stops")
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("most"))).over(whole), F.lit(0.0))) / F.sum(F.when(free, F.col("weight"))).over(whole)
    return stops.select("source", "source_size", "rank", F.when(F.col("stops"), F.col("most")).otherwise(F.col("weight") * level).alias("target"))


def apportion(claims: DataFrame, seats: DataFrame, by: list[str], claim: str, order: list[str]) -> DataFrame:
    """``claims`` with a column ``quota``: Sainte-Laguë seats within each group ``by``, by highest quotients.

    ``seats`` has one row (by..., seats) per group. The divisor of the result lies within half a seat per claimant of
    the plain one, so of every claimant only the seats between those bounds compete; fewer than that it has for sure.
    Ties go by ``order``. A claim of zero gets none.
    """
    group = Window.partitionBy(*by)
    share = F.col(claim) * F.col("seats") / F.col("_all")
    slack = F.col("_n") / (2 * F.greatest(F.col("seats"), F.lit(1)))
    wide = claims.join(seats, by) if by else claims.crossJoin(F.broadcast(seats))  # a single row
    wide = wide.withColumn("_all", F.sum(claim).over(group)).withColumn("_n", F.count("*").over(group))
    sure = F.when(F.col("_all") > 0, F.greatest(F.floor(share * (1 - slack)) - 1, F.lit(0))).otherwise(0).cast("long")
    most = F.when(F.col(claim) > 0, F.floor(share * (1 + slack)) + 2).otherwise(0).cast("long")
    wide = wide.withColumn("_sure", sure).withColumn("_most", F.greatest(most, sure))
    wide = wide.withColumn("_open", F.col("seats") - F.sum("_sure").over(group))
    rivals = wide.where("_most > _sure").withColumn("_k", F.explode(F.sequence("_sure", F.col("_most") - 1))).withColumn("_q", F.col(claim) / (2 * F.col("_k") + 1))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_q").desc(), *order, "_k"))
    won = rivals.withColumn("_place", place).where(F.col("_place") <= F.col("_open")).groupBy(*order).agg(F.count("*").alias("_won"))
    keyed = won.select(*(F.col(c).alias(f"_{c}") for c in order), "_won")
    same = [wide[c].eqNullSafe(F.col(f"_{c}")) for c in order]
    return wide.join(keyed, same, "left").select(*claims.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).cast("long").alias("quota"))


def order_of(j: Column, turn: Column) -> Column:
    """A number for block ``j`` of a stream, by whose order its blocks are picked: a keyed hash, then the block itself."""
    first = (j * STEP + turn) % PRIME
    second = (first * first % PRIME * MIX + j + turn) % PRIME
    return second * second % PRIME * STEP % PRIME * (1 << 31) + j


def _source_key(source: Column) -> Column:
    """A source's name in joins, where null is one, too."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def _dealt(rows: DataFrame, shards: DataFrame, p: str) -> DataFrame:
    """``rows`` (text, source, doc_id) with columns that begin with ``p``: size, digest, s (the source's key) and shard."""
    text = F.col("text").cast("string")
    sized = rows.withColumn(p + "size", size_of(text)).withColumn(p + "digest", F.coalesce(F.md5(text), F.lit(""))).withColumn(p + "s", _source_key(F.col("source")))
    return _sharded(sized, shards, p)


def _sharded(sized: DataFrame, shards: DataFrame, p: str) -> DataFrame:
    wide = sized.crossJoin(F.broadcast(shards.withColumnRenamed("shards", p + "shards")))  # a single row
    return wide.withColumn(p + "shard", shard_of(F.col("doc_id").cast("long"), F.col(p + "digest"), F.col(p + "shards"))).drop(p + "shards")


def _planned(thin: DataFrame, weights: tuple[float, ...], repeats: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Number of shards (a row), and for each stream (s, shard): source_size, target, blocks, passes, picks, turn (the
    key of its order) and last, the last number in this order that is picked. ``thin`` has doc_id, source, size and digest.
    """
    shards = cut(thin.agg(F.greatest(F.ceil(F.count("*") / SHARD_ROWS), F.lit(1)).cast("long").alias("shards")))
    dealt = _sharded(thin.withColumnRenamed("digest", "_digest"), shards, "_")
    streams = cut(dealt.groupBy("source", F.col("_shard").alias("shard")).agg(F.sum("size").alias("words")))
    sources = cut(targets(streams.groupBy("source").agg(F.sum("words").alias("source_size")), weights, repeats))
    total = sources.agg(F.round(F.coalesce(F.sum("target"), F.lit(0.0)) / block).cast("long").alias("seats"))
    quotas = apportion(sources, total, [], "target", ["rank"])
    ranked = streams.join(quotas.select(F.col("source").alias("_s"), "rank", F.col("quota").alias("seats")), F.col("source").eqNullSafe(F.col("_s"))).select("rank", "shard", "words", "seats")
    shares = apportion(ranked.select("rank", "shard", "words"), ranked.select("rank", "seats").distinct(), ["rank"], "words", ["rank", "shard"])
    plan = shares.join(sources, "rank").withColumn("blocks", F.ceil(F.col("words") / block).cast("long")).withColumn("quota", F.least("quota", F.col("blocks") * repeats))
    plan = plan.withColumn("passes", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long"))
    turn = ((F.lit(seed) * 7919 + F.col("rank") * 104_729 + F.col("shard") * 1_299_709) % PRIME).cast("long")
    plan = plan.withColumn("picks", F.col("quota") - F.col("passes") * F.col("blocks")).withColumn("turn", turn)
    plan = cut(plan.select(_source_key(F.col("source")).alias("s"), "shard", "source_size", "target", "blocks", "passes", "picks", "turn"))
    each = plan.where((F.col("picks") > 0) & (F.col("picks") < F.col("blocks"))).repartition("s", "shard")  # blocks are made where they are put in order
    each = each.select("s", "shard", "picks", "turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j")).select("s", "shard", "picks", order_of(F.col("j"), F.col("turn")).alias("last"))
    place = F.row_number().over(Window.partitionBy("s", "shard").orderBy("last"))
    lasts = each.withColumn("place", place).where(F.col("place") == F.col("picks")).select("s", "shard", "last")
    every = F.when(F.col("picks") > 0, F.lit(2**63 - 1)).otherwise(-1)
    return shards, cut(plan.join(lasts, ["s", "shard"], "left").withColumn("last", F.coalesce("last", every)))


def _joined(dealt: DataFrame, plan: DataFrame, block: int, p: str) -> DataFrame:
    """The rows with their stream's plan, first_word (their place in it) and taken; names begin with ``p``. Window and join
    share one shuffle.
    """
    of = lambda name: F.col(p + name)
    at = Window.partitionBy(p + "s", p + "shard").orderBy(F.col("doc_id").cast("long"), of("digest")).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn(p + "first_word", F.coalesce(F.sum(of("size")).over(at), F.lit(0)).cast("long"))
    rows = placed.join(plan.select(*(F.col(c).alias(p + c) for c in plan.columns)), [p + "s", p + "shard"])
    first, last = F.floor(of("first_word") / block), F.floor((of("first_word") + of("size") - 1) / block)
    end = of("first_word") + of("size")
    hit = lambda j: order_of(j, of("turn")) <= of("last")
    part = F.aggregate(
        F.sequence(first, last),
        F.lit(0).cast("long"),
        lambda sum_, j: sum_ + F.when(hit(j), F.least(end, (j + 1) * block) - F.greatest(of("first_word"), j * block)).otherwise(0).cast("long"),
    )
    taken = F.when(of("size") > 0, of("size") * of("passes") + F.when(of("picks") > 0, part).otherwise(0)).otherwise(0).cast("long")
    return rows.withColumn(p + "taken", taken)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken.

    A null text has no words and takes none; a null source is a source of its own, last in order; documents without
    words take none; very long texts count whole; repeated rows are taken one by one, the same in every run (rows that
    agree in id and text change places only with each other); empty tables give no rows; of further columns none is
    read. Shards are formed by doc_id and text, so no shard, and no window, grows with a source.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    text = F.col("text").cast("string")
    thin = cut(given.select("doc_id", "source", size_of(text).alias("size"), F.coalesce(F.md5(text), F.lit("")).alias("digest")))
    shards, plan = _planned(thin, weights, repeats, block, seed)
    dealt = _sharded(thin.select("doc_id", "source", F.col("size").alias("_size"), F.col("digest").alias("_digest"), _source_key(F.col("source")).alias("_s")), shards, "_")
    rows = _joined(dealt, plan, block, "_")
    return rows.select("doc_id", "source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it has whole passes, and once more with
    the words of its picked blocks (joined by single spaces) if they are not all or none.

    Every row has a plan of its own, the one of ``mix``, whatever ids or texts it shares with others.
    """
    p = "_"
    while any(c.startswith(p) for c in docs.columns):  # names that no column of docs has
        p += "_"
    of = lambda name: F.col(p + name)
    text = F.col("text").cast("string")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    thin = cut(given.select("doc_id", "source", size_of(text).alias("size"), F.coalesce(F.md5(text), F.lit("")).alias("digest")))
    shards, plan = _planned(thin, weights, repeats, block, seed)
    rows = _joined(_dealt(docs, shards, p), plan, block, p).where(of("taken") > 0)
    some = of("taken") - of("passes") * of("size")
    # a flag for every word, beside the words: within a lambda function, either would be made anew for each of them
    first, end = of("first_word"), of("first_word") + of("size")
    here = lambda j: (F.least(end, (j + 1) * block) - F.greatest(first, j * block)).cast("int")
    flags = F.flatten(F.transform(F.sequence(F.floor(first / block), F.floor((end - 1) / block)), lambda j: F.array_repeat(order_of(j, of("turn")) <= of("last"), here(j))))
    words = F.array_join(F.zip_with(F.regexp_extract_all(text, F.lit(f"({WORD})")), flags, lambda w, hit: F.when(hit, w)), " ")
    extra = F.when(some == of("size"), F.array(text)).when(some > 0, F.array(words)).otherwise(F.array().cast("array<string>"))
    out = rows.withColumn(p + "copy", F.explode(F.concat(F.array_repeat(text, of("passes").cast("int")), extra)))
    cols = [of("copy").alias(c) if c == "text" else F.length(of("copy")).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*cols)


def op2(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_sql() -> str:
    """The same over a view ``documents``, for DuckDB."""
    weights = ", ".join(map(str, WEIGHTS))

    def apportion_sql(name: str, claims: str, seats: str, by: str, claim: str, order: str) -> str:
        group = f"partition by {by}" if by else ""
        keys = order.split(", ")
        same = " and ".join(f"b.{k} = a.{k}" for k in keys)
        joined = f"{claims} join {seats} using ({by})" if by else f"{claims} cross join {seats}"
        return f"""{name}_a as (select *, sum({claim}) over ({group}) a_all, count(*) over ({group}) a_n from {joined}),
{name}_b as (select *, case when a_all > 0 then greatest(floor({claim} * seats / a_all * (1 - a_n / (2 * greatest(seats, 1)))) - 1, 0) else 0 end::bigint sure,
  case when {claim} > 0 then floor({claim} * seats / a_all * (1 + a_n / (2 * greatest(seats, 1)))) + 2 else 0 end::bigint top from {name}_a),
{name}_c as (select *, seats - sum(sure) over ({group}) a_open from {name}_b),
{name}_d as (select *, unnest(range(sure, greatest(top, sure))) k from {name}_c),
{name}_e as (select *, row_number() over ({group} order by {claim} / (2 * k + 1) desc, {order}, k) place from {name}_d),
{name}_f as (select {order}, count(*) won from {name}_e where place <= a_open group by {order}),
{name} as (select a.*, (a.sure + coalesce(b.won, 0))::bigint quota from {name}_c a left join {name}_f b on {same})"""

    first = lambda j: f"(({j} * {STEP} + turn) % {PRIME})"
    second = lambda j: f"(({first(j)} * {first(j)} % {PRIME} * {MIX} + {j} + turn) % {PRIME})"
    order_sql = lambda j: f"({second(j)} * {second(j)} % {PRIME} * {STEP} % {PRIME} * {1 << 31} + {j})"
    return f"""
with thin as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size, coalesce(md5(text), '') digest from documents),
dealt as (select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || digest), 1, 8))::bigint % (select greatest(ceil(count(*) / {SHARD_ROWS}.0), 1)::bigint from thin) shard from thin),
streams as (select source, shard, sum(size)::bigint words from dealt group by all),
sizes as (select source, sum(words)::bigint source_size from streams group by all),
ranked as (select *, row_number() over (order by source nulls last) - 1 as rank from sizes),
bound as (select *, [{weights}][rank % {len(WEIGHTS)} + 1]::double weight, source_size * {float(REPEATS)} most from ranked),
lefts as (select *, sum(source_size) over () - coalesce(sum(most) over (order by most / weight, rank rows between unbounded preceding and 1 preceding), 0.0) lft,
  sum(weight) over () - coalesce(sum(weight) over (order by most / weight, rank rows between unbounded preceding and 1 preceding), 0.0) opn from bound),
stopped as (select *, most * opn <= weight * lft stops from lefts),
sources as (select source, source_size, rank, case when stops then most else weight * ((sum(source_size) over () - coalesce(sum(most) filter (stops) over (), 0.0)) / sum(weight) filter (not stops) over ()) end target from stopped),
total as (select round(coalesce(sum(target), 0.0) / {BLOCK})::bigint seats from sources),
{apportion_sql('q', 'sources', 'total', '', 'target', 'rank')},
claims as (select q.rank, st.shard, st.words from streams st join q on st.source is not distinct from q.source),
quotas as (select rank, quota seats from q),
{apportion_sql('s', 'claims', 'quotas', 'rank', 'words', 'rank, shard')},
plan as (select s.rank, s.shard, ceil(words / {BLOCK}.0)::bigint blocks, least(s.quota, ceil(words / {BLOCK}.0)::bigint * {REPEATS}) quota from s),
turns as (select *, case when blocks > 0 then quota // blocks else 0 end passes, ({SEED} * 7919 + rank * 104729 + shard * 1299709) % {PRIME} turn from plan),
picks as (select *, quota - passes * blocks picks from turns),
orders as (select rank, shard, picks, {order_sql('j')} o from (select *, unnest(range(0, blocks)) j from picks where picks > 0 and picks < blocks)),
lasts as (select rank, shard, o last from (select *, row_number() over (partition by rank, shard order by o) n from orders) where n = picks),
placed as (select *, coalesce(sum(size) over (partition by source, shard order by doc_id nulls first, digest rows between unbounded preceding and 1 preceding), 0)::bigint first_word from dealt),
joined as (select p.*, src.source_size, src.target, t.passes, t.turn, coalesce(l.last, case when t.picks > 0 then 9223372036854775807 else -1 end) last
  from placed p join sources src on p.source is not distinct from src.source join picks t on t.rank = src.rank and t.shard = p.shard left join lasts l on l.rank = t.rank and l.shard = t.shard)
select doc_id, size, source_size, target, case when size > 0 then size * passes + list_sum(list_transform(range(first_word // {BLOCK}, (first_word + size - 1) // {BLOCK} + 1),
  lambda j: case when {order_sql('j')} <= last then least(first_word + size, (j + 1) * {BLOCK}) - greatest(first_word, j * {BLOCK}) else 0 end)) else 0 end::bigint taken, source
from joined"""
