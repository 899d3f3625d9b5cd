"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

1. A source's target is its weight's share of all words, at most ``repeat_cap`` times its size; what is cut off goes to
   the others by weight until none is above.
2. Blocks of ``block_words`` words are dealt to sources by the highest quotients target / (2 seats + 1), then each
   source's blocks to its shards by words. A shard is a hash bucket of bounded size, so no source, however large, meets
   in one task. What whole blocks and caps leave over or lack of a target its largest shards with room even out.
3. A shard's documents, in seeded order, form one stream of words. Whole passes over the stream come first, the rest is
   a seeded choice among its blocks, ``passes`` and ``pieces`` say what a document gives.

The apportionment starts from seats rounded at the mean divisor. The true divisor moves a row with v of V votes among n
rows by at most n v / 2V seats, so only the quotients in that range are ranked: about as many as there are rows.

Edge cases: a NULL text has size 0, an empty one too; both take nothing. NULL is a source of its own, ordered last.
Repeated rows are mixed one by one; rows equal in id and text are interchangeable. A table without words takes nothing,
an empty one gives an empty result. Input columns named like result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import WORD, broadcast_if_small
from stratafold.session import cut

#: Odd primes just under 2^31: coprime to every smaller block count, so each gives a permutation of the blocks.
STEPS = (2147483647, 2147483629, 2147483587, 2147483579)
ADDED = ("size", "source_size", "target", "taken", "passes", "pieces")


def count_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[float], repeat_cap: float) -> DataFrame:
    """(source, source_size, docs) with ``source_no`` (from 1, by code point, NULL last) and ``target``."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    known = sources.withColumn("source_no", F.row_number().over(by_name))
    known = known.withColumn("weight", F.element_at(listed, (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int")))
    known = known.withColumn("cap", F.lit(float(repeat_cap)) * F.col("source_size"))
    # In order of cap / weight the capped sources come first: one is capped if its share of what the earlier caps leave exceeds its cap.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = known.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    known = known.withColumn("share", F.col("left") / F.sum("weight").over(onward))
    known = known.withColumn("capped", F.col("share") * F.col("weight") >= F.col("cap"))
    # The first uncapped source in that order has the share of all uncapped ones.
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "source_no", "share"))).over(everything)["share"]
    return known.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level)).select(
        "source", "source_no", "source_size", "docs", "target")


def apportion(rows: DataFrame, group: Sequence[str], name: str, votes: str, seats: str, into: str) -> DataFrame:
    """``rows`` with Sainte-Lague seats in ``into``; ``seats`` holds the seats of a row's group. Ties go to the lower name."""
    whole = Window.partitionBy(*group)
    base = rows.withColumn("_all", F.sum(votes).over(whole)).withColumn("_n", F.count("*").over(whole))
    room = F.ceil(F.col("_n") * F.col(votes) / (2 * F.col("_all"))) + 1
    rounded = F.floor(F.col(votes) * F.col(seats) / F.col("_all") + 0.5)
    base = base.withColumn("_room", F.when(F.col(votes) > 0, room).otherwise(0))
    base = base.withColumn("_low", F.when(F.col(votes) > 0, F.greatest(rounded - F.col("_room"), F.lit(0))).otherwise(0))
    base = base.withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    place = F.explode_outer(F.when(F.col("_room") > 0, F.sequence(F.lit(0).cast("bigint"), 2 * F.col("_room"))))
    ranked = base.select("*", place.alias("_k")).withColumn("_quotient", F.col(votes) / (2 * (F.col("_low") + F.col("_k")) + 1))
    order = Window.partitionBy(*group).orderBy(F.col("_quotient").desc_nulls_last(), name)
    ranked = ranked.withColumn("_won", ((F.row_number().over(order) <= F.col("_open")) & F.col("_quotient").isNotNull()).cast("bigint"))
    keys = [*group, name]
    return ranked.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in rows.columns if c not in keys], (F.first("_low") + F.sum("_won")).cast("bigint").alias(into))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), repeat_cap: int = 3, block_words: int = 256, shard_docs: int = 4096,
    seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """``docs`` with size, source_size, target, taken, passes and pieces: array of (start, length), in words of the text."""
    keep = [c for c in docs.columns if c not in ADDED]
    sized = docs.select(*keep, count_words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("_order"))
    sources = cut(sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    goals = targets(sources, weights, repeat_cap)
    goals = goals.withColumn("_none", F.lit(0)).withColumn("_blocks", F.floor(F.sum("target").over(Window.partitionBy()) / block_words))
    goals = cut(apportion(goals, ["_none"], "source_no", "target", "_blocks", "quota"))
    goals = goals.withColumn("_shards", F.ceil(F.col("docs") / shard_docs))
    wide = goals.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "_shards")
    placed = sized.join(broadcast_if_small(wide), F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64("_order", F.lit(seed)), F.col("_shards")))
    # Texts are left out of the count of a shard.
    shards = placed.groupBy("source_no", "_shard").agg(F.sum("size").alias("_words"))
    shards = shards.join(goals.select("source_no", "quota", F.col("target").alias("_goal")), "source_no")
    shards = apportion(shards, ["source_no"], "_shard", "_words", "quota", "_won")
    # What blocks and caps leave over or lack is added to, or taken from, the largest shards that have room.
    shards = shards.withColumn("_base", F.least(F.col("_won") * block_words, repeat_cap * F.col("_words")))
    by_size = Window.partitionBy("source_no").orderBy(F.desc("_words"), "_shard").rowsBetween(Window.unboundedPreceding, -1)
    lack = F.round(F.col("_goal")).cast("bigint") - F.sum("_base").over(Window.partitionBy("source_no"))
    room = repeat_cap * F.col("_words") - F.col("_base")
    shards = shards.withColumn("_lack", lack).withColumn("_room", F.when(F.col("_lack") > 0, room).otherwise(F.col("_base")))
    met = F.coalesce(F.sum("_room").over(by_size), F.lit(0))
    change = F.least(F.greatest(F.abs("_lack") - met, F.lit(0)), F.col("_room"))
    shards = shards.withColumn("_take", F.col("_base") + F.signum("_lack").cast("bigint") * change)
    shards = shards.select("source_no", "_shard", "_words", "_take")

    stream = Window.partitionBy("source_no", "_shard").orderBy("_order", doc_id, "size")
    mixed = placed.join(shards, ["source_no", "_shard"])
    mixed = mixed.withColumn("_to", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    words = F.greatest(F.col("_words"), F.lit(1))
    mixed = mixed.withColumn("_from", F.col("_to") - F.col("size")).withColumn("passes", F.floor(F.col("_take") / words).cast("bigint"))
    mixed = mixed.withColumn("_rest", F.col("_take") - F.col("passes") * F.col("_words"))
    mixed = mixed.withColumn("passes", F.when(F.col("size") > 0, F.col("passes")).otherwise(0).cast("bigint"))
    mixed = mixed.withColumn("_whole", F.floor(F.col("_words") / block_words)).withColumn("_full", F.floor(F.col("_rest") / block_words))
    mixed = mixed.withColumn("_part", F.col("_rest") - F.col("_full") * block_words)
    draw = F.xxhash64(F.lit(seed), "source_no", "_shard")
    mixed = mixed.withColumn("_step", F.element_at(F.array(*[F.lit(s) for s in STEPS]), (F.pmod(draw, F.lit(len(STEPS))) + 1).cast("int")).cast("bigint"))
    mixed = mixed.withColumn("_shift", F.pmod(F.shiftright(draw, 8), F.greatest(F.col("_whole"), F.lit(1))))

    def piece(block: Column) -> Column:
        # The tail shorter than a block has the last place.
        place = F.when(block < F.col("_whole"), F.pmod(F.col("_step") * block + F.col("_shift"), F.greatest(F.col("_whole"), F.lit(1)))).otherwise(F.col("_whole"))
        length = F.when(place < F.col("_full"), F.lit(block_words)).when(place == F.col("_full"), F.col("_part")).otherwise(0).cast("bigint")
        begin = F.greatest(block * block_words, F.col("_from"))
        return F.struct((begin - F.col("_from")).alias("start"), (F.least(block * block_words + length, F.col("_to")) - begin).alias("length"))

    first, last = F.floor(F.col("_from") / block_words), F.floor((F.col("_to") - 1) / block_words)
    pieces = F.when((F.col("size") > 0) & (F.col("_rest") > 0), F.filter(F.transform(F.sequence(first, last), piece), lambda p: p["length"] > 0))
    mixed = mixed.withColumn("pieces", F.coalesce(pieces, F.array().cast("array<struct<start:bigint,length:bigint>>")))
    part = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda a, p: a + p["length"])
    return mixed.withColumn("taken", F.col("passes") * F.col("size") + part).select(*keep, *ADDED)


def realize(mixed: DataFrame, columns: Sequence[str], text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The rows of the mix: a document once for each pass, and once more with the words of its pieces, joined by one blank."""
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    cuts = F.flatten(F.transform("pieces", lambda p: F.slice(words, (p["start"] + 1).cast("int"), p["length"].cast("int"))))
    partial = (F.size("pieces") > 0) & (F.col("size") > 0)
    texts = F.concat(
        F.array_repeat(F.col(text), F.col("passes").cast("int")),
        F.when(partial, F.array(F.array_join(cuts, " "))).otherwise(F.array().cast("array<string>")))
    out = mixed.select(*[c for c in columns if c != text], F.explode(texts).alias(text))
    if n_chars in columns:
        out = out.withColumn(n_chars, F.length(text).cast(dict(mixed.dtypes)[n_chars]))
    return out.select(*columns)
