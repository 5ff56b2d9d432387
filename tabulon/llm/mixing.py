"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

The blocks of the whole mix go to sources by highest quotients, and a source's blocks to its
shards likewise. Only DataFrame functions; what comes to the driver is a row of totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.shared import if_small, release, running, written

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, wished words of a shard.
BLOCK, SHARD_WORDS = 64, 1 << 20
#: Parts that one pass over the items cuts the range of each group's divisors into, and passes.
TRIED, PASSES = 32, 4
#: Quotients of a group and of all groups that are ranked without another pass.
RANKED, ALL_RANKED = 100_000, 1_000_000


def source_targets(per_source: DataFrame, weights: list[int], share: float, ceiling: float) -> DataFrame:
    """source, source_size and target of each source.

    Sources by code point, null last, weigh ``weights`` over and over. They share ``share``
    times all words; a target stops at ``ceiling`` times its source's size and what is over
    goes to the others by weight until none is above: with the sources in order of
    size / weight, the k first are full, and the others get one rate times their weight.
    """
    d = running(per_source, [F.col("source").asc_nulls_last()], {})
    d = d.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double")).drop("_rank")
    d = written(d.withColumn("most", ceiling * F.col("source_size")), "sources")
    words, weight = d.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).collect()[0]
    fill = running(d, [F.col("most") / F.col("w"), F.col("source").asc_nulls_last()], {"_full": F.col("most"), "_weight": F.col("w")})
    # the first source in this order that its rate doesn't fill sets the rate of all after it
    rate = (F.lit(share * words) - F.col("_full")) / (F.lit(weight) - F.col("_weight"))
    found = fill.filter(F.col("most") > rate * F.col("w")).agg(F.min_by(rate, "_rank")).collect()[0][0]
    target = F.col("most") if found is None else F.least(F.col("most"), F.lit(found) * F.col("w"))
    return d.select("source", "source_size", F.round(target, 6).alias("target"))


def apportion(items: DataFrame, seats: str = "_seats") -> DataFrame:
    """_group, _item and _q: of each group's seats (``seats``, the same on its rows) those of the
    highest quotients _weight / (2k + 1); ties go to the smaller _item.

    The divisor whose rounded shares sum to the seats is closed in on for all groups at once,
    in at most PASSES aggregations, until few quotients lie between the two divisors next to
    it. Those, and those that tie, are ranked. Each pass is a plan of its own, so that the
    driver holds no large one.
    """
    w = F.col("_weight")
    some = items.filter((w > 0) & (F.col(seats) > 0))
    n, total = F.col("_n") / 2, F.col("_total")
    d = some.groupBy("_group").agg(F.count("*").alias("_n"), F.sum("_weight").alias("_total"), F.max("_weight").alias("_top"), F.max(seats).alias("_k"))
    above = F.when(F.col("_k") > n, F.least(total / (F.col("_k") - n), 2.001 * F.col("_top"))).otherwise(2.001 * F.col("_top"))
    divisors = d.select("_group", "_k", (total / (F.col("_k") + n) * 0.999).alias("_lo"), (above * 1.001).alias("_hi"))
    of = lambda divisor: F.floor(w / divisor + 0.5)
    divisors = written(divisors, "divisors")
    for _ in range(PASSES):
        tried = some.join(divisors, "_group").withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(TRIED))))
        tried = tried.withColumn("_divisor", F.when(F.col("_j") == TRIED, F.col("_hi")).otherwise(F.col("_lo") * F.pow(F.col("_hi") / F.col("_lo"), F.col("_j") / TRIED)))
        tried = tried.groupBy("_group", "_k", "_divisor").agg(F.sum(of(F.col("_divisor"))).alias("_s"))
        enough, few = F.when(F.col("_s") >= F.col("_k"), F.col("_divisor")), F.when(F.col("_s") <= F.col("_k"), F.col("_divisor"))
        left = F.min(F.when(enough.isNotNull(), F.col("_s"))) - F.max(F.when(few.isNotNull(), F.col("_s")))
        before, divisors = divisors, written(tried.groupBy("_group", "_k").agg(F.max(enough).alias("_lo"), F.min(few).alias("_hi"), left.alias("_left")), "divisors")
        release(before)
        most, all_left = divisors.agg(F.max("_left"), F.sum("_left")).collect()[0]
        if (most or 0) <= RANKED and (all_left or 0) <= ALL_RANKED:
            break
    d = some.join(divisors, "_group").select("_group", "_item", "_weight", "_k", of(F.col("_hi")).alias("_base"), F.greatest(of(F.col("_hi")), of(F.col("_lo"))).alias("_most"))
    need = d.groupBy("_group").agg((F.max("_k") - F.sum("_base")).alias("_need"))
    close = d.filter("_most > _base").withColumn("_kth", F.explode(F.sequence("_base", F.col("_most") - 1)))
    by_quotient = Window.partitionBy("_group").orderBy((w / (2 * F.col("_kth") + 1)).desc(), "_item", "_kth")
    won = close.withColumn("_nth", F.row_number().over(by_quotient)).join(need, "_group").filter("_nth <= _need").groupBy("_group", "_item").agg(F.count("*").alias("_won"))
    d = d.join(won, ["_group", "_item"], "left").select("_group", "_item", (F.col("_base") + F.coalesce("_won", F.lit(0))).cast("long").alias("_q"))
    return items.select("_group", "_item").join(d, ["_group", "_item"], "left").select("_group", "_item", F.coalesce("_q", F.lit(0)).cast("long").alias("_q"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: str = "mix",
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """All columns of docs plus size, source_size, target and taken.

    The mix has as many blocks of ``block`` words as all targets make. They go to sources by
    the highest quotients target / (2k + 1). A source's documents lie in shards by a seeded
    digest, and its quota goes to its shards by their highest quotients too. A shard's
    documents, in seeded order, are a ring of words; the shard takes whole rounds of it while
    its quota lasts, then a run of blocks from the seeded one on.
    ``taken`` is how many words of a document that takes, repeats counted: at most
    ``ceiling`` rounded up times its size.

    Null or empty texts have size 0 and nothing taken; a null source is a source of its own;
    an empty table gives none; repeated rows each have their place on the line. Other columns
    of docs go through; if one has a name of the result's, the result's replaces it.
    A source has a shard for each ``shard_words`` words, so no task holds all of a hot one.
    """
    own = ("size", "source_size", "target", "taken")
    d = docs.drop(*own)
    d = d.withColumn("size", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"))
    d = d.withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    per_source = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(per_source, list(weights), share, ceiling)
    # a null-safe key for the joins below
    named = lambda x: x.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    t = written(named(targets).drop("source").withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")), "targets")
    blocks = int((t.agg(F.coalesce(F.sum("target"), F.lit(0.0))).collect()[0][0] / block) + 0.5)
    sources = apportion(t.select(F.lit(0).alias("_group"), F.col("_s").alias("_item"), F.col("target").alias("_weight"), F.lit(blocks).alias("_seats")))
    sources = written(sources.select(F.col("_item").alias("_s"), F.col("_q").alias("_seats")), "quotas")
    d = named(d).join(if_small(t), "_s").withColumn("_shard", F.pmod(F.conv(F.substring("_key", 1, 15), 16, 10).cast("long"), F.col("_n")))

    shards = written(d.groupBy("_s", "_shard").agg(F.sum("size").alias("_words")), "shards")
    items = written(shards.join(sources, "_s").select(F.col("_s").alias("_group"), F.col("_shard").alias("_item"), F.col("_words").cast("double").alias("_weight"), "_seats"), "items")
    quotas = shards.join(apportion(items).select(F.col("_group").alias("_s"), F.col("_item").alias("_shard"), "_q"), ["_s", "_shard"])
    words, wanted = F.col("_words"), F.col("_q") * block
    quotas = quotas.withColumn("_rounds", F.when(words > 0, F.least(F.floor(wanted / words), F.lit(int(ceiling)))).otherwise(0).cast("long"))
    quotas = quotas.withColumn("_rest", F.when((F.col("_rounds") < ceiling) & (words > 0), wanted - F.col("_rounds") * words).otherwise(0))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("_s"), F.col("_shard").cast("string"))), 1, 8), 16, 10).cast("long")
    quotas = quotas.withColumn("_lo", F.when(words > 0, F.pmod(start, F.ceil(words / block)) * block).otherwise(0))
    quotas = quotas.withColumn("_hi", F.col("_lo") + F.col("_rest")).withColumn("_round", words)

    quotas = written(quotas.select("_s", "_shard", "_rounds", "_lo", "_hi", "_round"), "quotas")

    line = Window.partitionBy("_s", "_shard").orderBy("_key", "doc_id", "size")
    d = d.withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", F.col("_end") - F.col("size"))
    d = d.join(quotas, ["_s", "_shard"])
    overlap = lambda a: F.greatest(F.lit(0), F.least(F.col("_end") + a, F.col("_hi")) - F.greatest(F.col("_start") + a, F.col("_lo")))
    d = d.withColumn("taken", (F.col("_rounds") * F.col("size") + overlap(F.lit(0)) + overlap(F.col("_round"))).cast("long"))
    return d.select(*[c for c in docs.columns if c not in own], *own)
