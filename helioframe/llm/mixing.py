"""Mixing sources to target weights by whole blocks of equal size.

Targets: the sources share the words of all documents by weight, none above ``MAX_REPEATS`` times its own
size; what a capped source leaves is shared among the others by weight. Sorted by cap / weight the capped
sources come first, so running sums give the level directly.

Quotas: each shard of the mix has ``shard_blocks`` blocks of ``block_words`` words. The blocks of shards 1 to j
are apportioned by Sainte-Laguë (a source's k-th block has the quotient target / (2k - 1); the highest
quotients get the blocks), and a shard's quota is what its source has gained since the shard before; the
method never takes a block back when there are more to give. Only quotients near the last one given are
compared: all sources lie within sources / 2 blocks (times their share) of their exact share.

Selection: a source's documents, in the order of a seeded hash, are one run of words cut into blocks. Its
quota takes the run whole as often as it goes and then a cyclic stretch of blocks from a seeded block on, so
at most two documents of a source are cut. Everything is DataFrame expressions; positions are running sums
within ``BUCKETS`` hash buckets of a source plus the sums of the buckets before, so no source is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.session import persist_table, prepare

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK_WORDS = 16
SHARD_BLOCKS = 1 << 16
BUCKET_DIGITS = 3        # 4096 buckets
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One line per source: number by code point (null last), weight, size, target in words."""
    totals = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    # all windows of this function run over one line per source
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    totals = totals.withColumn("source_no", number)
    totals = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("source_no", F.lit(len(weights))) + F.when(F.pmod("source_no", F.lit(len(weights))) == 0, F.lit(len(weights))).otherwise(0)))
    totals = totals.withColumn("cap", max_repeats * F.col("source_size"))
    order = [F.col("cap") / F.col("weight"), F.col("source_no")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    totals = totals.withColumns({
        "total": F.sum("source_size").over(everything),
        "given": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "place": F.row_number().over(Window.orderBy(*order)),
    })
    level = (F.col("total") - F.col("given")).cast("double") / F.col("weight_left")
    totals = totals.withColumn("fits", (level * F.col("weight") <= F.col("cap")).cast("int")).withColumn("level", level)
    first = F.min(F.when(F.col("fits") == 1, F.col("place"))).over(everything)
    totals = totals.withColumn("first", first).withColumn("level", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(everything))
    target = F.when(F.col("place") < F.coalesce("first", F.lit(1 << 30)), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return totals.select("source", "source_no", "weight", "source_size", target.alias("target"), "total")


def shard_quotas(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """Blocks of each source in each shard: source_no, shard, quota."""
    blocks = F.when(F.col("total") > 0, F.greatest(F.lit(1), F.round(F.col("total") / block_words))).otherwise(0).cast("bigint")
    live = targets.filter("target > 0").withColumn("blocks", blocks).withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    shards = live.withColumn("shard", F.explode(F.expr(f"sequence(1L, cast(ceil(blocks / {shard_blocks}) as bigint))")))
    shards = shards.withColumn("house", F.least(F.col("shard") * shard_blocks, "blocks"))
    share = F.col("target") * F.col("house") / F.col("total")
    reach = F.col("target") / F.col("total") * F.col("sources") / 2 + 1
    shards = shards.withColumn("low", F.greatest(F.lit(0), F.floor(share - reach)).cast("bigint")).withColumn("high", F.ceil(share + reach).cast("bigint"))
    tries = shards.withColumn("k", F.explode(F.expr("sequence(low + 1, high)")))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc(F.col("target") / (2 * F.col("k") - 1)), "source_no"))
    sure = shards.groupBy("shard").agg(F.sum("low").alias("sure"))
    ranked = tries.withColumn("rank", rank).join(sure, "shard")
    won = ranked.groupBy("shard", "source_no", "low").agg(F.sum((F.col("rank") <= F.col("house") - F.col("sure")).cast("bigint")).alias("won"))
    upto = F.col("low") + F.col("won")
    return won.select("source_no", "shard", (upto - F.coalesce(F.lag(upto).over(Window.partitionBy("source_no").orderBy("shard")), F.lit(0))).alias("quota"))


def mix_plan(sizes: DataFrame, source: str = "source", size: str = "size", block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: str = SEED) -> DataFrame:
    """One line per source: target, whole passes, and the stretch of blocks taken once more."""
    targets = persist_table(source_targets(sizes, source, size), "targets")
    quotas = shard_quotas(targets, block_words, shard_blocks).groupBy("source_no").agg(F.sum("quota").alias("quota"))
    plan = targets.join(quotas, "source_no", "left").fillna(0, ["quota"])
    plan = plan.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("bigint"))
    plan = plan.withColumn("quota", F.least("quota", MAX_REPEATS * F.col("n_blocks")))
    some = F.greatest("n_blocks", F.lit(1))
    seeded = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("bigint")
    plan = plan.withColumns({"passes": F.floor(F.col("quota") / some), "extra": F.col("quota") % some, "first_block": F.pmod(seeded, some)})
    return persist_table(plan.drop("total"), "mix-plan")


def _ordered(df: DataFrame, key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))))


def mix(rows: DataFrame, plan: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """Adds source_size, target, passes, taken and up to two word ranges taken once more (from_a to to_b)."""
    known = plan.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "passes", "extra", "first_block", "n_blocks")
    rows = rows.withColumn("_h", _ordered(rows, key, seed)).withColumn("_bucket", F.substring("_h", 1, BUCKET_DIGITS))
    # one line per source; the plan is a stored table, so Spark knows its size and picks the join
    numbered = rows.join(known, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    sums = numbered.groupBy("source_no", "_bucket").agg(F.sum(size).alias("_sum"))
    up = Window.partitionBy("source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "_bucket", F.coalesce(F.sum("_sum").over(up), F.lit(0)).alias("_before"))
    placed = numbered.join(sums, ["source_no", "_bucket"])
    # rows of equal key and size by what they hold, so that reruns cut the same one
    plain = [f.name for f in rows.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    run = Window.partitionBy("source_no", "_bucket").orderBy("_h", size, F.xxhash64(*[F.col(f"`{c}`") for c in plain])).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_start", F.col("_before") + F.sum(size).over(run) - F.col(size))

    def overlap(start: Column, end: Column) -> tuple[Column, Column]:
        low = F.greatest(start - F.col("_start"), F.lit(0))
        high = F.least(end - F.col("_start"), F.col(size))
        return low, F.greatest(low, high)

    first, stop = F.col("first_block"), F.col("first_block") + F.col("extra")
    a = overlap(first * block_words, F.least(stop, F.col("n_blocks")) * block_words)
    b = overlap(F.lit(0), F.greatest(stop - F.col("n_blocks"), F.lit(0)) * block_words)
    out = placed.withColumns({"from_a": a[0], "to_a": a[1], "from_b": b[0], "to_b": b[1]})
    taken = F.col("passes") * F.col(size) + F.col("to_a") - F.col("from_a") + F.col("to_b") - F.col("from_b")
    return out.withColumn("taken", taken).drop("_h", "_bucket", "_before", "_start", "source_no", "extra", "first_block", "n_blocks")


def mix_sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: key, size, source_size, target, taken, passes.

    Null or empty text has size 0 and is taken 0 times; a null source is a source of its own and comes last;
    rows with equal keys count one by one; a null key takes its place by an empty string; other columns are
    not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    sizes = persist_table(docs.select(
        F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size")), "sizes")
    return mix(sizes, mix_plan(sizes))


def mix_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns; a cut one keeps the words taken, joined by spaces.

    Null and empty texts have no words and are not taken. A null source is a source of its own; a null key takes its
    place by an empty string; rows with equal keys are taken one by one, equal rows are interchangeable. Very long texts
    are cut like others; columns may have any names; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    size = word_count(F.col(f"`{text}`"))
    plan = mix_plan(persist_table(docs.select(F.col(f"`{source}`").alias("source"), size.alias("size")), "sizes"))
    names = [f"_m_{c}" for c in docs.columns]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).withColumn("size", size_of(f"_m_{text}"))
    mixed = mix(rows, plan, f"_m_{key}", f"_m_{source}")
    whole = F.transform(F.array_repeat(F.lit(0), F.col("passes").cast("int")), lambda _: F.struct(F.lit(0).cast("bigint").alias("a"), F.col("size").alias("b")))
    parts = F.filter(F.array(*[F.struct(F.col(f"from_{x}").alias("a"), F.col(f"to_{x}").alias("b")) for x in "ab"]), lambda p: p["b"] > p["a"])
    copies = mixed.filter("size > 0").withColumn("_part", F.explode(F.concat(whole, parts)))
    full = (F.col("_part.a") == 0) & (F.col("_part.b") == F.col("size"))
    words = F.regexp_extract_all(f"_m_{text}", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.slice(words, F.col("_part.a").cast("int") + 1, (F.col("_part.b") - F.col("_part.a")).cast("int")), " ")
    copies = copies.withColumn(f"_m_{text}", F.when(full, F.col(f"_m_{text}")).otherwise(cut))
    return copies.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def size_of(text: str) -> Column:
    return word_count(F.col(f"`{text}`"))
