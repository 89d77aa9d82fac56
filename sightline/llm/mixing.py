"""Mixing sources to target weights by Sainte-Laguë apportionment [native].

Every source has a target in words. The budget is cut into blocks of equal word
counts, the blocks are allotted to sources by highest quotients
``target / (2k - 1)``, a source's quota is allotted to its shards in the same
way, and each shard takes its quota as whole passes plus the blocks of smallest
seeded hash. All of it is DataFrame expressions.

Defined results
  * null or blank text: size 0, nothing taken; the row is still returned;
  * null source: a source of its own, ordered last;
  * repeated rows and repeated doc_ids: each row is a document of its own;
  * a source whose words are all zero: target 0;
  * texts of any length: a text is cut at blocks and may be taken in part;
  * extra columns: left out by ``mix``, passed through by ``mixed_texts``, the
    pipeline's stage, whatever their names; empty table: no rows.

Windows over all sources, and over a source's shards, run in one task: it orders
a row of numbers for each source, and MOST_SHARDS shards at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.session import cut, docs_of, packed, prepare

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 32
#: About so many words of a source make a shard.
SHARD_WORDS = 250_000
#: Shards at most, about: beyond it each takes more words. A shard's stream is a row of numbers for each document,
#: so at 100 TB one task orders some million of them, and one task ranks the shards of a source.
MOST_SHARDS = 65_536
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = 20
#: Rows about sources and shards that may be broadcast (some 50 bytes each).
FEW = 100_000


def word_count(text: Column) -> Column:
    """Number of words: each word with what follows it becomes one character."""
    blank = r"^[\x20\x09-\x0D]+"
    return F.coalesce(
        F.length(F.regexp_replace(F.regexp_replace(text, blank, ""), WORD + r"[\x20\x09-\x0D]*", "x")), F.lit(0)
    ).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, target: weighted shares of ``share`` times all words.

    No target exceeds ``most`` times its source; what is cut off goes to the
    others by weight. With sources in order of capacity per weight the full ones
    are a prefix: source i is full if its capacity per weight is at most
    (budget - capacity before i) / (weight from i on).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    here = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")
    )
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_rank", F.row_number().over(by_name))
    ranked = named.select(
        "source", "source_size", "_rank", weight.alias("_weight"), (F.lit(most) * F.col("source_size")).alias("_cap")
    ).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum(
        "_weight"
    ).over(here)
    leveled = ranked.withColumn("_level", level).withColumn("_full", F.col("_ratio") <= F.col("_level"))
    # The level of the first source that is not full holds for all that are not.
    shared = F.min(F.when(~F.col("_full"), F.struct("_ratio", "_rank", "_level"))).over(whole)["_level"]
    return leveled.select(
        "source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_weight") * shared).alias("target")
    )


def apportion(votes: DataFrame, within: list[str], key: list[str]) -> DataFrame:
    """Sainte-Laguë: adds ``quota``, the seats each row of ``votes`` gets.

    ``votes`` has ``_votes``, ``_seats`` (of the group ``within``, the same in
    its rows) and ``_most`` (a bound on the row's quota). The quotients are not
    listed one by one: a divisor that is surely too large gives every row the
    seats it has for certain, one that is surely too small bounds what it can
    still get, and only those few seats (two a row on average) are ranked.
    """
    group = Window.partitionBy(*within)
    n, total = F.count(F.lit(1)).over(group), F.sum("_votes").over(group)
    base = votes.withColumn("_n", n).withColumn("_total", total)
    seats = F.col("_seats").cast("double")
    sure = F.when(
        (seats > F.col("_n") / 2) & (F.col("_total") > 0),
        F.floor(F.col("_votes") * (seats - F.col("_n") / 2) / F.col("_total") + 0.5 - 1e-9),
    ).otherwise(F.lit(0))
    limit = F.when(
        F.col("_total") > 0, F.floor(F.col("_votes") * (seats + F.col("_n") / 2) / F.col("_total") + 0.5 + 1e-9)
    ).otherwise(F.lit(0))
    base = base.withColumn("_sure", F.greatest(F.lit(0), F.least(sure.cast("long"), F.col("_most")))).withColumn(
        "_limit", F.least(limit.cast("long") + 1, F.col("_most"))
    )
    base = base.withColumn("_left", F.col("_seats") - F.sum("_sure").over(group))
    order = Window.partitionBy(*within).orderBy(F.col("_quotient").desc(), *[F.col(k).asc_nulls_last() for k in key])
    extra = (
        base.where((F.col("_left") > 0) & (F.col("_limit") > F.col("_sure")))
        .select(*within, *[k for k in key if k not in within], "_votes", "_left", F.explode(F.sequence(F.col("_sure") + 1, F.col("_limit"))).alias("_k"))
        .withColumn("_quotient", F.col("_votes") / (2 * F.col("_k") - 1))
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= F.col("_left"))
    )
    columns = [*dict.fromkeys([*within, *key])]
    won = extra.groupBy(*columns).agg(F.count(F.lit(1)).alias("_won"))
    won = won.select(*[F.col(c).alias(f"_w_{c}") for c in columns], "_won")
    same = [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in columns]
    return base.join(won, same, "left").select(
        *votes.columns, (F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0))).alias("quota")
    )


def mix(
    docs: DataFrame,
    share: float = SHARE,
    most: float = MOST,
    weights: tuple = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text).

    Returns doc_id, size, source_size, target, taken, passes (whole copies) and
    ranges: the word ranges [from, to) taken once more.
    """
    prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    sizes = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("_text")))
    targets = cut(source_targets(sizes, share, most, weights))
    words = targets.agg(F.sum("source_size")).first()[0] or 0
    shard_words = max(shard_words, words // MOST_SHARDS)
    known = targets.count(), words // shard_words
    # Rows of fixed width for sources and shards: broadcast only while they are few.
    held = lambda x: F.broadcast(x) if sum(known) <= FEW else x
    drawn = F.xxhash64("doc_id", "source", "_text", F.lit(seed))
    stream = Window.partitionBy("source", "_shard").orderBy("_draw", F.col("doc_id").asc_nulls_last(), "_text", "size")
    shards = targets.select(F.col("source").alias("_s"), F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard_words).alias("_shards"))
    placed = (
        sizes.withColumn("_draw", drawn)
        .join(held(shards), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_shard", F.pmod(F.col("_draw"), F.col("_shards")))
        .withColumn("_end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(stream))
    )
    placed = cut(placed.select("doc_id", "source", "_text", "size", "_shard", "_row", (F.col("_end") - F.col("size")).alias("_start"), "_end"))

    streams = placed.groupBy("source", "_shard").agg(F.max("_end").alias("_words"))
    blocks = F.ceil(F.col("_words") / block_words).cast("long")
    # Blocks for the sources, then each source's blocks for its shards.
    seats = targets.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    room = streams.groupBy("source").agg((F.sum(blocks) * int(most)).alias("_most"))
    room = room.select(F.col("source").alias("_s"), "_most")
    votes = seats.join(room, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "source", "source_size", "target", F.col("target").alias("_votes"), "_seats", F.coalesce("_most", F.lit(0)).alias("_most"), F.lit(0).alias("_all")
    )
    quotas = cut(apportion(votes, ["_all"], ["source"]).select(F.col("source").alias("_s"), "source_size", "target", "quota"))
    shard_votes = streams.join(held(quotas), F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "_shard", "_words", F.col("_words").cast("double").alias("_votes"), F.col("quota").alias("_seats"), (blocks * int(most)).alias("_most")
    )
    taken = cut(apportion(shard_votes, ["source"], ["source", "_shard"]).select("source", "_shard", "_words", "quota", blocks.alias("_blocks")))

    # Seeded choice within a shard: whole passes, then the blocks that hash lowest.
    rest = F.when(F.col("_blocks") > 0, F.pmod(F.col("quota"), F.col("_blocks"))).otherwise(F.lit(0))
    by_hash = Window.partitionBy("source", "_shard").orderBy("_hash", "_block")
    chosen = (
        taken.withColumn("_rest", rest)
        .where("_rest > 0")
        .select("source", "_shard", "_rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
        .withColumn("_hash", F.xxhash64("source", "_shard", "_block", F.lit(seed)))
        .withColumn("_place", F.row_number().over(by_hash))
        .where(F.col("_place") <= F.col("_rest"))
        .select(F.col("source").alias("_s"), F.col("_shard").alias("_h"), F.col("_block").alias("_b"))
    )
    # Documents meet the blocks they reach into: a few rows each, spread over (source, shard, block).
    reach = placed.where("size > 0").select(
        "source", "_shard", "_row", "_start", "_end",
        F.explode(F.sequence(F.floor(F.col("_start") / block_words), F.floor((F.col("_end") - 1) / block_words))).alias("_block"),
    )
    met = reach.join(
        chosen, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")) & (F.col("_block") == F.col("_b"))
    ).select(
        "source", "_shard", "_row",
        (F.greatest(F.col("_start"), F.col("_block") * block_words) - F.col("_start")).alias("from"),
        (F.least(F.col("_end"), (F.col("_block") + 1) * block_words) - F.col("_start")).alias("to"),
    )
    parts = met.groupBy("source", "_shard", "_row").agg(
        F.sum(F.col("to") - F.col("from")).alias("_part"), F.sort_array(F.collect_list(F.struct("from", "to"))).alias("ranges")
    )
    parts = parts.select(F.col("source").alias("_ps"), F.col("_shard").alias("_ph"), F.col("_row").alias("_pr"), "_part", "ranges")
    full = taken.select(
        F.col("source").alias("_fs"), F.col("_shard").alias("_fh"),
        F.when(F.col("_blocks") > 0, F.floor(F.col("quota") / F.col("_blocks"))).otherwise(F.lit(0)).cast("long").alias("passes"),
    )
    out = (
        placed.join(parts, F.col("source").eqNullSafe(F.col("_ps")) & (F.col("_shard") == F.col("_ph")) & (F.col("_row") == F.col("_pr")), "left")
        .join(held(full), F.col("source").eqNullSafe(F.col("_fs")) & (F.col("_shard") == F.col("_fh")), "left")
        .join(held(quotas), F.col("source").eqNullSafe(F.col("_s")), "left")
    )
    passes = F.coalesce("passes", F.lit(0))
    return out.select(
        "doc_id", "source", F.col("_text").alias("text_hash"), "size", "source_size", "target",
        (passes * F.col("size") + F.coalesce("_part", F.lit(0))).alias("taken"),
        passes.alias("passes"), F.coalesce("ranges", F.array().cast("array<struct<from:long,to:long>>")).alias("ranges"),
    )


def mixed_texts(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` with the words the mix takes as text, columns as before.

    A document taken more than once holds its text once for each whole pass and
    then its chosen ranges, joined by newlines; one of which nothing is taken goes.
    """
    plan = mix(docs, **settings).where("taken > 0")
    # Rows that share doc_id, source and text are told apart by their number; nulls meet by flags.
    own = [F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("doc_id").isNull().alias("_nd"), F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_ns"), F.col("text_hash").alias("_t")]
    key = ["_d", "_nd", "_s", "_ns", "_t"]
    plan = plan.select(*own, "passes", "ranges").withColumn("_copy", F.row_number().over(Window.partitionBy(*key).orderBy("passes", "ranges")))
    rows = packed(docs).withColumn("source", F.col("row.source").cast("string")).select(*own, "text", "row")
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), 1)
    # Bound as the element of an array: as a column, the words would be moved into the inner lambda and split anew for every range.
    pieces = F.transform(F.array(words), lambda w: F.transform("ranges", lambda r: F.rtrim(F.array_join(F.slice(w, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")), ""))))[0]
    met = rows.join(plan, [*key, "_copy"])
    copies = F.array_repeat(F.col("text"), F.col("passes").cast("int"))
    text = F.array_join(F.concat(copies, F.when(F.size("ranges") > 0, pieces).otherwise(F.array().cast("array<string>"))), "\n")
    met = met.select("row", text.alias("text"))
    made = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return met.select(*[made[c].alias(c) if c in made else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(docs_of(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
