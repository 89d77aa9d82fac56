"""Exact and near-duplicate pages, and pages that speak about the same topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline import config as C
from sightline.config import SiteConfig
from sightline.functions import text as T
from sightline.operators.lineage import cut
from sightline.operators.pages import exact_hash, finding


def exact_members(hashed: DataFrame) -> DataFrame:
    """text_hash, url, n: a row for each page whose text n pages have; a template's pages are rows, not one list."""
    counts = hashed.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return hashed.select("text_hash", "url").join(counts, "text_hash")


def exact_groups(hashed: DataFrame) -> DataFrame:
    """text_hash, urls (sorted) of every hash that more than one page has, for findings, which list them."""
    return exact_members(hashed).groupBy("text_hash").agg(F.array_sort(F.collect_list("url")).alias("urls"))


def exact_findings(analyses: DataFrame) -> DataFrame:
    evidence = F.concat(F.lit("equal text, sha256="), F.substring("text_hash", 1, 16))
    return finding(exact_groups(cut(exact_hash(analyses))), "exact_duplicate_candidate", "high", "candidate", urls=F.col("urls"), evidence=evidence)


def signatures(pages: DataFrame, key: str, within: list[str], tokens: str = "tokens", least: int = C.MINHASH_TOKENS) -> DataFrame:
    """key, text_hash, the columns ``within`` and sig, for pages with enough tokens.

    Shingles are rows: they are hashed and meet their minima in generated code, where
    functions of arrays are interpreted. Minima combine before they are dealt, so
    a page is a row of MINHASH_SIZE numbers in the shuffle, whatever its length.
    """
    own = [key, "text_hash", *within]
    each = pages.where(F.size(tokens) >= least).select(*own, F.explode(T.shingles(F.col(tokens))).alias("_s"))
    numbers = each.select(*own, T.shingle_number(F.col("_s")).alias("_v"))
    least_of = [F.min(F.col("_v").bitwiseXOR(F.lit(s).cast("long"))).alias(f"_m{k}") for k, s in enumerate(T.SEEDS)]
    return numbers.groupBy(*own).agg(*least_of).select(*own, F.array(*[F.col(f"_m{k}") for k in range(len(T.SEEDS))]).alias("sig"))


def near_pairs(signed: DataFrame, key: str, threshold: float, within: list[str], most: int | None = None) -> DataFrame:
    """left, right, similarity of pages whose signatures agree in a band and in ``threshold`` of all places.

    Pages with equal text (text_hash) are no near pairs. The columns ``within``
    are part of the join, so only comparable pages meet.
    """
    rows = C.MINHASH_SIZE // C.BANDS
    # Pages of equal signature and text are one class, which meets others once, whatever its size.
    classes = signed.select(key, "text_hash", *within, "sig").withColumn("code", F.xxhash64("text_hash", "sig", *within))
    classes = cut(classes)
    heads = cut(classes.groupBy("code").agg(F.min(key).alias("head"), F.first("text_hash").alias("text_hash"), F.first("sig").alias("sig"), *[F.first(c).alias(c) for c in within], F.count(F.lit(1)).alias("n")))
    bands = F.transform(F.sequence(F.lit(0), F.lit(C.BANDS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * rows + 1, rows), *within))
    # Only numbers are dealt by band; signatures join the candidate pairs afterwards.
    banded = heads.select("code", F.explode(bands).alias("band"))
    a, b = banded.alias("a"), banded.alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.code") < F.col("b.code"))).select(F.col("a.code").alias("x"), F.col("b.code").alias("y")).distinct()
    side = lambda name: heads.select(F.col("code").alias(name), F.col("sig").alias(f"sig_{name}"), F.col("text_hash").alias(f"text_{name}"))
    scored = pairs.join(side("x"), "x").join(side("y"), "y").where("text_x = '' or text_x <> text_y").select("x", "y", T.signature_similarity(F.col("sig_x"), F.col("sig_y")).alias("similarity"))
    alike = scored.where(F.col("similarity") >= threshold)
    # Texts too short for a text hash are no exact duplicates of each other: their equal signatures are pairs as well.
    own = heads.where("text_hash = '' and n > 1").select(F.col("code").alias("x"), F.col("code").alias("y"), F.lit(1.0).alias("similarity"))
    member = lambda name, of: classes.select(F.col("code").alias(of), F.col(key).alias(name))
    met = alike.unionByName(own).join(member("one", "x"), "x").join(member("two", "y"), "y").where("x <> y or one < two")
    found = met.select(F.least("one", "two").alias("left"), F.greatest("one", "two").alias("right"), "similarity")
    return found if most is None else found.orderBy("left", "right").limit(most)


def near_findings(analyses: DataFrame, config: SiteConfig) -> DataFrame:
    page = analyses.where("status = 200 and not noindex").select("url", "lane", T.language_lane(F.col("url"), F.col("lang")).alias("language"), "tokens", T.text_hash(F.col("tokens")).alias("text_hash"))
    pairs = near_pairs(signatures(page, "url", ["lane", "language"]), "url", config.near_duplicate, ["lane", "language"], config.max_pairs)
    evidence = F.concat(F.lit("MinHash similarity="), F.format_string("%.3f", "similarity"), F.lit("; read both before acting"))
    return finding(pairs, "near_duplicate_candidate", "medium", "candidate", source=F.col("left"), target=F.col("right"), evidence=evidence)


def token_frequency(signals: DataFrame) -> DataFrame:
    """token, df over the signals' token sets."""
    return signals.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def retained(signals: DataFrame) -> DataFrame:
    """token, df, retained of all tokens: a token is too frequent beyond max(200, a fifth of all signals)."""
    ceiling = max(200, int(signals.count() * 0.2))
    return token_frequency(signals).withColumn("retained", F.col("df") <= ceiling)


def overlap_pairs(signals: DataFrame, key: str, threshold: float, within: list[str], most: int | None = None) -> DataFrame:
    """left, right, similarity, shared: pages of Jaccard ``threshold`` or more that share two tokens that are not too frequent.

    Two sets of that similarity share one of their first few tokens once all are
    ordered from rare to frequent: of n tokens one of the first n - ceil(threshold n)
    + 1. Only those are dealt by token, so frequent ones hardly ever are; sets whose
    sizes differ too much never meet, and the rest is verified on the whole sets.
    """
    signals = cut(signals)
    each = signals.select(key, F.explode("tokens").alias("token")).join(retained(signals), "token")
    ordered = each.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("ordered"), F.collect_list(F.when(F.col("retained"), F.col("token"))).alias("rare"),
    ).where(F.size("rare") >= 2)
    sets = cut(signals.select(key, "shown", *within).join(ordered, key).withColumn("n", F.size("ordered")))
    # A little slack keeps rounding from dropping a pair that is just similar enough.
    prefix = F.col("n") - F.ceil(F.col("n") * (threshold - 1e-9)).cast("int") + 1
    dealt = sets.select(key, "n", *within, F.explode(F.slice("ordered", F.lit(1), prefix)).alias("token"))
    a, b = dealt.alias("a"), dealt.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("token", *within)]
    sizes = (F.col("a.n") >= F.col("b.n") * (threshold - 1e-9)) & (F.col("b.n") >= F.col("a.n") * (threshold - 1e-9))
    met = a.join(b, [*same, F.col(f"a.{key}") < F.col(f"b.{key}"), sizes]).select(F.col(f"a.{key}").alias("left"), F.col(f"b.{key}").alias("right")).distinct()
    side = lambda name: sets.select(F.col(key).alias(name), F.col("ordered").alias(f"t_{name}"), F.col("rare").alias(f"r_{name}"), F.col("shown").alias(f"i_{name}"))
    pairs = met.join(side("left"), "left").join(side("right"), "right").where((F.size(F.array_intersect("r_left", "r_right")) >= 2) & (F.col("i_left") + F.col("i_right") > 0))
    found = pairs.select("left", "right", T.jaccard(F.col("t_left"), F.col("t_right")).alias("similarity"), F.array_sort(F.array_intersect("t_left", "t_right")).alias("shared")).where(F.col("similarity") >= threshold)
    return found if most is None else found.orderBy("left", "right").limit(most)


def overlap_findings(known: DataFrame, analyses: DataFrame, config: SiteConfig) -> DataFrame:
    page = analyses.select("url", *[F.col(c).alias(f"p_{c}") for c in ("title", "h1", "lane", "lang")])
    both = known.join(page, "url", "left")
    full = lambda a, b: F.when(F.coalesce(F.col(a), F.lit("")) != "", F.col(a)).otherwise(F.coalesce(F.col(b), F.lit("")))
    spoken = F.concat_ws(" ", T.clean_signal(full("p_title", "title")), T.clean_signal(full("p_h1", "h1")), T.clean_signal(F.col("top_queries")))
    signals = both.withColumn("tokens", T.signal_set(T.tokenize(spoken), config.brand_terms)).withColumn("_lane", full("lane", "p_lane"))
    signals = signals.where(T.is_content_lane(F.col("_lane")) & (F.size("tokens") >= 2)).select("url", F.col("_lane").alias("lane"), T.language_lane(F.col("url"), F.col("p_lang")).alias("language"), F.col("latest_impressions").alias("shown"), "tokens")
    pairs = overlap_pairs(signals, "url", config.overlap, ["lane", "language"], config.max_pairs)
    evidence = F.concat(
        F.lit("title/H1/query token Jaccard="), F.format_string("%.3f", "similarity"), F.lit("; shared="),
        F.array_join(F.slice("shared", 1, 12), ", "), F.lit("; compare search figures before acting"),
    )
    return finding(pairs, "cannibalization_candidate", "medium", "candidate", source=F.col("left"), target=F.col("right"), evidence=evidence)
