"""Scalar functions on text as Catalyst expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from sightline import config as C

_TOKEN = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
_TRUE = ("1", "true", "yes", "y")


def text_of(c: Column) -> Column:
    """Null as the empty string, as sources have it."""
    return F.coalesce(c.cast("string"), F.lit(""))


def numeric(c: Column, default: float = 0.0) -> Column:
    """A double, or ``default``; no locale. NaN counts as missing."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(default)).otherwise(value)


def number(c: Column, default: float = 0.0) -> Column:
    """A double read as exports write it: 1,234 and 1.234,56 and 10 %."""
    raw = F.regexp_replace(text_of(c), r"[ \s%]", "")
    comma, dot = F.instr(raw, ",") > 0, F.instr(raw, ".") > 0
    last = lambda s: F.length(raw) - F.locate(s, F.reverse(raw))
    both = F.when(last(",") > last("."), F.translate(F.translate(raw, ".", ""), ",", ".")).otherwise(F.translate(raw, ",", ""))
    grouped = raw.rlike(r"^[+-]?\d{1,3}(,\d{3})+$")
    plain = F.when(comma & dot, both).when(grouped, F.translate(raw, ",", "")).when(comma, F.translate(raw, ",", ".")).otherwise(raw)
    value = plain.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(default)).otherwise(value)


def boolish(c: Column) -> Column:
    return F.lower(F.trim(text_of(c))).isin(*_TRUE)


def explicit_true(c: Column) -> Column:
    """Attestations: also ``on``, ``complete``, ``full`` and the number one."""
    value = F.lower(F.trim(text_of(c)))
    return value.isin(*_TRUE, "on", "complete", "full") | F.coalesce(value.try_cast("double") == 1.0, F.lit(False))


def first_of(*columns: Column) -> Column:
    """The first that is not null and not empty."""
    return F.coalesce(*[F.when(F.trim(text_of(c)) != "", c.cast("string")) for c in columns])


def words(normalized: Column) -> Column:
    """Words of text that is in normal form already: lower case, longer than one, no stop words."""
    found = F.regexp_extract_all(F.lower(normalized), F.lit(_TOKEN), 0)
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*C.STOPWORDS))


@F.pandas_udf(S.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normal form, which Catalyst lacks."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def tokenize(text: Column) -> Column:
    return words(nfkc(text_of(text)))


def signal_set(tokens: Column, brand_terms: tuple[str, ...] = ()) -> Column:
    """Distinct tokens that are neither brand terms nor digits only."""
    kept = F.filter(tokens, lambda w: ~w.rlike(r"^\p{Nd}+$"))
    if brand_terms:
        brand = F.array(*[F.lit(b) for b in brand_terms])
        kept = F.filter(kept, lambda w: ~F.array_contains(brand, w))
    return F.array_distinct(kept)


def clean_signal(value: Column) -> Column:
    """Text that speaks about a page; addresses and escaped text are blanked."""
    v = F.trim(text_of(value))
    escaped = F.size(F.regexp_extract_all(v, F.lit("%[0-9A-Fa-f]{2}"), 0)) >= 2
    return F.when(v.rlike("^(/|http://|https://)") | escaped, F.lit("")).otherwise(v)


def path_of(url: Column) -> Column:
    """Path of a normalized URL."""
    path = F.regexp_extract(url, r"^[a-z][a-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def is_page_like(url: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path_of(url), r"[^/.](\.[^./]*)/*$", 1))
    return ~suffix.isin(*C.NON_PAGE_SUFFIXES)


def infer_lane(url: Column, supplied: Column, post_type: Column) -> Column:
    path = F.lower(path_of(url))
    first = F.regexp_extract(path, r"^/*([^/]+)", 1)
    rest = F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), 2, 1 << 20), "/"), F.when(path.endswith("/"), F.lit("/")).otherwise(F.lit("")))
    inner = F.when(first.isin(*C.LANGUAGE_CODES), rest).otherwise(path)
    lane = F.when(inner.endswith("/amp/"), F.lit("legacy_amp"))
    for prefix, name in C.LANE_PREFIXES:
        lane = lane.when(inner.startswith(prefix), F.lit(name))
    given, kind = F.trim(text_of(supplied)), F.lower(F.trim(text_of(post_type)))
    return (
        lane.when(inner.rlike(r"/page/\d+/$"), F.lit("pagination"))
        .when(given != "", given)
        .when(kind.isin(*C.CONTENT_TYPES), F.lit("content"))
        .when(kind.isin(*C.COMMERCE_TYPES), F.lit("commerce"))
        .when(kind != "", kind)
        .otherwise(F.lit("content"))
    )


def language_lane(url: Column, lang: Column) -> Column:
    given = F.split(F.translate(F.lower(F.trim(text_of(lang))), "_", "-"), "-", 2)[0]
    first = F.regexp_extract(F.lower(path_of(url)), r"^/*([^/]+)", 1)
    return F.when(given != "", given).when(first.isin(*C.LANGUAGE_CODES), first).otherwise(F.lit("und"))


def is_content_lane(lane: Column) -> Column:
    named = F.lower(F.trim(F.when(text_of(lane) == "", F.lit("content")).otherwise(lane)))
    return ~named.isin(*C.NON_CONTENT_LANES)


def is_generic_anchor(anchor: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_of(anchor)), r"\s+", " ")).isin(*C.GENERIC_ANCHORS)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def same_site(url: Column, site: Column) -> Column:
    host = bare_host(url)
    return (host != "") & (host == bare_host(site))


def origin_of(url: Column) -> Column:
    """scheme, host and port, with the scheme's own port where none is given."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    own = F.when(scheme == "https", F.lit("443")).when(scheme == "http", F.lit("80"))
    return F.struct(scheme.alias("scheme"), host_of(url).alias("host"), F.when(port != "", port).otherwise(own).alias("port"))


def same_origin(a: Column, b: Column) -> Column:
    """Scheme, host (with www) and port all agree, and there is a host."""
    return F.coalesce((host_of(a) != "") & (origin_of(a) == origin_of(b)), F.lit(False))


def text_hash(tokens: Column) -> Column:
    return let(tokens, lambda t: F.when(F.size(t) >= C.EXACT_TOKENS, F.sha2(F.array_join(t, " "), 256)).otherwise(F.lit("")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: an expression that a lambda names is computed anew at each step."""
    return F.transform(F.array(value), use)[0]


def shingles(tokens: Column, size: int = C.SHINGLE_TOKENS) -> Column:
    """Every run of ``size`` tokens, repeats included."""

    def run(t: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(t) - size)
        return F.when(F.size(t) >= size, F.transform(at, lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(size)])))

    return let(tokens, run)


def shingle_number(shingle: Column) -> Column:
    """Fifteen hex digits of SHA-256 as a number: the same in any SQL engine."""
    return F.conv(F.substring(F.sha2(shingle, 256), 1, 15), 16, 10).cast("long")


SEEDS = [((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1)) & (2**60 - 1) for k in range(C.MINHASH_SIZE)]


def signature_similarity(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda acc, x: acc + x) / F.size(a)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def csv_safe(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading quote."""
    return F.when(F.regexp_replace(c, r"^\s+", "").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
