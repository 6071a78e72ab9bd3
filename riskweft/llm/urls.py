"""URL filters by a temporal list join.

Dated list entries (add or remove a host or a path prefix) become validity intervals; an as-of join meets every capture
with the entries that were active when it was fetched. A host entry covers the host and its subdomains, a prefix entry
what begins with it as host and path, wherever it ends.

A capture is named by its contents (id, URL and time), so captures of one page at different times are judged apart.

Edge cases: entries with a null value, list or date are ignored; captures with a null or malformed URL, or without a
fetch time, match nothing and pass; a null id is like any other; captures equal in id, URL and time get the same result,
each its own row; equal entries count once; of entries at one moment a removal comes first, so an addition at that
moment holds; dots at the end of a host don't count; a very long URL is looked up under no more beginnings than entries
of its host have lengths; empty tables pass everything; extra columns of captures pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .quality import row_key


def host(url: Column) -> Column:
    """Lower-cased host without user, port and dots at its end; empty for what is no URL."""
    return F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit("."))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, value, since, until) from (list, kind, value, action, at); until is null while an entry stands.

    Additions to what is already listed are merged, so the intervals of a value are as many as its real changes.
    """
    known = entries.where("list IS NOT NULL AND kind IS NOT NULL AND value IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    value = F.when(F.col("kind") == "host", F.rtrim(F.lower("value"), F.lit("."))).otherwise(F.lower("value"))
    known = known.select("list", "kind", value.alias("value"), (F.col("action") == "add").alias("on"), "at")
    # of one moment, the addition holds
    moments = known.groupBy("list", "kind", "value", "at").agg(F.max("on").alias("on"))
    over = Window.partitionBy("list", "kind", "value").orderBy("at")
    changes = moments.withColumn("was", F.coalesce(F.lag("on").over(over), F.lit(False))).where("on <> was")
    spans = changes.withColumn("until", F.lead("at").over(over)).where("on")
    return spans.select("list", "kind", "value", F.col("at").alias("since"), "until")


def keys(url: Column, lengths: Column) -> Column:
    """Array of (kind, value) under which an entry for the URL may stand: its host's suffixes, and the beginnings of host
    and path that have one of the lengths."""
    labels, page = F.split(host(url), r"\."), F.concat(host(url), F.lower(path(url)))
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("value")))
    fitting = F.filter(F.array_distinct(lengths), lambda x: x <= F.length(page))
    prefixes = F.transform(fitting, lambda x: F.struct(F.lit("prefix").alias("kind"), F.substr(page, F.lit(1), x).alias("value")))
    return F.when(host(url) != "", F.array_distinct(F.concat(hosts, prefixes))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))


#: Bytes of entries, with ENTRY_BYTES for each besides, up to which they are sent to all captures.
BROADCAST_BYTES, ENTRY_BYTES = 2 << 20, 64
#: Bits by which keys that no entry has are told before they are dealt: for each entry, at least, and at most (64 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 23, 1 << 29


def _small(df: DataFrame, size: Column) -> bool:
    """Whether df may be sent to all captures, by the bytes that size gives for a row."""
    return df.agg(F.coalesce(F.sum(size + ENTRY_BYTES), F.lit(0))).first()[0] <= BROADCAST_BYTES


def _listed(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of asked whose (kind, value) may be on a list: those whose bit is set among the bits of all entries. The
    bits grow with the entries, so that one in BITS_EACH is set; with too many entries for that nothing is left out."""
    wide = max(LEAST_BITS, 1 << (BITS_EACH * spans.count() - 1).bit_length())
    if wide > MOST_BITS:
        return asked
    bit = F.pmod(F.xxhash64("kind", "value"), F.lit(wide))
    bits = spans.select(bit.alias("__b")).groupBy(F.bitmap_bucket_number("__b").alias("__n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__b")).alias("__bits"))
    at = F.bitmap_bit_position("__b")
    byte = F.conv(F.hex(F.substr("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = asked.withColumn("__b", bit).join(F.broadcast(bits), F.bitmap_bucket_number("__b") == F.col("__n"))  # MOST_BITS at most
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("__b", "__n", "__bits")


def matches(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """(__k1, __k2, id_col, at_col, list, kind, value, since): the entries active for each capture at its time, once for
    captures that are equal; __k1 and __k2 name the capture.

    A prefix may end anywhere, so a page is looked up under its beginnings of the lengths that its host's entries have,
    not under each entry of its host. The intervals and the lengths are written and measured: small ones go to the
    captures, which are then not dealt at all; with larger ones they meet by merging, keys that no entry can have are
    left out before, and a hot host or key is split.
    """
    scratch = Scratch(captures.sparkSession, "urls")
    spans = scratch.keep(intervals(entries), "intervals")
    begun = spans.where("kind = 'prefix'").select(F.substring_index("value", "/", 1).alias("__host"), F.length("value").alias("n"), F.contains("value", F.lit("/")).alias("__whole"))
    own = scratch.keep(begun.where("__whole").groupBy("__host").agg(F.collect_set("n").alias("__own")), "lengths")  # no more than a URL has characters
    other = begun.where("NOT __whole").agg(F.collect_set("n").alias("__other"))  # ends within the host
    asked = captures.select(*row_key(id_col, url_col, at_col), F.col(id_col).alias("__id"), F.col(at_col).alias("__at"), F.col(url_col).alias("__url"), host(F.col(url_col)).alias("__h"))
    own = F.broadcast(own) if _small(own, F.octet_length("__host") + 8 * F.size("__own")) else own.hint("merge")
    asked = asked.join(own, F.col("__h") == F.col("__host"), "left").crossJoin(F.broadcast(other))  # one row
    lengths = F.concat(F.coalesce("__own", F.array().cast("array<int>")), F.col("__other"))
    asked = asked.select("__k1", "__k2", "__id", "__at", F.explode(keys(F.col("__url"), lengths)).alias("__k")).select("__k1", "__k2", "__id", "__at", F.col("__k.kind").alias("kind"), F.col("__k.value").alias("value"))
    if _small(spans, F.octet_length("value") + F.octet_length("list")):
        hit = asked.join(F.broadcast(spans), ["kind", "value"])
    else:
        hit = _listed(asked, spans).join(spans.hint("merge"), ["kind", "value"])
    hit = hit.where((F.col("__at") >= F.col("since")) & (F.col("until").isNull() | (F.col("__at") < F.col("until"))))
    hit = hit.select("__k1", "__k2", F.col("__id").alias(id_col), F.col("__at").alias(at_col), "list", "kind", "value", "since")
    return scratch.keep(hit, "hits").distinct()  # written, since the join can't split a hot key if an aggregate uses how it was dealt


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """The captures, all columns, that no entry matches."""
    hit = matches(captures, entries, id_col, url_col, at_col).select(F.col("__k1").alias("__m1"), F.col("__k2").alias("__m2")).distinct()
    keyed = captures.select("*", *row_key(id_col, url_col, at_col))
    return keyed.join(hit, (F.col("__k1") == F.col("__m1")) & (F.col("__k2") == F.col("__m2")), "left_anti").select(*[f"`{c}`" for c in captures.columns])


def report(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """(id_col, host, n_matches, lists, blocked) of each capture."""
    hit = matches(captures, entries, id_col, url_col, at_col).groupBy(F.col("__k1").alias("__m1"), F.col("__k2").alias("__m2"))
    hit = hit.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    out = captures.select(F.col(id_col), host(F.col(url_col)).alias("host"), *row_key(id_col, url_col, at_col)).join(hit, (F.col("__k1") == F.col("__m1")) & (F.col("__k2") == F.col("__m2")), "left")
    return out.select(id_col, F.coalesce("host", F.lit("")).alias("host"), F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("lists", F.lit("")).alias("lists"), F.col("n").isNotNull().alias("blocked"))
