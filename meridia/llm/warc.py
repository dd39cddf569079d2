"""WARC revisit records of the kind not-modified, resolved to the response they confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 answer may bring up to date; others stay as stored.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name content.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")
#: Seconds of a URL's history that one task handles together.
CHUNK_SECONDS = 1 << 20


def canonical_url(url: Column) -> Column:
    """One name for a page: no scheme, fragment, ``www.``, default port, tracking parameters or
    trailing slash; the host in lower case, parameters sorted."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    asked = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Find for each not-modified revisit the latest earlier full response of its page.

    ``records``: ``record_id``, ``url``, ``ts`` (long, seconds), ``kind``
    (``response`` or ``revisit``), ``status`` (int), ``etag``, ``last_modified``
    and ``headers`` (map of names to values); other columns are ignored.  A full
    response has kind ``response`` and status 200.  "Earlier" is a smaller
    ``(ts, record_id)``, on the same canonical URL.

    The validators agree if both records have an etag and these are equal, apart
    from a weak mark; or, where one of them has none, if both have equal
    last-modified dates.  Only then does the revisit resolve.

    Returns for each revisit ``record_id, url_key, source_id`` (the response, or
    null), ``outcome`` (``resolved``, ``changed``: validators differ,
    ``unverified``: none to compare, ``orphan``: no earlier response) and
    ``headers`` (of a resolved one: the response's, with the permitted headers of
    the revisit put over them; names in lower case).

    Null URL, time or id: a revisit is an orphan, a response is no source.  A
    record_id should be unique: of responses that share one, the latest gives
    validators and headers; repeated revisits give a row each.  No revisits: an
    empty table.
    Payloads never move: join them by ``source_id``.  A page's history is cut
    into spans of time, and what is latest before each span is carried in, so a
    page with very many records does not meet in one task.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "status", F.regexp_replace("etag", r"^W/", "").alias("etag"), "last_modified", "headers")
    rows = rows.withColumn("headers", _lower_keys(F.col("headers"))).withColumn("span", F.floor(F.col("ts") / CHUNK_SECONDS))
    known = F.col("url_key").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    full = known & (F.col("kind") == "response") & (F.col("status") == 200)
    rows = rows.where((F.col("kind") == "revisit") | full)
    place = F.struct("ts", "record_id")
    source = F.struct(F.col("ts").alias("ts"), F.col("record_id").alias("record_id"))
    # the last response of each span, and from it the last one before each span
    ends = rows.where(full).groupBy("url_key", "span").agg(F.max(source).alias("end"))
    spans = rows.where(known).select("url_key", "span").distinct().join(ends, ["url_key", "span"], "left")
    before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("carried", F.max("end").over(before)).select("url_key", "span", "carried")
    inside = Window.partitionBy("url_key", "span").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.where(known).withColumn("own", F.max(F.when(full, source)).over(inside)).where("kind = 'revisit'")
    placed = placed.join(carried, ["url_key", "span"], "left").withColumn("source_id", F.coalesce("own", "carried")["record_id"])
    lost = rows.where((F.col("kind") == "revisit") & ~F.coalesce(known, F.lit(False)))
    asked = placed.select("record_id", "url_key", "etag", "last_modified", "headers", "source_id").unionByName(lost.select("record_id", "url_key", "etag", "last_modified", "headers"), allowMissingColumns=True)
    kept = F.struct("ts", F.col("etag").alias("s_etag"), F.col("last_modified").alias("s_modified"), F.array_sort(F.map_entries("headers")).alias("entries"))
    found = rows.where(full).groupBy(F.col("record_id").alias("source_id")).agg(F.max(kept).alias("r"))
    found = found.select("source_id", "r.s_etag", "r.s_modified", F.map_from_entries("r.entries").alias("s_headers"))
    out = asked.join(found, "source_id", "left")
    tags = F.col("etag").isNotNull() & F.col("s_etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("s_modified").isNotNull()
    outcome = (
        F.when(F.col("source_id").isNull(), "orphan")
        .when(tags, F.when(F.col("etag") == F.col("s_etag"), "resolved").otherwise("changed"))
        .when(dates, F.when(F.col("last_modified") == F.col("s_modified"), "resolved").otherwise("changed"))
        .otherwise("unverified")
    )
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    stale = F.map_filter("s_headers", lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    return out.withColumn("outcome", outcome).select(
        "record_id", "url_key", F.when(F.col("outcome") == "resolved", F.col("source_id")).alias("source_id"), "outcome", F.when(F.col("outcome") == "resolved", F.map_concat(stale, fresh)).alias("headers")
    )


def _lower_keys(headers: Column) -> Column:
    """Names in lower case; of names that differ in case only, the first in order holds."""
    entries = F.transform(F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    start = F.array().cast("array<struct<key:string,value:string>>")
    first = F.aggregate(entries, start, lambda acc, e: F.when(F.exists(acc, lambda x: x["key"] == e["key"]), acc).otherwise(F.array_append(acc, e)))
    return F.map_from_entries(first)
