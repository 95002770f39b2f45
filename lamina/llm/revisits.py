"""Not-modified captures of a crawl, resolved to the full response they stand for.

Records have record_id, url, at (seconds), kind (`response` or `revisit`), status,
headers (a map), digest (of the payload) and body. A full response has status
200. A revisit is joined to the latest full response of the same canonical URL
that is strictly earlier; of several at one moment the one of the largest id.
The verdict is

* `resolved`: the validators agree. Digests are asked first, then ETags (weakly
  compared), then Last-Modified; the first that both records have decides;
* `mismatch`: that validator differs;
* `unverified`: the records have no validator in common;
* `unmatched`: there is no earlier full response, or the URL is NULL or blank.

A resolved revisit gets the response's body and headers, updated by its own
headers except those that may not change with a 304 (`KEPT`). Header names are
lower-cased; of names that differ in case only the first by value counts.

The as-of join is by windows, in two steps, so that no URL is one task's work:
moments of a URL are collapsed to one row each and dealt to time slots; in a
slot the last response before each moment is found, and a slot hands its last
response on to the following ones. A slot of `SLOT` seconds has that many moments
at most, and a URL has as many slots as the crawl has days.

Repeated revisits are resolved one by one; a response that repeats counts once.
Rows without a time are unmatched if revisits, and never a match. record_id tells
responses apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SLOT = 86_400

# Fixed names: header fields that a 304 must not change, and those of a connection.
KEPT = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding",
    "upgrade",
)


def canonical(url: Column) -> Column:
    """Host in lower case without `www.`, default ports and user; path without a last slash; sorted parameters.

    Scheme, fragment and `utm_` parameters do not tell pages apart. NULL for a blank URL.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_replace(bare, r"\?.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_replace(place, "/.*$", "")), "^[^@]*@", "")
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_replace(place, "^[^/]*", ""), "/+$", "")
    asked = F.regexp_replace(F.regexp_replace(bare, r"^[^?]*", ""), r"^\?", "")
    parts = F.array_join(F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    whole = F.concat(host, path, F.when(parts != "", F.concat(F.lit("?"), parts)).otherwise(F.lit("")))
    return F.when(whole != "", whole)


def lowered(headers: Column) -> Column:
    """The headers with lower-case names, one of each."""
    entries = F.array_sort(F.transform(
        F.map_entries(headers), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value"))))
    single = F.filter(entries, lambda e, i: (i == 0) | (e["key"] != F.get(entries, i - 1)["key"]))
    return F.coalesce(F.map_from_entries(single), F.create_map().cast("map<string,string>"))


def latest_before(records: DataFrame, slot: int = SLOT) -> DataFrame:
    """(canonical, at, found): for each moment of a revisit, the id of the latest earlier full response."""
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    moments = (
        records.where(F.col("canonical").isNotNull() & F.col("at").isNotNull() & (full | (F.col("kind") == "revisit")))
        .groupBy("canonical", "at")
        .agg(F.max(F.when(full, F.col("record_id"))).alias("id"), F.bool_or(F.col("kind") == "revisit").alias("asked"))
        .withColumn("slot", F.floor(F.col("at") / slot))
    )
    inside = Window.partitionBy("canonical", "slot").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    near = moments.withColumn("near", F.last("id", ignorenulls=True).over(inside)).where("asked")
    ends = moments.groupBy("canonical", "slot").agg(
        F.max_by("id", F.when(F.col("id").isNotNull(), F.col("at"))).alias("last"))
    across = Window.partitionBy("canonical").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.withColumn("handed", F.last("last", ignorenulls=True).over(across)).select(
        "canonical", "slot", "handed")
    return near.join(handed, ["canonical", "slot"]).select(
        "canonical", "at", F.coalesce("near", "handed").alias("found")).where("found IS NOT NULL")


def resolved(records: DataFrame, slot: int = SLOT) -> DataFrame:
    """Each revisit with verdict, refers_to, status, headers, digest and body of what it stands for."""
    own = records.withColumn("canonical", canonical(F.col("url"))).withColumn("headers", lowered(F.col("headers")))
    asked = own.where(F.col("kind") == "revisit").select("record_id", "url", "canonical", "at", "headers", "digest")
    joined = asked.join(latest_before(own, slot), ["canonical", "at"], "left")
    answers = own.where((F.col("kind") == "response") & (F.col("status") == 200)).select(
        F.col("record_id").alias("found"), F.col("headers").alias("stored"), F.col("digest").alias("stored_digest"),
        F.col("at").alias("stored_at"), "body").dropDuplicates(["found"])
    both = joined.join(answers, "found", "left")

    def tag(headers: str) -> Column:
        return F.regexp_replace(F.col(headers)["etag"], "^W/", "")

    def when_modified(headers: str) -> Column:
        return F.col(headers)["last-modified"]

    agree = F.coalesce(F.col("digest") == F.col("stored_digest"), tag("headers") == tag("stored"),
                       when_modified("headers") == when_modified("stored"))
    verdict = (
        F.when(F.col("stored").isNull(), "unmatched").when(agree.isNull(), "unverified")
        .when(agree, "resolved").otherwise("mismatch")
    )
    fresh = F.map_filter("headers", lambda name, _: ~name.isin(*KEPT))
    merged = F.map_zip_with("stored", fresh, lambda _, old, new: F.coalesce(new, old))
    done = F.col("verdict") == "resolved"
    return both.withColumn("verdict", verdict).select(
        "record_id", "url", "at", "verdict", F.col("found").alias("refers_to"), F.col("stored_at").alias("refers_at"),
        F.when(done, 200).alias("status"), F.when(done, merged).alias("headers"),
        F.when(done, F.col("stored_digest")).alias("digest"), F.when(done, F.col("body")).alias("body"))


def captures(pages: DataFrame, step: int = 40, turns: int = 97) -> DataFrame:
    """Crawl records of a table of pages: a full response for each page, and a not-modified answer later on.

    Pages are fetched `step` seconds apart in order of their id, and asked for
    again some hundred steps later, over https. A third of the answers has a
    digest, a third a weak ETag, a third only the time of the last change.
    """
    number = F.col("page_id")
    later = (number + 1 + F.pmod(number * 7919, F.lit(turns))) * step
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    changed = F.concat(F.lit("t"), (number * step).cast("string"))

    def pairs(*items) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in items]), F.array(*[v for _, v in items]))

    response = pages.select(
        (number * 2).alias("record_id"), "url", (number * step).alias("at"), F.lit("response").alias("kind"),
        F.lit(200).alias("status"),
        pairs(("Content-Type", F.lit("text/html")), ("ETag", tag), ("Last-Modified", changed),
              ("Content-Length", F.octet_length(F.coalesce("html", F.lit(""))).cast("string")),
              ("Cache-Control", F.lit("max-age=60"))).alias("headers"),
        F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.col("html").alias("body"))
    common = (("Content-Length", F.lit("0")), ("Cache-Control", F.lit("max-age=120")),
              ("Age", later.cast("string")))
    third = F.pmod(number, F.lit(3))
    revisit = pages.select(
        (number * 2 + 1).alias("record_id"), F.regexp_replace("url", "^http:", "https:").alias("url"),
        later.alias("at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(third == 0, pairs(*common)).when(third == 1, pairs(*common, ("ETag", F.concat(F.lit("W/"), tag))))
        .otherwise(pairs(*common, ("Last-Modified", changed))).alias("headers"),
        F.when(third == 0, F.md5(F.coalesce("html", F.lit("")))).alias("digest"), F.lit(None).cast("string").alias("body"))
    return response.union(revisit)
