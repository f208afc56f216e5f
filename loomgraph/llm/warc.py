"""Not-modified revisits of web archives: an as-of join by canonical URL to the latest earlier full response.

Records: record_id, kind ('response' or 'revisit'), url, ts, etag, last_modified, headers (map). A revisit takes the
latest full response of its canonical URL with a lesser ts (ties: the greatest record_id), its validators are checked
(etags if both have one, else the last-modified values), and if they agree the headers that a 304 may carry replace
those of the response.

The join is made of aggregates and two windows. Time is cut into spans. The last response of each URL and second, and of
each URL and span, are aggregates (combined before the shuffle); a window over a URL's spans carries the last response
into each span; a window over the seconds of one URL and span finds the last response within. A hot URL is thus split by
time, and no window holds more than a span's seconds or a URL's spans, however many records there are. Only small records
move: neither payloads nor pages.

Cases: records with a null URL or time, and revisits without an earlier response, are unresolved; a response or revisit
without validators in common is 'unchecked'; empty URLs are a URL like others; repeated rows are records of their own;
null headers are no headers, and very long URLs and headers are taken whole; other columns do not pass. An empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers that a 304 response may update (RFC 9110, 15.4.5), and query parameters that only track.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified"]
TRACKING = "(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)"


def canonical_url(url: Column) -> Column:
    """Without scheme, user, www., m., default port, fragment, tracking parameters and closing slashes; host in lower case."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^(.*@)?((www|m)\.)?|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    asked = F.regexp_extract(rest, r"\?(.*)$", 1)
    asked = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), asked), f"&{TRACKING}=[^&]*", ""), "^&+", "")
    return F.concat(host, path, F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked)))


def resolve_revisits(records: DataFrame, span: int = 86_400) -> DataFrame:
    """record_id, url_key, ts, response_id, response_ts, status, headers of every revisit.

    status: 'resolved', 'mismatch', 'unchecked' or 'unresolved'. headers: merged where resolved, else the revisit's own."""
    none = F.create_map().cast("map<string,string>")
    rows = records.select(canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "kind", "record_id", "etag", "last_modified", F.coalesce("headers", none).alias("headers"))
    rows = rows.withColumn("span", F.floor(F.col("ts") / span))
    response = F.struct("ts", "record_id", "etag", "last_modified", "headers")
    usable = rows.where("url_key is not null and ts is not null")
    answered = F.col("kind") == "response"
    seconds = usable.groupBy("url_key", "span", "ts").agg(F.max_by(F.when(answered, response), F.when(answered, F.col("record_id"))).alias("own"), F.max(~answered).alias("asked"))
    spans = usable.groupBy("url_key", "span").agg(F.max_by(F.when(answered, response), F.when(answered, F.struct("ts", "record_id"))).alias("latest"))
    over = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("url_key", "span", F.last("latest", ignorenulls=True).over(over).alias("carried"))
    within = Window.partitionBy("url_key", "span").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    near = seconds.withColumn("near", F.last("own", ignorenulls=True).over(within)).where("asked")
    near = near.join(spans.where("carried is not null"), ["url_key", "span"], "left").select("url_key", "ts", F.coalesce("near", "carried").alias("r"))
    found = usable.where("kind = 'revisit'").join(near, ["url_key", "ts"])
    lost = rows.where("kind = 'revisit' and (url_key is null or ts is null)").withColumn("r", F.lit(None).cast(found.schema["r"].dataType))
    both = found.select("url_key", "ts", "record_id", "etag", "last_modified", "headers", "r").unionByName(lost.select("url_key", "ts", "record_id", "etag", "last_modified", "headers", "r"))
    tagged = F.col("etag").isNotNull() & F.col("r.etag").isNotNull()
    dated = F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull()
    agree = F.when(tagged, F.regexp_replace("etag", "^W/", "") == F.regexp_replace("r.etag", "^W/", "")).when(dated, F.col("last_modified") == F.col("r.last_modified"))
    status = F.when(F.col("r").isNull(), "unresolved").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    permitted = F.map_filter("headers", lambda k, v: F.lower(k).isin(PERMITTED))
    names = F.transform(F.map_keys(permitted), F.lower)
    merged = F.map_concat(F.map_filter("r.headers", lambda k, v: ~F.array_contains(names, F.lower(k))), permitted)
    return both.withColumn("status", status).select("record_id", "url_key", "ts", F.col("r.record_id").alias("response_id"), F.col("r.ts").alias("response_ts"), "status", F.when(F.col("status") == "resolved", merged).otherwise(F.col("headers")).alias("headers"))


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl log of the pages: each page is a response, and is asked for again by another form of its URL some time
    later; every fifth revisit has a stale etag, every seventh only a date, every eleventh no validator."""
    page = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("etag"), F.length("html").cast("string").alias("size"))
    day = F.concat(F.lit("day "), F.floor(F.col("page_id") / 7).cast("string"))
    headers = F.create_map(F.lit("Content-Length"), F.coalesce("size", F.lit("0")), F.lit("ETag"), F.col("etag"), F.lit("Date"), F.col("page_id").cast("string"))
    full = page.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (F.col("page_id") * 997).alias("ts"), "etag", day.alias("last_modified"), headers.alias("headers"))
    again = page.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        F.lit("revisit").alias("kind"),
        F.concat(F.regexp_replace("url", "^http:", "https:"), F.lit("#again")).alias("url"),
        (F.col("page_id") * 997 + 50_000 * (1 + F.col("page_id") % 9)).alias("ts"),
        F.when(F.col("page_id") % 7 == 0, F.lit(None)).when(F.col("page_id") % 11 == 0, F.lit(None)).when(F.col("page_id") % 5 == 0, F.concat(F.lit("old"), F.col("etag"))).otherwise(F.col("etag")).alias("etag"),
        F.when(F.col("page_id") % 11 == 0, F.lit(None)).otherwise(day).alias("last_modified"),
        F.create_map(F.lit("Date"), F.concat(F.lit("again "), F.col("page_id").cast("string")), F.lit("Content-Length"), F.lit("0")).alias("headers"),
    )
    return full.unionByName(again)


def op7_query(spark, sf_dir: str) -> DataFrame:
    from .tables import read

    out = resolve_revisits(crawl_records(read(spark, sf_dir, "pages")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("record_id", "url_key", "ts", "response_id", "response_ts", "status", shown.alias("headers"))


OP7_SQL = r"""
WITH c AS (
    SELECT page_id, md5(coalesce(html, '')) AS etag, coalesce(CAST(length(html) AS VARCHAR), '0') AS size, 'day ' || CAST(CAST(floor(page_id / 7) AS BIGINT) AS VARCHAR) AS day,
        regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM pages
), u AS (
    SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^(.*@)?((www|m)\.)?|:(80|443)$', '', 'g') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS front,
        regexp_replace(regexp_replace('&' || regexp_extract(rest, '\?(.*)$', 1), '&(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)=[^&]*', '', 'g'), '^&+', '') AS asked FROM c
), p AS (SELECT *, front || CASE WHEN asked = '' THEN '' ELSE '?' || asked END AS url_key FROM u
), v AS (
    SELECT page_id * 2 + 1 AS record_id, page_id, url_key, page_id * 997 + 50000 * (1 + page_id % 9) AS ts,
        CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 'old' || etag ELSE etag END AS etag, CASE WHEN page_id % 11 = 0 THEN NULL ELSE day END AS day FROM p
), j AS (
    SELECT v.*, r.page_id * 2 AS response_id, r.page_id * 997 AS response_ts, r.etag AS re, r.day AS rd, r.size, r.page_id AS rp,
        row_number() OVER (PARTITION BY v.record_id ORDER BY r.page_id * 997 DESC, r.page_id DESC) AS n
    FROM v LEFT JOIN p r ON r.url_key = v.url_key AND r.page_id * 997 < v.ts
), s AS (
    SELECT *, CASE WHEN response_id IS NULL THEN 'unresolved' WHEN etag IS NOT NULL THEN CASE WHEN etag = re THEN 'resolved' ELSE 'mismatch' END
        WHEN day IS NULL THEN 'unchecked' WHEN day = rd THEN 'resolved' ELSE 'mismatch' END AS status FROM j WHERE n = 1
)
SELECT record_id, url_key, ts, response_id, response_ts, status,
    CASE WHEN status = 'resolved' THEN 'Content-Length=' || size || ';Date=again ' || CAST(page_id AS VARCHAR) || ';ETag=' || re
    ELSE 'Content-Length=0;Date=again ' || CAST(page_id AS VARCHAR) END AS headers FROM s
"""
