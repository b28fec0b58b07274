"""WARC records, and the resolution of not-modified revisits.

``resolve`` gives every revisit record the latest earlier full response of the same
canonical URL (an as-of join), checks that their validators agree, and merges the
headers that a 304 response may update into the stored ones.

The as-of join doesn't gather a URL's records in one task: records are cut into
slices of time, each slice's latest response is found by aggregation, the latest
of the earlier slices is carried over them, and only a slice is sorted.

``read_warc`` and ``to_warc`` are the file format: records of whole WARC/1.0 files,
plain or gzip by member. Times are ISO 8601 there and whole seconds here; a record id
that ``to_warc`` didn't write becomes a 64-bit hash of it.

Edge cases: a revisit without an earlier response is ``unresolved``; one whose
validators contradict the response is ``mismatch`` and takes no headers; null
validators on either side agree with anything, but at least one must be on both
sides, else the outcome is ``unverified``; responses at the revisit's own time
aren't earlier; of responses at one time the larger id wins; null URLs, times and
kinds are resolved for no revisit; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick, table

#: Query parameters that name no other resource.
IGNORED_PARAMS = r"^(utm_[a-z]*|ref|fbclid|gclid|sessionid)(=|$)"
#: Headers of a stored response that a 304 must not replace.
FIXED_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
SLICE_SECONDS = 86_400
RECORD = ("record_id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers")


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment, trailing slash and tracking parameters; host in
    lower case, parameters in order."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(IGNORED_PARAMS)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """A row a revisit: ``record_id, url_key, response_id, outcome, headers`` (merged, by name).

    ``records``: record_id long, url, ts (seconds, long), kind ('response' or 'revisit'), etag,
    last_modified, digest, headers map<string,string> with names in lower case.
    """
    r = pick(records, *RECORD).withColumn("url_key", canonical_url(F.col("url")))
    r = r.withColumn("slice", F.floor(F.col("ts") / SLICE_SECONDS))
    known = r.where("url_key IS NOT NULL AND ts IS NOT NULL")
    slim = known.select("record_id", "url_key", "ts", "slice", "kind", "etag", "last_modified", "digest", F.array_sort(F.map_entries("headers")).alias("entries"))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "digest", "entries"))
    slim = slim.withColumn("full", full)
    # The latest response before each slice: one row a URL and slice.
    last = slim.groupBy("url_key", "slice").agg(F.max("full").alias("latest"))
    earlier = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("url_key", "slice", F.max("latest").over(earlier).alias("carried"))
    within = Window.partitionBy("url_key", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    slim = slim.withColumn("near", F.max("full").over(within)).where("kind = 'revisit'").drop("full")
    v = slim.join(last, ["url_key", "slice"]).withColumn("resp", F.coalesce("near", "carried"))

    pairs = [(_opaque(F.col("etag")), _opaque(F.col("resp.etag"))), (F.col("last_modified"), F.col("resp.last_modified")), (F.col("digest"), F.col("resp.digest"))]
    clash = F.lit(False)
    agree = F.lit(False)
    for a, b in pairs:
        clash = clash | F.coalesce(a != b, F.lit(False))
        agree = agree | F.coalesce(a == b, F.lit(False))
    outcome = F.when(F.col("resp").isNull(), "unresolved").when(clash, "mismatch").when(agree, "resolved").otherwise("unverified")
    fresh = F.filter(F.coalesce("entries", F.expr("array()")), lambda e: ~F.lower(e["key"]).isin(*FIXED_HEADERS))
    names = F.transform(fresh, lambda e: e["key"])
    stored = F.filter(F.coalesce("resp.entries", F.expr("array()")), lambda e: ~F.array_contains(names, e["key"]))
    merged = F.when(F.col("outcome") == "resolved", F.array_sort(F.concat(stored, fresh)))
    out = v.withColumn("outcome", outcome).select("record_id", "url_key", F.when(F.col("outcome") != "unresolved", F.col("resp.record_id")).alias("response_id"), "outcome", F.map_from_entries(merged).alias("headers"))
    lost = r.where("kind = 'revisit' AND (url_key IS NULL OR ts IS NULL)")
    return out.unionByName(lost.select("record_id", "url_key", F.lit(None).cast("long").alias("response_id"), F.lit("unresolved").alias("outcome"), F.lit(None).cast("map<string,string>").alias("headers")))


DATE = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:[Tt ](\d\d):(\d\d)(?::(\d\d)(?:[.,]\d+)?)?(?:[Zz]|([+-])(\d\d):?(\d\d))?)?)?)?")


def _iso(ts: int | None) -> str | int | None:
    """Seconds as a WARC-Date; beyond the calendar's years, as they are."""
    try:
        return None if ts is None else (datetime(1970, 1, 1) + timedelta(seconds=ts)).isoformat() + "Z"
    except OverflowError:
        return ts


def _seconds(date: str) -> int | None:
    """A WARC-Date, of any precision from the year down, as seconds; also plain seconds."""
    if m := DATE.fullmatch(date):
        y, mo, d, h, mi, s = (int(x or low) for x, low in zip(m.groups()[:6], (0, 1, 1, 0, 0, 0), strict=True))
        off = timedelta(hours=int(m[8]), minutes=int(m[9])) * (-1 if m[7] == "-" else 1) if m[7] else timedelta()
        try:  # a leap second runs over into the next minute
            return int(datetime(y, mo, d, h, mi, tzinfo=UTC).timestamp()) + s - int(off.total_seconds())
        except ValueError:
            return None
    return int(date) if re.fullmatch(r"-?\d{1,18}", date) else None


def _record_id(text: str | None) -> int | None:
    """The id that ``to_warc`` wrote, or a 64-bit hash."""
    if not text:
        return None
    if (m := re.fullmatch(r"<?urn:x-record:(-?\d+)>?", text)) and -(1 << 63) <= int(m[1]) < 1 << 63:
        return int(m[1])
    h = xxhash.xxh64_intdigest(text.strip("<>").encode())
    return h - (1 << 64) if h >> 63 else h


def to_warc(records: DataFrame, column: str = "warc") -> DataFrame:
    """``record_id`` and one WARC/1.0 record each, as bytes; ``payload`` is an optional column."""
    extra = ["payload"] if "payload" in records.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                http = [("HTTP/1.1 200 OK" if r["kind"] == "response" else "HTTP/1.1 304 Not Modified")]
                http += [f"{k}: {v}" for k, v in sorted(dict(r["headers"] or {}).items())]
                body = "\r\n".join([*http, "", ""]).encode() + (r.get("payload") or "").encode()
                head = [("WARC-Type", r["kind"]), ("WARC-Record-ID", f"<urn:x-record:{r['record_id']}>"), ("WARC-Target-URI", r["url"]), ("WARC-Date", _iso(r["ts"])), ("WARC-Payload-Digest", r["digest"]), ("Content-Type", "application/http"), ("Content-Length", len(body))]
                lines = ["WARC/1.0", *[f"{k}: {v}" for k, v in head if v is not None], "", ""]
                rows.append("\r\n".join(lines).encode() + body + b"\r\n\r\n")
            yield pa.RecordBatch.from_arrays([b.column("record_id"), pa.array(rows, pa.binary())], ["record_id", column])

    return pick(records, *RECORD, *extra).mapInArrow(run, f"record_id long, {column} binary")


def _gunzip(data: bytes) -> bytes:
    out = bytearray()
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(wbits=31)
        try:
            out += one.decompress(data) + one.flush()
        except zlib.error:
            break
        data = one.unused_data
    return bytes(out)


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of one file; a gzip file is one member a record or one for all, and of a damaged one what comes
    before the damage. A record whose length is missing or no number goes up to the next record."""
    if data[:2] == b"\x1f\x8b":
        data = _gunzip(data)
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        if (length := head.get("content-length", "")).isascii() and length.isdigit():
            n = int(length)
        else:
            n = max(0, data.find(b"\r\n\r\nWARC/1.", end + 4) - end - 4) if data.find(b"\r\n\r\nWARC/1.", end + 4) >= 0 else len(data) - end - 4
        block = data[end + 4 : end + 4 + n]
        http, _, payload = block.partition(b"\r\n\r\n")
        headers = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:]) if sep}
        yield {
            "record_id": _record_id(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "ts": _seconds(head.get("warc-date", "")), "kind": head.get("warc-type"),
            "etag": headers.get("etag"), "last_modified": headers.get("last-modified"), "digest": head.get("warc-payload-digest"), "headers": list(headers.items()), "payload": payload.decode("utf-8", "replace"),
        }
        at = end + 4 + n


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, payload string"
    arrow = pa.schema([("record_id", pa.int64()), ("url", pa.string()), ("ts", pa.int64()), ("kind", pa.string()), ("etag", pa.string()), ("last_modified", pa.string()), ("digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                yield pa.RecordBatch.from_pylist(list(parse_warc(data.as_py())), schema=arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def capture_log(pages: DataFrame) -> DataFrame:
    """A crawl's records from all pages: each page is fetched in full once, an hour apart, then checked
    again up to three times under other spellings of its URL; some checks carry validators of
    another version, some none, some come before the fetch."""
    p = pick(pages, "page_id", "url", "html").where("page_id IS NOT NULL")
    p = p.select("page_id", "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), (F.col("page_id") * 3600).alias("t"))
    p = p.withColumn("etag", F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))).withColumn("modified", F.col("t").cast("string"))
    f = p.select(
        (F.col("page_id") * 4).alias("record_id"), "url", F.col("t").alias("ts"), F.lit("response").alias("kind"), "etag", F.col("modified").alias("last_modified"), "digest",
        F.create_map(F.lit("etag"), "etag", F.lit("content-length"), F.length("digest").cast("string"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-type"), F.lit("text/html")).alias("headers"))
    k = F.col("k")
    r = p.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).where((F.col("page_id") + k) % 3 != 0)
    etag = F.when(F.col("page_id") % 7 == 0, F.lit('"other"')).when(F.col("page_id") % 11 != 0, F.concat(F.when(k == 2, F.lit("W/")).otherwise(""), F.col("etag")))
    ts = F.when((F.col("page_id") % 13 == 0) & (k == 1), F.col("t") - 60).otherwise(F.col("t") + k * 100_000)
    r = r.select(
        (F.col("page_id") * 4 + k).alias("record_id"), F.concat("url", F.when(F.col("url").contains("#"), "").otherwise("#again")).alias("url"), ts.alias("ts"), F.lit("revisit").alias("kind"), etag.alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("cache-control"), F.concat(F.lit("max-age="), (k * 60).cast("string")), F.lit("content-length"), F.lit("0"), F.lit("age"), k.cast("string")).alias("headers"))
    return f.unionByName(r)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(capture_log(table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", F.floor(F.col("record_id") / 4).alias("page_id"), "url_key", "response_id", "outcome", text.alias("headers"))


SQL = {"op4_warc_revisits": r"""
WITH p AS (SELECT page_id, url, sha256(coalesce(html, '')) AS digest, page_id * 3600 AS t FROM pages WHERE page_id IS NOT NULL),
f AS (SELECT page_id * 4 AS record_id, url, t AS ts, '"' || left(digest, 16) || '"' AS etag FROM p),
v AS (SELECT page_id, k, page_id * 4 + k AS record_id, url,
  CASE WHEN page_id % 13 = 0 AND k = 1 THEN t - 60 ELSE t + k * 100000 END AS ts,
  CASE WHEN page_id % 7 = 0 THEN '"other"' WHEN page_id % 11 <> 0 THEN '"' || left(digest, 16) || '"' END AS etag
  FROM p CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE (page_id + k) % 3 <> 0),
u AS (SELECT DISTINCT url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://', '') AS rest FROM p WHERE url IS NOT NULL),
c0 AS (SELECT url, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www\.', ''), ':(80|443)$', '') AS host,
  regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS params FROM u),
c AS (SELECT url, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key FROM c0),
fk AS (SELECT f.*, url_key FROM f JOIN c USING (url)),
j AS (SELECT v.record_id, v.page_id, v.k, c.url_key, v.etag, arg_max(fk.record_id, (fk.ts, fk.record_id)) AS response_id, arg_max(fk.etag, (fk.ts, fk.record_id)) AS stored
  FROM v LEFT JOIN c USING (url) LEFT JOIN fk ON fk.url_key = c.url_key AND fk.ts < v.ts GROUP BY ALL),
o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'unresolved' WHEN etag IS NULL THEN 'unverified' WHEN etag <> stored THEN 'mismatch' ELSE 'resolved' END AS outcome FROM j)
SELECT record_id, page_id, url_key, response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'age: ' || k || chr(10) || 'cache-control: max-age=' || (k * 60) || chr(10) || 'content-length: 64' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || stored END AS headers
FROM o"""}
