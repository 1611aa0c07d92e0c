"""Resolving not-modified revisit records of a web archive.

A revisit record of a 304 answer has no content of its own. It stands for the latest earlier full response (one with a
status that carries a whole representation, see FULL) of the same canonical URL, if its validators agree: entity tags by weak comparison, or where either side has none, Last-Modified.
The stored headers are then brought up to date with those of the 304 answer, other than the ones that describe the
stored content or the connection.

The as-of join never brings all captures of a URL together. Time is cut into slices at approximate quantiles of all
captures. For each URL and instant the response that counts is found by a partial aggregation, so that captures of one instant, however
many, are one row; likewise for each slice. A window over a URL's slices (as many rows as slices at most) carries the latest response
forward; inside a slice a window over its instants finds nearer ones; captures join their instant. Bodies take no part; with_payload()
fetches them by record id. warc_records() reads archive files.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import shipping
from tidemark.llm import scratch

#: Headers of a 304 answer that never replace stored ones: of the connection, and those that describe the content.
KEPT_HEADERS = "connection keep-alive proxy-authenticate proxy-authentication-info proxy-authorization proxy-connection te trailer transfer-encoding upgrade content-encoding content-length content-md5 content-range content-type set-cookie".split()
#: Statuses of full responses. A server looks at a condition only where the answer would be 2xx (RFC 9110, 13.2.1); 204 and 205 have no content,
#: 206 a part.
FULL = [s for s in range(200, 300) if s not in (204, 205, 206)]
#: Query parameters that don't change what a URL names.
IGNORED = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid|phpsessid|jsessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. or m., default port, user or scheme; path without a slash at its end; sorted
    parameters without the ignored ones; no fragment. Null if there is no host."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    authority = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r":(80|443)?$", "")
    host = F.regexp_replace(host, r"^(www[0-9]*|m)\.(?=[^.]+\.)", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    wanted = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(IGNORED)))
    joined = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(wanted) > 0, F.concat(F.lit("?"), F.array_join(wanted, "&"))).otherwise(""))
    return F.when(host != "", joined)


def header(headers: Column, name: str) -> Column:
    """The value of a header by its name in lower case, of several the last; null if there is none."""
    return F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(-1))["value"]


def merged(stored: Column, update: Column) -> Column:
    """Stored headers with those of a 304 answer in place of equal names, by name; each as name: value."""
    free = F.filter(update, lambda h: ~F.lower(h["name"]).isin(KEPT_HEADERS))
    names = F.transform(free, lambda h: F.lower(h["name"]))
    left = F.filter(stored, lambda h: ~F.array_contains(names, F.lower(h["name"])))
    low = lambda hs: F.transform(hs, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    return F.array_sort(F.concat(low(left), low(free)))


def resolve(records: DataFrame, slices: int = 256) -> DataFrame:
    """records with canonical_url, outcome, response_id and merged_headers.

    records: record_id (long), url, captured_at (timestamp), status (one of FULL: a full response, 304: a revisit), headers
    (array of name and value). Other columns stay; those of the results' names are replaced. outcome: full, resolved,
    no_url, no_time, no_earlier_response, no_validator, changed (the validators differ), or other for any other status.
    response_id and merged_headers are null unless it is full (its own) or resolved. Earlier means strictly earlier;
    of responses of one time the one of the largest id counts, one without an id comes before all others. Repeated rows each get their
    result; null headers are none; no rows give no rows.
    """
    none = F.array().cast("array<struct<name:string,value:string>>")
    rows = records.withColumn("__url", canonical_url(F.col("url"))).withColumn("__at", F.unix_micros(F.col("captured_at").cast("timestamp")))
    rows = rows.withColumn("__headers", F.coalesce(F.col("headers").cast("array<struct<name:string,value:string>>"), none))
    bounds = rows.agg(F.percentile_approx("__at", [i / slices for i in range(1, slices)], 10_000)).first()[0] or []
    edges = F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<bigint>")
    rows = rows.withColumn("__slice", F.size(F.filter(edges, lambda e: e <= F.col("__at"))))
    usable = F.col("__url").isNotNull() & F.col("__at").isNotNull()
    is_full = F.coalesce(F.col("status").isin(FULL), F.lit(False))
    full = F.when(is_full & usable, F.struct(F.col("__at").alias("at"), F.col("record_id").alias("id"), F.col("__headers").alias("headers")))

    instants = rows.filter(usable).groupBy("__url", "__slice", "__at").agg(F.max(full).alias("__here"))
    instants = scratch.table(instants, "instants")
    last = instants.groupBy("__url", "__slice").agg(F.max("__here").alias("__last"))
    carried = F.max("__last").over(W.partitionBy("__url").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1))
    carried = last.select(F.col("__url").alias("__u"), F.col("__slice").alias("__s"), carried.alias("__carried"))
    near = F.max("__here").over(W.partitionBy("__url", "__slice").orderBy("__at").rowsBetween(W.unboundedPreceding, -1))
    before = instants.withColumn("__near", near).join(carried, (F.col("__url") == F.col("__u")) & (F.col("__slice") == F.col("__s")), "left")
    before = before.select(F.col("__url").alias("__bu"), F.col("__at").alias("__bt"), "__near", "__carried")
    found = rows.filter(usable).join(before, (F.col("__url") == F.col("__bu")) & (F.col("__at") == F.col("__bt")), "left")
    none_yet = F.lit(None).cast(instants.schema["__here"].dataType)
    found = found.drop("__bu", "__bt").unionByName(rows.filter(~usable).withColumns({"__near": none_yet, "__carried": none_yet}))
    found = found.withColumn("__from", F.coalesce("__near", "__carried"))

    stored, update = F.col("__from.headers"), F.col("__headers")
    tags = [F.regexp_replace(header(h, "etag"), "^W/", "") for h in (stored, update)]
    dates = [header(h, "last-modified") for h in (stored, update)]
    agrees = F.when(tags[0].isNotNull() & tags[1].isNotNull(), tags[0] == tags[1]).when(dates[0].isNotNull() & dates[1].isNotNull(), dates[0] == dates[1])
    outcome = (
        F.when(is_full, "full").when(~F.coalesce(F.col("status") == 304, F.lit(False)), "other").when(F.col("__url").isNull(), "no_url").when(F.col("__at").isNull(), "no_time")
        .when(F.col("__from").isNull(), "no_earlier_response").when(agrees.isNull(), "no_validator").when(agrees, "resolved").otherwise("changed")
    )
    results = {
        "canonical_url": F.col("__url"),
        "outcome": F.col("__outcome"),
        "response_id": F.when(F.col("__outcome") == "full", F.col("record_id")).when(F.col("__outcome") == "resolved", F.col("__from.id")),
        "merged_headers": F.when(F.col("__outcome") == "full", merged(F.col("__headers"), none)).when(F.col("__outcome") == "resolved", merged(stored, update)),
    }
    found = found.withColumn("__outcome", outcome)
    return found.select(*[F.col(f"`{c}`") for c in records.columns if c not in results], *[v.alias(k) for k, v in results.items()])


def with_payload(resolved: DataFrame, records: DataFrame, body: str = "body") -> DataFrame:
    """resolved with the body of the response each row stands for; ids of full responses must differ."""
    bodies = records.filter(F.col("status").isin(FULL)).select(F.col("record_id").alias("__id"), F.col(body).alias("payload"))
    return resolved.join(bodies, F.col("response_id") == F.col("__id"), "left").drop("__id")


def captures(pages: DataFrame) -> DataFrame:
    """Two captures of each page, as a crawler would leave them: an answer, and 30 days later a 304 by another URL.

    There are no archive files beside the tables; headers follow from the page. Every seventh 304 has the tag of other content, every
    fifth answer no tag, every eleventh 304 neither tag nor date.
    """
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    date = F.date_format(start + F.make_dt_interval(days=F.pmod("page_id", F.lit(300)).cast("int")), "yyyy-MM-dd")
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    at = lambda days: start + F.make_dt_interval(days=F.lit(days), mins=F.pmod("page_id", F.lit(40_000)).cast("int"))
    some = lambda *parts: F.filter(F.array(*parts), lambda h: h["value"].isNotNull())
    p = F.col("page_id")
    first = pages.select(
        (p * 2).alias("record_id"), "url", at(0).cast("timestamp").alias("captured_at"), F.lit(200).alias("status"),
        some(pair("Content-Type", F.lit("text/html")), pair("Content-Length", F.octet_length(F.coalesce("html", F.lit("")))), pair("ETag", F.when(p % 5 != 0, tag)), pair("Last-Modified", date), pair("Cache-Control", F.lit("max-age=60"))).alias("headers"),
    )
    again = F.regexp_replace(F.regexp_replace(F.col("url"), "^http:", "https:"), "[#].*$", "")
    again = F.concat(again, F.when(again.contains("?"), "&").otherwise("?"), F.lit("utm_source=x"))
    old = F.when(p % 11 == 0, F.lit(None).cast("string")).when(p % 7 == 0, F.lit('"0"')).otherwise(F.concat(F.lit("W/"), tag))
    second = pages.select(
        (p * 2 + 1).alias("record_id"), again.alias("url"), at(30).cast("timestamp").alias("captured_at"), F.lit(304).alias("status"),
        some(pair("etag", old), pair("last-modified", F.when(p % 11 != 0, date)), pair("cache-control", F.lit("max-age=3600")), pair("content-length", F.lit(0)), pair("date", F.date_format(at(30), "yyyy-MM-dd"))).alias("headers"),
    )
    return first.unionByName(second)


WARC_SCHEMA = "file string, number long, record_id string, kind string, url string, captured_at timestamp, profile string, status int, headers array<struct<name:string,value:string>>, body binary, fault string"


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, plain or of gzip members: one row each, in the order (file, number).

    kind is the WARC-Type; status, headers and body are those of the HTTP message in response and revisit records, whose
    body is undone of chunks; a record of another kind has its block as body. A null url or captured_at isn't in the record or not to be read.
    A file that breaks off, or isn't an archive, ends with a row whose fault says so; its records before that stay. A file is read by
    one task and must fit in its memory, as archive files of about 1 GB do. For resolve(), number the rows or hash their record ids.
    """
    shipping.ensure(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.int32(), kinds, pa.binary(), pa.string()]
        names = [f.split()[0] for f in WARC_SCHEMA.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for number, row in enumerate(parsed(memoryview(content.as_buffer()))):
                    rows.append((file.as_py(), number, *row))
                    size += len(row[-2] or b"")
                    if len(rows) == 1000 or size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, WARC_SCHEMA)


def parsed(content) -> Iterator[tuple]:
    """(record id, kind, url, time, profile, status, headers, body, fault) of each record of one archive file."""
    source = io.BytesIO(content)
    if bytes(content[:2]) == b"\x1f\x8b":
        source = io.BufferedReader(gzip.GzipFile(fileobj=source), 1 << 20)
    try:
        while line := source.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("no record begins here")
            fields = {k.lower(): v for k, v in _fields(source)}
            size = int(fields["content-length"])
            block = source.read(size)
            if len(block) < size:
                raise ValueError("the block is shorter than its length")
            kind = fields.get("warc-type", "").lower()
            status, headers, body = _message(block) if kind in ("response", "revisit") and "http" in fields.get("content-type", "") else (None, None, block)
            try:
                at = datetime.fromisoformat(fields["warc-date"].replace("Z", "+00:00"))
            except (KeyError, ValueError):
                at = None
            url = fields.get("warc-target-uri")
            yield fields.get("warc-record-id"), kind, url.strip("<>") if url else None, at, fields.get("warc-profile"), status, headers, body, None
    except (ValueError, KeyError, EOFError, OSError) as e:
        yield None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


def _fields(source) -> Iterator[tuple[str, str]]:
    """Names and values of header lines up to an empty one; lines that begin with white space go on with the one before."""
    name, value = None, ""
    for line in iter(source.readline, b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and name is not None:
            value += " " + text.strip()
            continue
        if name is not None:
            yield name, value
        if not text:
            return
        name, _, value = (x.strip() for x in text.partition(":"))
    if name is not None:
        yield name, value


def _message(block: bytes) -> tuple[int | None, list[dict], bytes]:
    """(status, headers, body) of an HTTP answer."""
    source = io.BytesIO(block)
    first = source.readline().split()
    status = int(first[1]) if len(first) > 1 and first[0].startswith(b"HTTP/") and first[1].isdigit() else None
    headers = [{"name": k, "value": v} for k, v in _fields(source)]
    body = source.read()
    if any(h["name"].lower() == "transfer-encoding" and "chunked" in h["value"].lower() for h in headers):
        body = _unchunked(body)
    return status, headers, body


def _unchunked(body: bytes) -> bytes:
    """The content of a chunked body; a body that isn't chunked after all, as some crawlers store it, stays as it is."""
    source, out = io.BytesIO(body), []
    while line := source.readline():
        try:
            size = int(line.split(b";")[0].strip(), 16)
        except ValueError:
            return body
        if not size:
            break
        out.append(source.read(size))
        source.readline()
    return b"".join(out)
