import datetime as dt
import random

import pytest

from tidemark.llm import revisit

SCHEMA = "record_id long, url string, captured_at timestamp, status int, headers array<struct<name:string,value:string>>, body string, outcome int"


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://WWW.Example.com:80/a/?utm_source=x#top", "example.com/a"), ("https://m.example.com", "example.com/"), ("example.com?b=2&a=1&ref=q", "example.com/?a=1&b=2"), ("https://u:p@example.com:8443/A/b/", "example.com:8443/A/b"),
        ("http://m.de/", "m.de/"), ("", None), (None, None), ("#x", None), ("http:///path", None),
    ],
)
def test_canonical_urls(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(revisit.canonical_url(df.u)).first()[0] == want


def brute(rows, urls):
    low = lambda hs: [(n.lower(), v) for n, v in hs or []]
    value = lambda hs, k: ([v for n, v in hs if n == k] or [None])[-1]
    out = []
    for r, url in zip(rows, urls, strict=True):
        i, _, t, status, headers = r[:5]
        if status != 304:
            out.append((i, "full" if status in revisit.FULL else "other", i if status in revisit.FULL else None, sorted(low(headers)) if status in revisit.FULL else None))
            continue
        earlier = [(q[2], q[0] is not None, q[0] or 0, low(q[4])) for q, u in zip(rows, urls, strict=True) if q[3] in revisit.FULL and u == url and u is not None and t is not None and q[2] is not None and q[2] < t]
        if url is None or t is None or not earlier:
            out.append((i, "no_url" if url is None else "no_time" if t is None else "no_earlier_response", None, None))
            continue
        best = max(earlier, key=lambda e: e[:3])
        tags = [value(h, "etag") for h in (best[3], low(headers))]
        dates = [value(h, "last-modified") for h in (best[3], low(headers))]
        pair = tags if None not in tags else dates if None not in dates else None
        if pair is None or pair[0].removeprefix("W/") != pair[1].removeprefix("W/"):
            out.append((i, "no_validator" if pair is None else "changed", None, None))
            continue
        new = [(n, v) for n, v in low(headers) if n not in revisit.KEPT_HEADERS]
        kept = [(n, v) for n, v in best[3] if n not in {n for n, _ in new}]
        out.append((i, "resolved", best[2], sorted(kept + new)))
    return out


@pytest.mark.parametrize("slices", [1, 2, 16])
def test_against_brute_force(spark, slices):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        url = rng.choice(["http://a.org/x", "http://a.org/x", "https://www.a.org/x/#f", "http://a.org/y?ref=1", None, "", f"http://b.org/{rng.randint(0, 20)}"])
        headers = [h for h in (("ETag", rng.choice(['"1"', 'W/"1"', '"2"'])), ("Last-Modified", rng.choice("ab")), ("Content-Length", str(i)), ("Date", str(i))) if rng.random() < 0.7]
        rows.append((i, url, start + dt.timedelta(minutes=rng.randint(0, 60)) if rng.random() < 0.97 else None, rng.choice([200, 203, 304, 304, 206, 404, None]), headers if rng.random() < 0.95 else None, f"body {i}", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    urls = {r[0]: r[1] for r in df.select("record_id", revisit.canonical_url(df.url)).collect()}
    got = revisit.resolve(df, slices)
    have = {r["record_id"]: (r["record_id"], r["outcome"], r["response_id"], None if r["merged_headers"] is None else sorted((h["name"], h["value"]) for h in r["merged_headers"])) for r in got.collect()}
    assert [have[i] for i in range(400)] == brute(rows, [urls[i] for i in range(400)])
    bodies = revisit.with_payload(got, df).filter("outcome = 'resolved'").collect()
    assert bodies and all(r["payload"] == f"body {r['response_id']}" for r in bodies)


def test_captures_and_no_rows(spark):
    pages = spark.createDataFrame([(i, f"http://www.a.org/{i % 3}", "<p>" if i % 4 else None) for i in range(60)], "page_id long, url string, html string")
    got = revisit.resolve(revisit.captures(pages)).groupBy("outcome").count().collect()
    assert sum(r[1] for r in got) == 120 and {"full", "resolved", "changed", "no_validator"} <= {r[0] for r in got}
    assert revisit.resolve(revisit.captures(pages.filter("page_id < 0"))).collect() == []
    same = spark.createDataFrame([(None, "http://a.org", dt.datetime(2024, 1, 1), 200, [("ETag", "1")], "", 1)] * 2 + [(5, "http://a.org", dt.datetime(2024, 1, 2), 304, [("ETag", "1")], "", 1)] * 2, SCHEMA)
    assert sorted(r["outcome"] for r in revisit.resolve(same).collect()) == ["full", "full", "resolved", "resolved"]


def test_many_captures_of_one_instant_and_long_headers(spark):
    start = dt.datetime(2024, 1, 1)
    url = "http://a.org/" + "x" * 200_000
    rows = [(i, url, start, 200, [("ETag", '"1"')], "b", 1) for i in range(2000)] + [(5000 + i, url, start + dt.timedelta(hours=1), 304, [("ETag", '"1"'), ("X", "y" * 100_000)] if i == 0 else [("ETag", '"1"')], None, 1) for i in range(300)]
    got = {r["record_id"]: (r["outcome"], r["response_id"]) for r in revisit.resolve(spark.createDataFrame(rows, SCHEMA)).select("record_id", "outcome", "response_id").collect()}
    assert len(got) == 2300 and all(got[5000 + i] == ("resolved", 1999) for i in range(300))


def record(kind, fields, block):
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **fields, "Content-Length": len(block)}.items())
    return f"WARC/1.0\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def archive():
    http = {"Content-Type": "application/http; msgtype=response"}
    answer = b'HTTP/1.1 200 OK\r\nETag: "1"\r\nX-Long: a\r\n b\r\n\r\nbody \xff\x00 text'
    chunked = b"HTTP/1.1 203 Fine\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nWiki\r\n5;x=1\r\npedia\r\n0\r\n\r\n"
    return [
        record("warcinfo", {"WARC-Date": "2024-01-01T00:00:00Z"}, b"software: x"),
        record("request", {"WARC-Target-URI": "http://a.org/", "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\n\r\n"),
        record("response", {"WARC-Record-ID": "<urn:1>", "WARC-Target-URI": "<http://a.org/>", "WARC-Date": "2024-01-01T00:00:00Z", **http}, answer),
        record("response", {"WARC-Record-ID": "<urn:2>", "WARC-Target-URI": "http://a.org/c", "WARC-Date": "never", **http}, chunked),
        record("revisit", {"WARC-Record-ID": "<urn:3>", "WARC-Target-URI": "https://www.a.org", "WARC-Date": "2024-01-02T00:00:00.5Z", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/server-not-modified", **http}, b'HTTP/1.1 304 Not Modified\r\nETag: W/"1"\r\n\r\n'),
    ]


def test_archive_files(spark, tmp_path):
    import gzip

    from pyspark.sql import functions as F

    records = archive()
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "c.warc").write_bytes(records[0] + records[2][:-40])
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "e.warc").write_bytes(b"no archive")
    (tmp_path / "f.warc.gz").write_bytes(gzip.compress(records[0])[:-9])
    got = revisit.warc_records(spark, str(tmp_path)).orderBy("file", "number").collect()
    by = {}
    for r in got:
        by.setdefault(r["file"].rsplit("/", 1)[1], []).append(r)
    assert [tuple(r)[1:] for r in by["a.warc"]] == [tuple(r)[1:] for r in by["b.warc.gz"]] and len(by["a.warc"]) == 5
    first, second, third = by["a.warc"][2:]
    assert (first["url"], first["status"], bytes(first["body"])) == ("http://a.org/", 200, b"body \xff\x00 text")
    assert [(h["name"], h["value"]) for h in first["headers"]] == [("ETag", '"1"'), ("X-Long", "a b")]
    assert bytes(second["body"]) == b"Wikipedia" and second["captured_at"] is None and third["status"] == 304
    assert [r["fault"] is None for r in by["c.warc"]] == [True, False] and "d.warc" not in by and len(by["e.warc"]) == 1 and by["f.warc.gz"][-1]["fault"]
    captures = revisit.warc_records(spark, str(tmp_path / "a.warc")).filter("kind in ('response', 'revisit')")
    out = revisit.resolve(captures.withColumn("record_id", F.col("number"))).collect()
    assert sorted((r["number"], r["outcome"], r["response_id"]) for r in out) == [(2, "full", 2), (3, "full", 3), (4, "resolved", 2)]
