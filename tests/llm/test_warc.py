"""Archives: an exact round trip, the revisits, and the index."""

import base64
import hashlib

import pytest

from surveyframe.llm import warc
from tests.conftest import SF_DIR

ODD = [
    (5, "http://a.b.org/x?y#z", "same"),
    (3, "http://a.b.org/x?y#z", "same"),
    (9, None, "same"),
    (None, "not a url", "same"),
    (None, "http://[::1", "only nulls"),
    (None, None, "only nulls"),
    (4, "http://c.org/\r\nWARC-Type: x", None),
    (6, "//c.org", ""),
    (7, "https://u:p@c.org:80/é\r\n\r\n", "é\r\n\r\n\0"),
    (7, "https://u:p@c.org:80/é\r\n\r\n", "é\r\n\r\n\0"),
    (8, "http://c.org/", "x" * 3_000_000),
    (-2, "http://c.org/", "twice"),
    (-2, "http://c.org/", "twice, another"),
]


def wanted(rows, min_bytes=0):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        f = first.get(html or "")
        again = len(raw) >= min_bytes and f is not None and page != f
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_odd_rows(spark, min_bytes):
    df = spark.createDataFrame([(*r, 1, "x") for r in ODD], "page_id long, url string, html string, size long, sha1 string")
    got = warc.archive_round_trip(df, min_bytes=min_bytes, payloads=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == wanted(ODD, min_bytes)
    assert {r.payload for r in got if r.record_type == "response"} == {r[2] or "" for r in ODD}
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_many_blocks_and_one_hot_url(spark, monkeypatch):
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i}.org/{i}", f"page {i // 2}") for i in range(9_000)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), partitions=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == wanted(rows)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in warc.archive_round_trip(pages).collect()), key=str) == wanted(rows)


def test_keys_reverse_the_host():
    assert warc.url_key("http://A.b.org/x?y#z") == "org,b,a)/x?y"
    assert warc.entry(None, None) < warc.entry(None, -5) < warc.entry(None, 5) < warc.entry("http://a.org", 0)
