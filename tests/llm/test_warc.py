import hashlib
import io

from churnlens.llm import catalog, warc

from .helpers import SF

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def test_copies_revisit_the_smallest_page(spark):
    big, small = "x" * 100, "x" * 99
    got = {r["page_id"]: r for r in warc.transactions(pages(spark, [(5, "http://a/", big), (2, "http://b/", big), (9, None, big), (3, "u", small), (4, "u", small),
                                                                  (6, "http://c/", None), (7, "http://d/", "")])).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        2: ("response", None), 5: ("revisit", 2), 9: ("revisit", 2), 3: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert got[5]["payload_bytes"] == 100 and got[5]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest()
    assert got[6]["payload_bytes"] == 0 and got[6]["payload_digest"] == hashlib.sha256(b"").hexdigest()


def test_payloads_may_hold_anything(spark):
    nasty = ["\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3, "\r\n\r\n", "é \x00\x85" * 40, "\n" * 300]
    found = warc.captures(pages(spark, [(i, f"http://h/{i} b\r\nX: y", t) for i, t in enumerate(nasty)]), payloads=True).collect()
    assert sorted(bytes(r["answer"]["payload"]).decode() for r in found) == sorted(nasty)
    for r in found:
        assert len(r["requests"]) == 1 and len(r["metadata"]) == 1
        assert r["requests"][0]["concurrent_to"] == r["capture_id"]


def test_repeated_rows_are_captures_of_their_own(spark):
    rows = [(1, "http://a/", "p" * 200)] * 3
    got = warc.transactions(pages(spark, rows)).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["record_type"] == "revisit") == [(1, "revisit", 1)] * 2
    assert len(got) == 3


def test_records_in_any_order_and_without_partners(spark):
    r = lambda kind, rid, to: (kind, rid, to, None, None, "d", 0, None, {})
    rows = [r("metadata", "m", "a"), r("request", "q", "a"), r("response", "a", None), r("response", "b", None), r("request", "z", "gone"),
            r("request", "y", None), r("response", None, None)]
    got = {x["capture_id"]: x for x in warc.assemble(spark.createDataFrame(rows, warc.RECORD_SCHEMA)).collect()}
    assert set(got) == {"a", "b"}
    assert [q["record_id"] for q in got["a"]["requests"]] == ["q"] and [m["record_id"] for m in got["a"]["metadata"]] == ["m"]


def test_parse_refuses_a_wrong_digest():
    import pytest
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:00\r\nContent-Type: application/http\r\nContent-Length: 7\r\n\r\nA\r\n\r\nxy\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(bad), True))


def test_empty_table_and_extra_columns(spark):
    df = pages(spark, [(1, "u", "t")]).selectExpr("*", "1 as row", "'a' as digest", "'b' as payload", "2 as bytes")
    assert [r["page_id"] for r in warc.transactions(df).collect()] == [1]
    assert warc.transactions(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    first = {}
    for r in sorted(rows, key=lambda r: r["page_id"]):
        first.setdefault((r["html"] or "").encode(), r["page_id"])
    got = {r["page_id"]: r for r in catalog.op2_warc(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        p = (r["html"] or "").encode()
        refers = first[p] if len(p) >= 100 and first[p] != r["page_id"] else None
        g = got[r["page_id"]]
        assert (g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) == (
            len(p), hashlib.sha256(p).hexdigest(), "response" if refers is None else "revisit", refers)
