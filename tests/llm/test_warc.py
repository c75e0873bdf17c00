import base64
import hashlib

from tierline.llm import warc

SCHEMA = "html string, payload string, page_id long, url string, original int"


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ROWS_PER_FILE", 3)
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\n"
    pages = [(1, "x"), (2, tricky), (3, "x"), (4, None), (5, ""), (6, "é" * 50000), (7, tricky), (8, "x"), (8, "x"), (None, "y"), (None, "x"), (9, "\r\n\r\n")]
    df = spark.createDataFrame([(h, "p", i, None if i == 3 else f"http://h/{i}\r\nX: y", 0) for i, h in pages], SCHEMA)
    path = str(tmp_path / "w")
    got = sorted(map(tuple, warc.archived(df, path=path).collect()), key=repr)
    latest = {}
    for i, h in pages:
        if i is not None:
            latest[h or ""] = max(i, latest.get(h or "", i))
    want = []
    for i, h in pages:
        raw = (h or "").encode()
        top = latest.get(h or "")
        own = top is None or i == top
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else top))
    assert got == sorted(want, key=repr)
    back = warc.read_archives(spark, path, with_payload=True).where("record_type = 'response'").collect()
    assert sorted(bytes(r["payload"]).decode() for r in back) == sorted(h or "" for (i, h), w in zip(pages, want) if w[3] == "response")


def test_small_payloads_and_no_pages(spark):
    df = spark.createDataFrame([("aa", "p", 1, "u", 0), ("aa", "p", 2, "u", 0), ("a" * 9, "p", 3, "u", 0), ("a" * 9, "p", 4, "u", 0)], SCHEMA)
    got = {r["page_id"]: r["record_type"] for r in warc.archived(df, least_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.archived(df.limit(0)).collect() == []
