import base64
import hashlib

from verdure.llm import common, warc

PAGES = [(i, f"http://a.b/{i} x", f"<p>{'é' * (i % 4)}{i % 5}</p>") for i in range(40)] + [(100, None, None), (101, "", ""), (None, "u", "<p>null id</p>"), (102, "v", "<p>null id</p>"), (7, "again", "<p>ééé2</p>"), (200, "big", "x" * 300_000)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1, "c") for p in PAGES], "page_id long, url string, html string, id int, digest string").repartition(3)
    folder = common.fresh(spark, "t")
    index = warc.write_archive(pages, folder, frame_bytes=2000)
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", -(2**63)), common.NULL_ID if i is None else i)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        best = last[h or ""]
        me = common.NULL_ID if i is None else i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if best == me else "revisit", None if best == me else best))
    got = [tuple(r)[:5] for r in warc.read_archive(index, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert index.agg({"frame": "max"}).first()[0] > 0
    by = {i: (u, h) for i, u, h in PAGES if i is not None and i != 7}
    for r in index.where("id % 9 = 4").collect():
        head, _, body = warc.fetch(folder, r.bundle, r.frame, r.offset, r.length)
        assert head["WARC-Record-ID"] == f"<urn:page:{r.id}>" and head["WARC-Target-URI"].replace("%20", " ") == (by[r.id][0] or "")
        assert body == ((by[r.id][1] or "").encode() if head["WARC-Type"] == "response" else b"")


def test_short_payloads_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    folder = common.fresh(spark, "t")
    kinds = [r.record_type for r in warc.read_archive(warc.write_archive(pages, folder, min_bytes=3), folder).collect()]
    assert kinds == ["response", "response"]
    folder = common.fresh(spark, "t")
    assert warc.read_archive(warc.write_archive(pages.where("false"), folder), folder).count() == 0
