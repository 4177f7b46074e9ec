"""WARC archives: round trips, the member layout, the index, odd rows."""

import base64
import collections
import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string"


def rows_of(n):
    rnd = random.Random(4)
    parts = ["\r\n", "\n", "\r", "\r\n\r\n", "WARC/1.1\r\n", "Content-Length: 5\r\n", "é漢🙂", "<p>", " ", "x" * 50]
    texts = ["", None, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "y" * 300_000] + [
        "".join(rnd.choices(parts, k=rnd.randint(1, 12))) for _ in range(n)]
    urls = ["http://a.example/b", None, "", "http://a.example/x y\r\nEvil: 1", "http://é.example/"]
    return [(i, rnd.choice(urls), t if i % 3 else rnd.choice(texts)) for i, t in enumerate(texts * 2)]


def brute(rows, least=0):
    top = {}
    for i, _, t in rows:
        k = (t or "").encode()
        if len(k) >= least and i is not None:
            top[k] = max(top.get(k, i), i)
    out = []
    for i, _, t in rows:
        k = (t or "").encode()
        first = len(k) < least or top.get(k) == i
        out.append((i, len(k), base64.b32encode(hashlib.sha1(k).digest()).decode(),
                    "response" if first else "revisit", None if first else top.get(k)))
    return sorted(out, key=str)


def written(spark, df, path, **kw):
    from upkeep.llm import warc
    index = warc.archive_pages(df, path, **kw)
    got = warc.read_records(index, path, payload=True)
    found = got.select(warc.page_id("record_id").alias("p"), "payload_bytes", "payload_digest", "type",
                       warc.page_id("refers_to").alias("r"))
    return index, got, sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, tmpdir_path, least):
    rows = rows_of(200)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    index, got, found = written(spark, df, f"{tmpdir_path}/w", min_bytes=least)
    assert found == brute(rows, least)
    assert {r[3] for r in found} == {"response", "revisit"}
    by_id = {r.record_id: r for r in got.collect()}
    for i, url, text in rows:
        r = by_id[f"<urn:page:{i}>"]
        assert r.intact is not False and (r.type == "revisit" or bytes(r.payload) == (text or "").encode())
        want = f"<urn:page:{i}>" if url is None else url.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A")
        assert (r.target_uri or "") == want


def test_members_and_index(spark, tmpdir_path):
    from upkeep.llm import warc
    path = f"{tmpdir_path}/w"
    index, _, _ = written(spark, spark.createDataFrame(rows_of(60), SCHEMA).repartition(3), path)
    at = collections.defaultdict(list)
    for r in index.orderBy("archive", "record").collect():
        at[r.archive].append(r)
    assert len(at) == len(glob.glob(f"{path}/archives/*.warc.gz")) == 3
    for name, rows in at.items():
        data = open(f"{path}/archives/{name}", "rb").read()
        assert [r.record for r in rows] == list(range(len(rows)))
        assert [r.offset for r in rows] == [0, *(r.offset + r.length for r in rows)][:-1]
        assert rows[-1].offset + rows[-1].length == len(data)
        members = [gzip.decompress(data[r.offset:r.offset + r.length]) for r in rows]
        assert b"".join(members) == gzip.decompress(data)
        for m, r in zip(members, rows):
            f = warc.record_fields(m)
            assert m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n")
            assert (f["warc-record-id"], f["warc-type"]) == (r.record_id, r.type)
            assert len(m) == m.index(b"\r\n\r\n") + 8 + int(f["content-length"])
    one = index.filter("record_id = '<urn:page:7>'")
    assert warc.read_records(one, path).count() == 1


def test_foreign_streams(spark, tmpdir_path):
    """Binary payloads, several members in a stream, blank lines between records, damaged streams."""
    from upkeep.llm import warc
    rnd = random.Random(9)

    def record(i, body, kind="resource"):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\ncontent-length:{len(body)}\r\n"
                f"Content-Type: image/png\r\n\r\n").encode() + body + b"\r\n\r\n"

    bodies = [bytes(rnd.choices(b"\r\n\x00\xffab", k=rnd.randint(0, 400))) for _ in range(300)] + [rnd.randbytes(3 << 20)]
    recs = [record(i, b) for i, b in enumerate(bodies)]
    src = f"{tmpdir_path}/in"
    spark.createDataFrame([], "value string").write.text(src)
    open(f"{src}/a.warc.gz", "wb").write(gzip.compress(b"".join(recs[:100])))
    open(f"{src}/b.warc.gz", "wb").write(gzip.compress(b"\r\n".join(recs[100:200])) + gzip.compress(b"".join(recs[200:])))
    open(f"{src}/c.warc.gz", "wb").write(gzip.compress(b""))
    index = warc.normalise(spark, src, f"{tmpdir_path}/out")
    got = {r.record_id: r for r in warc.read_records(index, f"{tmpdir_path}/out", payload=True).collect()}
    assert len(got) == index.count() == len(bodies)
    assert all(bytes(got[f"<urn:x:{i}>"].payload) == b for i, b in enumerate(bodies))
    for name, data in (("cut", b"".join(recs[:3])[:-40]), ("junk", recs[0] + b"junk here\r\n\r\n" + recs[1])):
        bad = f"{tmpdir_path}/{name}"
        spark.createDataFrame([], "value string").write.text(bad)
        open(f"{bad}/{name}.warc.gz", "wb").write(gzip.compress(data))
        with pytest.raises(Exception, match=f"{name}.warc.gz"):
            warc.normalise(spark, bad, f"{tmpdir_path}/out-{name}")


def test_pieces_of_any_size():
    from upkeep.llm.warc import RecordCutter
    recs = [f"WARC/1.1\r\nContent-Length: {n}\r\n\r\n".encode() + b"\r" * n + b"\r\n\r\n" for n in (0, 1, 5, 70, 300)]
    data = b"".join(recs)
    for size in (1, 2, 3, 7, 50, len(data)):
        cutter = RecordCutter("x")
        got = [r for lo in range(0, len(data), size) for r in cutter.feed(data[lo:lo + size])] + list(cutter.close())
        assert got == recs


def test_odd_rows(spark, tmpdir_path):
    rows = [(None, None, None), (None, "u", "same"), (1, "u", "same"), (1, "u", "same"), (0, "v", "same"), (None, "w", "alone"),
            (2, "u", ""), (-5, "u", "z"), (3, None, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    _, _, found = written(spark, df, f"{tmpdir_path}/a")
    # rows of a payload that only null ids have are responses; the null payload equals the empty one
    assert found == sorted([(i, b, d, "response" if (i is None and b == 5) else t, r)
                            for i, b, d, t, r in brute(rows)], key=str)
    clash = df.select(*[F.lit(i).alias(n) for i, n in enumerate(["sha", "record", "bytes", "top", "key", "id", "payload"])], "*")
    assert written(spark, clash, f"{tmpdir_path}/b")[2] == found
    _, got, none = written(spark, df.limit(0), f"{tmpdir_path}/c")
    assert none == [] and "payload" in got.columns


def test_hot_payload(spark, tmpdir_path):
    """A third of the rows hold one payload, others come in pairs."""
    rows = [(i, "u", "hot" if i % 3 == 0 else f"pair {i // 2}" if i % 3 == 1 else f"t{i % 700}") for i in range(3_000)]
    _, _, found = written(spark, spark.createDataFrame(rows, SCHEMA), f"{tmpdir_path}/w")
    assert found == brute(rows)
