import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from inkveil.llm.warc import captures, op6_warc, read_warc, records_of, write_warc


def expected(pages):
    rows = {}
    for p in pages:
        data = (p.html or "").encode()
        same = max(q.page_id for q in pages if (q.html or "") == (p.html or "") and q.page_id is not None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        rows[p.page_id] = (p.page_id, len(data), digest, "response" if same == p.page_id else "revisit", None if same == p.page_id else same)
    return rows


def test_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = op6_warc(spark, sf_dir).collect()
    assert len(got) == len(pages)
    assert {r.page_id: tuple(r) for r in got} == expected(pages)


def test_edge_cases(spark, tmp_path):
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\nWARC\n\r\n\r\nWARC/1.1\r\n é" * 50
    rows = [(1, "http://a.org/x?y#z", tricky, 1), (2, None, None, 1), (3, "http://b.org/a\r\nb", "", 1), (4, "no scheme", tricky, 1), (4, "no scheme", tricky, 1), (5, "http://c/", "x" * 200_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_id int")
    write_warc(df, f"file://{tmp_path}/w")
    records = read_warc(spark, f"file://{tmp_path}/w")
    found = captures(records).collect()
    assert sorted((r.metadata.fields["page_id"], r.response.type) for r in found if r.metadata.fields["page_id"] == "4") == [("4", "response"), ("4", "revisit")]
    got = {r.metadata.fields["page_id"]: r for r in found if (r.metadata.fields["page_id"], r.response.type) != ("4", "revisit")}
    assert sorted(got) == ["1", "2", "3", "4", "5"] and len(found) == 6
    assert {k: r.response.type for k, r in got.items()} == {"1": "revisit", "2": "revisit", "3": "response", "4": "response", "5": "response"}
    assert bytes(got["4"].response.payload).decode() == tricky and got["4"].response.digest_ok
    assert got["1"].response.refers_to == got["4"].capture_id and got["1"].response.payload_bytes == len(tricky.encode())
    assert got["1"].request.fields["host"] == "a.org" and got["2"].response.target_uri is None
    write_warc(df.limit(0), f"file://{tmp_path}/none")
    assert captures(read_warc(spark, f"file://{tmp_path}/none")).count() == 0


def test_each_of_repeated_rows_and_null_ids_has_a_record(spark, tmp_path):
    rows = [(7, "u", "same")] * 3 + [(7, "v", "same"), (None, "u", "same"), (None, "u", "same"), (None, None, None), (None, None, None), (1, "w", "tiny"), (1, "w", "tiny")]
    for least, want in ((0, {"response": 3, "revisit": 7}), (100, {"response": 10})):
        write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/{least}", least_bytes=least)
        found = captures(read_warc(spark, f"file://{tmp_path}/{least}")).collect()
        kinds = [r.response.type for r in found]
        assert {k: kinds.count(k) for k in kinds} == want and len({r.capture_id for r in found}) == 10
        assert {r.response.refers_to for r in found if r.response.type == "revisit"} <= {r.capture_id for r in found if r.response.type == "response"}


def test_foreign_archive(spark, tmp_path):
    def record(kind, rid, block, *more):
        head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Record-ID", rid), *more, ("Content-Length", len(block))])
        return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"

    http = ("Content-Type", "application/http; msgtype=response")
    parts = [
        record("warcinfo", "<i>", b"software: x\r\n", ("Content-Type", "application/warc-fields")),
        record("request", "<q1>", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", ("Content-Type", "application/http; msgtype=request")),
        record("response", "<r1>", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody", http, ("WARC-Concurrent-To", "<q1>"), ("WARC-Concurrent-To", "<m1>")),
        record("metadata", "<m1>", b"lang: en\r\n", ("Content-Type", "application/warc-fields")),
        record("response", "<r2>", b"HTTP/1.1 200 OK\r\n\r\nalone", http),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    for name in ("a.warc", "b.warc.gz"):
        assert [r["record_id"] for r in records_of((tmp_path / name).read_bytes())] == ["<i>", "<q1>", "<r1>", "<m1>", "<r2>"]
        got = {r.capture_id: r for r in captures(read_warc(spark, f"file://{tmp_path}/{name}")).collect()}
        assert set(got) == {"<r1>", "<r2>"} and got["<r2>"].request is None
        assert (got["<r1>"].request.record_id, got["<r1>"].metadata.fields, bytes(got["<r1>"].response.payload)) == ("<q1>", {"lang": "en"}, b"body")


def test_files_are_bounded_and_ids_resolved(spark, tmp_path):
    """No archive holds more records than asked; of records of one id with other contents the same one is taken, however they are dealt."""
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", "x" * (i % 7)) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    write_warc(pages, f"file://{tmp_path}/w", records_per_file=20)
    files = [f for f in (tmp_path / "w").iterdir() if f.name.endswith(".gz")]
    held = [sum(1 for _ in records_of(f.read_bytes())) for f in files]
    assert max(held) <= 20 and sum(held) == 150
    records = read_warc(spark, f"file://{tmp_path}/w")
    assert captures(records).count() == 50
    twice = records.unionByName(records.withColumn("date", F.lit("1999-01-01T00:00:00Z")))
    for n in (1, 5):
        assert {r.response.date for r in captures(twice.repartition(n)).collect()} == {"1999-01-01T00:00:00Z"}
