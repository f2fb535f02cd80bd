import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from tagmill.llm import warc as m

SCHEMA = "page_id long, url string, html string"


def test_query_matches_sql(spark, sf_dir, same_as_sql):
    same_as_sql(m.op4_warc_archive(spark, sf_dir), m.OP4_SQL, sf_dir)


def written(spark, tmp_path, rows, schema=SCHEMA, **more):
    path = str(tmp_path / "w")
    m.write_archives(spark.createDataFrame(rows, schema), path, **more)
    return path


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_payloads_come_back_and_magic_inside_is_rejected(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.0\r\n"
    texts = ["", "é" * 5, fake, "x\r\n\r\ny\r\n\r\n", "WARC/1.1\r\n" * 300, "z" * 2_000_000, "\r\n\r\n"]
    path = written(spark, tmp_path, [(i, f"http://h/{i}", t) for i, t in enumerate(texts)], file_bytes=3 * m.SMALL)
    rows = m.read_archives(spark, path, payloads=True).collect()
    got = {r["record_id"]: (bytes(r["payload"]).decode(), r["payload_bytes"], r["payload_digest"], r["url"]) for r in rows}
    assert got == {f"<{m.PAGE_URN}{i}>": (t, len(t.encode()), digest(t), f"http://h/{i}") for i, t in enumerate(texts)}
    assert m.candidates(spark, path).count() > len(texts)


def test_revisits(spark, tmp_path):
    rows = [(5, None, "same"), (3, "a\r\nX: y", "same"), (9, "u", None), (8, "u", ""), (None, "u", "same"), (3, "u", "same"), (7, "u", "own")]
    got = sorted((str(r["record_id"]), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in m.read_archives(spark, written(spark, tmp_path, rows)).collect())
    urn = lambda x: f"<{m.PAGE_URN}{x}>"
    assert got == sorted(
        [
            (urn(5), "revisit", urn(3), 4, digest("same")),
            (urn(3), "response", None, 4, digest("same")),
            (urn(3), "response", None, 4, digest("same")),
            (urn("none"), "revisit", urn(3), 4, digest("same")),
            (urn(9), "revisit", urn(8), 0, digest("")),
            (urn(8), "response", None, 0, digest("")),
            (urn(7), "response", None, 3, digest("own")),
        ]
    )


def test_small_payloads_are_not_revisited(spark, tmp_path):
    path = written(spark, tmp_path, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], min_payload=3)
    assert sorted(r["record_type"] for r in m.read_archives(spark, path).collect()) == ["response", "response", "response", "revisit"]


def test_files_are_standard(spark, tmp_path):
    path = written(spark, tmp_path, [(1, "http://h/", "<p>"), (2, "http://h/2", "<p>")])
    from pathlib import Path

    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path).glob("part-*"))
    head = data.split(b"\r\n\r\n")[0].decode().split("\r\n")
    assert head[0] == "WARC/1.1" and "Content-Type: application/http;msgtype=response" in head and data.endswith(b"\r\n\r\n")


def test_chain_ends_where_a_record_is_cut(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one * 3 + one[:-6])
    (tmp_path / "b.warc").write_bytes(gzip.compress(one) + gzip.compress(one))
    (tmp_path / "c.warc").write_bytes(b"junk" + one)
    (tmp_path / "d.warc").write_bytes(b"")
    got = m.read_archives(spark, str(tmp_path)).groupBy(F.substring_index("file", "/", -1).alias("f")).count().collect()
    # of a.warc the third record isn't followed by a whole one, yet it is whole itself; c.warc doesn't start with a record
    assert {r["f"]: r["count"] for r in got} == {"a.warc": 3, "b.warc": 2}


def test_urls_of_any_length(spark, tmp_path):
    rows = [(0, "u", "a"), (1, "data:," + "x" * (3 << 20), "b"), (2, "v", "c"), (3, "data:," + "y" * (1 << 20), "b"), (4, "WARC/1.1", "d"), (5, "w", "e")]
    got = m.read_archives(spark, written(spark, tmp_path, rows), payloads=True).collect()
    assert sorted((int(r["record_id"][len(m.PAGE_URN) + 1 : -1]), r["url"], r["record_type"]) for r in got) == [(i, u, "revisit" if i == 3 else "response") for i, u, _ in rows]


def test_headers_are_scanned_once():
    # many magics before a blank line, or before none at all, take no time that grows with their square
    import time

    record = lambda body: b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    begun = time.time()
    got = list(m.candidates_of(record(b"WARC/1.1\r\n" * 200_000) + record(b"x") + b"WARC/1.1\r\n" * 200_000))
    assert [r[2] for r in got] == [True, False, True, False] and time.time() - begun < 30


def test_files_stay_below_their_bound(spark, tmp_path):
    from pathlib import Path

    sizes = [100] * 30 + [60_000] * 9 + [400_000] * 5 + [3_000_000] * 2 + [20_000_000]
    path = written(spark, tmp_path, [(i, "u", chr(97 + i % 26) * n + str(i)) for i, n in enumerate(sizes)], file_bytes=1 << 20)
    held = [gzip.decompress(p.read_bytes()) for p in Path(path).glob("part-*")]
    assert all(len(x) <= 1 << 20 or x.count(b"WARC/1.1\r\n") == 1 for x in held)
    assert m.read_archives(spark, path).count() == len(sizes)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    path = written(spark, tmp_path, [], SCHEMA)
    assert m.read_archives(spark, path).count() == 0
    df = spark.createDataFrame([(1, "u", "h", 5, "z")], SCHEMA + ", first int, same string")
    m.write_archives(df, str(tmp_path / "x"))
    assert m.read_archives(spark, str(tmp_path / "x")).count() == 1


def test_pointer_jumping_over_long_chains(spark):
    links = spark.range(1000).select(F.lit("f").alias("file"), F.col("id").alias("at"), F.when(F.col("id") < 998, F.col("id") + 2).alias("after"))
    assert sorted(r["at"] for r in m.reachable(links).collect()) == list(range(0, 1000, 2))
