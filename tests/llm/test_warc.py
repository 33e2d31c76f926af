import base64
import hashlib

import pytest

from scriptorium.llm import warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines_and_lengths(version):
    blocks = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npay\nload", b"", b"\n\nhttp://x 0.0.0.0 20200101000000 text/html 5\n"]
    data = warc.make_arc([("http://a b/é", "1.2.3.4", "20200102030405", "text/html", b) for b in blocks], version)
    got = list(warc.parse_arc(data))
    assert [r.block for r in got] == blocks and {r.version for r in got} == {version}
    assert got[0].url == "http://a%20b/é" and got[0].ip == "1.2.3.4"
    record = warc.to_warc(got[0])
    (fields, block), = warc.parse_warc([*record.split(b"\r\n\r\n")])
    assert fields["WARC-Type"] == "response" and fields["WARC-Date"] == "2020-01-02T03:04:05Z" and block == blocks[0]
    assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"pay\nload").digest()).decode()
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-20]))


PAGES = [
    (1, "http://x/1", "<p>one</p>"), (2, "http://x/2", "<p>one</p>"), (3, None, "<p>one</p>"), (4, "http://x y/4", None), (5, "http://x/5", ""), (6, "http://x/6", "a\r\n\r\nb"),
    (7, "http://x/7", "WARC/1.1\r\n\r\nend\r\n"), (8, "u", "\r\n\r\n"), (9, "u", "x\r\n"), (10, "u", "é\x00" * 30000), (10, "u", "é\x00" * 30000), (None, "u", "<p>one</p>"), (11, "u", "\r\n\r"), (12, "u", "y\r"),
]


def test_round_trip_against_brute_force(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest", "'x' AS value", "2L AS refers_to").repartition(3)
    got = sorted((tuple(r)[:5] for r in warc.round_trip(df).collect()), key=str)
    want = []
    for n, _, html in PAGES:
        data = (html or "").encode()
        last = max(p if p is not None else -1 for p, _, h in PAGES if (h or "") == (html or ""))
        own = n if n is not None else -1
        want.append((n, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own == last else "revisit", None if own == last else last))
    assert got == sorted(want, key=str)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_plain_archives_that_spark_cuts(spark, tmp_path):
    import gzip

    rows = PAGES + [(k, f"http://x/{k}", f"{k} " + "\r\n" * (k % 40) + "z" * (k % 7)) for k in range(20, 400)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    warc.archive(df, str(tmp_path / "gz"))
    want = sorted(map(str, warc.read_archives(spark, str(tmp_path / "gz")).collect()))
    (tmp_path / "mixed").mkdir()
    for k, file in enumerate(sorted((tmp_path / "gz").glob("*.gz"))):
        if k:
            (tmp_path / "mixed" / file.stem).write_bytes(gzip.decompress(file.read_bytes()))
        else:
            (tmp_path / "mixed" / file.name).write_bytes(file.read_bytes())
    most, cost = (spark.conf.get(f"spark.sql.files.{c}") for c in ("maxPartitionBytes", "openCostInBytes"))
    try:
        for size in ("997", "64k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert sorted(map(str, warc.read_archives(spark, str(tmp_path / "mixed")).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
