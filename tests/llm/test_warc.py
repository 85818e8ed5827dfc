import gzip
import hashlib
import random

from brute import words
from pyspark.sql import functions as F

from emberline.llm import warc
from emberline.llm.store import Workspace

SF = "/root/testdata/sf0.001"


def test_loser_tree_merges_any_runs():
    draw = random.Random(5)
    for _ in range(300):
        runs = [sorted(draw.choices(range(30), k=draw.randint(0, 12))) for _ in range(draw.randint(0, 9))]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def expected(rows):
    """page_id, bytes, digest, type and refers_to of each row."""
    largest = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and page is not None:
            largest[body] = max(page, largest.get(body, page))
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        refers = largest.get(body) if page is not None and largest.get(body) != page else None
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=lambda r: (r[0] or 0, str(r)))


def test_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = [(9001, None, None), (9002, "HTTP://Sub.Example.org:80/a?b#c", ""), (None, "x\ny", "é" * 700), (9003, "u", "é" * 700), (9003, "u", "é" * 700),
           (9004, "u", "é" * 700), (9005, "u", "a" * 999), (9006, "u", "a" * 999), (9007, "v", "\r\n\r\nWARC/1.1\r\n" * 100_000)]
    both = pages.union(spark.createDataFrame(odd, "page_id LONG, url STRING, html STRING")).union(
        pages.withColumn("page_id", F.col("page_id") + 500)).withColumn("digest", F.lit(1)).withColumn("run", F.lit(1)).repartition(6)
    rows = [(r.page_id, r.url, r.html) for r in both.collect()]
    got = warc.round_trip(both).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[n] for n in names) for r in got), key=lambda r: (r[0] or 0, str(r))) == expected(rows)
    ordered = sorted(got, key=lambda r: r.capture_rank)
    assert [r.capture_rank for r in ordered] == list(range(len(rows)))
    keys = [(r.url_key.encode(), r.page_id or 0) for r in ordered]
    assert keys == sorted(keys)
    assert warc.round_trip(both.where("false")).count() == 0


def test_archives_are_members_that_the_index_finds(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/p", "x" * 1200) for i in range(20)], "page_id LONG, url STRING, html STRING")
    with Workspace(spark) as work:
        for r in work.table(warc.write(pages.repartition(3), work.folder("a")), "c").collect():
            with open(r.path.removeprefix("file://"), "rb") as f:
                f.seek(r.offset)
                page, size, _, kind, refers = warc.parse(gzip.decompress(f.read(r.length)))
            assert (page, size) == (r.page_id, 1200) and (kind == "response") == (page == 19) and refers in (19, None)
    assert words(" a  b ") == ["a", "b"]
