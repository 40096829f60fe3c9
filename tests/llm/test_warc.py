import base64
import hashlib
import io
import os
import random
import struct

import pytest
import zstandard
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tessera.llm import queries, warc

from .duck import rows

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string, payload string, digest int, id string, keeper string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(pages, least=0):
    """What op11 returns for (page_id, html) pairs, by a loop."""
    last = lambda k: (k is None, k or 0)
    smallest = {}
    for k, html in pages:
        smallest[html or ""] = min(smallest.get(html or "", k), k, key=last)
    out = []
    for k, html in pages:
        kept = smallest[html or ""]
        again = len((html or "").encode()) >= least and kept != k
        out.append((k, len((html or "").encode()), digest(html), "revisit" if again else "response", kept if again else None))
    return sorted(out, key=str)


def frame(df, name, sf_dir):
    df.write.parquet(f"{sf_dir}/{name}.parquet")


def test_base32_digest(spark):
    texts = ["", "a", "é", "x" * 100_000, *[str(i) for i in range(300)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.base32_sha1(F.encode("t", "UTF-8")).alias("d"))
    assert all(r["d"] == digest(r["t"]) for r in df.collect())


def test_query_by_brute_force(spark):
    pages = [(r["page_id"], r["html"]) for r in rows("SELECT page_id, html FROM pages", SF)]
    assert sorted(map(tuple, queries.op11_warc(spark, SF).collect()), key=str) == plain(pages)


def test_query_over_copies_and_edges(spark, tmp_path):
    """A third of the pages alike, nulls in all columns, repeated rows, a very long page, clashing columns."""
    rng = random.Random(1)
    html = lambda i: None if i % 17 == 0 else "hot" if i % 3 == 0 else f"<p>{i % 70} é" + "x" * rng.randint(0, 3) if i % 5 else ""
    pages = [(i if i % 11 else None, rng.choice([None, "http://a b/\r\nX: y\x00", "https://é.com/"]), html(i)) for i in range(500)]
    pages += pages[:50] + [(-1, "u", "é" * 1_500_000), (-(2**63), "u", "low"), (2**63 - 1, "u", "low"), (None, None, None)]
    rng.shuffle(pages)
    frame(spark.createDataFrame([(*p, "x", 1, "y", "z") for p in pages], PAGES).repartition(7), "pages", tmp_path)
    found = queries.op11_warc(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == plain([(p[0], p[2]) for p in pages])


def test_join_for_rare_copies_and_small_payloads(spark):
    pages = [(i, "u", "hot" if i % 3 == 0 else f"page {i % 40}" if i % 2 else "s") for i in range(400)]
    df = spark.createDataFrame([(*p, "", 0, "", "") for p in pages], PAGES)
    keyed = warc.with_keepers(warc.keyed_pages(df), least_bytes=3, hot=10).collect()  # only "hot" is frequent
    assert sorted(((r["id"], r["size"], r["digest"], "revisit" if r["keeper"] else "response", r["keeper"] and r["keeper"]["kept"]) for r in keyed), key=str) == plain([(p[0], p[2]) for p in pages], 3)
    files = warc.write_archives(df, least_bytes=3)
    read = warc.read_archives(files).where("record_type = 'response'")
    assert sorted(bytes(r["payload"]).decode() for r in read.collect()) == sorted(p[2] for p, q in zip(pages, sorted(keyed, key=lambda r: r["id"]), strict=True) if not q["keeper"])


def test_empty_table(spark):
    files = warc.write_archives(spark.createDataFrame([], PAGES))
    assert files.count() == 0 and warc.read_archives(files).count() == 0


def test_files_roll_and_are_read_by_other_means(spark, tmp_path):
    """Each file: a dictionary in a skippable frame, then frames that the library's own reader takes."""
    df = spark.createDataFrame([(i, f"http://a/{i}", f"<html>{'some words here ' * 20}{i}", "", 0, "", "") for i in range(3000)], PAGES).coalesce(2)
    files = warc.write_archives(df, f"file://{tmp_path}/out", roll_bytes=20_000).collect()
    assert len(files) > 4 and sum(f["records"] for f in files) == 3000
    assert {f.split("/")[-1] for f in os.listdir(f"{tmp_path}/out") if not f.startswith(".")} == {f["path"].split("/")[-1] for f in files}
    seen = 0
    for f in files:
        raw = open(f["path"].removeprefix("file://"), "rb").read()
        assert len(raw) == f["bytes"]
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
        with zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(raw[8 + size :]), read_across_frames=True) as r:
            text = r.read().decode()
        assert text.startswith("WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        seen += text.count("WARC-Type: response")
    assert seen == 3000
    again = warc.read_archives(warc.list_archives(spark, f"{tmp_path}/out"), payload=False)
    assert again.where("record_type = 'response'").count() == 3000 and again.where("payload IS NOT NULL OR problem IS NOT NULL").count() == 0


def test_ids_come_back(spark):
    keys = [None, 0, 1, -1, 2**62, -(2**62), 2**63 - 1, -(2**63), 123456789]
    names = [(k, warc.record_id(k, digest("x"), again)) for k in keys for again in (True, False)]
    df = spark.createDataFrame(names, "k long, name string").select("k", warc.row_id(F.col("name")).alias("back"))
    assert all(r["k"] == r["back"] for r in df.collect()) and len({n for _, n in names}) == len(names)


GOOD = warc.page_record(1, "http://a/", b"text", digest("text"), 4, None)


@pytest.mark.parametrize(
    ("old", "new", "says"),
    [
        (b"WARC/1.1", b"WARC/9.9", "version"),
        (b"WARC-Type: response", b"WARC-Type: other", "type"),
        (b"WARC-Type: response\r\n", b"", "no warc-type"),
        (b"WARC-Date: 2024", b"WARC-Date: x2024", "time"),
        (b"<urn:uuid:", b"<urn uuid:", "URI"),
        (b"Content-Length: 4\r\n\r\ntext", b"Content-Length: 4\r\n\r\ntextual", "content-length"),
        (b"text\r\n\r\n", b"text\r\n", "content-length"),
        (b"\r\n\r\ntext", b"\r\n\r\ntexT", "digest"),
        (b"WARC-Date:", b"WARC-Date", "header"),
        (b"WARC-Date:", b"WARC-Type: response\r\nWARC-Date:", "twice"),
    ],
)
def test_broken_records(old, new, says):
    assert warc.parse_record(GOOD).payload == b"text"
    with pytest.raises(warc.WarcError, match=says):
        warc.parse_record(GOOD.replace(old, new))


def test_payload_digest_is_checked():
    raw = warc.build_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:a:b>"), ("WARC-Date", warc.DATE), ("WARC-Payload-Digest", "sha1:" + digest("other")), ("Content-Type", "application/http")], b"HTTP/1.1 200 OK\r\n\r\ntext")
    with pytest.raises(warc.WarcError, match="payload-digest"):
        warc.parse_record(raw)


def test_foreign_archives(spark, tmp_path):
    """A plain dictionary, none at all, other skippable frames, frames without a size; and damage of each kind."""
    one, two = GOOD, warc.page_record(2, "http://b/", b"", digest(""), 0, None)
    samples = [warc.page_record(i, f"http://a/{i}", b"words " * 50, digest("words " * 50), 300, None) for i in range(300)]
    dictionary = zstandard.train_dictionary(4096, samples)
    packed = zstandard.ZstdCompressor(dict_data=dictionary).compress(one)
    bare = zstandard.ZstdCompressor().compressobj()
    unsized = bare.compress(two) + bare.flush()
    other = struct.pack("<II", 0x184D2A50, 3) + b"xyz"
    lead = struct.pack("<II", 0x184D2A5D, len(dictionary.as_bytes())) + dictionary.as_bytes()
    cases = {
        "raw": (lead + packed + packed, 2, None),
        "none": (other + unsized + other + unsized, 2, None),
        "empty": (b"", 0, None),
        "early": (lead + packed + packed[:-9], 1, "ends early"),
        "nodict": (packed, 0, "at 0"),
        "noise": (unsized + b"noise", 1, "no frame"),
        "tail": (unsized + b"\x28\xb5", 1, "after the last"),
        "skip": (unsized + other[:-1], 1, "skippable"),
        "two": (zstandard.ZstdCompressor().compress(one + two), 0, "content-length"),
    }
    for name, (content, _, _) in cases.items():
        (tmp_path / f"{name}.warc.zst").write_bytes(content)
    found = warc.read_archives(warc.list_archives(spark, str(tmp_path)), strict=False).collect()
    for name, (_, n, says) in cases.items():
        mine = [r for r in found if r["path"].endswith(f"/{name}.warc.zst")]
        assert sum(r["problem"] is None for r in mine) == n, name
        assert [says in r["problem"] for r in mine if r["problem"]] == ([True] if says else []), name
    bad = spark.createDataFrame([(f"{tmp_path}/early.warc.zst", 1), (None, 2)], "path string, records int")
    with pytest.raises(PythonException, match="ends early"):
        warc.read_archives(bad).collect()
