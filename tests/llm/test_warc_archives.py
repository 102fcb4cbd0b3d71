import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cases import sentence
from twinloom.llm import warc_archives as warc
from twinloom.llm.common import shared_folder


def pages(seed=1):
    rng = random.Random(seed)
    rows = [(k, f"http://a.example/{k}", f"<p>{sentence(rng, rng.randint(0, 60))}</p>\r\n") for k in range(300)]
    rows += [(1000 + k, None, "<p>" + "copy " * 40 + "</p>") for k in range(200)]
    rows += [(3, "again", rows[3][2] + "é" * 90), (5000, "x", rows[7][2]), (5001, "x", None), (5002, "x", ""), (None, "x", "no id " * 40)]
    rows += [(None, "x", rows[300][2]), (6000, "a b\r\nWARC-Type: revisit", "\r\n\r\nWARC/1.1\r\n" * 50), (6001, "", "\r\n\r\nWARC/1.1\r\n" * 50)]
    rows += [(6002, "u", "é" * 49 + "x"), (6003, "u", "é" * 49 + "x"), (6004, "u", "é" * 50), (6005, "u", "é" * 50), (6005, "u", "é" * 50)]
    return rows + [(7000, "u", "long " * 300_000), (7001, "u", "long " * 300_000)]


def brute(rows):
    first = {}
    for p, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and p is not None:
            first[body] = min(p, first.get(body, p))
    out = []
    for p, _, html in rows:
        body = (html or "").encode()
        at = first.get(body)
        again = at is not None and p != at
        out.append((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", at if again else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, original string").repartition(4)


@pytest.mark.parametrize("size", [64 << 20, 20_000])
def test_archives_come_back(spark, size):
    rows, folder = pages(), shared_folder(spark)
    warc.write_archives(frame(spark, rows), folder, archive_bytes=size)
    records = warc.read_archives(spark, folder)
    named = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, records.select(*named).collect()), key=str) == brute(rows)
    whole = sorted(((r.page_id, bytes(r.payload)) for r in warc.revisited(records).collect()), key=str)
    assert whole == sorted(((p, (html or "").encode()) for p, _, html in rows), key=str)


def test_revisits_hold_no_payload(spark):
    rows, folder = [(k, "u", "copy " * 1000) for k in range(200)], shared_folder(spark)
    warc.write_archives(frame(spark, rows), folder)
    counts = warc.read_archives(spark, folder).groupBy("record_type").agg(F.count("*").alias("n"), F.count("payload").alias("payloads"))
    kinds = {r.record_type: (r.n, r.payloads) for r in counts.collect()}
    assert kinds == {"response": (1, 1), "revisit": (199, 0)}
    size = spark.read.format("binaryFile").load(folder).selectExpr("sum(length) n").first().n
    assert size < 200 * 800


def test_an_archive_that_was_changed(spark):
    folder = shared_folder(spark)
    warc.write_archives(frame(spark, [(1, "u", "payload " * 20)]), folder)
    archive = spark.read.format("binaryFile").load(folder).where("length > 0").first().content
    fields, block = next(warc.parsed(bytes(archive)))
    assert fields["warc-type"] == "response" and block.endswith(b"payload " * 20)
    plain = gzip.decompress(bytes(archive))
    assert list(warc.parsed(plain)) == [(fields, block)]
    for changed in (plain.replace(b"payload ", b"p"), plain[:-9], b"x" + plain):
        with pytest.raises(ValueError):
            list(warc.parsed(changed))


def test_no_pages(spark):
    folder = shared_folder(spark)
    warc.write_archives(frame(spark, []), folder)
    assert warc.read_archives(spark, folder).collect() == []
