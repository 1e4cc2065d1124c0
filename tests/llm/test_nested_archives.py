"""Byte ranges of archives that hold archives, padding and other members."""

import gzip
import random

import pyarrow as pa
import pytest

from pactlane.llm import warc


def stored(rng, n):
    return rng.randbytes(n)


def found(data, step):
    out = []
    for s in range(0, len(data), step):
        out += [(p, h["WARC-Record-ID"], block) for p, h, block in warc.records(pa.BufferReader(data), len(data), s, min(s + step, len(data)))]
    return out


@pytest.mark.parametrize("inner", [60_000, 9_000, 300])
def test_an_archive_as_a_payload(inner):
    rng = random.Random(inner)
    nested = b"".join(warc.record(f"inner{k}", "u", stored(rng, inner), "D", None) for k in range(360_000 // inner))
    parts = [warc.record("1", "u", b"plain text " * 50, "D", None), warc.record("2", "u", nested, "D", None), warc.record("3", "u", stored(rng, 70_000), "D", None), gzip.compress(b"no record"), warc.record("4", "u", nested, "D", None)]
    for data in (b"".join(parts), b"".join([*parts, bytes(512)])):
        want = found(data, len(data))
        assert [i for _, i, _ in want] == [f"<urn:page:{k}>" for k in "1234"]
        for step in (7_001, 50_000, 100_000, 262_144):
            assert found(data, step) == want


def test_bad_headers_are_errors():
    data = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")
    with pytest.raises(ValueError, match="fits"):
        found(data, len(data))


def test_many_ranges_in_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_TASKS", 40)
    files = spark.createDataFrame([("a", 50_000), ("b", 50_000), ("none", 0)], "file string, bytes bigint")
    cut = warc.ranges(spark, "unused", files, 1)
    assert cut.rdd.getNumPartitions() <= 40 and cut.count() == 100_000
    assert max(r["count"] for r in cut.groupBy(warc.F.spark_partition_id()).count().collect()) < 10_000
