import io
import random
import zlib

import pyarrow as pa
import pytest

from pactlane.llm import decontam, warc
from pactlane.llm.common import shared_dir

from .conftest import COLUMNS, prose, rows

PAGES = "page_id bigint, url string, html string, id string, payload string, `first` int, digest string"


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {" ".join(w)} if w else set()


def plain_contained(docs, items, threshold=0.8):
    out = {}
    for i, text in docs:
        for j, item in items:
            s = shingles(item)
            n = len(s & shingles(text))
            if i is not None and s and n / len(s) >= threshold:
                out[i, j] = max(out.get((i, j), (0, 0))[0], n), len(s)
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.choice([1, 3, 5, 6, 12, 40, 41, 90]))) for k in range(30)]
    items += [(100, None), (101, ""), (102, items[5][1]), (103, "a b c d e f a b c d e f a b c d e f")]
    docs = []
    for k in range(120):
        w = prose(rng, rng.randint(0, 300)).split()
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(items)[1] or ""
            part = piece.split()
            if rng.random() < 0.5 and len(part) > 8:
                part[rng.randrange(len(part))] = "changed"
                if rng.random() < 0.5:
                    part = part[: int(len(part) * 0.9)]
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs.append((k, " ".join(w).replace(" ", rng.choice([" ", "\n", "  \t"]))))
    docs += [(500, items[0][1]), (501, None), (7, docs[8][1]), (None, items[20][1])]
    got = decontam.contained(spark.createDataFrame(rows([(i, t, "x") for i, t in docs]), COLUMNS), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in got} == plain_contained(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got}) and all(r.containment == r.n_shared / r.n_item for r in got)


@pytest.mark.parametrize("n", [1, 5, 9, 16, 17, 33, 100])
def test_a_document_with_just_enough_is_found(spark, n):
    words = [f"w{k}" for k in range(n + 4)]
    item = " ".join(words)
    lacking = int(0.2 * n + 1e-9)
    docs = [(k, " ".join(words[: len(words) - j])) for k, j in enumerate((lacking, lacking + 1))]
    got = decontam.contained(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert [r.doc_id for r in got] == [0]


def test_shuffled_way_gives_the_same(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, prose(rng, 20)) for k in range(5)]
    docs = [(k, prose(rng, 50) + " " + items[k % 5][1]) for k in range(20)]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    few = sorted(map(tuple, decontam.contained(*frames).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontam.contained(*frames).collect())) == few and len(few) == 20


def test_native_plan(spark, sf_dir):
    from pactlane.llm.common import table

    plan = decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))


def test_odd_rows_and_drop(spark, odd, empty):
    items = spark.createDataFrame([(1, "same text here again"), (2, None), (None, "word " * 9)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contained(odd, items).collect()}
    assert got == {(7, 1), (10, None)}
    kept = decontam.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contained(odd, none).count() == 0 and decontam.contained(empty, items).count() == 0 and decontam.drop_contaminated(empty, none).count() == 0


def archived(spark, pages, range_bytes, **more):
    folder = shared_dir(spark, "warc-test")
    files = warc.write(pages, folder, **more)
    return folder, files, warc.read(spark, folder, files, range_bytes)


def page_rows(found):
    return [(i, u, h, "x", "y", 1, "z") for i, u, h in found]


@pytest.mark.parametrize("range_bytes", [100, 1000, 1 << 20])
def test_round_trip_at_every_range_size(spark, range_bytes):
    rng = random.Random(3)
    noise = lambda n: "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(n))
    found = [(k, f"http://x/{k}\r\nEvil: 1", noise(rng.choice([0, 3, 500, 9000]))) for k in range(60)] + [(100, None, None), (101, "u", ""), (102, "u", "\x1f\x8b\x08 magic \r\n\r\nWARC/1.0\r\n\r\n" * 50), (103, "u", "same"), (104, "u", "same"), (90, "u", "same"), (None, "u", "same")]
    _, _, read = archived(spark, spark.createDataFrame(page_rows(found), PAGES).repartition(2), range_bytes)
    got = read.collect()
    assert len(got) == len(found) and len({(r.file, r.offset) for r in got}) == len(found)
    first = {}
    for i, _, h in found:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for r in got:
        i = r.id[len("<urn:page:") : -1]
        h = next(h for j, _, h in found if str(j if j is not None else "") == i) or ""
        assert r.payload_bytes == len(h.encode()) and r.digest == "sha1:" + warc.payload_digest(h.encode())
        if i == "" or first[h] == int(i):
            assert r.type == "response" and r.payload.decode() == h and r.refers_to is None
        else:
            assert r.type == "revisit" and r.payload is None and r.refers_to == f"<urn:page:{first[h]}>"
        assert "\n" not in (r.url or "")


def test_small_payloads_can_be_exempt(spark):
    pages = spark.createDataFrame(page_rows([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), PAGES)
    _, _, read = archived(spark, pages, 1 << 20, least_bytes=3)
    assert {r.id: r.type for r in read.collect()} == {"<urn:page:1>": "response", "<urn:page:2>": "response", "<urn:page:3>": "response", "<urn:page:4>": "revisit"}


def test_files_roll_and_folders_are_listed(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    pages = spark.createDataFrame(page_rows([(k, "u", f"{k} " * 200) for k in range(40)]), PAGES).coalesce(1)
    folder, files, read = archived(spark, pages, 500)
    assert files.count() > 1 and read.count() == 40
    assert warc.read(spark, folder, None, 700).count() == 40


def test_ranges_own_the_records_that_start_in_them():
    data = b"".join(warc.record(str(k), "u", f"payload {k}".encode() * (k % 7), "D", None) for k in range(50))
    starts = [p for p, _, _ in warc.records(pa.BufferReader(data), len(data), 0, len(data))]
    assert len(starts) == 50
    for step in (1, 37, 333):
        found = [p for s in range(0, len(data), step) for p, _, _ in warc.records(pa.BufferReader(data), len(data), s, min(s + step, len(data)))]
        assert found == starts


def test_a_broken_record_is_an_error():
    data = warc.record("1", "u", b"x" * 500, "D", None)
    with pytest.raises(ValueError):
        list(warc.records(pa.BufferReader(data[:-12]), len(data) - 12, 0, len(data) - 12))


def test_plain_gzip_members_are_not_records():
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    other = z.compress(b"no archive " * 20) + z.flush()
    data = other + warc.record("1", "u", b"x", "D", None) + other + warc.record("2", "u", b"y", "D", None)
    assert [h["WARC-Record-ID"] for _, h, _ in warc.records(pa.BufferReader(data), len(data), 0, len(data))] == ["<urn:page:1>", "<urn:page:2>"]
    assert io.BytesIO(data).read(3) == warc.MAGIC


def test_no_pages(spark):
    folder, files, read = archived(spark, spark.createDataFrame([], PAGES), 100)
    assert files.count() == 0 and read.count() == 0
