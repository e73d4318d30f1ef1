"""Salvage inside gzip members that hold several records."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm.warc import encode_record, salvage


def records(n=8):
    rnd = random.Random(2)
    pages = [rnd.randbytes(3000).hex().encode() for _ in range(n)]
    return [encode_record(i, p, hashlib.sha256(p).hexdigest(), "response", None) for i, p in enumerate(pages)]


def gz(b, level=6):
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b) + z.flush()


def ids(data):
    return [r["page_id"] for r in salvage(data) if r["status"] == "ok"]


def test_damaged_record_in_a_whole_member():
    some = records()
    bad = bytearray(some[3])
    bad[-20] ^= 1
    data = gz(b"".join(some[:3]) + bytes(bad) + b"".join(some[4:]))
    rows = list(salvage(data))
    assert [r["page_id"] for r in rows if r["status"] == "ok"] == [0, 1, 2, 4, 5, 6, 7]
    (gap,) = [r for r in rows if r["status"] == "gap"]
    assert (gap["position"], gap["length"]) == (0, len(data))
    assert (gap["inner_position"], gap["inner_length"]) == (sum(map(len, some[:3])), len(bad))


@pytest.mark.parametrize("level", [0, 6])
def test_cut_tail_then_another_member(level):
    some = records()
    one = gz(b"".join(some[:6]), level)
    cut = one[: len(one) * 3 // 4]
    kept = ids(cut)
    assert kept == list(range(len(kept))) and 3 <= len(kept) < 6
    rows = list(salvage(cut + gz(some[6]) + some[7]))
    assert [r["page_id"] for r in rows if r["status"] == "ok"] == [*kept, 6, 7]
    assert any(r["status"] == "gap" and r["position"] + r["length"] == len(cut) for r in rows)


@pytest.mark.parametrize("level", [0, 6])
def test_flipped_byte_in_one_stream(level):
    some = records()
    data = bytearray(gz(b"".join(some), level))
    data[len(data) * 6 // 10] ^= 255
    got = ids(bytes(data) + gz(some[0]))
    assert got[:4] == [0, 1, 2, 3] and got[-1] == 0 and len(got) == len(set(got)) + 1
    if level == 0:
        assert len(got) == 8


def test_bad_crc_keeps_the_records():
    data = bytearray(gz(b"".join(records())))
    data[-6] ^= 255
    assert ids(bytes(data)) == list(range(8))


def test_only_named_archives_count_and_references_resolve(spark, tmp_path):
    from tidemark.llm.warc import mark_revisits, read_archives, read_manifest, write_archives

    rows = [(i, f"page {i % 7} " * 40) for i in range(40)]
    folder = f"file://{tmp_path}/warc"
    marked = mark_revisits(spark.createDataFrame(rows, "page_id long, html string").repartition(3))
    manifest = write_archives(marked, folder)
    write_archives(marked.limit(5), folder)  # what another attempt left behind
    got = read_manifest(manifest, folder).where("status = 'ok'").collect()
    assert sorted(r.page_id for r in got) == list(range(40))
    assert read_archives(spark, folder).where("status = 'ok'").count() == 45
    ids = {r.page_id: r.record_id for r in got}
    text = b""
    import gzip

    for file in (tmp_path / "warc").iterdir():
        if file.name.endswith(".warc.gz"):
            text += gzip.decompress(file.read_bytes())
    for r in got:
        if r.record_type == "revisit":
            assert b"WARC-Refers-To: " + ids[r.refers_to].encode() + b"\r\n" in text
