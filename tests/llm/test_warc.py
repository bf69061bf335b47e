"""Archives: round trip, revisits, damage."""

import gzip
import hashlib
import io
import re

import pytest

from pulseweave.lineage import new_path
from pulseweave.llm import warc

LONG = "<p>é text</p>" * 20
PAGES = [
    (5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, None, LONG), (4, "http://a/4", "short"), (2, "u", "short"), (6, "x\r\nWARC-Type: evil", None),
    (7, "u", ""), (8, "u", "big " * 100_000), (1, "u", "a" * 100), (10, "u", "a" * 100), (11, "u", "a" * 99), (12, "u", "a" * 99), (3, "http://a/3", LONG), (None, "u", "a" * 100),
]


def plain():
    out = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
        first = min(same, default=None) if len(body) >= 100 else None
        revisit = first is not None and i is not None and i != first
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    frame = spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, digest string, size int").repartition(4)
    got = warc.page_records(frame).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == plain()
    assert next(r["target_uri"] for r in got if r["page_id"] == 6) == "x%0D%0AWARC-Type:%20evil"
    folder = new_path(spark, "warc-test")
    manifest = warc.write_archives(frame, folder)
    read = warc.read_archives(manifest, folder, with_payload=True).collect()
    assert {bytes(r["payload"]) for r in read if r["record_type"] == "response"} == {(h or "").encode() for _, _, h in PAGES}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.page_records(frame).count() == 0


def record(payload=b"body", page=1):
    return warc.build_record(page, "http://x", payload, hashlib.sha256(payload).hexdigest(), len(payload), None)


def test_members_are_read_in_pieces():
    archive = b"".join(gzip.compress(record(b"x" * n, n)) for n in (0, 1, 5000))
    for piece in (1, 7, 1 << 16):
        assert [warc.parse_record(m)["payload_bytes"] for m in warc.members(io.BytesIO(archive), piece)] == [0, 1, 5000]


@pytest.mark.parametrize(
    "raw",
    [record()[:-4], record() + b"x", record().replace(b"body", b"bodi"), re.sub(rb"Content-Length: \d+(?=\r\n\r\nHTTP)", b"Content-Length: 60", record()), b"no record at all\r\n\r\n"],
)
def test_damage_is_found(raw):
    with pytest.raises(warc.DamagedArchive):
        for member in warc.members(io.BytesIO(gzip.compress(raw))):
            warc.parse_record(member)


def test_cut_and_broken_archives():
    whole = gzip.compress(record()) + gzip.compress(record(page=2))
    for bad in (whole[:-5], whole[: len(whole) // 2] + b"junkjunk" + whole[len(whole) // 2 + 8 :]):
        with pytest.raises(warc.DamagedArchive):
            for member in warc.members(io.BytesIO(bad)):
                warc.parse_record(member)
