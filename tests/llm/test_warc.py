"""Archives read back, whole and damaged at every place."""

import hashlib
import random
import zlib
from pathlib import Path

import pytest

from remarkt.llm import warc
from remarkt.llm.warc import archive_report, gaps, member, read_archives, record, records, salvage, write_archives

BIG, OTHER = "<p>same page</p>" * 20, "é日本" * 50


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute(rows, least=100):
    first = {}
    for page_id, _, html in rows:
        p = (html or "").encode()
        if len(p) >= least and page_id is not None:
            first[p] = min(first.get(p, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        p = (html or "").encode()
        to = first.get(p)
        again = to is not None and page_id != to
        out.append((page_id, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ROWS = [(5, "http://a.example/x y", BIG), (3, None, BIG), (9, "http://b.example/\r\nWARC/1.0", BIG), (3, "again", BIG), (None, "u", BIG), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", OTHER), (8, "u", OTHER), (None, "v", "no page has this text " * 9), (None, "w", "no page has this text " * 9), (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 4)]


@pytest.mark.parametrize("hot", [1000, 1])
def test_round_trip(spark, hot, monkeypatch):
    """Nulls, repeated ids and rows, equal and short payloads; payloads of many rows by broadcast or not."""
    monkeypatch.setattr(warc, "HOT_ROWS", hot)
    docs = frame(spark, ROWS + [(3, "again", BIG)]).repartition(3).selectExpr("*", "1 as digest", "2 as first", "3 as size", "4 as key", "5 as n")
    assert got(archive_report(docs)) == brute(ROWS + [(3, "again", BIG)])


def test_payloads_and_urls_come_back(spark, tmp_path):
    for compress in (True, False):
        path = str(tmp_path / f"{compress}")
        write_archives(frame(spark, ROWS), path, compress=compress)
        found = read_archives(spark, path)
        back = {(r.page_id, r.url): r for r in records(found).collect()}
        assert gaps(found).count() == 0 and len(back) == len(ROWS)
        assert back["7", "u"].payload.decode() == OTHER and back["8", "u"].payload is None and back["8", "u"].refers_to == "7"
        assert ("5", "http://a.example/x%20y") in back and ("9", "http://b.example/%0D%0AWARC/1.0") in back


def test_empty_table(spark):
    assert archive_report(frame(spark, [])).collect() == []


def test_text_page_ids(spark):
    docs = spark.createDataFrame([("b/1", "u", BIG), ("a é", "u", BIG)], "page_id string, url string, html string")
    assert [(r.page_id, r.refers_to) for r in archive_report(docs).orderBy("page_id").collect()] == [("a é", None), ("b/1", "a é")]


def test_very_long_record(spark, monkeypatch):
    """A record of 20 MB, whose member's last byte is not 0, and rows of the writer of few bytes."""
    monkeypatch.setattr(warc, "ROW_BYTES", 1000)
    rng = random.Random(1)
    rows = [(k, "u", rng.randbytes(300).hex()) for k in range(40)] + [(99, "u", "abcd" * 5_000_000)]
    assert got(archive_report(frame(spark, rows))) == brute(rows)


def test_files_are_plain_gzip(spark, tmp_path):
    write_archives(frame(spark, ROWS), str(tmp_path / "a"))
    import gzip

    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "a").glob("part-*")))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)


def made(n=12, seed=0):
    rng = random.Random(seed)
    return [record(str(k), f"http://x/{k}", rng.randbytes(rng.randint(0, 300)).hex().encode(), "", None, False) for k in range(n)]


def pages_of(found):
    return [warc.page_of(f.fields["warc-record-id"]) for f in found if f.fields]


def bounds(parts):
    at = [0]
    for p in parts:
        at.append(at[-1] + len(p))
    return at


def plain(k):
    """A record whose payload digest is right."""
    body = (f"text of {k} " * (3 + k)).encode()
    return record(str(k), f"http://x/{k}", body, hashlib.sha256(body).hexdigest(), None, False)


@pytest.mark.parametrize("compress", [True, False])
def test_any_damaged_byte(compress):
    """Every byte of one record changed, one at a time: all others come back, and the gap is that record."""
    parts = [member(plain(k)) if compress else plain(k) for k in range(5)]
    at, whole = bounds(parts), b"".join(parts)
    assert pages_of(salvage(whole)) == list("01234")
    lost = 0
    for k in range(at[2], at[3]):
        data = bytearray(whole)
        data[k] ^= 0x55
        found = list(salvage(bytes(data)))
        assert [p for p in pages_of(found) if p != "2"] == list("0134") or not compress
        bad = [f for f in found if f.reason]
        if bad:
            lost += 1
            assert (bad[0].start, bad[-1].end) == (at[2], at[3]) and set("0134") <= set(pages_of(found))
        else:
            # a change that no check covers: in a gzip header, or in a field's text
            assert len(found) == 5
    assert lost > (at[3] - at[2]) // 2


@pytest.mark.parametrize("compress", [True, False])
def test_cut_inserted_and_missing_bytes(compress):
    parts = [member(plain(k)) if compress else plain(k) for k in range(6)]
    at, whole = bounds(parts), b"".join(parts)
    found = list(salvage(whole[: at[5] + 40]))
    assert pages_of(found) == list("01234") and [(f.start, f.end) for f in found if f.reason] == [(at[5], at[5] + 40)]
    found = list(salvage(whole[: at[2]] + b"\x1f\x8b\x08 junk WARC/1.0\r\n" + whole[at[2] :]))
    assert pages_of(found) == list("012345") and [(f.start, f.end) for f in found if f.reason] == [(at[2], at[2] + 19)]
    found = list(salvage(whole[: at[1] + 30] + whole[at[3] :]))
    assert pages_of(found) == list("0345") and [(f.start, f.end) for f in found if f.reason] == [(at[1], at[1] + 30)]
    assert [(f.start, f.end, f.reason) for f in salvage(b"nothing here")] == [(0, 12, "no version line")] and list(salvage(b"")) == []


def test_members_and_plain_records_mixed():
    """Some records of a member of several are damaged; plain records follow."""
    inner = bytearray(plain(0) + plain(1) + plain(2))
    inner[len(plain(0)) + len(plain(1)) // 2 + 200] ^= 1
    whole = member(bytes(inner)) + plain(3) + warc.EMPTY + member(plain(4))
    found = list(salvage(whole))
    assert pages_of(found) == list("0234") and [(f.start, f.end, f.member) for f in found if f.reason] == [(len(plain(0)), len(plain(0) + plain(1)), 0)]


def test_salvage_of_files(spark, tmp_path):
    """A written archive with bytes overwritten: the later records of its file come back, the gap is logged."""
    path = tmp_path / "a"
    rows = [(k, "u", f"page {k} " * 30) for k in range(200)]
    write_archives(frame(spark, rows).coalesce(1), str(path))
    files = sorted(path.glob("part-*"), key=lambda p: -p.stat().st_size)
    data = bytearray(files[0].read_bytes())
    whole = list(salvage(bytes(data)))
    victim = whole[len(whole) // 2]
    data[victim.start + 30 : victim.start + 60] = bytes(30)
    Path(files[0]).write_bytes(data)
    for crc in path.glob(".*.crc"):
        crc.unlink()
    found = read_archives(spark, str(path))
    lost = warc.page_of(victim.fields["warc-record-id"])
    assert {r.page_id for r in records(found).collect()} == {str(k) for k in range(200)} - {lost}
    assert [(r.start, r.end, r.member) for r in gaps(found).collect()] == [(victim.start, victim.end, None)]


def test_time_grows_with_the_archive():
    """Members are read in pieces: nothing is copied for each of them but its own bytes."""
    import time

    took = []
    for n in (2000, 8000):
        whole = b"".join(member(plain(k % 50)) for k in range(n))
        began = time.process_time()
        assert sum(1 for _ in salvage(whole)) == n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]
    assert zlib.decompress(warc.EMPTY, wbits=31) == b"" and warc.EMPTY[-1] == 0
