import base64
import gzip
import hashlib

import pytest
from oracle import assert_same, connect

from lumenseek.llm import common, warc

LONG = "<p>" + "x" * 1200


def built(n=5):
    out = []
    for i in range(n):
        payload = f"page {i} ".encode() * 50
        out.append(warc.record(i, f"http://h/{i}", payload, hashlib.sha1(payload).hexdigest(), None, False))
    return out


def split(data):
    found = list(warc.salvage(data))
    return [r.headers["x-page-id"] for r in found if isinstance(r, warc.Record)], [g for g in found if isinstance(g, warc.Gap)]


def test_clean_files_have_no_gaps():
    records = built()
    assert split(b"".join(records)) == (list("01234"), [])
    assert split(warc.EMPTY_MEMBER.join(map(warc.member, records))) == (list("01234"), [])
    assert split(gzip.compress(b"".join(records))) == (list("01234"), [])
    assert split(b"") == ([], [])


def test_damage_is_quarantined_and_later_records_recovered():
    members = [warc.member(r) for r in built()]
    bad = bytearray(members[2])
    bad[len(bad) // 2] ^= 0xFF
    data = b"".join([*members[:2], bytes(bad), *members[3:]])
    ids, gaps = split(data)
    at = len(members[0] + members[1])
    assert ids == list("0134") and [(g.start, g.end) for g in gaps] == [(at, at + len(bad))]
    ids, gaps = split(b"garbage" + members[0] + b"\0" * 9 + members[1] + members[2][:-5])
    assert ids == ["0", "1"] and [(g.start, g.end) for g in gaps][0] == (0, 7) and len(gaps) == 3 and "short" in gaps[2].reason


def test_plain_records_resume_at_the_next_version_line():
    records = built()
    wrong = records[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    broken = records[3].replace(b"page 3", b"pAge 3", 1)  # digest differs
    ids, gaps = split(b"".join([records[0], wrong, records[2], broken, records[4]]))
    assert ids == list("024") and len(gaps) == 2 and "digest" in gaps[1].reason
    assert gaps[0].start == len(records[0]) and gaps[0].end == len(records[0]) + len(wrong)


def test_a_bad_record_costs_only_itself_inside_a_member():
    records = built()
    records[2] = records[2].replace(b"page 2", b"pAge 2", 1)
    data = warc.member(b"".join(records))
    ids, gaps = split(data + warc.member(built(6)[5]))
    assert ids == list("01345") and [(g.start, g.end, "digest" in g.reason) for g in gaps] == [(0, len(data), True)]
    before = len(records[0] + records[1])
    assert gaps[0].inner == (before, before + len(records[2]))
    tail = warc.member(b"".join(built()) + b"trailing bytes")
    assert split(tail)[0] == list("01234") and len(split(tail)[1]) == 1


def test_a_cut_or_corrupt_member_keeps_what_stands_before_the_damage():
    records = built(50)
    data = warc.member(b"".join(records))
    ids, gaps = split(data[:-20])
    assert ids == [str(i) for i in range(len(ids))] and 40 <= len(ids) < 50 and [(g.start, g.end) for g in gaps] == [(0, len(data) - 20)] and "short" in gaps[0].reason
    ids, gaps = split(data[:-4])  # all is there but the end of the checksum
    assert ids == [str(i) for i in range(49)]
    wrong = data[:-8] + b"\0\0\0\0" + data[-4:]
    ids, gaps = split(wrong + warc.member(built(51)[50]))
    assert ids == [*(str(i) for i in range(49)), "50"] and "bad member" in gaps[0].reason and gaps[0].end == len(wrong)
    ids, gaps = split(data[:-20] + data[:-20] + warc.member(built(51)[50]))
    assert ids.count("0") == 2 and ids[-1] == "50"
    # without a digest nothing proves a record of a damaged member
    bare = [r.replace(b"WARC-Payload-Digest: sha1:", b"X-Other: ") for r in built(10)]
    assert split(warc.member(b"".join(bare))[:-4])[0] == []


def test_foreign_archives_give_nulls_and_no_errors(spark, tmp_path):
    def made(i, *changes):
        data = built(i + 1)[i]
        for a, b in changes:
            assert a in data
            data = data.replace(a, b)
        return data

    digest = hashlib.sha1(b"page 3 " * 50).digest()
    b32 = base64.b32encode(digest)
    records = [
        made(0, (b"X-Page-ID: 0", b"X-Page-ID: zero")),
        made(1, (b"X-Page-ID: 1", b"X-Page-ID: " + b"9" * 30)),
        made(2, (b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: md5:")),
        made(3, (b"sha1:" + b32, b"sha1:" + digest.hex().encode())),
        made(3, (b"sha1:" + b32, b"sha1:" + b32.lower())),
        made(4, (b"WARC-Target-URI: http://h/4", b"WARC-Target-URI:\r\n\thttp://h/4")),
        made(5, (b"WARC-Type: response", b"WARC-Type: metadata"), (b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: md5:")),
    ]
    (tmp_path / "foreign.warc").write_bytes(b"".join(records))
    found = warc.read(spark, str(tmp_path)).collect()
    assert [r["page_id"] for r in found] == [None, None, 2, 3, 3, 4, 5] and [r["url"] for r in found][5] == "http://h/4"
    assert found[3]["payload_digest"] == digest.hex() and found[6]["payload_digest"] is None and warc.gaps(spark, str(tmp_path)).count() == 0


def test_a_reader_of_whole_archives_fails_on_a_gap(spark, tmp_path):
    data = warc.member(built(1)[0])
    (tmp_path / "a.warc.gz").write_bytes(data + b"garbage")
    assert warc.read(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="of an archive"):
        warc.read(spark, str(tmp_path), whole=True).collect()


def test_adversarial_bytes_do_not_crash():
    for data in (b"\x1f\x8b\x08", b"WARC/1.1\r\n", b"WARC/1.0\r\nContent-Length: -1\r\n\r\n", b"\x1f\x8b\x08" * 1000, b"WARC/1.1\r\n\r\n" * 100):
        ids, gaps = split(data)
        assert ids == [] and gaps[0].start == 0 and gaps[-1].end == len(data)


def test_round_trip_and_revisits(spark):
    rows = [(1, "http://a/\r\nX: y", LONG), (9, "u", LONG), (3, None, LONG), (None, "u", LONG), (4, "u", None), (5, "u", ""), (6, "u", "é" * 400), (7, "u", "é" * 400), (8, "u", "é" * 499), (2, "u", "é" * 500), (10, "u", "é" * 500), (10, "u", "é" * 500)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string")
    path = common.scratch_path(spark, "warc-test")
    warc.write(pages, path)
    found = {(r["page_id"], r["payload_bytes"]): r for r in warc.read(spark, path, with_payload=True).collect()}
    assert sum(1 for _ in warc.read(spark, path).collect()) == len(rows) and warc.gaps(spark, path).count() == 0
    n = len(LONG)
    assert {k: (r["record_type"], r["refers_to"]) for k, r in found.items() if k[1] == n} == {(1, n): ("revisit", 9), (9, n): ("response", None), (3, n): ("revisit", 9), (None, n): ("revisit", 9)}
    assert found[2, 1000]["refers_to"] == 10 and found[10, 1000]["record_type"] == "response"
    assert found[6, 800]["record_type"] == found[7, 800]["record_type"] == found[4, 0]["record_type"] == "response"
    assert all(r["payload_digest"] == hashlib.sha1((h or "").encode()).hexdigest() for i, _, h in rows for r in [found[i, len((h or "").encode())]])
    assert bytes(found[9, n]["payload"]).decode() == LONG and found[1, n]["url"] == "http://a/%0D%0AX: y"


def test_urls_longer_than_64_kb(spark):
    long = "data:text/html," + "y" * 70_000
    rows = [(1, long, LONG), (9, long + "\n" * 40_000, LONG), (3, "u", LONG), (4, long, "short"), (5, "u", "short")]
    path = common.scratch_path(spark, "warc-long-url")
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path)
    found = {r["page_id"]: r for r in warc.read(spark, path, with_payload=True).collect()}
    assert warc.gaps(spark, path).count() == 0 and {i: found[i]["url"] for i in found} == {i: u.replace("\n", "%0A") for i, u, _ in rows}
    assert found[1]["refers_to"] == found[3]["refers_to"] == 9 and bytes(found[9]["payload"]).decode() == LONG


def test_headers_without_end_stop_at_the_next_version_line():
    record = built(1)[0]
    cut = b"WARC/1.1\r\nWARC-Target-URI: " + b"z" * 100_000 + b"\r\n"
    ids, gaps = split(cut * 50 + record)
    assert ids == ["0"] and [(g.start, g.end, g.reason) for g in gaps] == [(0, 50 * len(cut), "header has no end")]


def test_files_are_gzip_and_survive_damage(spark, tmp_path):
    path = str(tmp_path / "w")
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 30) for i in range(40)], "page_id bigint, url string, html string").coalesce(1)
    warc.write(pages, path)
    (name,) = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    assert gzip.decompress(name.read_bytes()).count(b"WARC/1.1\r\n") == 40
    data = bytearray(name.read_bytes())
    data[len(data) // 2] ^= 0x55
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part-0").write_bytes(data)
    assert warc.read(spark, str(tmp_path / "d")).count() == 39
    gap = warc.gaps(spark, str(tmp_path / "d")).collect()
    assert len(gap) == 1 and gap[0]["start"] <= len(data) // 2 < gap[0]["end"]


def test_empty_table(spark):
    path = common.scratch_path(spark, "warc-empty")
    warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


def test_query_equals_sql(spark, sf_dir):
    assert_same(spark, connect(sf_dir), warc.op6_warc, warc.ORACLE_SQL, sf_dir)
