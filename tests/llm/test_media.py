import base64
import hashlib
import random
import struct
import zlib

import pytest
import zstandard

from loomgraph.llm import mpeg_audio, warc
from tests.llm.helpers import ODD, documents, empty, rows


@pytest.mark.parametrize("n", [0, 1, 64, 1021, 1022, 5000, 70_000])
def test_audio_round_trip(n):
    payload = mpeg_audio.padded(bytes(i * 7 % 251 for i in range(n)))
    data = mpeg_audio.encode(payload)
    a = mpeg_audio.read(data)
    assert a.payload == payload and a.bad == a.skipped == a.resyncs == 0 and a.checked == a.frames
    assert a.table == "Xing" and a.table_frames == a.frames and a.table_bytes == len(data) - data.index(b"Xing") + 21
    assert a.samples == 1152 * a.frames and a.seconds * 44100 == a.samples
    assert all(data[x] == 0xFF for x in a.offsets)


def test_audio_resynchronises_and_notices_damage():
    data = mpeg_audio.encode(bytes(4096))
    a = mpeg_audio.read(data)
    cut = a.offsets[2]
    b = mpeg_audio.read(data[:cut] + b"\xff\x00junk\xff\xfb" + data[cut:])
    assert b.resyncs == 1 and b.skipped == 8 and b.frames == a.frames and b.payload == a.payload
    broken = bytearray(data)
    broken[a.offsets[1] + 8] ^= 1  # side information
    assert mpeg_audio.read(bytes(broken)).bad == 1
    broken = bytearray(data)
    broken[a.offsets[1] + 100] ^= 1  # payload
    assert mpeg_audio.read(bytes(broken)).payload is None
    assert mpeg_audio.read(data + b"TAG" + bytes(125)).tags["TAG"][:3] == b"TAG"
    assert mpeg_audio.read(b"").frames == 0 and mpeg_audio.read(b"\xff" * 50).frames == 0


def test_audio_keeps_a_payload_with_the_word_of_a_tag():
    hits, rnd = 0, random.Random(9)
    for n in range(64, 4096, 64):
        payload = bytes(rnd.choices(range(1, 250), k=n))
        data = mpeg_audio.encode(payload)
        tag = len(data) - 128
        if (at := payload.find(data[tag : tag + 8])) < 0:
            continue
        payload = payload[:at] + b"TAG" + payload[at + 3 :]
        data = mpeg_audio.encode(payload)
        assert data[tag : tag + 3] == b"TAG"
        a = mpeg_audio.read(data)
        assert a.payload == payload and a.skipped == a.resyncs == 0 and not a.tags.get("TAG")
        b = mpeg_audio.read(data + b"TAG" + bytes(125))
        assert b.payload == payload and b.skipped == 0 and b.tags["TAG"] == b"TAG" + bytes(125) and b.offsets == a.offsets
        hits += 1
    assert hits > 5


def test_audio_header_sizes_of_all_layers():
    size = lambda *b: mpeg_audio.parse_header(bytes(b)).size
    assert size(0xFF, 0xFB, 0x90, 0x00) == 417  # Layer III, 128 kbit/s, 44.1 kHz
    assert size(0xFF, 0xFD, 0xA4, 0x00) == 576  # Layer II, 192 kbit/s, 48 kHz
    assert size(0xFF, 0xFF, 0xC0, 0x00) == 416  # Layer I, 384 kbit/s, 44.1 kHz
    assert size(0xFF, 0xF3, 0x80, 0x00) == 208  # version 2, Layer III, 64 kbit/s, 22.05 kHz
    assert mpeg_audio.parse_header(b"\xff\xfb\xf0\x00") is None


def test_audio_reads_the_other_table():
    first = mpeg_audio._frame(9, False)
    frame = bytearray(mpeg_audio.parse_header(first[:4]).size)
    frame[: len(first)] = first
    frame[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 1234, 7, 3, 1, 2, 4)
    a = mpeg_audio.read(bytes(frame) + bytes(mpeg_audio.encode(bytes(3000))[258:]))
    assert (a.table, a.table_bytes, a.table_frames, len(a.toc)) == ("VBRI", 1234, 7, 6)


def test_audio_columns(spark):
    got = rows(mpeg_audio.audio_features(mpeg_audio.with_audio(documents(spark))))
    assert len(got) == len(ODD)
    for r in got:
        raw = (next(t for i, t, *_ in ODD if i == r["doc_id"]) or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(full[-64:])
    assert rows(mpeg_audio.audio_features(mpeg_audio.with_audio(empty(spark)))) == []


PAGES = [(3, "http://a/x", "<p>same</p>"), (1, "http://a/ü?q=1", "<p>same</p>"), (2, None, None), (4, "http://b/\r\nX: y", ""), (5, "u", "é" * 90_000), (5, "u", "é" * 90_000), (None, "n", "<p>same</p>")]


def test_archives_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS sha", "2 AS first", "3 AS payload")
    got = rows(warc.through_archives(df))
    assert len(got) == len(PAGES)
    for r in got:
        html = next(h for i, _, h in PAGES if i == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode())
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    types = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert types == {(1, "response", None), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None), (4, "revisit", 2), (5, "response", None)}
    assert rows(warc.through_archives(df.limit(0))) == []


def test_small_payloads_never_refer(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in rows(warc.through_archives(df, least_bytes=4))}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_revisits_can_get_the_payload_back(spark):
    from loomgraph.llm.common import shared_folder

    df = spark.createDataFrame([(1, "u", "ab" * 50), (2, "u", "ab" * 50), (3, "u", "x")], "page_id long, url string, html string")
    folder = f"{shared_folder(spark)}/warc-test"
    listed = warc.write_archives(warc.with_record_types(df), folder, archive_bytes=300)
    assert listed.count() >= 1
    got = {r["page_id"]: bytes(r["payload"]) for r in rows(warc.read_archives(spark, folder, listed, payloads=True))}
    assert got == {1: b"ab" * 50, 2: b"ab" * 50, 3: b"x"}


def test_attempts_that_run_twice_write_files_of_their_own(spark, monkeypatch, tmp_path):
    """The first attempt dies behind its first archive, two more run whole; one of these is committed."""
    import pyarrow as pa

    def refuse(*_):
        raise OSError("there is a file of that name")

    monkeypatch.setattr(warc, "fs", type("Store", (), {"FileSystem": warc.fs.FileSystem, "move": refuse}))
    folder = f"file://{tmp_path}"
    data = [(i, f"u{i}", bytes([65 + i]) * 200, False, None) for i in range(6)]
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.int64())
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["page_id", "url", "payload", "revisit", "refers_to"])
    write = warc.writer(folder, 300)

    def dying():
        yield batch(data[:2])
        raise MemoryError

    with pytest.raises(MemoryError):
        list(write(dying()))
    left = {p.name for p in tmp_path.iterdir()}
    assert left
    lost, won = (list(write(iter([batch(list(reversed(data))), batch([])]))), list(write(iter([batch(data)]))))
    names = lambda out: [x for b in out for x in b.column(0).to_pylist()]
    assert not set(names(lost)) & set(names(won)) and not left & set(names(won))
    listed = spark.createDataFrame([(n,) for n in names(won)], "archive string")
    warc.remove_unlisted(folder, listed)
    assert {p.name for p in tmp_path.iterdir() if p.suffix == ".zst"} == set(names(won))
    got = {r["page_id"]: bytes(r["payload"]) for r in rows(warc.read_archives(spark, folder, listed, payloads=True))}
    assert got == {i: payload for i, _, payload, _, _ in data}


def test_broken_archives_are_refused():
    good = warc.archive([warc.record(1, "u", b"payload", warc.digest(b"payload"), None, False)])
    assert list(warc.read_archive(good))[0]["payload"] == b"payload"
    plain = warc.record(1, "u", b"payload", warc.digest(b"payload"), None, False)
    pack = lambda raw: struct.pack("<II", warc.SKIPPABLE, 4) + b"dict" + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"dict")).compress(raw)
    assert list(warc.read_archive(pack(plain)))[0]["page_id"] == 1
    for bad in (good[8:], good[:-3], b"", good + b"xxxx", pack(plain.replace(b"payload\r\n", b"paylaod\r\n")), pack(plain[:-1]), pack(plain.replace(b"WARC/1.1", b"WORC/1.1")), pack(plain.replace(b"WARC-Date", b"WARC-Dote"))):
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.read_archive(bad))


def foreign(lines, block):
    return "\r\n".join(["WARC/1.0", *lines, "WARC-Date: 2001-02-03T04:05:06Z", f"Content-Length: {len(block)}\r\n\r\n"]).encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers_are_read():
    plain = zstandard.ZstdCompressor()
    http = b"HTTP/1.0 200 OK\r\nX-Long: a\r\n b\r\n\r\nbody"
    records = [
        foreign(["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:0>"], b"software: x\r\n"),
        foreign(["WARC-Type: request", "WARC-Record-ID: <urn:uuid:1>"], b"GET / HTTP/1.0\r\n\r\n"),
        foreign(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:2>", "WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=response"], http),
        foreign(["WARC-Type: resource", "WARC-Record-ID: <urn:x-page:abc>", "Content-Type: text/dns", "WARC-Payload-Digest: md5:00"], b"a.  IN  A"),
        foreign(["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:3>", "WARC-Refers-To: <urn:uuid:2>", "Content-Type: application/http"], b"HTTP/1.0 304 Same\r\n\r\n"),
    ]
    skipped = struct.pack("<II", 0x184D2A53, 5) + b"other"
    got = list(warc.read_archive(plain.compress(records[0]) + skipped + b"".join(map(plain.compress, records[1:]))))
    assert [(r["record_id"], r["page_id"], r["record_type"], r["payload"], r["refers_to_id"]) for r in got] == [
        ("<urn:uuid:2>", None, "response", b"body", None),
        ("<urn:x-page:abc>", None, "resource", b"a.  IN  A", None),
        ("<urn:uuid:3>", None, "revisit", None, "<urn:uuid:2>"),
    ]
    assert got[0]["payload_digest"] == warc.digest(b"body") and got[2]["payload_digest"] is None


def test_every_fault_is_a_warc_error():
    good = warc.record(1, "u", b"payload", warc.digest(b"payload"), None, False)
    data = warc.archive([good] * 20)
    pack = zstandard.ZstdCompressor().compress
    rnd, bad = random.Random(4), [data[:n] for n in range(0, len(data) - 1, 7)]
    bad += [pack(good.replace(b"Content-Length: 7", b"Content-Length: x")), pack(good.replace(b"HTTP/1.1", b"HTTQ/1.1")), pack(good[: good.index(b"\r\n\r\n")]), b"\x28\xb5\x2f\xfd" + bytes(40)]
    for _ in range(200):
        broken = bytearray(data)
        broken[rnd.randrange(len(broken))] ^= 1 << rnd.randrange(8)
        bad.append(bytes(broken))
    raised = 0
    for b in bad:
        try:
            list(warc.read_archive(b))
        except warc.WarcError:
            raised += 1
    assert raised > len(bad) // 2  # some damage can't be seen; none may raise anything else
    without = good.replace(b"WARC-Payload-Digest: sha1:" + warc.digest(b"payload").encode() + b"\r\n", b"").replace(b"Content-Length: 7\r\n", b"")
    n = int(without.split(b"\r\n\r\n")[0].rsplit(b" ", 1)[1])
    r = list(warc.read_archive(pack(without.replace(b"Content-Length: %d\r\n\r\nHTTP" % n, b"Content-Length: %d\r\n\r\nHTTP" % (n - 19)))))[0]
    assert (r["page_id"], r["payload_digest"], r["payload_bytes"]) == (1, warc.digest(b"payload"), 7)
