"""Archives written, damaged and read back."""
import gzip
import hashlib
import io
import random
import zlib

import pytest

from tickloom.llm import warc

PAGES = "page_id long, url string, html string, record string, first string, digest int"
LONG = "<p>" + "é long " * 300_000
SAME = "same " * 30
ROWS = [
    (5, "http://a/", SAME),
    (3, "http://b/", SAME),
    (3, "http://b/", SAME),
    (None, "http://c/", SAME),
    (9, None, "short"),
    (8, "u\r\nWARC-Type: metadata\r\n\r\nx", "short"),
    (1, "http://n/", None),
    (2, "http://e/", ""),
    (4, "http://l/", LONG),
    (6, "http://l/", LONG + "x"),
    (7, "http://w/", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3),
    (None, "http://x/", "null ids alone " * 10),
    (None, "http://y/", "null ids alone " * 10),
    (-7, "http://z/", "\r\n\r\n" * 40 + "\x00\x1f\x8b"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PAGES)


def expected(rows):
    for i, url, html in rows:
        html = html or ""
        size = len(html.encode())
        alike = [j for j, _, h in rows if (h or "") == html and j is not None]
        several = sum((h or "") == html for _, _, h in rows) > 1
        first = min(alike) if size >= 100 and several and alike else None
        revisit = first is not None and i != first
        yield i, url, size, hashlib.sha256(html.encode()).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else html


@pytest.mark.parametrize("compress", [True, False])
def test_archives_of_odd_rows(spark, tmp_path, compress):
    folder = str(tmp_path / "archives")
    warc.write_archives(table(spark, ROWS).repartition(3), folder, compress=compress)
    got = warc.read_archives(spark, folder).collect()
    assert all(r.problem is None for r in got)
    found = []
    for r in got:
        i = r.record_id.removeprefix("<urn:page:").removesuffix(">")
        to = r.fields.get("warc-refers-to")
        url = r.target_uri
        found.append((int(i) if i else None, url, int(r.fields["x-payload-length"]), r.fields["warc-payload-digest"][7:], r.type, int(to[10:-1]) if to else None, r.payload.decode() if r.type == "response" else None))
    want = [(i, u.replace("\r", "%0D").replace("\n", "%0A") if u else u, *rest) for i, u, *rest in expected(ROWS)]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert all(r.payload == b"" for r in got if r.type == "revisit")


def test_members_unpack_to_the_plain_archive(spark, tmp_path):
    rows = table(spark, ROWS).coalesce(1)
    for compress in (True, False):
        warc.write_archives(rows, str(tmp_path / str(compress)), compress=compress, date="2020-01-01T00:00:00Z")
    packed = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "True").glob("part-*")))
    plain = b"".join(p.read_bytes() for p in sorted((tmp_path / "False").glob("part-*")))
    split = lambda x: sorted(x.split(b"WARC/1.0\r\nWARC-Type: res"))
    assert split(packed) == split(plain) and packed.count(b"WARC-Block-Digest") == len(ROWS)


def test_tables_without_rows(spark, tmp_path):
    warc.write_archives(table(spark, []), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_large_groups_are_joined_apart(spark, monkeypatch):
    rows = [(i, "u", "hot " * 40 if i % 3 == 0 else f"pair {i // 6} " * 20 if i % 3 == 1 else f"single {i} " * 20) for i in range(600)]
    from pyspark.sql import functions as F

    monkeypatch.setattr(warc, "HOT_SHARES", 10)
    pages = table(spark, rows).withColumn("dig", F.md5("html")).withColumn("size", F.octet_length("html"))
    got = {r.page_id: r.f for r in warc.first_of_equal(pages, "page_id", "dig", "size", "f").collect()}
    for i, _, html in rows:
        alike = [j for j, _, h in rows if h == html]
        assert got[i] == (min(alike) if len(alike) > 1 else None)


def record(payload, kind="response", digest=True):
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"folded: a", b" b"]
    lines += [b"WARC-Block-Digest: sha256:" + hashlib.sha256(payload).hexdigest().encode()] if digest else []
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(payload), b"", b""]) + payload + warc.END


def pieces(rng, n, packed):
    out = []
    for i in range(n):
        payload = bytes(rng.choice(b"ab\r\n WARC/1.0") for _ in range(rng.choice((0, 5, 300)))) + b"%d" % i
        if rng.random() < 0.3:
            payload += record(b"inside %d" % i) + b"\x1f\x8b\x08"
        one = record(payload)
        out.append((payload, gzip.compress(one) if packed and rng.random() < 0.8 else one))
    return out


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("read_bytes", [1, 64, 1 << 20])
def test_records_outside_the_damage_are_recovered(packed, read_bytes, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", read_bytes)
    monkeypatch.setattr(warc, "LARGEST_HEADER", 400)
    rng = random.Random(read_bytes + packed)
    for _ in range(25):
        made = pieces(rng, 12, packed)
        data, spans = b"", []
        for payload, raw in made:
            hit = rng.random() < 0.3
            if hit and rng.random() < 0.5:
                at = rng.randrange(len(raw))
                raw = raw[:at] + bytes([raw[at] ^ (1 + rng.randrange(255))]) + raw[at + 1 :]
            elif hit:
                at = rng.randrange(len(raw))
                raw = raw[:at] + raw[at + rng.randrange(1, 200) :]
            if rng.random() < 0.1:
                data += bytes(rng.randrange(256) for _ in range(rng.randrange(1, 50)))
            spans.append((len(data), payload, hit))
            data += raw
        got = list(warc.salvaged(io.BytesIO(data)))
        at = 0
        for offset, length, problem, _, _ in got:  # records and gaps lie side by side, but for empty members
            assert offset == at and length > 0
            at += length
        assert at == len(data)
        found = {offset: block for offset, _, problem, _, block in got if problem is None}
        lost = [payload for offset, payload, hit in spans if not hit and found.get(offset) != payload]
        assert not lost


def test_problems_are_named():
    good = record(b"payload")
    flipped = good.replace(b"payload", b"pAyload")
    assert [(p, n) for _, n, p, _, _ in warc.salvaged(io.BytesIO(good + flipped + good))] == [(None, len(good)), ("digest differs", len(good)), (None, len(good))]
    assert [(o, p) for o, _, p, _, _ in warc.salvaged(io.BytesIO(good[:-9] + good))] == [(0, "no end mark"), (len(good) - 9, None)]
    assert [p for _, _, p, _, _ in warc.salvaged(io.BytesIO(good[:-1]))] == ["truncated record"]
    assert [p for _, _, p, _, _ in warc.salvaged(io.BytesIO(b"junk" + good))] == ["no record", None]
    assert [p for _, _, p, _, _ in warc.salvaged(io.BytesIO(good), largest=3)] == ["record too large"]
    member = gzip.compress(good)
    broken = member[:30] + bytes([member[30] ^ 255]) + member[31:]
    assert [p for _, _, p, _, _ in warc.salvaged(io.BytesIO(broken + member))] == ["broken member", None]
    assert [p for _, _, p, _, _ in warc.salvaged(io.BytesIO(member[:-4]))] == ["truncated member"]
    assert [p for _, _, p, _, _ in warc.salvaged(io.BytesIO(gzip.compress(good + good)))] == ["member holds more than a record"]
    assert [p for _, _, p, _, _ in warc.salvaged(io.BytesIO(gzip.compress(b"")))] == []
    assert [p for _, _, p, _, _ in warc.salvaged(io.BytesIO(gzip.compress(b"x" * 100)), largest=50)] == ["member too large"]
    assert list(warc.salvaged(io.BytesIO(b""))) == []
    assert [f["folded"] for _, _, _, f, _ in warc.salvaged(io.BytesIO(good))] == ["a b"]
    assert zlib.decompress(member, 31) == good


def test_damaged_files_on_the_cluster(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i} " * 50) for i in range(200)]
    folder = tmp_path / "archives"
    warc.write_archives(table(spark, rows).repartition(2), str(folder))
    path = max(folder.glob("part-*"), key=lambda p: p.stat().st_size)
    data = bytearray(path.read_bytes())
    data[500:520] = b"\0" * 20
    path.write_bytes(data)
    (folder / f".{path.name}.crc").unlink(missing_ok=True)
    got = warc.read_archives(spark, str(folder)).collect()
    kept = [r for r in got if r.problem is None]
    assert 190 < len(kept) < 200 and len(got) > len(kept)
    assert all(r.payload.decode() == f"page {r.record_id[10:-1]} " * 50 for r in kept)
