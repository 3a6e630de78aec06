import hashlib
import io
import random
import tarfile
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F
from rows import as_rows

from lodestead.llm import files, media, registry, token_files, warc
from lodestead.llm.common import scratch


def test_range_file_tries_again(tmp_path, monkeypatch):
    (tmp_path / "x").write_bytes(bytes(range(100)))
    file, real, failed = files.RangeFile(str(tmp_path / "x")), files.RangeFile.close, []

    class Broken:
        def seek(self, at):
            failed.append(at)
            raise OSError("lost")

        def close(self):
            pass

    file.handle = Broken()
    monkeypatch.setattr(files.time, "sleep", lambda s: None)
    assert file.read(10, 5) == bytes(range(10, 15)) and failed == [10] and file.read(98, 50) == bytes([98, 99])
    real(file)


# -- media


def test_images_hold_every_byte():
    for data in (b"", b"a", bytes(64), bytes(range(256)) * 3, b"x" * 65):
        payload, length = media.samples(media.image(data))
        assert length == len(data) and payload == data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
    broken = bytearray(media.image(b"hello"))
    broken[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.samples(bytes(broken))


def test_media_round_trip(spark, docs, clashing, empty):
    folder = scratch(spark, "test-media")
    assert media.write(docs, folder) == docs.count()
    rows = media.read(spark, folder, 4096).select("member", "payload").mapInArrow(media._features, media.FEATURES).collect()
    expected = Counter()
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        expected[r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter(tuple(r)[:5] for r in rows) == expected
    assert len({(r.payload_sha256, r.n_bytes) for r in rows}) == len({tuple(r)[1:] for r in rows})
    again = scratch(spark, "test-media")
    media.write(clashing, again)
    assert Counter(tuple(r)[:5] for r in media.read(spark, again).select("member", "payload").mapInArrow(media._features, media.FEATURES).collect()) == expected
    nothing = scratch(spark, "test-media")
    assert media.write(empty, nothing) == 0 and media.read(spark, nothing).count() == 0


def test_ranges_of_a_tar_find_each_member_once(tmp_path):
    """Members that are archives themselves, empty, or look like headers."""
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for k in range(5):
            info = tarfile.TarInfo(f"inner{k}")
            info.size = 700
            tar.addfile(info, io.BytesIO(bytes(700)))
    r = random.Random(1)
    with tarfile.open(tmp_path / "a.tar", mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for k in range(40):
            data = inner.getvalue() if k % 7 == 3 else b"" if k % 7 == 5 else r.randbytes(r.randint(1, 3000))
            info = tarfile.TarInfo(f"m{k}")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    size = (tmp_path / "a.tar").stat().st_size
    for length in (512, 2048, 10240, 1 << 20):
        file = files.RangeFile(str(tmp_path / "a.tar"))
        names = [n for at in range(0, size, length) for _, n, _ in media.members(file, at, min(at + length, size))]
        assert names == [f"m{k}" for k in range(40)]


def tar_of(path, format_, *members):
    with tarfile.open(path, mode="w", format=format_) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
            info.size = len(data or b"")
            tar.addfile(info, io.BytesIO(data or b""))
    return path


@pytest.mark.parametrize("format_", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_headers_of_all_formats(spark, tmp_path, format_):
    """Directories, long names, archives in payloads, ranges shorter than members; with an index and without."""
    r, long = random.Random(3), "d" * 90 + "/" + "n" * 60 if format_ == tarfile.USTAR_FORMAT else "n" * 300 + "ž"
    inner = tar_of(tmp_path / "inner", format_, ("a", b"x" * 600), ("b", b"y" * 700)).read_bytes()
    given = [("dir", None), *[(f"m{k}", r.randbytes(r.randint(0, 4000))) for k in range(20)], ("inner.tar", inner), (long, b"long"), ("last", b"")]
    tar_of(tmp_path / "a.tar", format_, *given)
    (tmp_path / "none.tar").write_bytes(b"")
    tar_of(tmp_path / "blank.tar", format_)
    expected = sorted((name, data) for name, data in given if data is not None)
    for length in (512, 3000, 1 << 20):
        rows = media.read(spark, str(tmp_path), length)
        assert sorted((x.member, bytes(x.payload)) for x in rows.collect()) == expected
    plain = spark.read.format("tar_ranges").option("path", str(tmp_path)).option("range_bytes", "2048").load()
    assert sorted((x.member, bytes(x.payload)) for x in plain.collect()) == expected


def test_sizes_as_binary_numbers():
    block = bytearray(tarfile.TarInfo("big").tobuf(tarfile.USTAR_FORMAT))
    block[124:136] = bytes([0x80]) + (10**12).to_bytes(11, "big")
    block[148:156] = b" " * 8
    block[148:156] = b"%06o\0 " % sum(block)
    assert media.heading(bytes(block)) == ("big", 10**12, b"0")
    assert media.extended(b"x", b"12 path=a=b\n13 size=1234\n") == {"path": "a=b", "size": "1234"}


def test_damaged_archives(spark, tmp_path):
    """Nothing after a damage is lost unseen: an error, or what is before it and a row that tells where."""
    whole = tar_of(tmp_path / "whole", tarfile.USTAR_FORMAT, *[(f"m{k}", bytes([k]) * 1500) for k in range(12)]).read_bytes()
    at = 5 * 2048  # the sixth header
    cases = {
        "header": (whole[:at] + b"\1" + whole[at + 1 :], at, "no header", 5),
        "cut": (whole[: at + 1000], at, "member cut short", 5),
        "cut-header": (whole[: at + 100], at, "no header", 5),
        "more": (whole + b"x" * 512, 12 * 2048, "data after the end", 12),
        "start": (b"x" * 700, 0, "no header", 0),
    }
    for name, (data, offset, reason, before) in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.tar").write_bytes(data)
        (tmp_path / name / "whole.tar").write_bytes(whole)
        with pytest.raises(ValueError, match=f"{reason} at {offset}"):
            media.read(spark, str(tmp_path / name), 4096)
        kept = Counter(r.archive[-9:] for r in media.read(spark, str(tmp_path / name), 4096, "keep").collect())
        assert sum(kept.values()) == before + 12 and kept["whole.tar"] == 12, name
        told = media.index(spark, str(tmp_path / name), 4096).where("reason IS NOT NULL").collect()
        assert [(r.archive[-5:], r.offset, r.reason) for r in told] == [("a.tar", offset, reason)]


# -- token files


def test_token_counts(spark, docs, clashing, empty, monkeypatch):
    import base64

    import public_tokenizers
    import tiktoken

    with open(token_files.default_path(), "rb") as file:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    expected = Counter((r.doc_id, len(encoding.encode_ordinary(r.text or ""))) for r in docs.collect())
    for length in (64, 4096, 8 << 20):
        monkeypatch.setattr(token_files, "RANGE", length)
        for table in (docs, clashing):
            folder = scratch(spark, "test-tokens")
            places = token_files.write(table, folder)
            counts = token_files.counts(spark, folder).collect()
            at = {(r.file.rsplit("/", 1)[1], r.document): r.n_tokens for r in counts if r.finished}
            assert all(r.finished for r in counts)
            assert Counter((r.doc_id, at[r.file, r.document]) for r in places.collect()) == expected
    folder = scratch(spark, "test-tokens")
    assert token_files.write(empty, folder).collect() == [] and token_files.counts(spark, folder).collect() == []


def test_unfinished_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE", 16)
    end = token_files.layout()[1]
    cases = {"a": [1, 2, end, end, *range(50), end, 7], "b": [*range(30)], "c": [end], "d": []}
    for name, ids in cases.items():
        np.array(ids, "<u2").tofile(tmp_path / f"{name}.tokens")
    found = Counter((r.file[-8], r.document, r.first_token, r.n_tokens, r.finished) for r in token_files.counts(spark, str(tmp_path)).collect())
    assert found == Counter({("a", 0, 0, 2, True): 1, ("a", 1, 3, 0, True): 1, ("a", 2, 4, 50, True): 1, ("a", 3, 55, 1, False): 1, ("b", 0, 0, 30, False): 1, ("c", 0, 0, 0, True): 1})


# -- WARC


def hostile(spark):
    """Payloads that hold records, repeats, nulls, headers longer than usual."""
    nested = warc.record(99, "http://x", b"inner payload", None, False).decode()
    long = "y" * 1200
    rows = [(1, "http://a", nested * 3), (2, "http://b\r\nX: y", long), (5, None, long), (3, "http://c", long), (4, "u" * 70_000, "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (6, "http://d", None), (7, "http://e", "short"), (8, "http://f", "short"), (None, "http://g", long), (9, "http://h", "WARC/1.1\r\n" * 500), (10, "http://i", "é" * 600), (10, "http://i", "é" * 600), (11, "http://j", "z" * 40_000 + nested)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc(spark, duck, monkeypatch):
    pages = hostile(spark)
    duck.sql("CREATE OR REPLACE VIEW hostile AS SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in pages.collect()) + ") t(page_id, url, html)")
    folder = scratch(spark, "test-warc")
    assert warc.write(pages.coalesce(1), folder) == 1
    sql = warc.ORACLE.replace("FROM pages", "FROM hostile")
    assert_same(warc.read(spark, folder), duck, sql)
    again = scratch(spark, "test-warc")
    from pyspark.sql import functions as F

    warc.write(pages.select("*", F.lit("x").alias("_sha1x"), F.lit(1).alias("refers_to"), F.lit(1).alias("revisit")), again)
    assert as_rows(warc.read(spark, again)) == as_rows(warc.read(spark, folder))
    nothing = scratch(spark, "test-warc")
    assert warc.write(pages.limit(0), nothing) == 0 and warc.read(spark, nothing).collect() == []


def test_damaged_and_foreign_warc(spark, tmp_path):
    """What is no chain of records is an error that tells where; other types and ids are no error."""
    records = [warc.record(k, f"http://x/{k}", b"p" * 300, None, False) for k in range(8)]
    whole, at = b"".join(records), sum(map(len, records[:4]))
    cases = {"start": (b"x" + whole, "no record at 0"), "cut": (whole[:-10], f"record cut short at {len(whole) - len(records[-1])}"), "broken": (whole[:at] + b"?" + whole[at:], f"no record at {at}"), "text": (b"no archive", "no record at 0")}
    for name, (data, told) in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        with pytest.raises(Exception, match=told):
            warc.read(spark, str(tmp_path / name)).collect()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 9\r\n\r\nsoftware:\r\n\r\n"
    foreign = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabcd\r\n\r\n"
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "a.warc").write_bytes(info + foreign + whole)
    rows = warc.read(spark, str(tmp_path / "ok")).collect()
    assert Counter(r.page_id for r in rows) == Counter([None, *range(8)])
    assert [(r.payload_bytes, r.payload_digest) for r in rows if r.page_id is None] == [(4, hashlib.sha1(b"abcd").hexdigest())]


def test_chains_over_many_ranges(spark, tmp_path):
    """Local jumps against a plain walk, ranges far shorter than records."""
    r = random.Random(2)
    data = b"".join(warc.record(k, f"http://x/{k}", (warc.record(k, None, r.randbytes(50), None, False) if k % 3 else b"") + r.randbytes(r.randint(0, 900)), None, False) for k in range(60))
    (tmp_path / "a.warc").write_bytes(data)
    file = files.RangeFile(str(tmp_path / "a.warc"))
    truth, at = [], 0
    while at < len(data):
        truth.append(at)
        _, start, length = warc.header(file, data, 0, at)
        at = start + length + 4
    offsets = np.array([m.start() for m in warc.MAGIC.finditer(data)])
    heads = [warc.header(file, data, 0, int(o)) for o in offsets]
    successors = np.array([h[1] + h[2] + 4 for h in heads])
    for length in (300, 1000, 5000, 1 << 20):
        reached, entry = [], 0
        exits = {}
        for start in range(0, len(data), length):
            mine = (offsets >= start) & (offsets < start + length)
            exits |= dict(zip(offsets[mine].tolist(), warc.jump(offsets[mine], successors[mine], min(start + length, len(data))).tolist(), strict=True))
        while entry in exits:
            reached.append(entry)
            entry = exits[entry]
        assert entry == len(data) and set(reached) <= set(truth) and {t // length for t in truth} == {e // length for e in reached}


def test_layout_follows_the_vocabulary(tmp_path):
    import base64

    def saved(name, ids):
        path = tmp_path / name
        path.write_bytes(b"".join(base64.b64encode(bytes([k % 256, k // 256 % 256, k >> 16])) + b" %d\n" % i for k, i in enumerate(ids)))
        return str(path)

    assert token_files.layout() == (2, 50256)
    assert token_files.layout(saved("gap", [0, 1, 3])) == (2, 2)
    assert token_files.layout(saved("large", range(70000))) == (4, 70000)


def test_wide_ids_round_trip(spark, docs, tmp_path):
    """The same counts with a vocabulary whose ids need four bytes."""
    import base64

    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([k])) + b" %d\n" % (k + 70000) for k in range(256)))
    places = token_files.write(docs, str(tmp_path / "wide"), str(path))
    found = token_files.counts(spark, str(tmp_path / "wide"), str(path)).withColumn("file", F.element_at(F.split("file", "/"), -1))
    rows = places.join(found, ["file", "document"])
    assert Counter((r.doc_id, r.n_tokens) for r in rows.collect()) == Counter((r.doc_id, len((r.text or "").encode())) for r in docs.collect())


def test_token_query(spark, sf):
    with open(token_files.default_path(), "rb") as file:
        encode = token_files._encoder(file.read()).encode_ordinary
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = registry.queries()["op4_token_counts"](spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {d: len(encode(t or "")) for d, t in source.items()} and len(found) == len(source)


def test_media_query(spark, sf):
    source = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = registry.queries()["op8_media_columns"](spark, sf).collect()
    assert len(found) == len(source)
    for r in found:
        padded = source[r.doc_id].ljust(max(64, -(-len(source[r.doc_id]) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(source[r.doc_id]), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
