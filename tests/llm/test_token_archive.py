import os
import zlib

import numpy as np
import pytest
from rows import as_rows

from lodestead.llm import registry, token_archive

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_archive.default_path())


def brute(rows, tokenizer):
    """(doc_id, start, n_tokens, crc) of (doc_id, text) rows."""
    found = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        found.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at, out = 0, []
    for doc_id, n, crc in sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])):
        out.append((doc_id, at, n, crc))
        at += n
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda x: x[1])


def test_round_trip(spark, docs, clashing, empty, tokenizer, tmp_path):
    folder = f"file://{tmp_path}/a"
    places = token_archive.write(docs, folder)
    wanted = brute([(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert rows_of(token_archive.read(spark, folder)) == wanted
    token_archive.write(clashing, f"file://{tmp_path}/b")
    assert rows_of(token_archive.read(spark, f"file://{tmp_path}/b")) == wanted
    full = token_archive.read(spark, folder, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in full)
    ids = {(r.file.split("/")[-1], r.document): r.ids for r in full}
    single = token_archive.lookup(places.where("doc_id IN (12, 21, 24)"), folder).collect()
    assert {r.doc_id for r in single} == {12, 21, 24} and all(ids[r.file, r.document] == r.ids for r in single)
    assert token_archive.write(empty, f"file://{tmp_path}/c").collect() == [] == token_archive.read(spark, f"file://{tmp_path}/c").collect()


def test_many_files_and_blocks(spark, labelled, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(token_archive, "PARTITION", 100_000)
    folder = f"file://{tmp_path}/a"
    token_archive.write(labelled.repartition(5), folder)
    assert len([x for x in os.listdir(tmp_path / "a") if x.endswith(token_archive.SUFFIX)]) > 2
    assert rows_of(token_archive.read(spark, folder)) == brute([(r.doc_id, r.text) for r in labelled.collect()], tokenizer)
    assert len([x for x in os.listdir(tmp_path / "a") if x.endswith(".zdict")]) == 1


def test_dictionary_helps_short_documents(docs, tmp_path):
    import zstandard

    arrays = token_archive.encoded(docs)
    data = token_archive.trained(arrays)
    assert data and data == token_archive.trained(arrays.repartition(2))
    short = [bytes(r.ids) for r in arrays.where("octet_length(ids) < 2000").collect()]
    size = lambda d: sum(len(zstandard.ZstdCompressor(level=token_archive.LEVEL, dict_data=d).compress(x)) for x in short)
    assert size(zstandard.ZstdCompressionDict(data)) < size(None)


def test_damaged_files_are_refused(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/a"
    token_archive.write(docs, folder)
    path = next((tmp_path / "a").glob(f"*{token_archive.SUFFIX}"))
    whole = path.read_bytes()
    path.write_bytes(whole[:-1])
    with pytest.raises(Exception, match="index does not fit|not a token archive"):
        token_archive.read(spark, folder).collect()
    path.write_bytes(whole)
    next((tmp_path / "a").glob("*.zdict")).write_bytes(b"other")
    with pytest.raises(Exception, match="is damaged"):
        token_archive.read(spark, folder).collect()


def test_pieces_between_white_space(tokenizer):
    with open(token_archive.default_path(), "rb") as file:
        encoder = token_archive.Encoder(file.read())
    assert encoder.separable
    odd = ["Á é\tİI ΣΑΣ Σ", "<|endoftext|><|startoftext|> x<|endoftext|>y", "don't 'S\x1cx\x85y z　w", "①Ⅷ ﬁ ﬃ 1234", "", " \n\t ", "z" * 300 + " z", "👩‍👩‍👧\r\na\x00b \x00 \x00\x00", "Word, word. WORD., it's. 3.5, é. É, .", "H\u0331 I\u0307 K\u0301 Á", "<|ENDOFTEXT|> <|EndOfText|>", "q" * 300 + ".", "q" * 300]
    wanted = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], encoder.type).tobytes() for t in odd]
    raw = [t.encode() for t in odd]
    assert encoder.encode(raw) == wanted == encoder.encode(raw) == [encoder.encode([x])[0] for x in raw]
    assert max(len(x.encode()) for x in encoder.known.to_pylist()) <= token_archive.LONGEST


def test_registered_query(spark, sf, tokenizer):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = registry.queries()["op12_token_archive"](spark, sf)
    assert rows_of(found) == brute([(r.doc_id, r.text) for r in rows], tokenizer)
    assert as_rows(found.select("doc_id")) == sorted(f"Row(doc_id={r.doc_id})" for r in rows)
