import hashlib
from collections import Counter, defaultdict

import pytest
from rows import as_rows

from lodestead.llm import alignment, registry


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path)


def brute_tokens(text, tools):
    """[(id, start, end)] of both sides, or none."""
    from lodestead.llm.bpe_automaton import byte_of_char

    a, b = tools
    chars = byte_of_char()
    if not text:
        return [], []
    sides = [[(i, bytes(chars[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]]
    sides.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))])
    found = []
    for side in sides:
        if b"".join(s for _, s in side) != b" " + text.encode():
            return [], []
        at, spans = 0, []
        for i, s in side:
            spans.append((i, at, at + len(s)))
            at += len(s)
        found.append(spans)
    return found


def brute(texts, tools):
    spans = [brute_tokens(t, tools) for t in texts]
    links = []
    for a, b in spans:
        by_end = defaultdict(list)
        for i, _, end in b:
            by_end[end].append(i)
        links.append([(i, j) for i, _, end in a for j in by_end[end]])
    count = Counter(x for doc in links for x in doc)
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for (a, b), mine in zip(spans, links, strict=True):
        shared = sorted({e for *_, e in a} & {e for *_, e in b})
        parts, left = [], [list(a), list(b)]
        for high in shared:
            inside = []
            for side in left:
                n = next(k for k, (*_, end) in enumerate(side) if end == high) + 1
                inside.append(",".join(str(i) for i, *_ in side[:n]))
                del side[:n]
            parts.append("|".join(inside))
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""
        out.append((len(a), len(b), len(shared), len(mine), sum(count[x] == best[x[1]] for x in mine), sum(count[x] for x in mine), digest))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["a▁b", "</s><s><unk> <0x41>", "<|endoftext|>x", " lead", "trail  ", "\n\n a\r\n b", "ﬁ①½ Å é", "👩‍👩‍👧 ok", "\x00\x01 z", "\t\t", " ", "1234567 12", "naïve 数据 don't"]


def test_odd_texts_and_blocks(spark, tools):
    texts = [*ODD, None, "", *ODD[3:6]]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    wanted = sorted((k, *x) for k, x in enumerate(brute(texts, tools)))
    assert sorted(tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in alignment.figures(rows).collect()) == wanted
    assert alignment.blocks(rows, block=8).where("pair IS NULL").select("block").distinct().count() > 4  # long documents are blocks of their own
    assert sorted(tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in alignment.figures(rows, block=8).collect()) == wanted


def test_fixture(docs, clashing, empty, tools):
    rows = docs.collect()
    found = alignment.figures(docs)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == sorted(brute([r.text for r in rows], tools))
    assert as_rows(found) == as_rows(alignment.figures(clashing))
    assert alignment.figures(empty).collect() == []


def test_groups_overlaps_and_products(spark, tools):
    texts = ["unbelievable tokenization", "1234567", "数据 x"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = alignment.aligned(rows)
    products = {k: sorted((r.group, r.a, r.b) for r in alignment.expanded(found).collect() if r.doc_id == k) for k in range(len(texts))}
    for r in found.collect():
        a, b = brute_tokens(texts[r.doc_id], tools)
        overlaps = [(i, j) for i, (_, s, e) in enumerate(a) for j, (_, t, f) in enumerate(b) if s < f and t < e]
        assert sorted((o.a, o.b) for o in r.overlaps) == overlaps
        text = (" " + texts[r.doc_id]).encode()
        assert b"".join(text[g.start : g.end] for g in r.groups) == text
        assert [i for g in r.groups for i in g.a] == [i for i, *_ in a] and [i for g in r.groups for i in g.b] == [i for i, *_ in b]
        assert products[r.doc_id] == sorted((k, i, j) for k, g in enumerate(r.groups) for i in g.a for j in g.b)


def test_registered_query(spark, sf, tools):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in registry.queries()["op11_token_alignment"](spark, sf).collect()}
    assert found == {r.doc_id: x for r, x in zip(rows, brute([r.text for r in rows], tools), strict=True)}
