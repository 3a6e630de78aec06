import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
from compare import assert_same
from rows import as_rows

from lodestead.llm import bpe_automaton, quality_rules, registry

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, sf, duck):
    assert_same(registry.queries()[name](spark, sf), duck, registry.oracle_sql()[name])


# -- quality rules


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_measures(docs, clashing, empty):
    for r in docs.collect():
        assert quality_rules.measure(r.text)[:5] == brute_measures(r.text)
    found = quality_rules.ledger(docs)
    assert as_rows(found) == as_rows(quality_rules.ledger(clashing))
    assert quality_rules.ledger(empty).collect() == []


def test_policies_and_ablations(labelled):
    ledger = quality_rules.ledger(labelled).persist()
    rows = [r.asDict() for r in ledger.collect()]
    for version, names in quality_rules.POLICIES.items():
        mask = quality_rules.mask(version)
        kept = quality_rules.apply_policy(ledger, version).where("kept").count()
        base = quality_rules.mask("base")
        assert kept == sum(not r["fail_bits"] & (mask | base) for r in rows)
        for row in quality_rules.ablations(ledger, version).collect():
            bit = 1 << list(quality_rules.rules()).index(row.rule)
            assert row.rule in names and row.failed == sum(bool(r["fail_bits"] & bit) for r in rows)
            assert row.kept_without == sum(not r["fail_bits"] & mask & ~bit for r in rows)


def test_quality_stage_keeps_clean_documents(docs, clashing, labelled, empty, spark, sf):
    out = quality_rules.stage(spark, docs, "")
    assert out.columns == docs.columns and {0, 1, 12} <= {r.doc_id for r in out.collect()} and 21 not in {r.doc_id for r in out.collect()}
    assert quality_rules.stage(spark, clashing, "").columns == clashing.columns
    assert quality_rules.stage(spark, empty, "").collect() == []
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").join(labelled, "doc_id")
    base = quality_rules.apply_policy(quality_rules.ledger(labels)).where("NOT base_failed")
    assert base.where("kept").count() >= 0.97 * base.count()


def test_rejects_what_is_labelled_bad(spark, labelled, sf):
    """Documents of the lowest quality go, by the base rules or by the policy."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").join(labelled, "doc_id")
    found = quality_rules.apply_policy(quality_rules.ledger(labels))
    assert found.where("NOT kept").count() >= 0.95 * found.count() > 0


def test_stored_ledger(docs, tmp_path):
    stored = quality_rules.write_ledger(docs, str(tmp_path / "ledger"))
    assert as_rows(quality_rules.apply_policy(stored, "v1")) == as_rows(quality_rules.apply_policy(quality_rules.ledger(docs), "v1"))


# -- tokens


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    from tokenizers import Tokenizer

    return bpe_automaton.Automaton(**bpe_automaton.load(bpe_automaton.default_path())), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_automaton_equals_the_library(both, docs, labelled):
    automaton, library = both
    odd = ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "aaaaaaaaaaaaaaaaa" * 40, "\r\n \x0b\x85 　x", "I'll they've don't'S", "½ Ⅷ 12 ٣", "\x00\x1c\x1d\x1e\x1f"]
    for text in [*odd, *(r.text or "" for r in docs.collect()), *(r.text for r in labelled.collect())]:
        ids = automaton.encode(text)
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert automaton.decode(ids) == library.decode(expected, skip_special_tokens=False) == text


def test_gadgets_on_a_toy_vocabulary():
    """Against merging by rank, pair by pair, for all short words."""
    from itertools import product

    merges = [("a", "a"), ("a", "b"), ("aa", "a"), ("b", "ab"), ("aa", "ab"), ("b", "b")]
    vocabulary = {t: k for k, t in enumerate(["a", "b", *(x + y for x, y in merges)])}
    automaton = bpe_automaton.Automaton(vocabulary, merges)
    ranks = {pair: k for k, pair in enumerate(merges)}
    for n in range(1, 9):
        for letters in product("ab", repeat=n):
            parts = list(letters)
            while pairs := [(ranks[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]:
                _, k = min(pairs)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert automaton.word("".join(letters).encode()) == [vocabulary[p] for p in parts]


def gadgets_by_hand(merges, letters):
    """The automaton by copying states: state -> {token: state}, and the state that each token's arcs end in."""
    rows, ends = [dict.fromkeys(letters, 0)], dict.fromkeys(letters, 0)
    for u, v in merges:
        if u not in ends or v not in ends or v not in rows[ends[u]]:
            continue
        rows.append(dict(rows[ends[u]]))
        whole = rows[ends[u]][v]
        del rows[-1][v]
        copy = len(rows) - 1
        if u == v:  # the copy is what u leads to while its v arc is gone
            rows[-1].pop(v, None)
        for row in rows:
            if u in row:
                row[u + v] = row.get(u + v, whole)
        for row in rows:
            if u in row:
                row[u] = copy
        ends[u] = copy
        ends.setdefault(u + v, whole)
    return rows, ends


def test_rows_equal_states_made_by_hand():
    for merges in ([("a", "b"), ("ab", "c"), ("b", "c"), ("c", "a"), ("bc", "a"), ("ca", "b")], [("b", "c"), ("a", "bc"), ("a", "b"), ("c", "c"), ("cc", "a"), ("ab", "cc")]):
        vocabulary = {t: k for k, t in enumerate(["a", "b", "c", *(x + y for x, y in merges)])}
        automaton = bpe_automaton.Automaton(vocabulary, merges)
        rows, ends = gadgets_by_hand(merges, "abc")
        for last in ends:
            low, high = (x[automaton.starts[vocabulary[last]] : automaton.starts[vocabulary[last] + 1]] for x in (automaton.low, automaton.high))
            for token in ends:
                missing = any(a <= automaton.place[vocabulary[token]] <= b for a, b in zip(low, high, strict=True))
                assert missing != (token in rows[ends[last]]), (last, token)


def test_workers_get_the_same_automaton(both):
    import pickle

    automaton, library = both
    copy = pickle.loads(pickle.dumps(automaton))
    text = "It's the same: naïve 数据 <|endoftext|> " * 3
    assert copy.encode(text) == automaton.encode(text) and copy.decode(copy.encode(text)) == text


def test_words_that_come_again_are_encoded_once(both, monkeypatch):
    """A word that keeps coming is not encoded again when the memory of words turns over; unknown bytes are an error."""
    automaton = bpe_automaton.Automaton(**bpe_automaton.load(bpe_automaton.default_path()))
    monkeypatch.setattr(bpe_automaton, "REMEMBERED", 8)
    encoded, word = [], automaton.word
    automaton.word = lambda spelled: encoded.append(spelled) or word(spelled)
    text = "".join(f" again x{k}y" for k in map(chr, range(97, 123)))
    expected = both[1].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(automaton.encode(text), "<u4").tolist() == expected
    assert encoded.count(b" again") == 1 and len(encoded) == 27
    with pytest.raises(ValueError, match="no tokens"):
        bpe_automaton.Automaton({"a": 0, "b": 1, "ab": 2}, [("a", "b")]).word(b"abc")


def test_the_driver_holds_the_automaton_packed(both, spark):
    import pickle

    packed = bpe_automaton.compiled(spark, bpe_automaton.default_path())
    assert set(vars(packed)) == {"pickled"} and len(packed.pickled) < 12_000_000
    assert pickle.loads(pickle.dumps(packed)).encode("a <|endoftext|> naïve") == both[0].encode("a <|endoftext|> naïve")


def test_other_tokenizer_files_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="automaton"):
        bpe_automaton.load(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_query(both, spark, sf):
    _, library = both
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.queries()["op9_bpe_automaton"](spark, sf).collect():
        ids = library.encode(source[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_digests(both, spark, docs, clashing, empty):
    automaton, _ = both
    found = bpe_automaton.digests(spark, docs)
    expected = Counter()
    for r in docs.collect():
        ids = automaton.encode(r.text)
        expected[r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in found.collect()) == expected
    assert as_rows(bpe_automaton.digests(spark, clashing)) == as_rows(found)
    assert bpe_automaton.digests(spark, empty).collect() == []


def test_bpe_stage_round_trip(spark, docs, clashing):
    out = bpe_automaton.stage(spark, docs, "")
    decode = bpe_automaton.decoder(spark)
    assert all(r.back == (r.text or "") for r in out.select("text", decode("ids").alias("back")).collect())
    assert sorted(bpe_automaton.stage(spark, clashing, "").columns) == sorted(set(clashing.columns))
    assert bpe_automaton.stage(spark, docs.limit(0), "").collect() == []
