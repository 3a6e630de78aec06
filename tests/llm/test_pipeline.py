import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from rows import as_rows
from test_dedup import brute_classes
from test_sharding_mixing import expected_targets

import corpus_pipeline
from lodestead.llm import bpe_automaton, quality_rules
from lodestead.llm.common import WRITTEN


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_automaton.default_path())


def passed(rows):
    """Documents after the first three stages, with plain loops: (doc_id, source, text as bytes)."""
    classes = brute_classes([(r.doc_id, r.text) for r in rows], 5)
    kept_ids = {d for (d, _, _, kept) in classes if kept}
    left = [r for r in rows if r.doc_id is None or r.doc_id in kept_ids]
    number = lambda d: (1 << 63) - 1 if d is None else d
    first, out = {}, []
    texts = [(r.doc_id, r.source, (r.text or "").encode()) for r in left]
    for d, _, t in texts:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(first.get(t[k : k + 50], number(None)), number(d))
    for d, s, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < number(d):
                gone[k : k + 50] = True
        out.append((d, s, np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    return out


@pytest.mark.parametrize("fixture", ["labelled", "docs", "clashing"])
def test_all_stages(fixture, request, spark, tmp_path, library):
    docs = request.getfixturevalue(fixture)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = len(WRITTEN)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(WRITTEN) - before == len(corpus_pipeline.STAGES)  # each stage's result, and nothing else
    good = quality_rules.stage(spark, docs, "").collect()
    expected = passed(good)
    sizes, by_id = Counter(), defaultdict(list)
    for d, s, t in expected:
        sizes[s] += len(t.split())
        by_id[d].append((s, t.encode().split()))
    goal, taken, per_document = expected_targets(dict(sizes)), Counter(), Counter()
    for r in rows:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids
        words = r.text.encode().split()
        taken[r.source] += len(words)
        per_document[r.doc_id] += len(words)
        assert any(s == r.source and not Counter(words) - Counter(w) for s, w in by_id[r.doc_id])
    for s, words in goal.items():
        assert abs(taken[s] - words) <= 1
    for d, n in per_document.items():
        assert n <= 2 * sum(len(w) for _, w in by_id[d])
    assert Counter(as_rows(corpus_pipeline.run(spark, str(tmp_path)))) == Counter(map(str, rows))


def test_empty_table(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_are_named_and_real():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "mixing", "bpe_encoding"]
    assert Path(corpus_pipeline.__file__).parent == Path(__file__).resolve().parents[2] and "lodestead.llm.mixing" in sys.modules
