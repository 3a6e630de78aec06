import math
import random
import re
from collections import Counter

import numpy as np
from rows import as_rows

from lodestead.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def brute(docs, items, k):
    """Rows of (item_id, rank, doc_id, score) over (doc_id, text) and (item_id, text)."""
    counted = [(d, Counter(brute_terms(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in counted:
            length, score = sum(c.values()), 0
            for t in set(brute_terms(text)) & set(c):
                m = 100 - 50 + (50 * length * n) // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, doc_id, -s) for r, (s, _, _, doc_id) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_against_brute_force(spark, docs, clashing, empty):
    some = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(1, some[3][1]), (1, some[3][1]), (2, "one TWO ONE"), (3, None), (4, ""), (5, "Don't naïve 数据, 12345!"), (None, some[12][1]), (6, "nothing-known-here")]
    wanted = items_of(spark, items).repartition(2)
    for k in (1, 3, 50):
        for block in (1 << 20, 40):
            assert rows_of(lexical_search.search(docs, wanted, k, block)) == brute(some, items, k)
    assert as_rows(lexical_search.search(docs, wanted)) == as_rows(lexical_search.search(clashing, wanted.selectExpr("*", "'x' AS term", "'x' AS block", "1 AS score", "2 AS rank")))
    assert lexical_search.search(empty, wanted).collect() == [] == lexical_search.search(docs, wanted.limit(0)).collect()


def test_chunks_of_queries(spark, labelled, sf, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = rows_of(lexical_search.search(labelled, items))
    monkeypatch.setattr(lexical_search, "CHUNK", 300)
    assert rows_of(lexical_search.search(labelled, items)) == whole


def test_stops_early_only_with_proof():
    """Blocks of skewed postings: results equal whole scoring, and not all postings are processed."""
    r = random.Random(7)
    size, terms = 5000, list(range(12))
    lengths = np.array([r.randint(5, 400) for _ in range(size)])
    postings = {}
    for t in terms:
        share = 0.5 / (t + 1) ** 2
        places = np.array([d for d in range(size) if r.random() < share], np.int32)
        postings[t] = (places, np.array([r.choice([1, 1, 1, 2, 3, 9]) for _ in places], np.int32))
    weights = {t: lexical_search.weight(size, len(postings[t][0])) for t in terms}
    block = lexical_search.Block(size, int(lengths.sum()), lengths, postings, weights)
    whole = sum(len(p) for p, _ in postings.values())
    early = 0
    for k in (1, 10, 50):
        for wanted in (terms, terms[3:], terms[:3], [11, 0], [5]):
            full = block.complete(wanted, np.arange(size))
            order = np.arange(size)
            processed = []
            places, scores = lexical_search._best(*block.search(wanted, k, processed), order, k)
            best = np.lexsort((order, -full))[:k]
            best = best[full[best] > 0]
            assert places.tolist() == best.tolist() and scores.tolist() == full[best].tolist()
            early += processed[0] < sum(len(postings[t][0]) for t in wanted)
    assert whole and early >= 3
