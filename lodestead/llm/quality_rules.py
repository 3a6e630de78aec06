"""Rule bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule. A policy is a
versioned mask over those bits, so applying another policy, or finding what each rule removes on its own, reads the
ledger and never the texts again.

Defined results: a null text counts as the empty text (no words, all measurements 0, base rules fail); null ids pass
through; repeated rows are judged one by one; an empty table gives an empty ledger; columns other than the id and the
text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import table, unused

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Odd multipliers of the window fingerprint, one per word of the window.
MIX = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

def rules(prefix: str = "") -> dict[str, Column]:
    """Rule name to failure condition over the measurements; the position of a rule is its bit in the ledger."""
    c = lambda name: F.col(prefix + name)
    return {
        "few_words": c("n_words") < 20,
        "repeated_words": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "duplicate_lines": (c("n_dup_lines") >= 3) & (100 * c("n_dup_lines") > 30 * c("n_lines")),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 25 * c("n_words"),
    }


#: Policy version -> names of the rules that reject. ``base`` holds the two rules every version shares.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines"),
    "v2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words"),
}
PRODUCTION = "v2"


def mask(version: str) -> int:
    names = list(rules())
    return sum(1 << names.index(name) for name in POLICIES[version])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words occurring at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    word = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        window += word[k : k + n] * MIX[k]
    order = np.sort(window)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(window, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen, repeats, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            repeats += line in seen
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), repeats, repeated_words(words), lines)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@F.pandas_udf(StructType([StructField(name, LongType()) for name in MEASURES]))
def measurements(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(x) for x in texts], columns=list(MEASURES), dtype="int64")


def fail_bits(prefix: str = "") -> Column:
    """One bit per failed rule."""
    total = F.lit(0).cast("long")
    for k, failed in enumerate(rules(prefix).values()):
        total = total.bitwiseOR(F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return total


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: measurements and ``fail_bits``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), measurements(F.col(text).cast("string")).alias("m"))
    return rows.select("doc_id", "m.*").withColumn("fail_bits", fail_bits())


def failed(bits: Column, version: str) -> Column:
    return bits.bitwiseAND(F.lit(mask(version))) != 0


def apply_policy(entries: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy version."""
    bits = F.col("fail_bits")
    return entries.withColumn("base_failed", failed(bits, "base")).withColumn("kept", ~failed(bits, "base") & ~failed(bits, version))


def ablations(entries: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents it rejects, rejects alone, and kept if it were dropped. One pass, one row per rule."""
    names, bits = list(rules()), F.col("fail_bits").bitwiseAND(F.lit(mask(version)))
    counts = [F.count("*").alias("n_docs"), F.count_if(bits == 0).alias("kept")]
    for name in POLICIES[version]:
        bit = 1 << names.index(name)
        counts += [F.count_if(bits.bitwiseAND(F.lit(bit)) != 0).alias(f"{name}_failed"), F.count_if(bits == bit).alias(f"{name}_alone")]
    each = [F.struct(F.lit(n).alias("rule"), F.col(f"{n}_failed").alias("failed"), F.col(f"{n}_alone").alias("alone"), (F.col("kept") + F.col(f"{n}_alone")).alias("kept_without"), F.col("n_docs")) for n in POLICIES[version]]
    return entries.agg(*counts).select(F.inline(F.array(*each)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the production policy."""
    return apply_policy(ledger(table(spark, sf_dir, "documents"))).drop("n_lines")


def write_ledger(docs: DataFrame, path: str) -> DataFrame:
    """The ledger as a table of its own; policies and ablations read it, and never the texts again."""
    ledger(docs).write.mode("error").parquet(path)
    return docs.sparkSession.read.parquet(path)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the production policy keeps, with their columns unchanged."""
    name = unused("_rules", docs.columns)
    measured = docs.withColumn(name, measurements(F.col("text").cast("string")))
    bits = fail_bits(f"{name}.")
    return measured.where(~failed(bits, "base") & ~failed(bits, PRODUCTION)).drop(name)


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
w AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM s),
g AS (SELECT r, i, CASE WHEN lead(w, 7) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) END AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 THEN 1 ELSE 0 END AS twice FROM g),
v AS (SELECT r, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM c),
n AS (SELECT r, sum(covered) AS n_repeat_words FROM v GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
k AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(s.words)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
 len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
 coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
 FROM d JOIN s USING (r) LEFT JOIN n USING (r) LEFT JOIN k USING (r)),
b AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
 + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
 + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits::BIGINT AS fail_bits, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept FROM b
"""
