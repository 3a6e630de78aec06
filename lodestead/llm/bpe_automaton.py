"""Byte-pair tokenisation as a deterministic automaton.

The automaton reads tokens and accepts exactly the correct tokenisations. It starts as one state that loops on every
byte, and each merge ``u v -> uv`` adds one gadget: the state that ``u`` leads to is copied without its ``v`` arc, ``u`` is
redirected to the copy, and every state with a ``u`` arc gets a ``uv`` arc. All arcs of a token end in one state, so the
states are the tokens, and a state's row is all tokens but those that gadgets took away.

Compiled form: a gadget that takes ``v`` from a state takes with it the tokens that begin with ``v`` and are born later. In
the order of a walk over the tree of left halves, the latest born first, these are one interval. A state's row is thus a
few disjoint intervals of missing arcs, and all rows are flat arrays (starts by state, lows, highs). Encoding a pre-split
word is a run of look-ups in them, the longest token first: every prefix has one correct tokenisation, so a position that leads
nowhere is left once and for all.
Decoding emits the bytes on the arcs.

Defined results: a null text is the empty text (no tokens); repeated rows are encoded one by one; added tokens that stand
in a text become their own ids, as the reference library does by default; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import pickle
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import table, unused

#: Fixed value: the pattern of the byte-level pre-tokeniser. ``\\s`` is spelled out as the Unicode White_Space property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NEVER = 1 << 60
#: Words a worker remembers; beyond it those are kept that come again among as many new ones, the results stay the same.
REMEMBERED = 300_000


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Automaton:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int] | None = None):
        to_byte = byte_of_char()
        spell = lambda token: bytes(to_byte[c] for c in token)
        self.added = added or {}
        self.label = {i: t.encode() for t, i in self.added.items()}
        self.label |= {i: spell(t) for t, i in vocabulary.items() if t not in self.added}
        self.byte_token = {spell(t)[0]: i for t, i in vocabulary.items() if t not in self.added and len(spell(t)) == 1}
        # A token's arcs end in the state made by its last gadget. A state's chain of gadgets is: those of its token, then
        # those of the token's right half from before the token was born, and so on down the right spine.
        self.born = dict.fromkeys(self.byte_token.values(), -1)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.gadget: dict[tuple[int, int], int] = {}
        for k, (u, v) in enumerate((vocabulary[a], vocabulary[b]) for a, b in merges):
            uv = vocabulary[merges[k][0] + merges[k][1]]
            if u not in self.born or v not in self.born or not self.arc(u, v):
                continue  # u is never followed by v: this merge has nothing to do
            if uv not in self.born:
                self.born[uv], self.left[uv], self.right[uv] = k, u, v
            self.gadget[u, v] = k
        self.spelled = [self.label.get(i, b"") for i in range(max(self.label) + 1)]
        self.compile_rows()
        self.ready()

    def compile_rows(self) -> None:
        """Flat rows: token ``t`` has no arc in the state after ``s`` if its place lies in one of s's intervals."""
        later: dict[int, list[int]] = {}
        for token in sorted(self.left, key=self.born.__getitem__, reverse=True):
            later.setdefault(self.left[token], []).append(token)
        place = np.full(len(self.spelled), -1, np.int32)
        end = place.copy()
        at = 0
        walk = [(t, False) for t in self.byte_token.values()]
        while walk:
            token, done = walk.pop()
            if done:
                end[token] = at - 1
                continue
            place[token], at = at, at + 1
            walk.append((token, True))
            walk += [(t, False) for t in reversed(later.get(token, ()))]
        # What each gadget takes away, by the token whose state it copies, in the order of the gadgets.
        own: dict[int, tuple[list[int], list[int], list[int]]] = {}
        for (u, v), k in sorted(self.gadget.items(), key=lambda x: x[1]):
            mine = later.get(v, ())
            n = bisect_right(mine, -k, key=lambda t: -self.born[t])  # those born with the gadget or after it
            times, lows, highs = own.setdefault(u, ([], [], []))
            times.append(k)
            lows.append(int(place[v]))
            highs.append(int(end[mine[n - 1]]) if n else int(place[v]))
        starts, low, high = [0], [], []
        states: dict[int, list[tuple[int, int]]] = {}
        for state in self.born:
            missing, token, before = [], state, NEVER
            while True:
                if token in own:
                    times, lows, highs = own[token]
                    n = bisect_left(times, before)
                    missing += zip(lows[:n], highs[:n], strict=True)
                if self.born[token] < 0:
                    break
                token, before = self.right[token], self.born[token]
            states[state] = missing
        for state in range(len(self.spelled)):
            reached = -1
            for a, b in sorted(states.get(state, ()), key=lambda x: (x[0], -x[1])):  # intervals nest or are apart
                if a > reached:
                    low.append(a)
                    high.append(b)
                    reached = b
            starts.append(len(low))
        self.place, self.starts, self.low, self.high = place.tolist(), array("i", starts), array("i", low), array("i", high)

    def ready(self) -> None:
        """What workers make for themselves: spellings by prefix, patterns, the memory of words."""
        self.prefixes: dict[bytes, int] = {}
        for token in self.born:
            spelled = self.label[token]
            for n in range(1, len(spelled)):
                self.prefixes.setdefault(spelled[:n], -1)
            self.prefixes[spelled] = token
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("prefixes", "words", "older", "split", "special", "left", "right", "gadget")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.ready()

    def arc(self, last: int, token: int) -> bool:
        """Whether the state after ``last`` has an arc for ``token``, by the gadgets so far (construction only).

        Along the state's chain of gadgets, the latest first, a token born with or after a gadget has the arcs of its left
        half there; the arc is missing if a gadget removed the token that stands for it at that point.
        """
        gadget, born, before = self.gadget, self.born, NEVER
        while True:
            x, until = token, NEVER
            while True:
                k = gadget.get((last, x))
                since = born[x]
                if k is not None and k < before and since < k <= until:
                    return False
                if since < 0:
                    break
                x, until = self.left[x], since
            if born[last] < 0:
                return True
            last, before = self.right[last], born[last]

    def word(self, spelled: bytes) -> list[int]:
        """The accepted token path over one pre-split word.

        The longest token goes first; where a path ends before the word does, the next shorter one is tried. Every prefix has
        one correct tokenisation, so no position is come to twice.
        """
        n, prefixes, place, starts, low, high = len(spelled), self.prefixes, self.place, self.starts, self.low, self.high
        path: list[int] = []
        untried: list[list[tuple[int, int]]] = []
        begin, first, last = 0, 0, 0
        while True:
            choices = []
            for end in range(begin + 1, n + 1):
                token = prefixes.get(spelled[begin:end])
                if token is None:
                    break
                if token >= 0:
                    choices.append((token, end))
            while True:
                while not choices:
                    if not path:
                        raise ValueError(f"no tokens of the vocabulary spell {spelled!r}")
                    path.pop()
                    choices = untried.pop()
                    first, last = (starts[path[-1]], starts[path[-1] + 1]) if path else (0, 0)
                token, end = choices.pop()
                if first < last:
                    k = bisect_right(low, place[token], first, last) - 1
                    if k >= first and place[token] <= high[k]:
                        continue
                break
            path.append(token)
            if end == n:
                return path
            untried.append(choices)
            begin, first, last = end, starts[token], starts[token + 1]

    def remember(self, word: str) -> bytes:
        """The ids of a word that is not among the recent ones."""
        ids = self.older.get(word)
        if ids is None:
            path = self.word(word.encode("utf-8", "replace"))
            ids = pack(f"<{len(path)}I", *path)
        if len(self.words) >= REMEMBERED:
            self.words, self.older = {}, self.words
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if not any(x in text for x in self.added):
            return b"".join(self.pieces(text))
        out: list[bytes] = []
        for k, piece in enumerate(self.special.split(text)):
            out += [self.added[piece].to_bytes(4, "little")] if k % 2 else self.pieces(piece)
        return b"".join(out)

    def pieces(self, text: str) -> list[bytes]:
        """The ids of the words of a text without added tokens."""
        words = self.split.findall(text)
        found = list(map(self.words.get, words))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    ids = self.words.get(words[k])
                    found[k] = self.remember(words[k]) if ids is None else ids
        return found

    def decode(self, ids: bytes) -> str:
        """The text on the arcs."""
        spelled = self.spelled
        return b"".join([spelled[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


#: What a tokenizer file must say besides its vocabulary, or may leave out; other settings are refused.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": "", "end_of_word_suffix": "", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False}


def load_data(data: dict, path: str = "the tokenizer file") -> dict:
    """Vocabulary, merges and added tokens of a tokenizer file's contents."""
    if data.get("normalizer"):
        raise ValueError(f"{path}: the automaton has no normalizer")
    for found, known in [(data.get("pre_tokenizer") or {}, PRE_TOKENIZER), (data["model"], MODEL), *((x, ADDED) for x in data.get("added_tokens", []))]:
        for key, value in known.items():
            if (found.get(key, value) or None) != (value or None):
                raise ValueError(f"{path}: {key} is {found.get(key)!r}, the automaton needs {value!r}")
    if (data.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        raise ValueError(f"{path}: the automaton needs the byte-level pre-tokeniser")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
    return {"vocabulary": data["model"]["vocab"], "merges": merges, "added": {x["content"]: x["id"] for x in data.get("added_tokens", [])}}


def load(path: str) -> dict:
    """The same of a file; read on the driver, a few MB whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        return load_data(json.load(file), path)


class Packed:
    """A pickled automaton, which whoever unpickles it gets as the automaton."""

    def __init__(self, pickled: bytes):
        self.pickled = pickled

    def __reduce__(self):
        return pickle.loads, (self.pickled,)


PACKED: dict[str, Packed] = {}


def compiled(spark: SparkSession, path: str) -> Packed:
    """The automaton of a file. A task compiles it, which takes some 150 MB; the driver holds its arrays, about 10 MB whatever the corpus."""
    if path not in PACKED:
        with open(path, encoding="utf-8") as file:
            text = file.read()

        def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in rows:
                yield pa.RecordBatch.from_pydict({"pickled": [pickle.dumps(Automaton(**load_data(json.loads(text), path)))]})

        PACKED[path] = Packed(bytes(spark.range(1, numPartitions=1).mapInArrow(made, "pickled binary").first()[0]))
    return PACKED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


ENCODED = StructType([StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
DIGESTS = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


def encoder(spark: SparkSession, path: str | None = None):
    """Pandas UDF: text -> (n_tokens, ids as little-endian unsigned 32-bit integers)."""
    shared = spark.sparkContext.broadcast(compiled(spark, path or default_path()))

    @F.pandas_udf(ENCODED)
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        for batch in texts:
            ids = [automaton.encode(x) for x in batch]
            yield pd.DataFrame({"n_tokens": [len(x) // 4 for x in ids], "ids": ids})

    return encode


def decoder(spark: SparkSession, path: str | None = None):
    """Pandas UDF: ids -> text."""
    shared = spark.sparkContext.broadcast(compiled(spark, path or default_path()))

    @F.pandas_udf(StringType())
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = shared.value
        for batch in ids:
            yield pd.Series([None if x is None else automaton.decode(x) for x in batch], dtype=object)

    return decode


def digests(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id with token count and digests of the ids and of the text decoded from them."""
    shared = spark.sparkContext.broadcast(compiled(spark, path or default_path()))

    @F.pandas_udf(DIGESTS)
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        for batch in texts:
            rows = []
            for text in batch:
                ids = automaton.encode(text)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(automaton.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=DIGESTS.names)

    return docs.select("doc_id", digest(F.col("text").cast("string")).alias("d")).select("doc_id", "d.*")


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return digests(spark, table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, which replace columns of these names; decoding them gives the text back."""
    encode, name = encoder(spark), unused("_tokens", docs.columns)
    kept = [c for c in docs.columns if c.lower() not in ("n_tokens", "ids")]
    return docs.withColumn(name, encode(F.col("text").cast("string"))).select(*kept, F.col(f"{name}.n_tokens").alias("n_tokens"), F.col(f"{name}.ids").alias("ids"))
