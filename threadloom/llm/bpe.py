"""Encoding with a public byte-level BPE through a token automaton compiled from the merges.

The automaton's states are "the last token emitted" and its arcs are tokens. It starts as the automaton that
accepts every sequence of single bytes; each merge (a, b) -> c, in order of rank, then adds one gadget: c may stand
wherever a followed by b could, and from then on a may not be followed by b. Of each gadget only what it changes is
stored: the tokens on either edge of c, and the ranks between which each of them was the outermost one. An arc u -> w
is thus in the final automaton unless a gadget (a, b) was added while a was the right edge of u and b the left edge of
w. Arcs are looked up once by that rule and then kept in the transition table. A word has exactly one accepted path,
found in one pass over its bytes, as exactly one token ends the path to each position.
"""

from __future__ import annotations

import hashlib
import json
import os

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter, they are never copied into the repository.
TOKENIZERS = os.environ.get("THREADLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: The split that the vocabulary was made with (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words kept with their ids in one Python worker; when full, the table starts anew.
WORDS_KEPT = 200_000
NEVER = 1 << 60


def _byte_names() -> dict[str, int]:
    """The characters by which the vocabulary file writes bytes: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenAutomaton:
    """Encodes and decodes texts; built from the JSON text of a byte-level BPE."""

    def __init__(self, source: str):
        model = json.loads(source)["model"]
        names = _byte_names()
        vocabulary: dict[str, int] = model["vocab"]
        self.labels = {i: bytes(names[c] for c in t) for t, i in vocabulary.items() if all(c in names for c in t)}
        self.gadgets: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocabulary[a], vocabulary[b]
            self.gadgets[pair] = rank
            parts.setdefault(vocabulary[a + b], (*pair, rank))
        self.left_edges = {t: self._edge(parts, t, 0) for t in self.labels}
        self.right_edges = {t: self._edge(parts, t, 1) for t in self.labels}
        self.trie: dict = {}
        for t, label in self.labels.items():
            if t not in parts and len(label) > 1:
                continue  # no merge makes it (special tokens)
            if t in parts and self._joined(parts[t][0], parts[t][1], parts[t][2]):
                continue  # an earlier merge always takes its bytes apart
            node = self.trie
            for byte in label:
                node = node.setdefault(byte, {})
            node[-1] = t
        self.arcs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(WORDS).findall

    @staticmethod
    def _edge(parts: dict[int, tuple[int, int, int]], token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that were outermost on that side, each with the rank of the merge that hid it."""
        edge, until = [(token, NEVER)], NEVER
        while token in parts:
            until = parts[token][2]
            token = parts[token][side]
            edge.append((token, until))
        return edge

    def _joined(self, u: int, w: int, before: int = NEVER) -> bool:
        """Whether a gadget older than ``before`` forbids w right after u."""
        for a, a_until in self.right_edges[u]:
            for b, b_until in self.left_edges[w]:
                rank = self.gadgets.get((a, b))
                if rank is not None and rank < before and rank < a_until and rank <= b_until:
                    return True
        return False

    def _word(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        n = len(data)
        state: list[int] = [-1] * (n + 1)
        came = [0] * (n + 1)
        arcs, root = self.arcs, self.trie
        for start in range(n):
            last = state[start]
            if start and last < 0:
                continue
            node = root
            for at in range(start, n):
                node = node.get(data[at])
                if node is None:
                    break
                token = node.get(-1)
                if token is None or state[at + 1] >= 0:
                    continue
                if start:
                    arc = (last, token)
                    allowed = arcs.get(arc)
                    if allowed is None:
                        allowed = arcs[arc] = not self._joined(last, token)
                    if not allowed:
                        continue
                state[at + 1] = token
                came[at + 1] = start
        ids, at = [], n
        while at:
            ids.append(state[at])
            at = came[at]
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        if len(self.arcs) > 20 * WORDS_KEPT:
            self.arcs.clear()
        words, out = self.words, []
        for word in self.split(text):
            ids = words.get(word)
            if ids is None:
                ids = self._word(word)
                if len(word) <= 64:
                    words[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one after the other."""
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


_BUILT: dict[str, TokenAutomaton] = {}


def automaton(source: str) -> TokenAutomaton:
    """One automaton a process for each vocabulary."""
    key = hashlib.md5(source.encode()).hexdigest()
    if key not in _BUILT:
        _BUILT[key] = TokenAutomaton(source)
    return _BUILT[key]


def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    with open(os.path.join(folder, name), encoding="utf-8") as file:
        return file.read()


def _shared(spark: SparkSession, folder: str, name: str):
    """The vocabulary file (1.6 MB, a fixed size) as a broadcast."""
    return spark.sparkContext.broadcast(vocabulary(folder, name))


def token_ids(df: DataFrame, text: str, out: str = "ids", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """Adds the token ids of a text column, without special tokens; their strings are ordinary text.

    Null and empty texts give an empty list. All other columns pass through unchanged; one named ``out`` is replaced.
    Texts of any length are encoded whole.
    """
    source = _shared(df.sparkSession, folder, name)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        built = automaton(source.value)
        return pa.array((built.encode(t) for t in texts.to_pylist()), type=pa.list_(pa.int32()), size=len(texts))

    return df.withColumn(out, encode(_text(df, text)))


def token_count(df: DataFrame, text: str, out: str = "n_tokens", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """Adds the number of tokens of a text column; 0 for null and empty texts."""
    source = _shared(df.sparkSession, folder, name)

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        built = automaton(source.value)
        return pa.array((len(built.encode(t)) for t in texts.to_pylist()), type=pa.int32(), size=len(texts))

    return df.withColumn(out, count(_text(df, text)))


def token_text(df: DataFrame, ids: str, out: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """Adds the text of a column of token ids; null stays null, an empty list gives an empty text."""
    source = _shared(df.sparkSession, folder, name)

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        built = automaton(source.value)
        return pa.array((None if x is None else built.decode(x) for x in lists.to_pylist()), type=pa.string(), size=len(lists))

    return df.withColumn(out, decode(df[ids]))


def _text(df: DataFrame, name: str) -> Column:
    return df[name].cast("string")
