"""BPE encoding and decoding with a tokenization automaton.

The merge list is compiled into a deterministic automaton over tokens that
accepts, for every string of base symbols, exactly the token sequence that
the merges give.  It starts as one state that every base symbol leads back
to, and each merge (a, b), in order, adds its gadget:

* every state with an arc a whose target has an arc b gets an arc ab to the
  target of that b;
* all arcs a are redirected to a copy of their target without the arc b.

So a state is fully given by the state it was copied from, the arc it lost
and the merge that made it, and all arcs of one token lead to one state.
The arc lists hold just that (one entry per merge), and an arc is looked up
by following copies back and gadgets down.

Words are encoded by a transition table over base symbols, which is the
automaton made deterministic with delayed output.  A row stands for all that
a prefix leaves open: the last token of the prefix's own path, and each
(state, part of a label) from which a longer arc may still end.  A prefix of
a path is the path of its string, so exactly one open label ends in an arc
at every symbol, and the row names it.  A word is one look-up per symbol; its
tokens are read back from the last row by their widths.  Rows are compiled
when a word first needs them, equal ones once, and at most TABLE_ROWS are
held (beyond that the table starts anew; results do not depend on it).
Decoding emits the labels of the arcs.

Text is prepared as the vocabulary file says: NFC, runs of white space to one
blank, lower case per character, split by its pattern, bytes as printable
symbols, end mark on a word's last symbol; added tokens found in a text are
tokens of their own.

Defined results: a null text is the empty text (no tokens, empty decoding);
every row is encoded by itself, so ties, repeats and other columns play no
part; very long texts and words need memory in proportion to their length.
"""
from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_right
from itertools import chain
from typing import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import table

WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CACHE_WORDS = 200_000
TABLE_ROWS = 150_000    # checked between words
BITS = 9                # base symbols: bytes, and bytes at a word's end


class MergeAutomaton:
    """States are numbered by the merge that made them (from 1); 0 is the start."""

    def __init__(self, symbols: list[str], merges: list[tuple[str, str]]):
        self.label = list(symbols)
        token = {s: i for i, s in enumerate(symbols)}
        n = len(symbols)
        self.left, self.born, self.live = [-1] * n, [0] * n, [True] * n
        self.after = [0] * n        # state that all arcs of a token lead to
        self.root = [0] * n         # ... before the first copy was made for it
        self.copies: list[list[int]] = [[] for _ in range(n)]  # states made by its merges
        self.owner = [-1]           # token whose arcs were redirected to a state
        self.lost: dict[tuple[int, int], int] = {}             # (owner, arc) -> state without it
        for k, (a, b) in enumerate(merges, 1):
            x, y = token[a], token[b]
            target = self.after[y]
            live = self.has_arc(self.after[x], y)
            t = token[a + b] = len(self.label)
            self.label.append(a + b)
            self.left.append(x)
            self.born.append(k)
            self.live.append(live)
            self.after.append(target)
            self.root.append(target)
            self.copies.append([])
            self.owner.append(x)
            if live:
                self.lost[x, y] = k
                self.copies[x].append(k)
                self.after[x] = k
        self.token = token
        spelled: list[tuple[int, ...]] = [(i,) for i in range(n)]
        for a, b in merges:
            spelled.append(spelled[token[a]] + spelled[token[b]])
        self.width = [len(parts) for parts in spelled]
        self.child: dict[int, int] = {}     # (label's part, base symbol) -> longer part
        self.whole = [-1]                   # token whose label the part is
        self.more = [True]                  # whether a longer part exists
        for t, parts in enumerate(spelled):
            node = 0
            for s in parts:
                key = node << BITS | s
                self.more[node] = True
                node = self.child.get(key, -1)
                if node < 0:
                    node = self.child[key] = len(self.whole)
                    self.whole.append(-1)
                    self.more.append(False)
            self.whole[node] = t
        self.clear()

    def clear(self) -> None:
        """Forget the compiled rows but the start."""
        self.rows: dict[tuple, int] = {}
        self.next: dict[int, int] = {}      # (row, base symbol) -> row
        self.last, self.open = [-1], [(0, 0)]

    def has_arc(self, state: int, t: int) -> bool:
        """Whether the state has an arc of the token."""
        while state:
            if self.born[t] >= state:       # the token is newer: its gadget needed the left arc
                if not self.live[t]:
                    return False
                t = self.left[t]
                continue
            x = self.owner[state]           # the state is newer: a copy that lost one arc
            if self.lost.get((x, t), state + 1) <= state:
                return False
            older = self.copies[x]
            at = bisect_right(older, self.born[t])
            state = older[at - 1] if at else self.root[x]
        while self.left[t] >= 0:
            if not self.live[t]:
                return False
            t = self.left[t]
        return True

    def compile(self, row: int, symbol: int) -> int:
        """Add the transition of a row under a base symbol, with its target row if new."""
        last, still, pairs = -1, [], iter(self.open[row])
        for state, node in zip(pairs, pairs):   # the longest open label first
            node = self.child.get(node << BITS | symbol)
            if node is None:
                continue
            t = self.whole[node]
            if t >= 0 and last < 0 and self.has_arc(state, t):
                last = t
            if self.more[node]:
                still += state, node
        if last < 0:
            raise ValueError("a symbol outside the automaton's")
        key = (last, *still)
        found = self.rows.get(key)
        if found is None:
            found = self.rows[key] = len(self.last)
            self.last.append(last)
            self.open.append((*still, self.after[last], 0))
        self.next[row << BITS | symbol] = found
        return found

    def walk(self, symbols: Iterable[int]) -> list[int]:
        """Token numbers of one pre-split word given as numbers of base symbols."""
        if len(self.last) > TABLE_ROWS:
            self.clear()
        row, path, step, last, width = 0, [], self.next.get, self.last, self.width
        for s in symbols:
            row = step(row << BITS | s) or self.compile(row, s)
            path.append(row)
        out, at = [], len(path)
        while at:
            t = last[path[at - 1]]
            out.append(t)
            at -= width[t]
        out.reverse()
        return out

    def encode(self, symbols: list[str]) -> list[int]:
        """Token numbers of one pre-split word given as base symbols."""
        return self.walk([self.token[s] for s in symbols])


def byte_symbols() -> list[str]:
    """Printable symbol of each byte: itself where printable, else from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder for a vocabulary file with word ends."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.symbols = byte_symbols()
        base = self.symbols + [s + self.end for s in self.symbols]
        self.automaton = MergeAutomaton(base, [tuple(m) for m in model["merges"]])
        self.ids = [self.vocab[s] for s in self.automaton.label]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: s for s, i in [*self.vocab.items(), *self.added.items()]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", WHITE)).findall
        ascii_only = pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", "\\t-\\r ")
        self.ascii_words = self.words if r"\p" in ascii_only else re.compile(ascii_only).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.cache: dict[str, tuple[tuple[int, ...], str, str]] = {}

    def entry(self, ids: tuple[int, ...]) -> tuple[tuple[int, ...], str, str]:
        return ids, " ".join(map(str, ids)), self.decode(ids)

    def word(self, word: str) -> tuple[tuple[int, ...], str, str]:
        """(ids, ids as text, decoded) of a pre-split word, remembered if short."""
        raw = word.encode()
        found = self.entry(tuple([self.ids[t] for t in self.automaton.walk([*raw[:-1], 256 + raw[-1]])]))
        if len(word) <= 40:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = found
        return found

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if "\u03a3" in text:  # capital sigma: per character, without the rule for word ends
            text = text.replace("\u03a3", "\u03c3")
        return text.lower()

    def plain(self, text: str) -> list[tuple[tuple[int, ...], str, str]]:
        known, word = self.cache.get, self.word
        words = self.ascii_words(text.lower()) if text.isascii() else self.words(self.normal(text))
        return [known(w) or word(w) for w in words]

    def parts(self, text: str) -> list[tuple[tuple[int, ...], str, str]]:
        """(ids, ids as text, decoded) of each pre-split word and added token, in order."""
        if self.cut is None:
            return self.plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.plain(text[at:m.start()])
            out.append(self.entry((self.added[m[0]],)))
            at = m.end()
        return out + self.plain(text[at:]) if at else self.plain(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([p[0] for p in self.parts(text)]))

    def decode(self, ids) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """The compiled codec of a vocabulary file's text, once per Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(json.loads(spec))
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the array column ``into``; ``vocabulary`` is the path of the file.

    The driver reads the file and broadcasts its text (its size is that of the
    vocabulary, whatever the corpus)."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(shared.value)
        for batch in texts:
            yield pd.Series([own.encode(t) if t else [] for t in batch], dtype=object)

    return docs.withColumn(into, F.pandas_udf(run, "array<int>").asNondeterministic()(F.col(text_col).cast("string")))


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``tokens`` with the decoded text of the array column ``ids_col``."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(shared.value)
        for batch in batches:
            yield pd.Series([own.decode(ids.tolist()) if ids is not None else "" for ids in batch], dtype=object)

    return tokens.withColumn(into, F.pandas_udf(run, "string").asNondeterministic()(F.col(ids_col)))


def digests(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids).

    Encodes, then decodes the ids again, in one Arrow exchange.  Both work
    word by word, and a bounded cache keeps the frequent words."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(shared.value)
        for batch in texts:
            out = []
            for t in batch:
                parts = own.parts(t) if t else []
                out.append((sum([len(p[0]) for p in parts]),
                            hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest(),
                            hashlib.sha256(" ".join([p[2] for p in parts]).encode()).hexdigest(),
                            *([list(chain.from_iterable([p[0] for p in parts]))] if keep_ids else [])))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])])

    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    own = F.pandas_udf(run, kind).asNondeterministic()
    return (docs.select("doc_id", own(F.col("text").cast("string")).alias("t")).select("doc_id", "t.*"))


def op6_bpe(spark, sf_dir):
    import public_tokenizers
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
