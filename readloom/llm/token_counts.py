"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces of a word are counted in one pass over its bytes. The vocabulary is a trie with failure
links: when the next byte has no arc at a node, the pieces that the greedy rule would cut there are popped at once; how
many they are is stored with the node, so no piece is ever built. Words end in an end mark, which some pieces hold.
Each node keeps: its failure node (where matching goes on after the pops) and its popped-token count, or none if the
rule fails there, which makes the whole word one unknown token.

Defined results: null and empty texts have no tokens; repeated rows count alike; null ids are kept; extra columns are
ignored; an empty table gives no rows. A word is any run of characters that are not white space, lower-cased; its UTF-8
bytes are matched. Words beyond `longest` bytes are not treated differently.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = 256
_KEPT: dict[str, Automaton] = {}


class Automaton:
    """Trie over bytes and the end mark, with failure links and popped-token counts."""

    def __init__(self, pieces: Iterable[tuple[int, ...]], remember: int = 1_000_000):
        self.arcs: list[dict[int, int]] = [{}]
        self.is_piece = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                if symbol not in self.arcs[node]:
                    self.arcs[node][symbol] = len(self.arcs)
                    self.arcs.append({})
                    self.is_piece.append(False)
                node = self.arcs[node][symbol]
            self.is_piece[node] = node > 0
        self.fail: list[int | None] = [None] * len(self.arcs)
        self.pops = [0] * len(self.arcs)
        todo = deque([0])
        while todo:
            node = todo.popleft()
            for symbol, child in self.arcs[node].items():
                todo.append(child)
                if self.is_piece[child]:
                    self.fail[child], self.pops[child] = 0, 1  # the node's own string is the longest piece
                    continue
                at, popped = self.fail[node], self.pops[node]
                while at is not None and symbol not in self.arcs[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at is not None:
                    self.fail[child], self.pops[child] = self.arcs[at][symbol], popped
        self.remember, self.seen = remember, {}

    def count(self, symbols: Iterable[int]) -> int:
        """Tokens of one word: 1 for a word that the pieces do not cover."""
        arcs, fail, pops = self.arcs, self.fail, self.pops
        node, total = 0, 0
        for symbol in symbols:
            while symbol not in arcs[node]:
                if fail[node] is None:
                    return 1
                total += pops[node]
                node = fail[node]
            node = arcs[node][symbol]
        while node:
            if fail[node] is None:
                return 1
            total += pops[node]
            node = fail[node]
        return total

    def word(self, word: str) -> int:
        n = self.count([*word.lower().encode(), END])
        if len(self.seen) >= self.remember:
            self.seen.clear()
        if len(word) < 64:
            self.seen[word] = n
        return n

    def text(self, text: str) -> tuple[int, int, int]:
        """Words, tokens, and most tokens in one word."""
        words = text.split()
        get = self.seen.get
        counts = [get(w) or self.word(w) for w in words]
        return len(words), sum(counts), max(counts, default=0)


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary file whose word-final pieces end in </w>, as bytes and the end mark."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    out = []
    for name in names:
        body, last = (name[:-4], (END,)) if name.endswith("</w>") else (name, ())
        if body and all(c in code for c in body):
            out.append((*(code[c] for c in body), *last))
    return out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def automaton(path: str) -> Automaton:
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Automaton(vocabulary(path))
    return _KEPT[path]


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_tokens, most_in_word. Nothing is shuffled."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = automaton(path or default_vocabulary()).text
        for batch in batches:
            found = [count(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))], ["doc_id", "n_words", "n_tokens", "most_in_word"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, most_in_word long")
