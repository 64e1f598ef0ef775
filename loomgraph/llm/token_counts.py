"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link, to the node that the rest of its string
reaches after the longest pieces at its front are popped, and the number of pieces popped on the way.
A word is then read once from left to right: no piece is built and no character is read twice.
Words are counted once for each worker as long as a bounded memory holds them.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Hashable, Iterable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a word of a vocabulary with word ends stops.
END = 256
WORD = re.compile(r"[^\W_]+|[^\w\s]|_")


class PieceCounter:
    """Counts the pieces of greedy longest match from the left.

    initial: pieces that start a word; following: those that continue one (None: the same). Where the
    last piece reaches the end of the bytes, but no piece holds the END left behind it, the longest
    pieces that still let its bytes be covered with the END take its place. A word that the pieces can't
    cover counts as one unknown token.
    """

    def __init__(self, initial: Iterable[Sequence[Hashable]], following: Iterable[Sequence[Hashable]] | None = None):
        self.next: list[dict] = [{}]
        self.whole = whole = [False]
        self.depth = [0]
        self.closed: dict[int, int | None] = {}
        self.rest = 0 if following is None else self._root(whole)
        for root, pieces in ((0, initial), (self.rest, following or ())):
            for piece in pieces:
                node = root
                for c in piece:
                    before, node = node, self.next[node].setdefault(c, len(self.next))
                    if node == len(self.next):
                        self.next.append({})
                        whole.append(False)
                        self.depth.append(self.depth[before] + 1)
                whole[node] = node != root
        self.link: list[int | None] = [None] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque({0, self.rest})
        while queue:
            at = queue.popleft()
            for c, node in self.next[at].items():
                if whole[node]:
                    self.link[node], self.popped[node] = self.rest, 1
                else:
                    n, z = self.popped[at], self.link[at]
                    while z is not None and c not in self.next[z]:
                        n, z = n + self.popped[z], self.link[z]
                    if z is not None:
                        self.link[node], self.popped[node] = self.next[z][c], n
                queue.append(node)

    def _root(self, whole: list[bool]) -> int:
        self.next.append({})
        whole.append(False)
        self.depth.append(0)
        return 1

    def _closing(self, node: int, tail: Sequence[Hashable], starts: bool) -> int | None:
        """The pieces of the bytes of node, tail, and the END behind them; None if they can't be covered."""
        if node not in self.closed:
            symbols, need = [*tail, END], [None] * len(tail) + [None, 0]
            for i in range(len(tail), -1, -1):
                at = 0 if starts and i == 0 else self.rest
                for k in range(i, len(symbols)):
                    if (at := self.next[at].get(symbols[k])) is None:
                        break
                    if self.whole[at] and need[k + 1] is not None:
                        need[i] = need[k + 1] + 1
            self.closed[node] = need[0]
        return self.closed[node]

    def count(self, word: Sequence[Hashable]) -> int:
        node, n = 0, 0
        step, link, popped = self.next, self.link, self.popped
        for i, c in enumerate(word):
            while c not in step[node]:
                if c == END and self.whole[node]:
                    last = self._closing(node, word[i - self.depth[node] : i], self.depth[node] == i)
                    return 1 if last is None else n + last
                if link[node] is None:
                    return 1
                n += popped[node]
                node = link[node]
            node = step[node][c]
        while node not in (0, self.rest):
            if link[node] is None:
                return 1
            n += popped[node]
            node = link[node]
        return n


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def word_end_pieces(text: str) -> list[tuple[int, ...]]:
    """The pieces of a tokenizer file whose pieces are bytes with a mark where words end."""
    to_byte = byte_of_char()
    model = json.loads(text)["model"]
    mark, out = model.get("end_of_word_suffix") or "</w>", []
    for piece in model["vocab"]:
        body = piece.removesuffix(mark)
        if body and all(c in to_byte for c in body):
            out.append(tuple(to_byte[c] for c in body) + (END,) * (body != piece))
    return out


class _Words(dict):
    """Pieces of a word, counted when first asked for; emptied when full, as the frequent words come back at once."""

    def __init__(self, counter: PieceCounter, most: int):
        self.counter, self.most = counter, most

    def __missing__(self, word: str) -> int:
        n = self.counter.count((*word.encode(), END))
        if len(word) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _counter(pieces: tuple) -> PieceCounter:
    return PieceCounter(pieces)


def count_words(text: str | None, words: dict[str, int]) -> tuple[int, int]:
    found = WORD.findall((text or "").lower())
    return len(found), sum(map(words.__getitem__, found))


def with_token_counts(rows: DataFrame, tokenizer_file: str, text_col: str = "text", name: str = "n_tokens", remembered: int = 400_000) -> DataFrame:
    """rows with the number of tokens of a text column in its place; see token_counts()."""
    with open(tokenizer_file, encoding="utf-8") as f:
        pieces = rows.sparkSession.sparkContext.broadcast(tuple(word_end_pieces(f.read())))
    others = [c for c in rows.columns if c != text_col]

    def count(batches):
        words = _Words(_counter(pieces.value), remembered)
        for batch in batches:
            n = pa.array([count_words(t.as_py(), words)[1] for t in batch.column(len(others))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], n], [*others, name])

    kept = rows.select(*others, F.col(text_col).cast("string").alias(text_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(others)])
    return kept.mapInArrow(count, f"{schema}, `{name}` long" if others else f"`{name}` long")


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = 400_000) -> DataFrame:
    """doc_id, n_words and n_tokens for each row of docs, over whole texts.

    Texts are lower-cased; words are runs of letters and digits, and each other character that is no
    white space. A word is its UTF-8 bytes and a word end; its tokens are the longest pieces of the
    vocabulary from the left that let it be covered to its end. tokenizer_file is read by the driver
    only; the vocabulary is broadcast, and its size doesn't depend on the data. remembered bounds a
    worker's memory of counted words.

    Edge cases: null and empty texts have 0 words and tokens; a null id stays null; repeated rows give
    repeated rows; an empty table gives no rows; other columns of docs aren't looked at.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        pieces = docs.sparkSession.sparkContext.broadcast(tuple(word_end_pieces(f.read())))

    def count(batches):
        words = _Words(_counter(pieces.value), remembered)
        for batch in batches:
            got = [count_words(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long")
