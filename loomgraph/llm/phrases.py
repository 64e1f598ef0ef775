"""Phrase collocation mining.

1. Sketches: each shard of texts hashes its words and pairs of neighbours into cells; the cells' counts are
   added up in Spark, block by block, and what remains is a bit for each cell whose count reaches the
   threshold. A cell's count is an upper bound for all that fall into it. A second sketch does the same for
   longer phrases, of which it takes those whose words and pairs all have their bit.
2. Candidates: in each shard, phrases that have their bit, as have all their parts. A phrase occurs no more
   often than its rarest part, so no phrase that is frequent enough is missing; what gets in besides is
   counted too and falls to the threshold.
3. Counts: a shard's candidates compile into an Aho-Corasick automaton, each guarded by delimiters on both
   sides, which scans the shard's own text for all overlapping occurrences. An automaton holds phrases of
   its shard only, so its size is bounded by the shard's and nothing but the bits is broadcast.
4. Spark adds the counts of all shards up, and applies the threshold.

A text belongs to one task as it comes; longer ones are cut between pieces, so memory is bounded by a shard
and the longest piece.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import written

#: A-Z to lower case, tabs to spaces, and what ends a piece to line feeds, in UTF-8.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
BLOCK = 1 << 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Settings:
    least: int = 30
    longest: int = 4
    top: int = 2000
    scale: int = 2_000_000
    inside_percent: int = 80
    #: Cells of a sketch. The bits, an eighth of it in bytes, are broadcast: twice 16 MB. Fewer cells let more phrases be counted in vain.
    cells: int = 1 << 27
    #: Bytes of text that a shard holds.
    shard: int = 4 << 20
    #: Phrases in an automaton, which takes up to some hundred bytes for each.
    automaton: int = 200_000


def shards(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[dict[str, bytes]]:
    """Texts by language, put together to at most `most` bytes unless a single piece is longer. Columns: lang, text."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            raw = text.as_py().translate(PLAIN)
            while raw:
                end = len(raw)
                if size + end > most:
                    end = raw.rfind(b"\n", 0, max(most - size, 1)) + 1
                    if not end and not size:
                        end = raw.find(b"\n") + 1 or len(raw)
                if end:
                    held.setdefault(lang, []).append(raw[:end])
                    size += end
                if end < len(raw) or size >= most:
                    yield {k: b"\n".join(v) for k, v in held.items()}
                    held, size = {}, 0
                raw = raw[end:]
    if held:
        yield {k: b"\n".join(v) for k, v in held.items()}


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


class Shard:
    """The words of one language's texts of a shard, as numbers; pieces are apart by number 0."""

    def __init__(self, lang: str, raw: bytes):
        numbers = _Numbers({"\n": 0})
        self.tokens = list(filter(None, raw.decode().replace("\n", " \n ").split(" ")))
        self.ids = np.fromiter(map(numbers.__getitem__, self.tokens), np.int64, len(self.tokens))
        self.words = list(numbers)
        seed = xxhash.xxh64_intdigest(lang)
        of = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        self.hashes = of[self.ids]
        self.real = self.ids > 0
        self.pair = self.real[:-1] & self.real[1:]

    def cells(self, size: int, cells: int) -> np.ndarray:
        """The cell of the phrase of `size` words at each place."""
        key = self.hashes
        for i in range(1, size):
            key = _mixed(key[:-1] * _B + (self.hashes[i:] ^ _A))
        return (_mixed(key) % np.uint64(cells)).astype(np.int64)

    def places(self, bits: np.ndarray, cells: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each size from 2 on, the places of the phrases whose words and pairs all have their bit."""
        word = _set(bits, self.cells(1, cells)) & self.real
        pair = self.pair & word[:-1] & word[1:]
        some = np.flatnonzero(pair)
        pair[some] = _set(bits, self.cells(2, cells)[some])
        ok = pair
        for size in range(2, longest + 1):
            yield size, np.flatnonzero(ok)
            ok = ok[:-1] & pair[size - 1 :] if len(ok) else ok


def _set(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 > 0


def _sketched(docs: DataFrame, s: Settings, short) -> DataFrame:
    """block, at (positions in the block, two bytes each) and n (a byte each for the first ones, of which there are several) of each shard.

    Without the bits of the short ones (words and pairs), of those, else of the longer phrases that they allow.
    Counts go up to the threshold.
    """
    most = min(s.least, 255)

    def sketch(batches):
        for shard in shards(batches, s.shard):
            cells = [np.zeros(0, np.int64)]
            for lang, raw in shard.items():
                own = Shard(lang, raw)
                if short is None:
                    cells += [own.cells(1, s.cells)[own.real], own.cells(2, s.cells)[own.pair]]
                else:
                    cells += [own.cells(size, s.cells)[at] for size, at in own.places(short.value, s.cells, s.longest) if size > 2 and len(at)]
            at, n = np.unique(np.concatenate(cells), return_counts=True)
            if not len(at):
                continue
            n = np.minimum(n, most).astype(np.uint8)
            order = np.lexsort((n == 1, at // BLOCK))
            at, n = at[order], n[order]
            blocks, starts = np.unique(at // BLOCK, return_index=True)
            ends, several = np.append(starts[1:], len(at)), np.concatenate([[0], np.cumsum(n > 1)])
            low = (at % BLOCK).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(blocks.astype(np.int32)),
                    pa.array([low[i:j].tobytes() for i, j in zip(starts, ends, strict=True)]),
                    pa.array([n[i : i + several[j] - several[i]].tobytes() for i, j in zip(starts, ends, strict=True)]),
                ],
                ["block", "at", "n"],
            )

    return docs.mapInArrow(sketch, "block int, at binary, n binary")


def _bits(docs: DataFrame, s: Settings, short=None) -> np.ndarray:
    """One bit a cell: whether its count, over all shards, reaches the threshold (255 at most, as counts are kept in bytes)."""
    least = min(s.least, 255)

    def added(batches):
        block, sums = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()])], ["block", "bits"])

        for batch in batches:
            for b, at, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if b != block:
                    if block is not None:
                        yield done()
                    block, sums = b, np.zeros(BLOCK, np.int64)
                places, several = np.frombuffer(at.as_py(), "<u2"), np.frombuffer(n.as_py(), np.uint8)
                sums[places[: len(several)]] += several
                sums[places[len(several) :]] += 1
        if block is not None:
            yield done()

    rows = _sketched(docs, s, short).repartition("block").sortWithinPartitions("block").mapInArrow(added, "block int, bits binary")
    out = np.zeros(s.cells // 8, np.uint8)
    for r in rows.collect():  # cells / 8 bytes
        out[r["block"] * (BLOCK // 8) : (r["block"] + 1) * (BLOCK // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def candidates(own: Shard, short: np.ndarray, long: np.ndarray, cells: int, longest: int) -> list[str]:
    """The different phrases of 2 to `longest` words of a shard that have their bit, as have all their parts."""
    #: key: a number for the phrase of `size` words at each place; equal phrases have equal numbers, without hashes.
    out, key, ok = [], own.ids, np.ones(len(own.ids), bool)
    for size, at in own.places(short, cells, longest):
        at = at[ok[at] & ok[at + 1]]
        if size > 2:
            at = at[_set(long, own.cells(size, cells)[at])]
        if not len(at):
            break
        _, first, back = np.unique((key[at] << 32) | own.ids[at + size - 1], return_index=True, return_inverse=True)
        out += [" ".join(own.tokens[i : i + size]) for i in at[first].tolist()]
        key, ok = np.zeros(len(own.ids), np.int64), np.zeros(len(own.ids), bool)
        key[at], ok[at] = back, True
    return out


def overlapping(tokens: list[str], phrases: list[str], most: int) -> np.ndarray:
    """How often each phrase occurs in the tokens, overlaps included. Each is guarded by a space on both sides.

    An automaton holds `most` phrases; with more, the text is scanned several times.
    """
    text, out = f" {' '.join(tokens)} ", np.zeros(len(phrases), np.int64)
    for at in range(0, len(phrases), most):
        some = phrases[at : at + most]
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, p in enumerate(some):
            machine.add_word(f" {p} ", i)
        machine.make_automaton()
        out[at : at + most] = np.bincount(np.fromiter(map(itemgetter(1), machine.iter(text)), np.int64), minlength=len(some))
    return out


def _counted(docs: DataFrame, s: Settings) -> DataFrame:
    """lang, size, phrase, n of each shard: its candidates, its words that have their bit, and all of its words as size 0."""
    context = docs.sparkSession.sparkContext
    short = context.broadcast(_bits(docs, s))
    long = context.broadcast(_bits(docs, s, short)) if s.longest > 2 else short

    def count(batches):
        for shard in shards(batches, s.shard):
            for lang, raw in shard.items():
                own = Shard(lang, raw)
                found = candidates(own, short.value, long.value, s.cells, s.longest)
                n = overlapping(own.tokens, found, s.automaton) if found else np.zeros(0, np.int64)
                words = np.bincount(own.ids, minlength=len(own.words))
                some = np.unique(own.ids[_set(short.value, own.cells(1, s.cells)) & own.real])
                names = [*found, *(own.words[i] for i in some.tolist()), ""]
                sizes = [*(p.count(" ") + 1 for p in found), *[1] * len(some), 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(names)), pa.array(sizes, pa.int32()), pa.array(names), pa.array(np.concatenate([n, words[some], [words[1:].sum()]]).astype(np.int64))],
                    ["lang", "size", "phrase", "n"],
                )

    return docs.mapInArrow(count, "lang string, size int, phrase string, n long")


def phrase_counts(docs: DataFrame, settings: Settings = Settings(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, size, phrase, n: exact counts of words (size 1) and phrases that occur at least `least` times, and of all words (size 0)."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sums = _counted(rows, settings).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return sums.filter((F.col("size") == 0) | (F.col("n") >= settings.least))


def collocations(docs: DataFrame, settings: Settings = Settings(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases.

    Texts are lower-cased (A-Z), cut into pieces at [.,;:!?\\x0A-\\x0D] and those into words [^\\x20\\x09]+. Phrases
    of 2 to `longest` words that occur at least `least` times within pieces are candidates; a candidate cut behind
    its first k words scores floor(scale * a / (l + r)), where a, l and r count it and its two parts; the lowest
    score counts, of equal ones that with the smallest k. Candidates whose words lie contiguously in a longer one
    that occurs at least `inside_percent` percent as often are dropped. Of the rest, the first `top` of each language
    by score, a and phrase (bytes) remain.

    Edge cases: a null language is 'und'; null and empty texts have no words; repeated rows count as often as they
    come; ids and other columns aren't looked at; an empty table gives no rows.
    """
    s = settings
    counts = written(phrase_counts(docs, s, lang_col, text_col), "phrases")
    words = F.split("phrase", " ")
    part = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    found = counts.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"first": part(F.lit(1), F.col("k")), "second": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    of = counts.filter("size > 0").select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of"), F.col("n").alias("times"))
    for name, column in (("first", "l"), ("second", "r")):
        cuts = cuts.join(of.withColumnRenamed("times", column), (F.col("lang") == F.col("of_lang")) & (F.col(name) == F.col("of"))).drop("of_lang", "of")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumns({"up": F.lit(s.scale) * F.col("a").cast("decimal(28,0)"), "down": wide("l") + wide("r")}).withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("b")).select("lang", "phrase", "b.*")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: part(i, n))))
    longer = found.filter("size > 2").select("lang", F.col("a").alias("of_longer"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("of_longer").alias("of_longer"))
    percent = F.lit(100).cast("decimal(10,0)") * F.col("of_longer").cast("decimal(28,0)") >= F.lit(s.inside_percent).cast("decimal(10,0)") * F.col("a").cast("decimal(28,0)")
    left = best.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(percent, F.lit(False)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # First within parts of a language, so that no task has to put a whole language in order.
    left = left.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= s.top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= s.top)
    total = counts.filter("size = 0").select("lang", "n")
    return left.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
