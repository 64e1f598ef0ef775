"""Language identification by words first, then by ever shorter runs of characters.

A text's known words score by their frequency in each language. A word that no language knows is scored by
the longest runs of its characters that are known, from `longest` down to single ones. Words and runs are
counted over all rows that may be learnt from; the model that is broadcast holds those that occur most often,
up to a stated number of entries.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import dropped, written

#: Words are runs of letters.
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    #: Rows whose crc32(id as text) has this remainder are held out, not learnt from.
    folds: int = 4
    held_out: int = 2
    #: Characters of the longest runs; a word is put between two spaces first.
    longest: int = 5
    #: Numbers that the words, and the runs of each length, may take in the model: 8 bytes each.
    most: int = 1 << 20
    smoothing: float = 0.5
    #: What a worker remembers of words that the model doesn't know.
    remembered: int = 200_000


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    runs: list[tuple[dict[str, int], np.ndarray]] = field(default_factory=list)  # the longest first

    def backed_off(self, word: str) -> np.ndarray:
        """Mean scores of the longest known runs of a word; zeros where not even one of its characters is known."""
        text = f" {word} "
        for size, (known, scores) in zip(range(len(self.runs), 0, -1), self.runs, strict=True):
            at = [known[text[i : i + size]] for i in range(len(text) - size + 1) if text[i : i + size] in known]
            if size == 1:
                at = [known[c] for c in word if c in known]
            if at:
                return scores[at].mean(0)
        return np.zeros(len(self.langs))


def _parts(words: DataFrame, longest: int) -> DataFrame:
    """size, name, lang, n: the words as size 0, and the runs of 1 to `longest` of their characters, from 2 on with spaces around the word."""
    size, text = F.col("size"), F.when(F.col("size") > 1, F.concat(F.lit(" "), "word", F.lit(" "))).otherwise(F.col("word"))
    sized = words.withColumn("size", F.explode(F.sequence(F.lit(0), F.lit(longest)))).withColumn("text", text)
    at = F.when(size == 0, F.array(F.lit(1))).when(F.length("text") >= size, F.sequence(F.lit(1), F.length("text") - size + 1)).otherwise(F.array().cast("array<int>"))
    name = F.when(size == 0, F.col("word")).otherwise(F.substring("text", F.col("at"), size))
    return sized.withColumn("at", F.explode(at)).select("size", name.alias("name"), "lang", "n").groupBy("size", "name", "lang").agg(F.sum("n").alias("n"))


def _scores(parts: DataFrame, s: Settings, langs: list[str]) -> list[tuple[dict[str, int], np.ndarray]]:
    """For each size the names that occur most often, as rows of log frequencies by language.

    How often a name must occur is read from a histogram over eighths of octaves, so that no task puts all
    names in order; names that occur as often as the rarest that would still fit in part are left out together.
    """
    total = parts.groupBy("size", "name").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by"))
    total = total.withColumn("step", F.floor(F.log2("total") * 8).cast("int"))
    room, least, different = {}, {}, {}
    for r in sorted(total.groupBy("size", "step").count().collect(), key=lambda r: -r["step"]):
        size = r["size"]
        room[size] = room.get(size, max(s.most // max(len(langs), 1), 1)) - r["count"]
        different[size] = different.get(size, 0) + r["count"]
        if room[size] >= 0:
            least[size] = r["step"]
    of, out = {x: i for i, x in enumerate(langs)}, []
    sums = {(r["size"], r["lang"]): r["n"] for r in parts.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    for size in range(s.longest + 1):
        known = total.filter((F.col("size") == size) & (F.col("step") >= least[size])).select("name", "by").toArrow().to_pylist() if size in least else []
        counts = np.zeros((len(known), len(langs)))
        known.sort(key=lambda r: r["name"])
        for i, r in enumerate(known):
            for x in r["by"]:
                counts[i, of[x["lang"]]] = x["n"]
        norm = np.array([sums.get((size, x), 0) + s.smoothing * (different.get(size, 0) + 1) for x in langs])
        out.append(({r["name"]: i for i, r in enumerate(known)}, np.log(counts + s.smoothing) - np.log(norm)))
    return out


def fit_languages(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts words over all rows with a language that aren't held out, and runs of characters over the different words."""
    s = settings
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~_held_out(F.col(id_col), s)).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by.setdefault(lang, Counter()).update(WORD.findall(text.as_py().lower()))
            for lang, n in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "word", "n"])

    words = written(rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    parts = written(_parts(words, s.longest), "parts")
    (known, scores), *runs = _scores(parts, s, langs)
    dropped(words, parts)
    return Model(langs, known, scores, runs[::-1])


def _held_out(doc_id, s: Settings):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % s.folds == s.held_out, F.lit(False))


class _Rows(dict):
    """Rows of scores of words: those of the model, and others as they come up."""

    def __init__(self, model: Model, most: int):
        super().__init__(model.words)
        self.model, self.most, self.fixed = model, most, len(model.words)
        self.scores = np.zeros((self.fixed + most, len(model.langs)))
        self.scores[: self.fixed] = model.word_scores

    def __missing__(self, word: str) -> int:
        n = len(self)
        self.scores[n] = self.model.backed_off(word)
        self[word] = n
        return n

    def room(self, words: int) -> None:
        """Before a text of so many words: forgets the others where they might not all fit."""
        if len(self) + words > len(self.scores):
            self.clear()
            self.update(self.model.words)
            if self.fixed + words > len(self.scores):
                self.scores = np.concatenate([self.scores[: self.fixed], np.zeros((words, len(self.model.langs)))])


def predicted(text: str | None, rows: _Rows) -> tuple[str, float]:
    """The language and the share of the vote that it gets; words weigh by the root of their number, as neighbours aren't independent."""
    found = WORD.findall((text or "").lower())
    if not rows.model.langs or not any(c.isalpha() for word in found for c in word):
        return "und", 0.0
    rows.room(len(found))
    at = np.fromiter(map(rows.__getitem__, found), np.int64, len(found))
    votes = rows.scores[at].sum(0) / math.sqrt(len(found))
    best = int(votes.argmax())
    return rows.model.langs[best], float(1 / np.exp(np.maximum(votes - votes[best], -700)).sum())


def languages(docs: DataFrame, model: Model, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs, from its text alone.

    lang_pred is a language that was learnt; 'und', with a score of 0, where the text is null or has no letter, or
    nothing could be learnt. score, from 0 to 1, is the share that the language gets of all languages' votes. Words
    are runs of letters of the lower-cased text.

    Edge cases: a null id stays null and isn't held out; equal texts get equal results, repeated rows one each; of
    languages with equal votes the first by name is taken; a text of letters that were never seen gets equal votes for
    all; an empty table gives no rows. Other columns aren't looked at.
    """
    s, shared = settings, docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        rows = _Rows(shared.value, s.remembered)
        for batch in batches:
            got = [predicted(t.as_py(), rows) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), _held_out(F.col(id_col), s).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
