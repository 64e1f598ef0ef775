"""SentencePiece encoding and decoding by matching all pieces against a suffix array.

The distinct words of a batch that aren't known yet are joined to one text. Its suffix array, ordered as
far as the longest piece reaches, is searched for every piece at once; the ranges found are the piece's
places. All places, sorted by position, are the edges of a lattice, and relaxing them from left to right
gives the encoding. For models of merges (BPE) an edge may follow another only if the two pieces are what
their joint string is encoded to; each prefix of a word then has one way in, the model's own encoding.
For unigram models the way with the highest sum of scores wins.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = range(6)
# Fixed values of the .model format: field numbers, and two of the model types.
TRAINER, TYPE = 2, 3
UNIGRAM, BPE = 1, 2


class Pieces:
    """A model's pieces in plain form: strings, scores and kinds by id; bpe: whether it merges.

    Models must leave texts as they are but for spaces, and may have no piece that holds a line end or
    the mark of a space behind another character; then words, with the spaces in front of them, are
    encoded independently.
    """

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], bpe: bool):
        self.pieces, self.scores, self.bpe = pieces, scores, bpe
        self.unknown = kinds.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == BYTE}
        self.normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k in (NORMAL, USER)}
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.normal):
            raise ValueError("the model has pieces across words")
        self.out = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in self.byte.items():
            self.out[i] = bytes((b,))
        for i, k in enumerate(kinds):
            if k in (CONTROL, UNKNOWN):
                self.out[i] = b" \xe2\x81\x87 " if k == UNKNOWN else b""
        usable = [p for p in self.normal if not bpe or self.merged(p) == [p]]
        self.usable = sorted(usable)
        self.lengths = np.array([len(p) for p in self.usable], np.int64)
        self.ids = np.array([self.normal[p] for p in self.usable], np.int64)
        self.weights = np.array([scores[i] for i in self.ids])
        width = -(-int(self.lengths.max(initial=1)) // 8) * 8
        self.grid = np.zeros((len(self.usable), width), np.int64)  # code points, 0 behind the end
        for row, p in zip(self.grid, self.usable):
            row[: len(p)] = [ord(c) for c in p]
        self.table = _Fits(self)

    def merged(self, text: str) -> list[str]:
        """text by merging: the neighbours whose joint string has the highest score, the leftmost of equals."""
        parts, known, scores = list(text), self.normal, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = known.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [a, b]

    def ids_of(self, piece: str) -> list[int]:
        i = self.normal.get(piece)
        if i is not None:
            return [i]
        return [self.byte[b] for b in piece.encode()] if len(self.byte) == 256 else [self.unknown]


def load_pieces(model_file: str) -> tuple[list[str], list[float], list[int], bool]:
    """Reads a .model file with the public library; what Pieces takes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    kind = lambda i: UNKNOWN if model.is_unknown(i) else CONTROL if model.is_control(i) else BYTE if model.is_byte(i) else UNUSED if model.is_unused(i) else NORMAL
    probe = "  AÉ  ﬁ ① x "
    if "".join(model.encode(probe, out_type=str)) != (SPACE + probe.replace(" ", SPACE)) and model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError("the model changes texts by more than marks for spaces")
    scores = [model.get_score(i) for i in ids]
    return [model.id_to_piece(i) for i in ids], scores, [kind(i) for i in ids], model_type(model.serialized_model_proto()) == BPE


def _messages(raw: bytes):
    """Number and value of each field of a message in the wire format of protocol buffers."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at, out, shift = at + 1, out | (byte & 0x7F) << shift, shift + 7
            if byte < 0x80:
                return out

    while at < len(raw):
        key = number()
        kind = key & 7
        size = number() if kind in (0, 2) else {1: 8, 5: 4}[kind]
        yield key >> 3, size if kind == 0 else raw[at : at + size]
        at += 0 if kind == 0 else size


def model_type(raw: bytes) -> int:
    """What the trainer's settings in a .model file call its type; those without one are unigram models."""
    trainer = next((value for field, value in _messages(raw) if field == TRAINER), b"")
    return next((value for field, value in _messages(trainer) if field == TYPE), UNIGRAM)


def _keys(codes: np.ndarray, n: int, width: int, per: int) -> list[np.ndarray]:
    """For each of n positions its next characters, per of them to a word, up to width of them."""
    ends = np.concatenate([codes, np.zeros(width + per, np.uint64)])
    packed = np.zeros(n + width, np.uint64)
    for i in range(per):
        packed |= ends[i : i + n + width] << np.uint64(64 // per * (per - 1 - i))
    return [packed[i : i + n] for i in range(0, width, per)]


def suffix_array(codes: np.ndarray, width: int, per: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the order of the width characters from there on, and those characters as sorted words."""
    keys = _keys(codes, len(codes), width, per)
    order = np.lexsort(keys[::-1])
    return order, [k[order] for k in keys]


def _bounds(rows: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """By binary search, for all of wanted at once, how many rows are smaller."""
    n = len(rows[0])
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
    for _ in range(n.bit_length()):
        mid = np.minimum((lo + hi) >> 1, n - 1)
        less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for r, w in zip(rows, wanted):
            x = r[mid]
            less |= same & (x < w)
            same &= x == w
        go = less & (lo < hi)
        hi = np.where(go | (lo >= hi), hi, mid)
        lo = np.where(go, mid + 1, lo)
    return lo


def edges(points: np.ndarray, model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Start and piece (its number in model.usable) of every occurrence in a text, given its code points."""
    alphabet = np.unique(points)
    codes = (np.searchsorted(alphabet, points) + 1).astype(np.uint64)
    width, per = model.grid.shape[1], 8 if len(alphabet) < 255 else 4 if len(alphabet) < 65_535 else 2  # characters in a word of 64 bits
    order, rows = suffix_array(codes, width, per)
    place = np.minimum(np.searchsorted(alphabet, model.grid), len(alphabet) - 1)
    there = (alphabet[place] == model.grid) | (model.grid == 0)
    which = np.flatnonzero(there.all(axis=1))
    if not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own, pad = (place[which] + 1).astype(np.uint64), model.grid[which] == 0
    low, top = (_bounds(rows, _packed(np.where(pad, np.uint64(x), own), per)) for x in (0, (1 << 64 // per) - 1))
    many = top - low
    at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return order[at], np.repeat(which, many)


def _packed(a: np.ndarray, per: int) -> list[np.ndarray]:
    out = [np.zeros(len(a), np.uint64) for _ in range(0, a.shape[1], per)]
    for i in range(a.shape[1]):
        out[i // per] |= a[:, i] << np.uint64(64 // per * (per - 1 - i % per))
    return out


class _Fits:
    """Whether a piece may follow another, for arrays of both; what was found is kept in a sorted table."""

    def __init__(self, model: Pieces, most: int = 3_000_000):
        self.model, self.most = model, most
        self.codes, self.ok = np.zeros(0, np.int64), np.zeros(0, bool)

    def __call__(self, a: np.ndarray, b: np.ndarray, name) -> np.ndarray:
        if not len(a):
            return np.zeros(0, bool)
        code = a * (1 << 32) + b
        distinct, back = np.unique(code, return_inverse=True)
        at = np.minimum(np.searchsorted(self.codes, distinct), max(0, len(self.codes) - 1))
        known = self.codes[at] == distinct if len(self.codes) else np.zeros(len(distinct), bool)
        ok = np.zeros(len(distinct), bool)
        ok[known] = self.ok[at[known]] if len(self.codes) else False
        new = np.flatnonzero(~known)
        if len(new):
            ok[new] = [self.model.follows(name(x >> 32), name(x & 0xFFFFFFFF)) for x in distinct[new].tolist()]
            if len(self.codes) > self.most:
                self.codes, self.ok = self.codes[:0], self.ok[:0]
            codes, oks = np.concatenate([self.codes, distinct[new]]), np.concatenate([self.ok, ok[new]])
            by = np.argsort(codes, kind="stable")
            self.codes, self.ok = codes[by], oks[by]
        return ok[back]


def encode_words(words: list[str], model: Pieces) -> list[bytes]:
    """The ids of each word, four bytes each. The words are matched together, as one text, and relaxed in step.

    Characters without a usable piece are edges of their own, numbered behind the pieces.
    """
    if not words:
        return []
    points = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    firsts = np.cumsum(lengths + 1) - lengths - 1
    starts, pieces = edges(points, model)
    base, count = np.repeat(firsts, lengths + 1), len(model.usable)
    inside = np.ones(len(points), bool)
    inside[firsts + lengths] = False
    inside[starts[model.lengths[pieces] == 1]] = False
    alone = np.flatnonzero(inside)
    starts, pieces = np.concatenate([starts, alone]), np.concatenate([pieces, count + points[alone]])
    ends = starts + np.where(pieces < count, model.lengths[np.minimum(pieces, count - 1)], 1)
    step = starts - base[starts]
    by = np.argsort(step, kind="stable")
    starts, pieces, ends, step = starts[by], pieces[by], ends[by], step[by]
    name = lambda k: model.usable[k] if k < count else chr(k - count)
    last = np.full(len(points) + 1, -1, np.int64)
    best = np.full(len(points) + 1, -np.inf)
    best[firsts] = 0
    cuts = np.flatnonzero(np.diff(step, prepend=-1, append=-2))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        s, p, e = starts[lo:hi], pieces[lo:hi], ends[lo:hi]
        if not model.bpe:
            value = best[s] + np.where(p < count, model.weights[np.minimum(p, count - 1)], model.weights.min() - 10)
            np.maximum.at(best, e, value)
            won = value == best[e]
            last[e[won]] = p[won]
            continue
        before = last[s]
        ok = np.full(len(s), step[lo] == 0)
        if step[lo]:
            there = np.flatnonzero(before >= 0)
            ok[there] = model.table(before[there], p[there], name)
        last[e[ok]] = p[ok]
    taken = np.zeros(len(points) + 1, bool)
    at, stop = firsts + lengths, firsts
    while len(at):
        taken[at] = True
        p = last[at]
        at = at - np.where(p < count, model.lengths[np.minimum(p, count - 1)], 1)
        at, stop = at[at > stop], stop[at > stop]
    where = np.flatnonzero(taken)
    chosen = last[where]
    plain = chosen < count
    sizes = np.ones(len(chosen), np.int64)
    spelled = {int(k): model.ids_of(name(int(k))) for k in np.unique(chosen[~plain])}
    sizes[~plain] = [len(spelled[k]) for k in chosen[~plain].tolist()]
    ids = np.zeros(int(sizes.sum()), "<u4")
    at = np.cumsum(sizes) - sizes
    ids[at[plain]] = model.ids[chosen[plain]]
    for i, k in zip(at[~plain].tolist(), chosen[~plain].tolist()):
        ids[i : i + len(spelled[k])] = spelled[k]
    tops = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(where, firsts + lengths, side="right")]
    raw, tops = ids.tobytes(), (4 * tops).tolist()
    return [raw[i:j] for i, j in zip([0, *tops], tops)]


WORDS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Encoder:
    """Encodes batches of texts; remembers the ids of up to so many words."""

    def __init__(self, model: Pieces, remembered: int = 500_000):
        self.model, self.remembered, self.known = model, remembered, {"\n": np.array(model.ids_of("\n"), "<u4").tobytes()}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, four bytes each, the lowest first."""
        split = [words_of(t) for t in texts]
        if len(self.known) > self.remembered:
            self.known = {"\n": self.known["\n"]}
        known = self.known
        new = list({w: None for words in split for w in words if w not in known})
        while new:  # in parts, so that the index stays small
            held = n = 0
            while n < len(new) and held < 600_000:
                held += len(new[n])
                n += 1
            part, new = new[:n], new[n:]
            known.update(zip(part, encode_words(part, self.model)))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in [w for words in split for w in words if len(w) > 64]:
            known.pop(w, None)
        return out


def decode(ids: list[int], model: Pieces) -> str:
    """The text of the ids: marks become spaces, but for the one in front; broken bytes become U+FFFD."""
    return b"".join(map(model.out.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=1)
def _model(key: str, value: tuple) -> Pieces:
    return Pieces(*map(list, value[:3]), value[3])


def encoded(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", batch_rows: int = 2000) -> DataFrame:
    """doc_id, ids, n_pieces, ids_sha256, decoded_sha256 and round_trip for each row of docs.

    ids are those that the public library gives for the whole text; ids_sha256 is over them in four bytes
    each, the lowest first; decoded_sha256 over the UTF-8 bytes of the text decoded from them. round_trip
    tells whether that is the text, but for U+2581, which the model itself turns into a space. The
    model file is read by the driver only; its pieces, whose number doesn't depend on the data, are
    broadcast.

    Edge cases: null and empty texts have no ids and round trip true; null ids stay null, repeated rows
    repeat; an empty table gives no rows; other columns of docs aren't looked at.
    """
    loaded = load_pieces(model_file)
    shared = docs.sparkSession.sparkContext.broadcast((*map(tuple, loaded[:3]), loaded[3]))

    def run(batches):
        model = _model(model_file, shared.value)
        encoder = Encoder(model)
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                n, held = 0, 0
                while at + n < whole.num_rows and n < batch_rows and (not n or held < 4_000_000):
                    held += len(whole.column(1)[at + n].as_buffer() or b"") if whole.column(1)[at + n].is_valid else 0
                    n += 1
                batch, at = whole.slice(at, n), at + n
                texts = batch.column(1).to_pylist()
                ids = encoder(texts)
                rows = []
                for t, raw in zip(texts, ids):
                    back = decode(np.frombuffer(raw, "<u4").tolist(), model)
                    rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (t or "").replace(SPACE, " ")))
                offsets = np.concatenate([[0], np.cumsum([r[0] for r in rows])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "ids", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
