"""MinHash near-dedup through a multi-index Hamming join, with every link confirmed on full sets.

A document's set of word shingles gives a signature of chunks x slots values of 16 bits. By the
pigeonhole principle two signatures that differ in fewer than chunks x (errors + 1) slots have a chunk
with at most `errors` differing slots; enumerating which slots those are gives the keys under which such
signatures certainly meet. Documents with equal sets are one node. Under each key the nodes are paired
with the key's smallest node first, in rows that grow with the nodes and not with their pairs; pairs with
close signatures are confirmed on full sets. Keys whose nodes are all joined by that have nothing left to
find. Of the other keys, nodes with close signatures that aren't joined yet are connected; what that connects
is a candidate part, and any two nodes that share a key and have close signatures are in one. Parts are gone through block by block: of the pairs with close signatures those are confirmed
that join what isn't joined yet, so a block gives fewer links than it has nodes, however many pairs are
similar.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import written
from loomgraph.llm.components import components


#: Bytes that an id, a number and a hash take in a broadcast table.
ROW = 128


@dataclass(frozen=True)
class Settings:
    """words: of a shingle; percent: least 100 x shared / joint shingles of a link.

    chunks, slots and errors shape the index: a link of exactly 80 percent is missed with a probability
    of about 1e-7. far: signatures that differ in more slots aren't compared on full sets; a link has
    so many with a probability of about 1e-8. block and block_bytes bound the nodes of one part, and the
    bytes of their sets, in one comparison, which takes two blocks; a part of n nodes is dealt out
    n / block times. few_bytes: what may be broadcast of ids to fetch texts, at ROW bytes each and only where
    ids are numbers, which have a fixed size; beyond it texts are joined.
    """

    words: int = 5
    percent: int = 80
    chunks: int = 12
    slots: int = 5
    errors: int = 1
    far: int = 30
    block: int = 512
    block_bytes: int = 32_000_000
    few_bytes: int = 64_000_000


class _Hashes(dict):
    """Word to 64-bit hash, remembered for the frequent ones."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 300_000:
            self.clear()
        if len(word) <= 40:
            self[word] = h
        return h


_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(raw: bytes, words: int, hashes: dict[bytes, int]) -> np.ndarray:
    """The distinct shingles of a UTF-8 text as sorted 64-bit hashes; A-Z count as a-z."""
    found = raw.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    x = _mixed(h[: len(h) - n + 1] + np.uint64(n))
    for k in range(1, n):
        x = _mixed(x * _A + h[k : len(h) - n + 1 + k])
    return np.unique(x)


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * _A)
    return x[:n], x[n:] | np.uint64(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """A row of n values of 16 bits for each of the sets, none of which may be empty."""
    out = np.zeros((len(sets), n), np.uint16)
    if sets:
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        for j, (b, a) in enumerate(zip(*_constants(n))):
            out[:, j] = _mixed(np.minimum.reduceat((flat ^ b) * a, starts)) >> np.uint64(48)
    return out


def index_keys(sig: np.ndarray, s: Settings) -> np.ndarray:
    """For each signature the keys of all chunks, each without every choice of `errors` slots."""
    out = []
    for c in range(s.chunks):
        part = sig[:, c * s.slots : (c + 1) * s.slots].astype(np.uint64)
        for k, left in enumerate(combinations(range(s.slots), s.slots - s.errors)):
            x = np.full(len(sig), c * 1000 + k + 1, np.uint64)
            for i in left:
                x = _mixed(x * _A + part[:, i])
            out.append(x)
    return np.stack(out, axis=1).view(np.int64)


def raw_of(text: str):
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def mark_of(text: str):
    """128 bits of hash that tell apart the texts of rows that repeat an id."""
    return F.unhex(F.md5(raw_of(text)))


def _signed(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, mark (the text's hash), n_shingles, digest of the set and signature of each row."""

    def run(batches):
        hashes = _Hashes()
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                n = held = 0
                sets = []
                while at + n < whole.num_rows and n < 1000 and held < 4_000_000:
                    raw = whole.column(2)[at + n].as_py() or b""
                    sets.append(shingle_set(raw, s.words, hashes))
                    held, n = held + len(raw), n + 1
                full = [i for i, x in enumerate(sets) if len(x)]
                sig = dict(zip(full, signatures([sets[i] for i in full], s.chunks * s.slots)))
                cols = (
                    whole.column(0).slice(at, n),
                    whole.column(1).slice(at, n),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array((xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets), pa.binary()),
                    pa.array((sig[i].tobytes() if i in sig else None for i in range(n)), pa.binary()),
                )
                at += n
                yield pa.RecordBatch.from_arrays(list(cols), ["doc_id", "mark", "n_shingles", "digest", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", mark_of("text").alias("mark"), raw_of("text").alias("raw"))
    return rows.mapInArrow(run, f"doc_id {kind}, mark binary, n_shingles long, digest binary, sig binary")


def _keyed(nodes: DataFrame, s: Settings) -> DataFrame:
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                keys = index_keys(sig, s)
                each = np.repeat(np.arange(batch.num_rows), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), batch.column(0).take(pa.array(each))], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """node and set (its sorted hashes) of the nodes in wanted (distinct and written).

    Up to `few` ids are broadcast and only their texts move; more are met by a shuffle of both sides.
    """

    def run(batches):
        hashes = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [shingle_set(raw.as_py() or b"", s.words, hashes).tobytes() for raw in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "set"])

    own = nodes.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
    fixed = own.schema["__id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    own = F.broadcast(own) if fixed and wanted.count() * ROW <= s.few_bytes else own
    rows = docs.select("doc_id", mark_of("text").alias("mark"), raw_of("text").alias("raw"))
    rows = rows.join(own, (F.col("doc_id") == F.col("__id")) & (F.col("mark") == F.col("__mark"))).select("node", "raw")
    return rows.dropDuplicates(["node"]).mapInArrow(run, "node long, set binary")


def _close(pairs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most s.far slots."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x != y).sum(axis=1) <= s.far))

    first, second = (nodes.select(F.col("node").alias(k), F.col("sig").alias(f"sig_{k}")) for k in "ab")
    return pairs.join(second, "b").join(first, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, s: Settings) -> bool:
    n = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * n >= s.percent * (len(x) + len(y) - n)


def _packed(rows: DataFrame, key: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """rows (key, node, set) with pack, blocks and own; and the keys (of) with their blocks.

    A key with too many nodes or bytes for a block is a pack of its own and has several blocks, of which
    own is the node's; small ones are packed together.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("set")), F.lit(0)).alias("bytes")).first()
    packs = max(1, total["n"] // s.block, total["bytes"] // s.block_bytes)
    sizes = rows.groupBy(F.col(key).alias("of")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("set")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(s.block)), F.ceil(F.col("bytes") / F.lit(s.block_bytes))).cast("int")
    pack = F.when(F.col("blocks") > 1, F.xxhash64("of", F.lit(2))).otherwise(F.pmod(F.xxhash64("of", F.lit(3)), F.lit(packs)))
    sizes = sizes.select("of", blocks.alias("blocks")).withColumn("pack", pack)
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    return rows.join(sizes, F.col(key) == F.col("of")).withColumn("own", own).drop("of"), sizes


def _stars(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that are linked. The set of a goes to each block of its partners."""
    rows, sizes = _packed(pairs.join(sets, F.col("b") == F.col("node")).select("a", "node", "set"), "a", s)
    hubs = sizes.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sets, F.col("of") == F.col("node"))
    both = rows.select("pack", "own", "a", "node", "set").union(hubs.select("pack", "own", F.col("of"), "node", "set"))

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        found = []
        for a, own in t.groupby("a"):
            node, sets = own["node"].tolist(), [np.frombuffer(x, np.uint64) for x in own["set"]]
            hub = sets[node.index(a)]
            found += [(a, b) for b, x in zip(node, sets) if b != a and _linked(hub, x, s)]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return both.groupBy("pack", "own").applyInPandas(compare, "a long, b long")


def links_of(sets: list[np.ndarray], sig: np.ndarray, part: np.ndarray, own: np.ndarray | None, label: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """Pairs of rows that join all rows of a part that links among them join; no more than rows.

    The closest signatures come first, and rows that are joined already, by equal labels or by a link
    found here, aren't compared. Where many comparisons fail, all shared counts are taken at once, as a
    product of incidence matrices. own: the block of each row, if only pairs across the two count.
    """
    n = len(sets)
    far = np.zeros((n, n), np.uint8)
    for column in sig.T:
        far += column[:, None] != column[None, :]
    ok = np.triu((far <= s.far) & (part[:, None] == part[None, :]) & (label[:, None] != label[None, :]), 1)
    if own is not None:
        ok &= own[:, None] != own[None, :]
    left, right = np.nonzero(ok)
    order = np.argsort(far[left, right], kind="stable")
    firsts, back = np.unique(label, return_index=True, return_inverse=True)[1:]
    group, sizes, out, failed, shared = firsts[back].tolist(), [len(x) for x in sets], [], 0, None

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i, j in zip(left[order].tolist(), right[order].tolist()):
        a, b = root(i), root(j)
        if a == b:
            continue
        if shared is None and failed > 2000:
            shared = shared_counts(sets)
        n = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) if shared is None else int(shared[i, j])
        if 100 * n >= s.percent * (sizes[i] + sizes[j] - n):
            group[max(a, b)] = min(a, b)
            out.append((i, j))
        else:
            failed += 1
    return out


def shared_counts(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """How many elements each two sets share, from dense products over some columns at a time."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, many = np.unique(flat, return_inverse=True, return_counts=True)
    common = many > 1
    place = np.cumsum(common) - 1
    row, column = row[common[column]], place[column[common[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(common.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        out += dense @ dense.T
    return out


def spanned(ok: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join what the symmetric matrix ok joins, fewer than it has rows."""
    left, out = ok.any(axis=1), []
    while left.any():
        root = int(left.argmax())
        left[root], front = False, np.array([root])
        while len(front):
            front = np.nonzero(ok[front].any(axis=0) & left)[0]
            left[front] = False
            out += [(root, i) for i in front.tolist()]
    return out


def _closest(rows: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) that join those nodes of a key (rows: key, node, label) that have close signatures and different labels.

    Only signatures move, and a key larger than a block is gone through block by block. Keys alone would join
    more and more unlike nodes as documents grow, and with them the sets that confirmed() deals out.
    """
    packed, _ = _packed(rows.join(nodes.select("node", F.col("sig").alias("set")), "node"), "key", s)
    dealt = packed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("pack", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "own", "key", "node", "label", F.col("set").alias("sig"))

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        t, across = t.sort_values("key", kind="stable"), t["x"].iloc[0] != t["y"].iloc[0]
        sig = np.frombuffer(b"".join(t["sig"]), np.uint16).reshape(len(t), -1)
        key, node, label, own = (t[c].to_numpy() for c in ("key", "node", "label", "own"))
        _, begin, many = np.unique(key, return_index=True, return_counts=True)
        few, found = np.repeat(many <= 64, many), []
        for d in range(1, 64):  # small keys: all rows with the d-th behind them at once
            i = np.nonzero(few[:-d] & (key[:-d] == key[d:]))[0]
            if not len(i):
                break
            i = i[(label[i] != label[i + d]) & (own[i] != own[i + d] if across else True)]
            i = i[(sig[i] != sig[i + d]).sum(axis=1) <= s.far]
            found += zip(node[i].tolist(), node[i + d].tolist())
        for at, n in zip(begin[many > 64].tolist(), many[many > 64].tolist()):
            here = slice(at, at + n)
            far = np.zeros((n, n), np.uint8)
            for column in sig[here].T:
                far += column[:, None] != column[None, :]
            ok = (far <= s.far) & (label[here, None] != label[None, here])
            if across:
                ok &= own[here, None] != own[None, here]
            found += [(node[at + i], node[at + j]) for i, j in spanned(ok)]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("pack", "x", "y").applyInPandas(compare, "a long, b long").distinct()


def confirmed(candidates: DataFrame, nodes: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) on full sets that join what all links within each part of candidates (node, part, label) join.

    Nodes with equal labels are joined already. Small parts are packed together; a part larger than a
    block is split, and each two of its blocks meet.
    """
    rows, _ = _packed(candidates.join(sets, "node").join(nodes.select("node", "sig"), "node"), "part", s)
    dealt = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("pack", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "own", "node", "part", "label", "sig", "set")

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in t["set"]]
        sig = np.frombuffer(b"".join(t["sig"]), np.uint16).reshape(len(t), -1)
        across = t["own"].to_numpy() if t["x"].iloc[0] != t["y"].iloc[0] else None
        node = t["node"].to_numpy()
        found = [(node[i], node[j]) for i, j in links_of(sets, sig, t["part"].to_numpy(), across, t["label"].to_numpy(), s)]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("pack", "x", "y").applyInPandas(compare, "a long, b long")


def _grouped(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, mark, n_shingles, component_id and group of each row of docs.

    group is a number that all rows of a component share and no others; null where nothing can be linked.
    """
    signed = written(_signed(docs, s), "near-signed")
    first = F.min(F.struct("doc_id", "mark")).alias("first")
    nodes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(first, F.first("sig").alias("sig"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "sig", "first.doc_id", "first.mark"), "near-nodes")
    keyed = _keyed(nodes, s)
    firsts = keyed.groupBy(F.col("key").alias("of")).agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    shared = written(keyed.join(firsts, F.col("key") == F.col("of")).select("key", "node", "first"), "near-shared")
    sets = written(_sets(docs, nodes, written(shared.select("node").distinct(), "near-wanted"), s), "near-sets")
    pairs = written(_close(shared.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), nodes, s), "near-pairs")
    links = written(_stars(pairs, sets, s), "near-stars")
    # nodes with one label are linked with one node, so a key whose nodes all have it can't join anything
    joined = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("hub"))
    # all pairs with a key's first node are settled by that
    labelled = shared.filter("node <> first").join(joined, "node", "left").select("key", "node", F.coalesce("hub", "node").alias("label"))
    sums = (F.sum(F.xxhash64("node", F.lit(i)) % (1 << 40)).alias(f"h{i}") for i in range(3))
    open_ = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n"), *sums).filter("least <> most")
    once = open_.groupBy("n", "h0", "h1", "h2").agg(F.min("key").alias("of")).select("of")  # keys of the same nodes, as a family has, are gone through once
    left = written(labelled.join(once, F.col("key") == F.col("of"), "left_semi").select("key", "node", "label"), "near-open")
    more = None
    if not left.isEmpty():
        near = components(written(_closest(left, nodes, s), "near-closest"))
        candidates = left.select("node", "label").distinct().join(near, "node")
        more = written(confirmed(written(candidates, "near-candidates"), nodes, sets, s), "near-links")
    parts = components(links.union(more) if more else links)
    least = parts.join(nodes.select("node", "doc_id"), "node").groupBy(F.col("part").alias("of")).agg(F.min("doc_id").alias("least"))
    named = parts.join(least, F.col("part") == F.col("of")).select("node", "part", "least")
    of_set = nodes.join(named, "node", "left").select(F.col("digest").alias("of"), F.coalesce("least", "doc_id").alias("least"), F.coalesce("part", "node").alias("group"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return signed.join(of_set, F.col("digest") == F.col("of"), "left").select("doc_id", "mark", "n_shingles", own.alias("component_id"), "group")


def near_groups(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (columns doc_id and text).

    A document's set has its distinct shingles of s.words words (runs of other than white space, A-Z as
    a-z); a shorter text is one shingle as a whole; a text without words has none and is linked with
    nothing. Two documents are linked if 100 x shared >= s.percent x joint shingles. component_id is the
    smallest doc_id that links lead to, the document's own included; kept tells whether it is its own.

    Edge cases: null texts are empty; a row with a null id is linked with nothing, has no component and
    is kept; repeated rows repeat; rows that repeat an id with another text are documents of their own,
    each with the component of its own text; an empty table gives no rows. Ties can't occur: ids decide.
    Very long texts are compared as a whole. Other columns aren't looked at.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return _grouped(docs, s).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def without_near_copies(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with the document of each group that has the smallest id, all its columns kept.

    Of rows that repeat that id within a group, the one with the smallest hash of its text stays, and of
    rows that repeat id and text any one. All rows with a null id or without words stay.
    """
    rows = written(_grouped(docs.select("doc_id", "text"), s), "near-grouped")
    gone = rows.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__of")).distinct()
    again = rows.filter("doc_id = component_id AND group IS NOT NULL").groupBy("doc_id", "group").agg(F.min("mark").alias("__of"), F.count(F.lit(1)).alias("__n"))
    again = written(again.filter("__n > 1").drop("__n").withColumnRenamed("doc_id", "__again"), "near-again")
    marked = docs.withColumn("__mark", mark_of("text"))
    left = marked.join(gone, (F.col("doc_id") == F.col("__gone")) & (F.col("__mark") == F.col("__of")), "left_anti")
    if not again.isEmpty():
        members = rows.join(again, (F.col("doc_id") == F.col("__again")) & rows["group"].eqNullSafe(again["group"]))
        members = members.select("__again", F.col("mark").alias("__mark_of"), (F.col("mark") == F.col("__of")).alias("__stays")).distinct()
        both = left.join(members, (F.col("doc_id") == F.col("__again")) & (F.col("__mark") == F.col("__mark_of")), "left")
        one = both.filter("__stays").dropDuplicates(["doc_id", "__mark"])
        left = both.filter("__again IS NULL").union(one)
    return left.select(*docs.columns)
