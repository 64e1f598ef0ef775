"""Mixing sources to target weights over a tree of domains, languages and sources.

Each leaf's tokens are counted over all documents, with whatever counts them: a tokenizer, or plain words. The budget goes down the tree by the weights; a child
that can't use its part, even with every epoch that is allowed, leaves the rest to its siblings, and what
a whole branch can't use goes to the branch's siblings. A leaf then takes whole epochs of its documents
and a prefix of one more, in an order that the seed gives for each epoch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import written

LEAF = ("domain", "lang", "source")


@dataclass(frozen=True)
class Settings:
    """weights: by path in the tree, ('web',), ('web', 'en') or ('web', 'en', 'src0'); others have weight 1.

    budget: tokens to draw, or share: of all tokens. epochs: how often a document may be drawn at most.
    buckets: parts, a power of two, into which a leaf is split to add up its tokens. few_leaves: up to so many
    leaves, budgets are worked out by the driver in exact fractions, and broadcast to the documents; with
    more, they are worked out in Spark, and documents are met by a shuffle.
    """

    weights: Mapping[tuple[str, ...], float] = field(default_factory=dict)
    budget: int | None = None
    share: float = 0.6
    epochs: int = 4
    seed: int = 17
    buckets: int = 4096
    few_leaves: int = 100_000


def filled(amount: Fraction, room: dict, weight: dict) -> dict:
    """amount split by weight, none above its room; what one leaves goes to the others by weight."""
    out, open_ = {k: Fraction(0) for k in room}, {k for k in room if room[k] > 0 and weight[k] > 0}
    left = min(amount, sum((room[k] for k in open_), Fraction(0)))
    while open_ and left > 0:
        total = sum(weight[k] for k in open_)
        full = {k for k in open_ if left * weight[k] >= (room[k] - out[k]) * total}
        if not full:
            for k in open_:
                out[k] += left * weight[k] / total
            break
        left -= sum(room[k] - out[k] for k in full)
        out |= {k: room[k] for k in full}
        open_ -= full
    return out


def budgets(tokens: Mapping[tuple[str, ...], int], s: Settings) -> dict[tuple[str, ...], int]:
    """The tokens that each leaf is to give, rounded down. A weight of 0 takes a branch out.

    In exact fractions, for up to few_leaves leaves; leaf_budgets() does the same for any number.
    """
    room = {leaf: Fraction(n * s.epochs) for leaf, n in tokens.items()}
    usable: dict[tuple[str, ...], Fraction] = {}
    children: dict[tuple[str, ...], set] = {}
    weight = lambda path: Fraction(s.weights.get(path, 1)).limit_denominator(10**9)
    for leaf, n in room.items():
        for d in range(len(leaf)):
            children.setdefault(leaf[:d], set()).add(leaf[: d + 1])

    def capacity(path: tuple[str, ...]) -> Fraction:
        got = room[path] if path in room else sum((capacity(c) for c in children[path] if weight(c) > 0), Fraction(0))
        usable[path] = got
        return got

    amount = Fraction(s.budget) if s.budget is not None else Fraction(s.share).limit_denominator(10**6) * sum(tokens.values())
    out: dict[tuple[str, ...], int] = {}

    def split(path: tuple[str, ...], part: Fraction) -> None:
        if path in room:
            out[path] = int(part)
            return
        own = sorted(children[path])
        for c, x in filled(part, {c: usable.get(c, Fraction(0)) for c in own}, {c: weight(c) for c in own}).items():
            split(c, x)

    if room:
        capacity(())
        split((), amount)
    return out


def words(text):
    """The column's number of words, runs of characters that are no white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _order(s: Settings, epoch):
    return F.xxhash64(F.lit(s.seed), epoch, F.col("doc_id"))


def _weighted(rows: DataFrame, names: list[str], s: Settings) -> DataFrame:
    """rows with the weight of each path (names); the table of weights is as large as the settings."""
    own = [(*path, float(w)) for path, w in s.weights.items() if len(path) == len(names)]
    if not own:
        return rows.withColumn("weight", F.lit(1.0))
    given = rows.sparkSession.createDataFrame(own, ", ".join([*(f"{n} string" for n in names), "given double"]))
    return rows.join(F.broadcast(given), names, "left").withColumn("weight", F.coalesce("given", F.lit(1.0))).drop("given")


def _split(parents: DataFrame, children: DataFrame, by: list[str]) -> DataFrame:
    """children (by, room, weight) with amount: their parents' amounts (by, amount) by weight, none above its room.

    Children are full up to some ratio of room to weight, and the others share what is left by weight.
    That ratio follows from running sums over the different pairs of room and weight, so equal children
    count as one row.
    """
    kinds = children.filter("room > 0 AND weight > 0").groupBy(*by, "room", "weight").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.select(*by, (F.col("room") / F.col("weight")).alias("ratio"), (F.col("n") * F.col("room")).alias("rooms"), (F.col("n") * F.col("weight")).alias("weights"))
    kinds = kinds.groupBy(*by, "ratio").agg(F.sum("rooms").alias("rooms"), F.sum("weights").alias("weights"))
    upto = Window.partitionBy(*by).orderBy("ratio").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(F.desc("ratio")).rowsBetween(Window.unboundedPreceding, -1)
    sums = kinds.select(*by, "ratio", "weights", F.sum("rooms").over(upto).alias("rooms"), F.coalesce(F.sum("weights").over(after), F.lit(0.0)).alias("open"))
    full = F.col("rooms") + F.col("ratio") * F.col("open") <= F.col("amount")
    state = sums.join(parents, by).groupBy(*by).agg(
        F.first("amount").alias("amount"),
        F.coalesce(F.max(F.when(full, F.col("rooms"))), F.lit(0)).alias("taken"),
        F.coalesce(F.min(F.when(full, F.col("open"))), F.max(F.col("open") + F.col("weights"))).alias("open"),
    )
    level = state.select(*by, F.when(F.col("open") > 0, (F.col("amount") - F.col("taken")) / F.col("open")).alias("level"))
    part = F.when(F.col("level").isNull(), F.col("room").cast("double")).otherwise(F.least(F.col("room").cast("double"), F.col("level") * F.col("weight")))
    usable = (F.col("room") > 0) & (F.col("weight") > 0)
    return children.join(level, by, "left").withColumn("amount", F.when(usable, part).otherwise(0.0)).drop("level")


def leaf_budgets(leaves: DataFrame, s: Settings) -> DataFrame:
    """leaves (the names of the path and n, its tokens) with budget, the tokens that each is to give.

    Budgets are worked out in double precision and rounded down; a millionth of a token is overlooked, and
    from about 1e10 tokens on a budget can be one token off.
    """
    names = [f"__{x}" for x in LEAF]
    level = _weighted(leaves.withColumn("room", F.col("n") * F.lit(s.epochs)), names, s)
    levels = [level]
    for depth in range(len(names) - 1, 0, -1):
        room = F.sum(F.when(F.col("weight") > 0, F.col("room")).otherwise(0)).alias("room")
        levels.insert(0, _weighted(levels[0].groupBy(*names[:depth]).agg(room), names[:depth], s))
    total = F.lit(float(s.budget)) if s.budget is not None else F.coalesce(F.sum("n"), F.lit(0)) * F.lit(float(s.share))
    part = leaves.agg(total.alias("amount")).withColumn("__root", F.lit(0))
    for depth, rows in enumerate(levels):
        by = ["__root", *names[:depth]]
        part = _split(part.select(*by, "amount"), rows.withColumn("__root", F.lit(0)), by)
        if depth + 1 < len(levels):
            part = written(part.select("__root", *names[: depth + 1], "amount"), "mix-level")
    return part.select(*names, "n", F.floor(F.col("amount") + F.lit(1e-6)).cast("long").alias("budget"))


def _exact(leaves: DataFrame, s: Settings) -> DataFrame:
    """leaf_budgets() of few leaves, exactly."""
    names = [f"__{x}" for x in LEAF]
    tokens = {tuple(r[n] for n in names): int(r["n"]) for r in leaves.collect()}
    rows = [(*leaf, tokens[leaf], n) for leaf, n in budgets(tokens, s).items()]
    return leaves.sparkSession.createDataFrame(rows, ", ".join([*(f"{n} string" for n in names), "n long", "budget long"]))


def _few(rows: DataFrame, s: Settings) -> bool:
    return rows.limit(s.few_leaves + 1).count() <= s.few_leaves


def _leaf(docs: DataFrame, domain) -> dict:
    none = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return {"__domain": none(domain), "__lang": none(F.col("lang")), "__source": none(F.col("source"))}


def _bucket(s: Settings):
    return F.shiftright("__key", 64 - s.buckets.bit_length() + 1)


def _cuts(narrow: DataFrame, s: Settings) -> DataFrame:
    """For each leaf of narrow (doc_id, leaf, __tokens): __whole epochs, and where the prefix of one more ends.

    The prefix has all buckets below __cut, and of that one the documents up to __last. Only the bucket
    in which the cut falls is put in order.
    """
    names = [f"__{x}" for x in LEAF]
    leaves = written(narrow.groupBy(*names).agg(F.sum("__tokens").alias("n")), "mix-leaves")
    plan = _exact(leaves, s) if _few(leaves, s) else leaf_budgets(leaves, s)
    some = F.col("n") > 0
    leaves = plan.select(*names, F.when(some, F.expr("budget div n")).otherwise(0).alias("__whole"), F.when(some, F.col("budget") % F.col("n")).otherwise(0).alias("__rest"))
    leaves = written(leaves, "mix-budgets")
    near = F.broadcast(leaves) if _few(leaves, s) else leaves
    keyed = narrow.join(near, names).withColumn("__key", _order(s, F.col("__whole"))).withColumn("__bucket", _bucket(s))
    sums = keyed.groupBy(*names, "__bucket").agg(F.sum("__tokens").alias("sum"), F.first("__rest").alias("__rest"))
    ahead = sums.withColumn("ahead", F.sum("sum").over(Window.partitionBy(*names).orderBy("__bucket")) - F.col("sum"))
    cut = written(ahead.filter("ahead <= __rest AND __rest < ahead + sum").select(*names, "__bucket", "ahead"), "mix-cuts")
    inside = keyed.join(F.broadcast(cut) if _few(cut, s) else cut, [*names, "__bucket"])
    upto = F.sum("__tokens").over(Window.partitionBy(*names).orderBy("__key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("upto", F.col("ahead") + upto).filter("upto <= __rest").groupBy(*names).agg(F.max(F.struct("__key", F.col("doc_id").isNotNull(), "doc_id")).alias("__last"))
    cut = cut.select(*names, F.col("__bucket").alias("__cut"))
    return written(leaves.drop("__rest").join(cut, names, "left").join(last, names, "left"), "mix-ends")


def _drawn(rows: DataFrame, ends: DataFrame, s: Settings) -> DataFrame:
    """rows with __draws; ends are small or met by a shuffle."""
    own = F.struct(F.col("__key"), F.col("doc_id").isNotNull(), F.col("doc_id"))
    inside = (F.col("__bucket") < F.col("__cut")) | ((F.col("__bucket") == F.col("__cut")) & (own <= F.col("__last")))
    both = rows.join(ends, [f"__{x}" for x in LEAF]).withColumn("__key", _order(s, F.col("__whole"))).withColumn("__bucket", _bucket(s))
    return both.withColumn("__draws", F.col("__whole") + F.coalesce(inside, F.lit(False)).cast("long")).drop("__key", "__bucket", *ends.columns[len(LEAF) :])


def _counted(docs: DataFrame, domain, count) -> DataFrame:
    own = docs.withColumns(_leaf(docs, domain)).select("doc_id", *(f"__{x}" for x in LEAF), "text")
    return written(count(own) if count else own.withColumn("__tokens", words(F.col("text"))).drop("text"), "mix-counts")


def mixture(docs: DataFrame, s: Settings, domain, count: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and draws for each row of docs; draws is 0 for rows left out.

    domain: a column expression over docs. count puts a column __tokens in the place of text, such as
    token_counts.with_token_counts(); without it, words between white space are counted as tokens. Within an epoch a leaf's documents come in the order of a
    hash of seed, epoch and id, then of the id; a document belongs to the prefix if the tokens up to its
    end fit in what is left.

    Edge cases: a null domain, language or source is the leaf's name ''; null and empty texts have 0
    tokens, and a leaf without tokens gives nothing; null ids come first in the order of the same hash;
    rows that repeat an id and stand at the cut are taken or left together; very long texts count as a
    whole; an empty table gives no rows. Other columns of docs aren't looked at.
    """
    narrow = _counted(docs.select("doc_id", "text", "lang", "source"), domain, count)
    ends = _cuts(narrow, s)
    out = _drawn(narrow, F.broadcast(ends) if _few(ends, s) else ends, s)
    return out.select("doc_id", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__tokens").alias("n_tokens"), F.col("__draws").alias("draws"))


def mixed(docs: DataFrame, s: Settings, domain, count: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of docs as often as they are drawn, with the columns of docs; as mixture() else.

    With few leaves texts aren't shuffled. With more, documents meet their draws by leaf and id, so a
    large leaf is spread over all tasks.
    """
    narrow = _counted(docs, domain, count)
    ends = _cuts(narrow, s)
    own = docs.withColumns(_leaf(docs, domain))
    if _few(ends, s):
        rows = _drawn(own, F.broadcast(ends), s)
    else:
        names = list(_leaf(docs, domain))
        draws = _drawn(narrow, ends, s).filter("__draws > 0").select(*(F.col(n).alias(f"{n}_of") for n in names), F.col("doc_id").alias("__id"), "__draws").distinct()
        on = own["doc_id"].eqNullSafe(draws["__id"])
        for n in names:
            on = on & (own[n] == draws[f"{n}_of"])
        rows = own.join(draws, on)
    return rows.filter("__draws > 0").withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__draws")))).select(*docs.columns)
