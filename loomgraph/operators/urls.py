"""Matching of URLs with routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import cut, reachable


def _parts(url: Column, leading: bool) -> Column:
    """All proper leading, or all proper trailing, parts of a URL by whole segments."""
    parts = F.split(url, "/")
    if leading:
        some = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    else:
        some = F.transform(F.sequence(F.lit(3), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, n, 1 << 20), "/")))
    return F.when(F.size(parts) > 2, F.filter(some, lambda x: x != "/")).otherwise(F.array().cast("array<string>"))


def _keys(kind: str, values: Column, score: int = 0) -> Column:
    return F.transform(values, lambda k: F.struct(F.lit(score).alias("score"), F.lit(kind).alias("kind"), k.alias("key")))


def held_keys(url: Column) -> Column:
    """The keys under which a route's URL is found: itself, its leading and its trailing parts."""
    return F.concat(_keys("whole", F.array(url)), _keys("lead", _parts(url, True)), _keys("trail", _parts(url, False)))


def asked_keys(calls: DataFrame) -> DataFrame:
    """calls (call, folded, ...) with each score that a fit can have, and the kind and key that it is found under."""
    c = F.col("call")
    one = F.concat(_keys("whole", F.array(c), 100), _keys("whole", F.array("folded"), 95))
    several = F.concat(_keys("whole", _parts(c, True), 50), _keys("lead", F.array(c), 40), _keys("whole", _parts(c, False), 35), _keys("trail", F.array(c), 30))
    rows = calls.withColumn("k", F.explode(F.concat(one, several))).select(*calls.columns, "k.*")
    return rows.filter((F.col("score") != 95) | F.contains("key", F.lit("{id}")))


def answers(calls: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What answers calls (method, call, folded): method, call, tier, url, target; and the calls (call, folded) whose URL fits any.

    index: tier, url, method, target. A URL with several targets for a method answers none; HEAD is
    answered by GET where a URL has nothing for HEAD. The best score wins, then the lower tier, the
    smaller URL and target. Each key keeps its first answer for a method, so no pairs are built.
    """
    known = index.select("tier", "url", F.upper("method").alias("method"), "target").distinct()
    one = known.groupBy("tier", "url", "method").agg(F.min("target").alias("target"), F.max("target").alias("most")).filter("target = most").drop("most")
    head = one.filter("method = 'GET'").join(known.filter("method = 'HEAD'").select("tier", "url").distinct(), ["tier", "url"], "left_anti")
    one = one.union(head.withColumn("method", F.lit("HEAD")).select(one.columns))
    held = one.withColumn("k", F.explode(held_keys(F.col("url")))).groupBy("k.kind", "k.key", "method").agg(F.min(F.struct("tier", "url", "target")).alias("first"))
    asked = asked_keys(calls.select("method", "call", "folded").distinct())
    best = asked.join(held, ["kind", "key", "method"]).groupBy("method", "call", "folded").agg(F.min(F.struct((-F.col("score")).alias("less"), "first")).alias("best"))
    every = known.select("url").distinct().select(F.explode(held_keys(F.col("url"))).alias("k")).select("k.kind", "k.key").distinct()
    seen = asked.join(every, ["kind", "key"], "left_semi").select("call", "folded").distinct()
    return best.select("method", "call", "best.first.tier", "best.first.url", "best.first.target"), seen


# What names of functions tell about the URLs that they answer.
SKIPPED = ("", "api", "v1", "v2", "v3")
BACKEND = ("api", "view", "route", "controller", "service", "modules")
VERBS = {
    "GET": ("get_", "list_", "fetch_", "retrieve_", "search_", "find_"),
    "POST": ("create_", "post_", "add_", "new_", "insert_", "submit_"),
    "PUT": ("update_", "put_", "edit_", "modify_", "set_"),
    "PATCH": ("patch_", "update_", "modify_"),
    "DELETE": ("delete_", "remove_", "destroy_", "del_"),
}
DATA_FILES = ("models.py", "apps.py", "admin.py")
EXACT, PART, POSITION, START, SEVERAL, KEYWORD, METHOD, PREFIX, TAIL, MODULE, ACCEPTED = 80, 30, 5, 10, 30, 15, 25, 20, 40, 20, 55
TEST, DATA, VIEW, SCRIPT, OTHER_MODULE, CLASS = -40, -40, -40, -20, -40, -40


def _singular(word: Column) -> Column:
    s = F.length(word)
    return F.when(F.endswith(word, F.lit("ies")), F.concat(F.substr(word, F.lit(1), s - 3), F.lit("y"))).when(F.endswith(word, F.lit("ses")), F.substr(word, F.lit(1), s - 2)).when(F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")), F.substr(word, F.lit(1), s - 1)).otherwise(word)


#: Words of URLs that are broadcast to the names as one automaton; with more, marks of words are, 2**BITS at most.
WORDS, BITS = 200_000, 29
#: Factors of the marks that a word has: a stretch of a name counts as a word where all of these marks are set.
_MARKS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _window_hashes(text: bytes, up, down):
    """For start and length of stretches of a text: hashes that don't depend on where they stand."""
    import numpy as np

    data = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[: len(data)], out=sums[1:])

    def of(start, length):
        x = (sums[start + length] - sums[start]) * down[start]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) >> np.uint64(20)

    return of


def _powers(n: int):
    import numpy as np

    base = 0xD6E8FEB86659FD93
    return [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64))]


def _parts_like(names: DataFrame, words: DataFrame) -> DataFrame:
    """lower, variant: the parts of names whose marks some words have, so all words that they hold and a few others.

    Names and words are distinct, and words written. Of the words only their lengths and the bits of their marks
    come to the driver, 64 MB at most; names are read once.
    """
    import numpy as np
    import pyarrow as pa

    spark = names.sparkSession
    reachable(spark)  # workers need this module's functions
    many = words.count()
    bits = max(10, min(BITS, (64 * many).bit_length()))
    tasks = max(4 * spark.sparkContext.defaultParallelism, many // 20_000)  # by the work, which the few bytes of names don't tell

    def laid_out(batch):
        raw = [x.encode() for x in batch.column(0).to_pylist()]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        text = b"".join(raw)
        return raw, size, np.cumsum(size) - size, _window_hashes(text, *_powers(len(text)))

    def places(h, factor):
        return h * np.uint64(factor) >> np.uint64(64 - bits)

    def marks(batches):
        for batch in batches:
            _, size, begin, hashed = laid_out(batch)
            h = hashed(begin, size)
            at = np.concatenate([places(h, f) for f in _MARKS]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(size, len(_MARKS))), pa.array(at + 1)], ["size", "at"])

    found = words.mapInArrow(marks, "size long, at long")
    sizes = sorted(r["size"] for r in found.select("size").distinct().collect())
    pages = found.groupBy(F.expr("bitmap_bucket_number(at)").alias("page")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits")).collect()
    table = np.zeros(max(1 << bits - 3, 4096), np.uint8)
    for r in pages:
        table[(r["page"] - 1) * 4096 : r["page"] * 4096] = np.frombuffer(r["bits"], np.uint8)[: len(table)]
    shared = spark.sparkContext.broadcast(table)

    def scan(batches):
        known = shared.value
        for batch in batches:
            raw, size, begin, hashed = laid_out(batch)
            name = np.repeat(np.arange(len(raw)), size)
            start = np.arange(len(name))
            left = np.repeat(begin + size, size) - start
            pairs = set()
            for n in sizes:
                hit = start[left >= n]
                h = hashed(hit, n)
                for f in _MARKS:
                    at = places(h, f)
                    is_set = (known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    hit, h = hit[is_set], h[is_set]
                of = name[hit]
                pairs.update((i, raw[i][a : a + n]) for i, a in zip(of.tolist(), (hit - begin[of]).tolist()))
            whole = [(raw[i].decode(), text) for i, part in pairs if (text := part.decode(errors="replace")).encode() == part]  # others start or end within a character
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in whole], pa.string()) for k in (0, 1)], ["lower", "variant"])

    return names.repartition(tasks, "lower").mapInArrow(scan, "lower string, variant string")


def _held_words(names: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """lower, variant: the words (variant) that names (lower) hold; words of one or two characters must be whole names.

    With many words there are further parts of names whose hash a word has; the join with the words leaves these out.
    """
    names = names.select("lower").distinct()
    words = cut(words.select("variant").distinct())
    few = [r["variant"] for r in words.limit(most + 1).collect()]
    if len(few) > most:
        parts = _parts_like(names, words)
        return parts.filter((F.length("variant") > 2) | (F.col("variant") == F.col("lower")))
    shared = names.sparkSession.sparkContext.broadcast(few)

    def scan(batches):
        import ahocorasick
        import pyarrow as pa

        machine = ahocorasick.Automaton()
        for w in shared.value:
            machine.add_word(w, w)
        machine.make_automaton()
        for batch in batches:
            found = [(name, w) for name in batch.column(0).to_pylist() for w in {w for _, w in machine.iter(name)} if len(w) > 2 or w == name] if len(machine) else []
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["lower", "variant"])

    return names.mapInArrow(scan, "lower string, variant string")


def named_answers(calls: DataFrame, names: DataFrame, endpoints: DataFrame, most: int = WORDS) -> DataFrame:
    """method, call, target, score: for calls that no URL fits, the one function or class whose name tells most.

    names: target, name, file, kind; endpoints: target, method. Segments of the URL, in singular and plural,
    are names or parts of names. Which names hold which words is found by one pass over the different names
    with an automaton of all words, up to `most` of them. URLs of the same words ask once. Ties stay open.
    """
    word = lambda c: F.lower(F.regexp_replace(c, "[- ]", "_"))
    segments = F.filter(F.transform(F.filter(F.split("call", "/"), lambda x: ~x.isin(*SKIPPED)), lambda x: F.regexp_replace(x, r"\{[^}]*\}", "")), lambda x: x != "")
    asked = calls.select("method", F.col("call").alias("asked")).distinct().withColumn("call", F.col("asked")).withColumn("words", F.transform(segments, word)).filter(F.size("words") > 0)
    asked = asked.withColumn("call", F.array_join("words", "/"))
    rows = asked.select("method", "call", "words").distinct()
    each = rows.select("method", "call", F.posexplode("words").alias("nth", "word"))
    w = F.col("word")
    n = F.length(w)
    to_ies = F.endswith(w, F.lit("y")) & (n > 2) & ~F.substr(w, n - 1, F.lit(1)).isin(*"aeiou")
    plural = F.when(to_ies, F.concat(F.substr(w, F.lit(1), n - 1), F.lit("ies"))).otherwise(F.concat(w, F.lit("s")))
    each = each.withColumn("variant", F.explode(F.array_distinct(F.array(w, F.replace(w, F.lit("_"), F.lit("")), _singular(w), plural)))).filter("variant <> ''")
    known = names.filter("name <> ''").withColumn("lower", F.lower("name"))
    part = _held_words(known, each, most)
    boost = (F.col("nth") + 1) * POSITION
    score = F.when(F.col("variant") == F.col("lower"), EXACT + boost).otherwise(PART + boost + 2 * F.length("variant") + F.when(F.startswith("lower", F.col("variant")), START).otherwise(0))
    hits = each.join(part, "variant").withColumn("score", score).groupBy("method", "call", "lower").agg(F.max("score").alias("score"), F.countDistinct("word").alias("words_met"))
    found = hits.join(known, "lower").join(rows, ["method", "call"])
    own = endpoints.groupBy("target").agg(F.collect_set(F.upper("method")).alias("own_methods"))
    found = found.join(own, "target", "left")
    id_ = F.lower("target")
    tail = F.ltrim(F.element_at(F.split(id_, ":"), -1), F.lit("@"))
    prefix = F.coalesce(*[F.when(F.col("method") == m, F.get(F.filter(F.array(*map(F.lit, ps)), lambda x: F.startswith(tail, x)), F.lit(0))) for m, ps in VERBS.items()])
    rest = F.when(prefix.isNotNull(), F.substr(tail, F.length(prefix) + 1)).otherwise(tail)
    wanted = F.array_join(F.transform(F.when(F.size("words") > 1, F.slice("words", 2, 1 << 20)).otherwise(F.col("words")), _singular), "_")
    file, base = F.col("file"), F.element_at(F.split("file", "/"), -1)
    module = F.regexp_extract(file, r"(?:^|/)modules/([^/]+)(?:/|$)", 1)
    plus = lambda test, value: F.when(test, value).otherwise(0)
    ends = lambda *es: reduce(lambda a, b: a | b, [F.endswith(base, F.lit(e)) for e in es])
    total = (
        F.col("score")
        + plus(F.col("words_met") > 1, SEVERAL)
        + plus(reduce(lambda a, b: a | b, [F.contains(id_, F.lit(k)) for k in BACKEND]), KEYWORD)
        + plus(F.array_contains("own_methods", F.col("method")), METHOD)
        + plus(prefix.isNotNull(), PREFIX)
        + plus((rest != "") & (rest == wanted), TAIL)
        + plus(F.contains(file, F.lit("/test")) | F.startswith(file, F.lit("test")), TEST)
        + plus(base.isin(*DATA_FILES), DATA)
        + F.when(ends(".tsx", ".jsx", ".vue", ".svelte"), VIEW).when(ends(".ts", ".js"), SCRIPT).otherwise(0)
        + F.when(module == F.col("words")[0], MODULE).when(module != "", OTHER_MODULE).otherwise(0)
        + plus(F.col("kind") == "Class", CLASS)
    )
    scored = found.withColumn("total", total).filter(F.col("total") >= ACCEPTED)
    equal = scored.groupBy("method", "call", "total").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))
    one = equal.groupBy("method", "call").agg(F.max(F.struct("total", "n", "target")).alias("b")).select("method", "call", "b.*")
    return asked.select("method", "call", "asked").join(one.filter("n = 1"), ["method", "call"]).select("method", F.col("asked").alias("call"), "target", F.col("total").alias("score"))


def best_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """call, folded, route, score: each call that a route fits, once, with the best score of url_score.

    route is null where several fit equally. A fit is an equality of one side with the other, or with a
    leading or trailing part of it, so calls meet keys of routes; each key keeps its least and greatest
    route, which is enough to tell ties, and no pair of a call and a route is built.
    """
    held = routes.select("route", F.explode(held_keys(F.col("route"))).alias("k")).groupBy("k.kind", "k.key").agg(F.min("route").alias("least"), F.max("route").alias("most"))
    fits = asked_keys(calls.select("call", "folded").distinct()).join(held, ["kind", "key"])
    level = fits.groupBy("call", "folded", "score").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    best = level.groupBy("call", "folded").agg(F.max(F.struct("score", "least", "most")).alias("b"))
    return best.select("call", "folded", F.when(F.col("b.least") == F.col("b.most"), F.col("b.least")).alias("route"), "b.score")
