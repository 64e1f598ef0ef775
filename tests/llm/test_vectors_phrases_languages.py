import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import centroids, language_id, phrases
from loomgraph.llm.common import table
from tests.llm.helpers import documents, empty, rows

# centroids


def lloyd(vectors, s):
    """(id, vector) pairs, whole numbers; plain rounds over all pairs."""
    kept = sorted(((hashlib.sha256(f"{s.seed}:{i}".encode()).hexdigest() if i is not None else "g", i, v) for i, v in vectors), key=lambda x: (x[0], x[1] is not None and x[1], x[2]))
    c = [list(v) for _, _, v in kept[: s.k]]
    near = lambda v: min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, c[j], strict=True)), j))
    for _ in range(s.rounds):
        by = defaultdict(list)
        for _, v in vectors:
            by[near(v)].append(v)
        for j, own in by.items():
            c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = []
    for i, v in vectors:
        j = near(v)
        out.append((i, j, sum((a - b) ** 2 for a, b in zip(v, c[j], strict=True)), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()))
    return out


def check_clusters(spark, vectors, s):
    df = spark.createDataFrame([(i, [x / s.scale for x in v]) for i, v in vectors], "vec_id long, embedding array<double>")
    got = rows(centroids.clustered(df.withColumns({"v": F.lit(1), "cluster": F.lit(2), "n": F.lit(3)}), s))
    want = lloyd(vectors, s)
    key = lambda x: repr(x)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, j, d, _ in want if j == r["cluster"])
        assert r["inertia"] == sum(d for _, _, d, _ in want)


@pytest.mark.parametrize("seed", range(4))
def test_clusters_equal_plain_rounds_with_many_ties(spark, seed):
    rnd = random.Random(seed)
    s = centroids.Settings(k=rnd.choice([1, 2, 5, 9]), size=2, rounds=5)
    ids = list(range(60)) + [7, 7, None]
    check_clusters(spark, [(i, [rnd.randint(-4, 4), rnd.randint(-4, 4)]) for i in ids], s)


def test_clusters_of_large_numbers_are_exact(spark):
    rnd = random.Random(9)
    s = centroids.Settings(k=3, size=2, rounds=3, scale=1)
    check_clusters(spark, [(i, [rnd.randint(-(2**29), 2**29), rnd.randint(-(2**29), 2**29)]) for i in range(30)], s)


def test_search_equals_all_distances_and_takes_fewer():
    rnd = np.random.default_rng(5)
    middle = rnd.integers(-3000, 3000, (20, 8))
    x = (middle[rnd.integers(0, 20, 4000)] + rnd.integers(-80, 80, (4000, 8))).astype(np.float64)
    now, taken = [list(map(int, v)) for v in x[:20]], 0
    a, upper, lower = centroids.Ball(now, None).all(x)
    for _ in range(6):
        before, now = now, [[int(v) for v in np.floor(x[a == j].mean(0))] if (a == j).any() else now[j] for j in range(20)]
        a, upper, lower, n = centroids.Ball(now, before).moved_on(x, a.copy(), upper, lower)
        d = centroids.squared(x, np.array(now, dtype=np.float64))
        assert (a == d.argmin(1)).all()
        second = np.sort(d, 1)[:, 1]
        assert (upper >= np.sqrt(d.min(1))).all() and (lower <= np.sqrt(second)).all()
        taken += n
    assert taken < 6 * 4000 * 20 / 4


def test_vectors_that_are_no_vectors_and_empty_tables(spark):
    s = centroids.Settings(k=3, size=2, rounds=2)
    data = [(1, [0.0, 0.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, None), (7, []), (8, [2.0, 2.0]), (8, [2.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id int, embedding array<float>")
    assert sorted(r["vec_id"] for r in rows(centroids.clustered(df, s))) == [1, 8, 8]
    assert rows(centroids.clustered(df.limit(0), s)) == []
    far = spark.createDataFrame([(1, [0.0, 0.0]), (2, [4e9, 4e9])], "vec_id int, embedding array<double>")
    got = {r["vec_id"]: r for r in rows(centroids.clustered(far, centroids.Settings(k=1, size=2, rounds=0)))}
    assert {r["distance"] for r in got.values()} == {0, None} and got[1]["inertia"] is None
    with pytest.raises(ValueError):
        centroids.clustered(df, centroids.Settings(k=0))


# phrases


def plain_phrases(docs, s):
    """lang, rank, phrase, a, l, r, n, score by plain counting."""
    f, total = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for size in range(1, s.longest + 1):
                f[lang or "und"].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, n in f.items():
        found = {p: a for p, a in n.items() if len(p) > 1 and a >= s.least}
        best = {p: min((s.scale * a // (n[p[:k]] + n[p[k:]]), k) for k in range(1, len(p))) for p, a in found.items()}
        inner = {(p, q) for q in found for size in range(2, len(q)) for i in range(len(q) - size + 1) if (p := q[i : i + size])}
        gone = {p for p, q in inner if p in found and 100 * found[q] >= s.inside_percent * found[p]}
        kept = sorted((p for p in found if p not in gone), key=lambda p: (-best[p][0], -found[p], " ".join(p).encode()))[: s.top]
        for rank, p in enumerate(kept, 1):
            score, k = best[p]
            out.append((lang, rank, " ".join(p), found[p], n[p[:k]], n[p[k:]], total[lang], score))
    return sorted(out)


@pytest.mark.parametrize("cells,shard", [(1 << 16, 64), (1 << 20, 1 << 20)])
def test_phrases_equal_plain_counts(spark, cells, shard):
    rnd = random.Random(3)
    words = ["a", "A", "b", "é", "日本", "a.b", "x\x00", "-", "ab", "\x1c", "new", "york"]
    docs = [(rnd.choice(["en", "fr", None, "und"]), "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", "\n", ", "]) for _ in range(rnd.randint(0, 60)))) for _ in range(150)]
    docs += [("en", None), ("en", ""), ("fr", "a a a a a a a a"), ("en", "new york " * 50)]
    s = phrases.Settings(least=4, top=40, cells=cells, shard=shard, automaton=7)
    df = spark.createDataFrame([(i % 9 or None, *d) for i, d in enumerate(docs)], "doc_id long, lang string, text string")
    got = rows(phrases.collocations(df.withColumns({"n": F.lit("x"), "phrase": F.lit("y"), "size": F.lit(1)}), s))
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == plain_phrases(docs, s)


def test_many_collisions_and_many_occurrences_change_nothing(spark):
    docs = [("en", "one two three four five " * 200 + "six seven")] * 3
    s = phrases.Settings(least=300, cells=phrases.BLOCK)
    df = spark.createDataFrame(docs, "lang string, text string")
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows(phrases.collocations(df, s)))
    assert got == plain_phrases(docs, s) and got


def test_phrases_of_odd_and_empty_tables(spark):
    assert rows(phrases.collocations(empty(spark))) == []
    got = rows(phrases.collocations(documents(spark)))
    assert {(r["phrase"], r["a"]) for r in got if r["lang"] == "xx"} == {("é日本 🙂 é日本 🙂", 3999), ("🙂 é日本 🙂 é日本", 3998)}


def test_shards_cut_long_texts_between_pieces():
    import pyarrow as pa

    texts = ["aa bb. " * 30, "cc " * 40, "", "dd. ee"]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y", "x", "y"]), pa.array(texts)], ["lang", "text"])
    got = list(phrases.shards([batch], 50))
    assert all(sum(map(len, x.values())) <= 60 or x == {"y": ("cc " * 40).encode()} or b"cc" in x.get("y", b"") for x in got)
    for lang in "xy":
        have = Counter(p.strip() for x in got for p in x.get(lang, b"").decode().split("\n") if p.strip())
        assert have == Counter(p.strip() for t, k in zip(texts, "xyxy", strict=True) if k == lang for p in t.split(".") if p.strip())


# languages


def plain_model(docs, s):
    """Word and run counts of all rows that aren't held out, none left out."""
    words = defaultdict(Counter)
    for i, lang, text in docs:
        if lang is not None and text is not None and not (i is not None and zlib.crc32(str(i).encode()) % s.folds == s.held_out):
            words[lang].update(re.findall(r"[^\W\d_]+", text.lower()))
    words = {lang: n for lang, n in words.items() if n}
    parts = [words]
    for size in range(1, s.longest + 1):
        runs = {lang: Counter() for lang in words}
        for lang, n in words.items():
            for word, times in n.items():
                text = f" {word} " if size > 1 else word
                for i in range(len(text) - size + 1):
                    runs[lang][text[i : i + size]] += times
        parts.append(runs)
    return sorted(words), parts


def plain_language(text, langs, parts, s):
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not langs or not any(c.isalpha() for w in found for c in w):
        return "und", 0.0
    names = [set().union(*p.values()) for p in parts]
    norm = [[sum(p[lang].values()) + s.smoothing * (len(n) + 1) for lang in langs] for p, n in zip(parts, names, strict=True)]
    log = lambda k, name: np.array([math.log((parts[k][lang][name] + s.smoothing) / norm[k][i]) for i, lang in enumerate(langs)])
    votes = np.zeros(len(langs))
    for word in found:
        if word in names[0]:
            votes += log(0, word)
            continue
        for size in range(s.longest, 0, -1):
            text = f" {word} " if size > 1 else word
            known = [text[i : i + size] for i in range(len(text) - size + 1) if text[i : i + size] in names[size]]
            if known:
                votes += sum(log(size, r) for r in known) / len(known)
                break
    votes /= math.sqrt(len(found))
    best = int(votes.argmax())
    return langs[best], float(1 / np.exp(votes - votes[best]).sum())


def test_languages_equal_a_plain_version(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "lang", "text")
    s = language_id.Settings(remembered=50)
    langs, parts = plain_model([tuple(r) for r in docs.collect()], s)
    held = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    some = [(r["doc_id"], r["text"]) for r in held.limit(12).collect()] + [(-1, "Θάλασσα!"), (-2, "²½ 123"), (-3, None), (-4, ""), (-5, "zzqx")]
    df = spark.createDataFrame(some, "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(language_id.languages(df, language_id.fit_languages(docs, s), s))}
    for i, text in some:
        lang, score = plain_language(text, langs, parts, s)
        assert (got[i]["lang_pred"], got[i]["held_out"]) == (lang, zlib.crc32(str(i).encode()) % 4 == 2) and got[i]["score"] == pytest.approx(score), text
    assert got[-2]["lang_pred"] == got[-3]["lang_pred"] == "und" and got[-5]["lang_pred"] in langs


def test_languages_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.languages(docs.drop("lang", "source"), language_id.fit_languages(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.99
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0


def test_the_model_keeps_to_its_size(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = language_id.fit_languages(docs, language_id.Settings(most=2000))
    assert all(0 < len(known) * len(model.langs) <= 2000 for known, _ in [(model.words, None), *model.runs])


def test_languages_of_odd_and_empty_tables(spark):
    df = documents(spark)
    got = rows(language_id.languages(df, language_id.fit_languages(df)))
    assert len(got) == df.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 6)} == {"und"}
    model = language_id.fit_languages(empty(spark))
    assert {(r["lang_pred"], r["score"]) for r in rows(language_id.languages(df, model))} == {("und", 0.0)}
    assert rows(language_id.languages(empty(spark), model)) == []
