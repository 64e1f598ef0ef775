import hashlib
import random
import zlib

import numpy as np
import pytest

from loomgraph.llm import mixing, quality_vote, repeated_bytes, sentencepiece_match, sharding, token_counts
from loomgraph.llm.queries import MIX, TOKENIZERS, domain_of, tokens_of
from tests.llm.helpers import ODD, by_id, documents, empty, rows


def greedy(word, pieces):
    n = at = 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def test_piece_counter_is_greedy_longest_match():
    rnd = random.Random(1)
    for _ in range(300):
        pieces = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 12))}
        counter = token_counts.PieceCounter(pieces)
        for _ in range(30):
            word = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12)))
            assert counter.count(word) == greedy(word, pieces), (word, pieces)


def test_piece_counter_with_other_pieces_inside_words():
    counter = token_counts.PieceCounter(["un", "unaff", "a"], ["able", "aff", "a", "b"])
    assert [counter.count(w) for w in ("un", "unaffable", "ab", "b", "unaffabl", "")] == [1, 2, 2, 1, 1, 0]


def covering(word, pieces):
    """The longest pieces from the left from which the rest can be covered; None if there are none."""
    if not word:
        return 0
    for k in range(len(word), 0, -1):
        if word[:k] in pieces and (rest := covering(word[k:], pieces)) is not None:
            return 1 + rest
    return None


def covered(word, pieces, longest):
    """The same for words of any length: which rests can be covered is found from the right."""
    can = [False] * len(word) + [True]
    sizes = lambda at: range(min(longest, len(word) - at), 0, -1)
    for at in range(len(word) - 1, -1, -1):
        can[at] = any(can[at + k] and word[at : at + k] in pieces for k in sizes(at))
    n = at = 0
    while at < len(word):
        at += next(k for k in sizes(at) if can[at + k] and word[at : at + k] in pieces)
        n += 1
    return n


def test_every_word_of_a_byte_complete_vocabulary_is_covered():
    rnd, end = random.Random(7), token_counts.END
    for _ in range(200):
        made = [tuple(rnd.choice(b"abc") for _ in range(rnd.randint(1, 5))) + (end,) * rnd.randint(0, 1) for _ in range(12)]
        pieces = {*made, *((b,) for b in b"abc"), *((b, end) for b in b"abc")}
        counter = token_counts.PieceCounter(pieces)
        for _ in range(20):
            word = (*(rnd.choice(b"abc") for _ in range(rnd.randint(1, 12))), end)
            assert counter.count(word) == covering(word, pieces), (word, pieces)
    with open(f"{TOKENIZERS}/word_bpe_49k.json", encoding="utf-8") as f:
        pieces = set(token_counts.word_end_pieces(f.read()))
    assert all((b,) in pieces and (b, end) in pieces for b in range(256))
    counter = token_counts.PieceCounter(pieces)
    for text in ("thinstou", "ofthresthe", "therorhe", "".join(rnd.choice("aehinorst") for _ in range(3000))):
        word = (*text.encode(), end)
        assert counter.count(word) > 1 and (len(word) > 500 or counter.count(word) == covering(word, pieces))
    spread = [0, 0]
    for _ in range(3000):
        word = (*(rnd.choice(b"aehinorst") for _ in range(rnd.randint(2, 12))), end)
        spread[word in pieces] += 1
        assert counter.count(word) == covering(word, pieces) and (counter.count(word) > 1 or word in pieces)
    assert spread[0] > 1000


def test_token_counts_take_odd_rows(spark):
    file = f"{TOKENIZERS}/word_bpe_49k.json"
    got = rows(token_counts.token_counts(documents(spark), file))
    assert len(got) == len(ODD)
    with open(file, encoding="utf-8") as f:
        pieces = set(token_counts.word_end_pieces(f.read()))
    longest, known = max(map(len, pieces)), {}
    for r in got:
        text = next(t for i, t, *_ in ODD if i == r["doc_id"]) or ""
        words = token_counts.WORD.findall(text.lower())
        for w in set(words) - set(known):
            known[w] = covered((*w.encode(), token_counts.END), pieces, longest)
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))
    assert rows(token_counts.token_counts(empty(spark), file)) == []


def test_encoding_equals_the_public_library(spark):
    import sentencepiece

    file = f"{TOKENIZERS}/piece_bpe_32k.model"
    library = sentencepiece.SentencePieceProcessor(model_file=file)
    extra = [(100 + i, t, "en", "s") for i, t in enumerate(["  a  b ", "\n\n x\n", "a\n b", "tab\there", "日本語 テスト", "🙂🙂 ok", "x" * 300, "▁x ▁▁"])]
    docs = documents(spark, ODD + extra)
    for r in rows(sentencepiece_match.encoded(docs, file)):
        text = next(t for i, t, *_ in ODD + extra if i == r["doc_id"]) or ""
        assert r["ids"] == library.encode(text) and r["n_pieces"] == len(r["ids"])
        assert r["round_trip"]
    assert rows(sentencepiece_match.encoded(empty(spark), file)) == []


def test_encoding_tells_any_number_of_characters_apart():
    import sentencepiece

    file = f"{TOKENIZERS}/piece_bpe_32k.model"
    model = sentencepiece_match.Pieces(*sentencepiece_match.load_pieces(file))
    assert model.bpe
    text = "".join(chr(c) for c in range(0x21, 0x12000) if not 0xD800 <= c < 0xE000 and c != 0x2581) + " the end"
    ids = sentencepiece_match.Encoder(model)([text])[0]
    assert len(set(text)) > 65_535
    assert np.frombuffer(ids, "<u4").tolist() == sentencepiece.SentencePieceProcessor(model_file=file).encode(text)


def test_unigram_encoding_takes_the_best_way():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁ab", "ba", "aba"]
    scores = [0.0, -1.5, -2.0, -2.5, -2.2, -3.0, -2.4, -5.0]
    model = sentencepiece_match.Pieces(pieces, scores, [1, 0, 0, 0, 0, 0, 0, 0], False)
    score = dict(zip(pieces, scores))

    def best(word):
        return max(([p] + rest for p in pieces[1:] if word.startswith(p) for rest in ([best(word[len(p) :])] if word[len(p) :] else [[]]) if rest is not None), key=lambda w: sum(score[p] for p in w), default=None)

    for word in ("▁ab", "▁abab", "▁aba", "▁bbaab", "▁"):
        raw = sentencepiece_match.encode_words([word], model)[0]
        assert [pieces[i] for i in np.frombuffer(raw, "<u4")] == best(word)


def test_quality_learns_and_keeps_held_out_rows_apart(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(80)) if i % 3 else " ".join([rnd.choice(words)] * 80), "en", "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    df = documents(spark, docs)
    model = quality_vote.fit_quality(df, labels)
    got = by_id(quality_vote.quality_scores(df, model))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert len(model.votes) == sum(not r["held_out"] for r in got.values())
    assert all(r["predicted"] == int(i % 3 > 0) for i, r in got.items() if r["held_out"])
    good = quality_vote.good_documents(df, model)
    assert good.columns == df.columns and good.count() == sum(r["predicted"] for r in got.values())
    odd = rows(quality_vote.quality_scores(documents(spark), model))
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert rows(quality_vote.quality_scores(empty(spark), model)) == []
    assert quality_vote.fit_quality(empty(spark), labels).prior == 0.5


def test_repeated_bytes_equal_brute_force(spark):
    rnd = random.Random(4)
    words = ["ab", "the", "cd", "xyz", "é", "q"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(8)] + [(200, "aaaa" * 40), (201, "abab" * 30 + "zz"), (202, None), (203, "The " * 50), (203, "The " * 50)]
    df = spark.createDataFrame([*docs, (None, "The " * 50)], "doc_id long, text string")
    for s in (
        repeated_bytes.Settings(length=20, gram=6, chunk=300, block=500, crowd=1000),
        repeated_bytes.Settings(length=20, gram=6, chunk=300, block=500, crowd=5),
        repeated_bytes.Settings(length=12, gram=5, chunk=100, block=50),
    ):
        first, want = {}, {}
        plain = {d: (t or "").encode() for d, t in docs}
        for d, b in sorted(plain.items()):
            for i in range(len(b) - s.length + 1):
                first.setdefault(b[i : i + s.length], (d, i))
        for d, b in plain.items():
            gone = np.zeros(len(b) + 1, int)
            for i in range(len(b) - s.length + 1):
                if first[b[i : i + s.length]] < (d, i):
                    gone[i : i + s.length] = 1
            want[d] = (len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), bytes(x for x, g in zip(b, gone) if not g))
        got = rows(repeated_bytes.repeated_bytes(df, s))
        assert len(got) == len(docs) + 1
        for r in got:
            if r["doc_id"] is None:
                assert r["n_removed"] == 0
            else:
                assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]]


def test_repeated_bytes_of_crowds_and_of_an_id_with_different_texts(spark):
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    shared, other = word(40), word(30)
    docs = [(i, word(rnd.randint(0, 15)) + shared + word(rnd.randint(0, 15))) for i in range(60)]
    docs += [(70, other), (71, other), (71, word(30)), (71, word(8) + other), (72, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    from pyspark.sql import functions as F

    own = {(r["doc_id"], r["text"]): r["own"] for r in rows(df.withColumn("own", F.xxhash64(F.col("text").cast("binary"))))}
    for s in (repeated_bytes.Settings(length=20, gram=6, chunk=300, combine=600, block=500, crowd=4), repeated_bytes.Settings(length=20, gram=6, chunk=300, block=200, crowd=2)):
        got = {(r["doc_id"], r["n_bytes"], r["kept_sha256"], r["n_removed"]) for r in rows(repeated_bytes.repeated_bytes(df, s))}
        want, seen = set(), set()
        for d, t in sorted(docs, key=lambda x: (x[0], own[x])):
            gone, b = set(), t.encode()
            for i in range(len(b) - s.length + 1):
                if b[i : i + s.length] in seen:
                    gone |= set(range(i, i + s.length))
                seen.add(b[i : i + s.length])
            want.add((d, len(b), hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest(), len(gone)))
        assert got == want


def test_anchors_stay_whole_beside_settled_runs(spark):
    big = (1 << 62) + 1
    rows_ = [(None, None, 1, 0, 0, 5), (big, 7, 1, 0, 9, 1), (big, 8, 2, 0, 9, 1), (big + 1, 9, 3, 0, 9, 1)]
    found = repeated_bytes._settled(spark.createDataFrame(rows_, repeated_bytes.ROWS).coalesce(1)).filter("anchor IS NOT NULL").collect()
    assert {r["anchor"] for r in found} <= {big} and {r["doc"] for r in found} <= {1, 2} and len(found) == 2


def test_repeated_bytes_take_odd_rows(spark):
    assert len(rows(repeated_bytes.repeated_bytes(documents(spark)))) == len(ODD)
    assert rows(repeated_bytes.repeated_bytes(empty(spark))) == []


def test_shards_are_even_and_keep_groups(spark):
    docs = [(i, f"text {i}" if i > 60 else f"group {i % 6}", "en", "s") for i in range(200)] + [(500 + i, "hot", "en", "s") for i in range(100)]
    got = rows(sharding.sharded(documents(spark, docs), sharding.Settings(shards=7)))
    counts = [sum(r["shard"] == k for r in got) for k in range(7)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == 300
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(counts[k])) for k in range(7))
    text = {i: t for i, t, *_ in docs}
    spread = lambda t: len({r["shard"] for r in got if text[r["doc_id"]] == t})
    assert sum(spread(f"group {g}") for g in range(6)) <= 12  # of 42 by chance alone
    assert spread("hot") < 7
    odd = rows(sharding.sharded(documents(spark)))
    assert len(odd) == len(ODD) and all(r["shard"] is not None and r["slot"] == 0 for r in odd)
    assert {r["size"] for r in odd if r["doc_id"] in (4, 5)} == {8}
    assert rows(sharding.sharded(empty(spark))) == []


def test_sharding_cuts_no_more_links_than_it_must(spark):
    """Against chance, and against the least number of shards that each group needs."""
    rnd = random.Random(14)
    sizes = [rnd.choice((2, 3, 5, 8)) for _ in range(60)] + [70]
    docs = [(g * 100 + i, f"group {g}", "en", "s") for g, n in enumerate(sizes) for i in range(n)] + [(10_000 + i, f"alone {i}", "en", "s") for i in range(200)]
    got = rows(sharding.sharded(documents(spark, docs), sharding.Settings(shards=8)))
    room = len(docs) // 8
    at = {}
    for r in got:
        at.setdefault(r["doc_id"] // 100 if r["doc_id"] < 10_000 else -1, []).append(r["shard"])
    counts = [sum(r["shard"] == k for r in got) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    parts = {g: len(set(at[g])) for g in range(len(sizes))}
    least = sum(-(-n // room) for n in sizes)
    chance = sum(min(8, n) for n in sizes)
    assert sum(parts.values()) <= least + (chance - least) // 10


def test_admitted_never_passes_the_room():
    load, room, wish = [10, 10, 2], [10, 8, 9], {(0, 1): 4, (1, 0): 3, (0, 2): 5, (1, 2): 4}
    share = sharding.admitted(load, room, wish)
    for s in range(3):
        come = sum(n * share[t] for (f, t), n in wish.items() if t == s)
        go = sum(n * share[t] for (f, t), n in wish.items() if f == s)
        assert come == 0 or load[s] + come - go <= room[s] + 1e-6


def test_budgets_give_shortages_to_siblings_first():
    s = mixing.Settings(weights={("a",): 3, ("b",): 1, ("a", "x"): 1, ("a", "y"): 1}, budget=400, epochs=1)
    have = {("a", "x", "s"): 50, ("a", "y", "s"): 500, ("b", "x", "s"): 500}
    assert mixing.budgets(have, s) == {("a", "x", "s"): 50, ("a", "y", "s"): 250, ("b", "x", "s"): 100}
    have[("a", "y", "s")] = 100  # the whole branch falls short: the rest goes to its sibling
    assert mixing.budgets(have, s) == {("a", "x", "s"): 50, ("a", "y", "s"): 100, ("b", "x", "s"): 250}
    assert mixing.budgets({}, s) == {}


def test_budgets_in_spark_equal_plain_fractions(spark):
    rnd = random.Random(6)
    for turn in range(2):
        tree = {(f"d{rnd.randrange(3)}", f"l{rnd.randrange(3)}", f"s{rnd.randrange(40)}"): rnd.choice([0, 1, 7, 7, rnd.randrange(5000)]) for _ in range(120)}
        weights = {("d0",): 0.3, ("d1",): 2, ("d0", "l1"): 0, ("d2", "l0"): 0.25, ("d1", "l1", "s3"): 9, ("d2", "l2", "s1"): 0}
        s = mixing.Settings(weights=weights, share=rnd.choice([0.1, 0.6, 1.7, 5]), epochs=2, budget=rnd.choice([None, 4000]))
        df = spark.createDataFrame([(*k, n) for k, n in tree.items()], "__domain string, __lang string, __source string, n long")
        assert {tuple(r.values())[:3]: r["budget"] for r in rows(mixing.leaf_budgets(df, s))} == mixing.budgets(tree, s)
    assert rows(mixing.leaf_budgets(df.limit(0), s)) == []


def test_mixture_equals_a_plain_prefix(spark):
    rnd = random.Random(8)
    docs = [(i, "w " * rnd.randint(0, 30), rnd.choice(["en", "de", None]), rnd.choice(["src0", "src1", "src2", "odd"])) for i in range(400)]
    df = documents(spark, docs)
    for s in (MIX, mixing.Settings(weights=MIX.weights, share=2.2, epochs=4, few_leaves=3)):
        got = rows(mixing.mixture(df, s, domain_of()))
        assert len(got) == len(docs)
        leaves = {}
        for r in got:
            leaves.setdefault((r["domain"], r["lang"], r["source"]), []).append(r)
        plan = mixing.budgets({k: sum(r["n_tokens"] for r in v) for k, v in leaves.items()}, s)
        from pyspark.sql import functions as F

        for leaf, members in leaves.items():
            total = sum(r["n_tokens"] for r in members)
            whole, rest = divmod(plan[leaf], total) if total else (0, 0)
            ids = spark.createDataFrame([(r["doc_id"],) for r in members], "doc_id long")
            order = [r["doc_id"] for r in ids.orderBy(F.xxhash64(F.lit(s.seed), F.lit(whole).cast("long"), "doc_id"), "doc_id").collect()]
            tokens, upto, want = {r["doc_id"]: r["n_tokens"] for r in members}, 0, {}
            for i in order:
                upto += tokens[i]
                want[i] = whole + (upto <= rest and total > 0)
            assert {r["doc_id"]: r["draws"] for r in members} == want
        drawn = mixing.mixed(df, s, domain_of())
        assert drawn.columns == df.columns and drawn.count() == sum(r["draws"] for r in got)
    assert rows(mixing.mixture(empty(spark), MIX, domain_of())) == []
    assert len(rows(mixing.mixture(documents(spark), MIX, domain_of()))) == len(ODD)


def test_mixture_counts_tokens_of_a_vocabulary_exactly(spark):
    df = documents(spark)
    counted = {(r["doc_id"], r["n_tokens"]) for r in rows(token_counts.token_counts(df, f"{TOKENIZERS}/word_bpe_49k.json"))}
    got = rows(mixing.mixture(df, MIX, domain_of(), tokens_of))
    assert {(r["doc_id"], r["n_tokens"]) for r in got} == counted
    assert mixing.mixed(df, MIX, domain_of(), tokens_of).count() == sum(r["draws"] for r in got)
    large = spark.createDataFrame([("a", "x", "s", 10**15 // 4 + 1), ("a", "y", "s", 3)], "__domain string, __lang string, __source string, n long")
    s = mixing.Settings(weights={("a", "y"): 1e-9}, budget=10**15, epochs=4)
    assert {r["__lang"]: r["budget"] for r in rows(mixing._exact(large, s))} == {k[1]: v for k, v in mixing.budgets({("a", "x", "s"): 10**15 // 4 + 1, ("a", "y", "s"): 3}, s).items()}


def test_rows_without_an_id_are_spread_over_the_shards(spark):
    df = spark.createDataFrame([(i if i < 30 else None, f"t{i}") for i in range(90)], "doc_id long, text string").repartition(5)
    got = rows(sharding.sharded(df, sharding.Settings(shards=6)))
    by = {k: sorted(r["slot"] for r in got if r["shard"] == k) for k in range(6)}
    assert all(v == list(range(15)) for v in by.values())
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 6


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 250])
def test_contexts_cover_every_window_once(n):
    s = repeated_bytes.Settings()
    data = bytes(random.Random(n).randrange(97, 123) for _ in range(n))
    own, start, many, *_ = repeated_bytes.contexts([data, b"x" * 50], s)
    covered = sorted(p for a, m in zip(start.tolist(), many.tolist()) for p in range(a, a + m))
    assert covered == list(range(max(0, n - s.length + 1)))


def test_quality_votes_equal_plain_cosines_of_all_labelled_rows(spark):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "DELTA", "!!"]) for _ in range(rnd.randint(0, 12))), "en", "s") for i in range(150)]
    labels = spark.createDataFrame([(i, rnd.randint(0, 1)) for i in range(150)], "doc_id long, quality int")
    model = quality_vote.fit_quality(documents(spark, docs), labels, quality_vote.Settings(neighbours=5, dimensions=6))
    got = by_id(quality_vote.quality_scores(documents(spark, docs), model))
    words = quality_vote._Words(model.settings.buckets)
    vectors = [[float(x) for x in v] for v in model.vectors]
    for i, text, *_ in docs:
        own = [float(x) for x in model.project([quality_vote.bag(text, words)])[0]]
        near = [sum(a * b for a, b in zip(own, v)) for v in vectors]
        least = sorted(near)[-5]
        votes = [(max(c, 0) ** 2, y) for c, y in zip(near, model.votes) if c >= least - 1e-6]
        total = sum(w for w, _ in votes)
        assert abs(got[i]["score"] - (sum(w * y for w, y in votes) / total if total else model.prior)) < 1e-3


def test_quality_samples_only_labels_with_a_document(spark):
    docs = [(i, f"w{i}", "en", "s") for i in range(60)] + [(1, "a", "en", "s"), (1, "b", "en", "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)] + [(2, 1)], "doc_id long, quality int")
    learnt = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    model = quality_vote.fit_quality(documents(spark, docs), labels, quality_vote.Settings(sample_rows=1000))
    assert model.votes.tolist() == [i % 2 for i in learnt]
    assert len(quality_vote.fit_quality(documents(spark, docs), labels, quality_vote.Settings(sample_rows=20)).votes) == 20


def test_quality_of_held_out_documents(spark):
    """Held-out accuracy on the given tables."""
    from loomgraph.llm.common import table

    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scores = by_id(quality_vote.quality_scores(docs, quality_vote.fit_quality(docs, labels)))
    found = [(r["quality"], scores[r["doc_id"]]) for r in rows(labels) if r["quality"] is not None and r["doc_id"] in scores and scores[r["doc_id"]]["held_out"]]
    assert len(found) > 50 and sum(y == r["predicted"] for y, r in found) >= 0.97 * len(found)
