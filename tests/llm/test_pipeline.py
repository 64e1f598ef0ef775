import random
import re

import corpus_pipeline
from loomgraph.llm import mixing, quality_vote
from loomgraph.llm.queries import MIX, QUERIES, TOKENIZERS, domain_of, tokens_of
from tests.llm.helpers import documents, rows
from tests.llm.test_exact_and_near import plain_components


def test_stages_are_the_asked_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "sentencepiece"]
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in sorted(QUERIES, key=lambda q: int(re.match(r"op(\d+)_", q)[1]))] == list(range(1, 14))


def test_pipeline_equals_plain_versions_of_its_stages(spark, tmp_path):
    import sentencepiece

    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    docs = []
    for i in range(160):
        text = " ".join(rnd.choice(words) for _ in range(60)) if i % 4 else " ".join([rnd.choice(words)] * 60)
        docs.append((i, text, rnd.choice(["en", "de"]), f"src{i % 5}"))
    docs += [(200 + i, docs[i * 4 + 1][1].replace(" ", "  "), "en", "src0") for i in range(10)]  # equal but for spaces
    docs += [(300 + i, docs[i * 4 + 2][1] + " more", "en", "src1") for i in range(10)]  # nearly equal
    docs += [(400, None, None, None), (401, "", "en", "src0"), (None, "no id at all here", "en", "src2")]
    df = documents(spark, docs)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    model = quality_vote.fit_quality(df, labels)
    good = {r["doc_id"] for r in rows(quality_vote.quality_scores(df, model)) if r["predicted"]}
    assert {i for i in range(160) if i % 4} <= good and not {i for i in range(160) if i % 4 == 0} & good
    left = [d for d in docs if d[0] in good and d[0] is not None]
    unnamed = [d for d in docs if d[0] is None and None in good]
    groups = {}
    for i, text, *_ in left:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i))
    kept = {min(g)[1] for g in groups.values()}
    left = [d for d in left if d[0] in kept]
    near = plain_components([d[:2] for d in left], 5)
    left = [d for d in left if near[d[0]][1] == d[0]]
    draws = {r["doc_id"]: r["draws"] for r in rows(mixing.mixture(documents(spark, left + unnamed), MIX, domain_of(), tokens_of))}

    got = [r for r in rows(corpus_pipeline.run(spark, str(tmp_path)))]
    library = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    text = {i: t for i, t, *_ in docs}
    assert {i: sum(r["doc_id"] == i for r in got) for i in draws} == draws
    assert all(r["ids"] == library.encode(text[r["doc_id"]] or "") and r["round_trip"] for r in got)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == documents(spark, docs[:1]).columns, name
