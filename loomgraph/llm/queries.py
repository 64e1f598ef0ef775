"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.centroids import clustered
from loomgraph.llm.common import table
from loomgraph.llm.exact_dedup import exact_groups
from loomgraph.llm.language_id import fit_languages, languages
from loomgraph.llm.mpeg_audio import audio_features, with_audio
from loomgraph.llm.mixing import Settings as MixSettings
from loomgraph.llm.mixing import mixture
from loomgraph.llm.near_dedup import Settings as NearSettings
from loomgraph.llm.near_dedup import near_groups
from loomgraph.llm.phrases import collocations
from loomgraph.llm.quality_vote import fit_quality, quality_scores
from loomgraph.llm.repeated_bytes import repeated_bytes
from loomgraph.llm.sentencepiece_match import encoded
from loomgraph.llm.sharding import sharded
from loomgraph.llm.token_counts import token_counts, with_token_counts
from loomgraph.llm.warc import through_archives

#: Where the public tokenizer files lie.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), NearSettings(words=2))


#: The mixture: weights of domains and of languages within them; sources weigh the same.
MIX = MixSettings(
    weights={("web",): 0.5, ("books",): 0.3, ("forum",): 0.2}
    | {(d, lang): w for d in ("web", "books", "forum") for lang, w in (("en", 0.55), ("de", 0.15), ("fr", 0.15), ("es", 0.15))},
    share=0.6,
    epochs=3,
)


def domain_of():
    """The domain of a row of documents: sources are dealt to three by their number."""
    n = F.regexp_extract("source", "(\\d+)$", 1)
    return F.when(n == "", "web").otherwise(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("forum")), (n.cast("long") % 3).cast("int") + 1))


def tokens_of(rows: DataFrame) -> DataFrame:
    """What the mixture counts: tokens of a public word-piece vocabulary."""
    return with_token_counts(rows, f"{TOKENIZERS}/word_bpe_49k.json", name="__tokens")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), MIX, domain_of(), tokens_of)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_archives(table(spark, sf_dir, "pages"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def op7_quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model").drop("ids")


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(with_audio(table(spark, sf_dir, "documents")))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages(docs, fit_languages(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_warc": op5_warc,
    "op6_shard": op6_shard,
    "op7_quality_vote": op7_quality_vote,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_mpeg_audio": op10_mpeg_audio,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_collocations": op12_collocations,
    "op13_language_id": op13_language_id,
}


def _centroid_sql(rounds: int = 10) -> str:
    """Plain rounds over all vectors and centroids, one pair of common table expressions each."""
    steps = [r"""
        v AS MATERIALIZED (
          SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
          FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id, x) - 1 AS j, x AS c
          FROM v QUALIFY j < 8)"""]
    for i in range(rounds + 1):
        steps.append(f"""
        d{i} AS MATERIALIZED (
          SELECT id, arg_min({{'j': j, 'd': d}}, d * 8 + j) AS best
          FROM (SELECT id, j, list_sum(list_transform(range(1, 65), lambda p: (x[p] - c[p]) * (x[p] - c[p])))::BIGINT AS d FROM v, c{i})
          GROUP BY id)""")
        if i < rounds:
            steps.append(f"""
        s{i} AS MATERIALIZED (
          SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS c
          FROM (SELECT best.j AS j, p, sum(x[p])::BIGINT AS s, count(*) AS n FROM d{i} JOIN v USING (id), range(1, 65) AS r(p) GROUP BY best.j, p)
          GROUP BY j),
        c{i + 1} AS MATERIALIZED (SELECT j, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} USING (j))""")
    return f"""
        WITH {",".join(steps)}
        SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia,
               CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM d{rounds} JOIN v USING (id) JOIN c{rounds} ON c{rounds}.j = best.j"""


ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clustering": _centroid_sql(),
    "op12_collocations": r"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents),
        split AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
        f AS MATERIALIZED (
          SELECT lang, size, phrase, count(*) AS a
          FROM (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
                FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM split, range(1, 5) AS r(size)))
          GROUP BY lang, size, phrase HAVING count(*) >= 30),
        cut AS (
          SELECT c.lang, c.phrase, c.size, c.a, k, f1.a AS l, f2.a AS r, CAST(2000000::HUGEINT * c.a // (f1.a + f2.a) AS BIGINT) AS score
          FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size > 1) AS c
          JOIN f AS f1 ON f1.lang = c.lang AND f1.phrase = array_to_string(c.w[1:k], ' ')
          JOIN f AS f2 ON f2.lang = c.lang AND f2.phrase = array_to_string(c.w[k + 1:], ' ')),
        best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        longer AS (
          SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS a
          FROM (SELECT lang, a, w, n, unnest(range(1, size - n + 2)) AS i
                FROM (SELECT lang, a, size, string_split(phrase, ' ') AS w, unnest(range(2, size)) AS n FROM f WHERE size > 2))
          GROUP BY lang, array_to_string(w[i:i + n - 1], ' ')),
        ranked AS (
          SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.score
          FROM best AS b LEFT JOIN longer ON longer.lang = b.lang AND longer.phrase = b.phrase
          WHERE longer.a IS NULL OR 100 * longer.a < 80 * b.a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op1_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, coalesce(text, '') AS s, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents),
        r AS (
          SELECT doc_id, norm, length(s) AS n_chars,
                 first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(s) DESC, doc_id NULLS LAST) AS keep_id,
                 count(*) OVER (PARTITION BY norm) AS group_size
          FROM t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256, n_chars
        FROM r""",
}
