"""The corpus operators' queries, with SQL where it can express them."""

from __future__ import annotations

from siltflow.llm import flac, jaccard, mixing, quality, sharding, suffixes, tokens, topk, transcripts
from siltflow.llm.common import table

#: The folder of public tokenizer files, if not that of the installed module.
TOKENIZERS: str | None = None


def vocabulary(name: str) -> str:
    import public_tokenizers

    return f"{TOKENIZERS}/{name}" if TOKENIZERS else public_tokenizers.path(name)


def pre_token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_pu_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_suffix_dedup(spark, sf_dir):
    return suffixes.dedup(table(spark, sf_dir, "documents"))


def op3_flac_media(spark, sf_dir):
    return flac.read_media(flac.write_media(table(spark, sf_dir, "documents")))


def op4_chunked_bpe(spark, sf_dir):
    return tokens.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pre_token_pattern())


def op5_prefix_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_histogram_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_viterbi_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return transcripts.format_transcripts(transcripts.plain_transcripts(turns), "conv_id", model=transcripts.train(turns), truth="true_lines")


def op8_best_fit_shards(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_prefix_tree_join(spark, sf_dir):
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op10_scheduled_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pu_quality, op2_suffix_dedup, op3_flac_media, op4_chunked_bpe, op5_prefix_counts, op6_histogram_topk, op7_viterbi_chat, op8_best_fit_shards, op9_prefix_tree_join, op10_scheduled_mix, pipeline)}

ORACLE = {
    "op6_histogram_topk": """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op9_prefix_tree_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS gram
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)),
r AS (SELECT a AS doc_id, a AS reach FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT doc_id, min(reach) AS root FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
}
