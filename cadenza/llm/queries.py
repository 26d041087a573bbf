"""The queries opN_<name> of this subpackage, each over its whole table."""

from __future__ import annotations

from . import chat, decontaminate, languages, media_chunks, near_dups, pieces, pii, quality, sst, token_counts, vocab
from .common import table


def op1_media_chunks(spark, sf_dir):
    return media_chunks.store_and_read(table(spark, sf_dir, "documents"))


def op2_sentence_pieces(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"), vocab.path("piece_bpe_32k.model"))


def op3_skip_chain_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op4_prefix_token_counts(spark, sf_dir):
    return token_counts.count(table(spark, sf_dir, "documents"), vocab.path("word_bpe_49k.json"))


def op5_budgeted_chat(spark, sf_dir):
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.windows(turns, vocab.path("word_bpe_49k.json")))


def op6_sst_shards(spark, sf_dir):
    return sst.write_and_read(table(spark, sf_dir, "documents"), vocab.path("byte_bpe_50k.json"), end_id=2)


def op7_language_bitmasks(spark, sf_dir):
    return languages.identify(table(spark, sf_dir, "documents"))


def op8_quality_bayes(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_string_tiling(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_minhash_near_dups(spark, sf_dir):
    return near_dups.cluster(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_media_chunks,
        op2_sentence_pieces,
        op3_skip_chain_pii,
        op4_prefix_token_counts,
        op5_budgeted_chat,
        op6_sst_shards,
        op7_language_bitmasks,
        op8_quality_bayes,
        op9_string_tiling,
        op10_minhash_near_dups,
    )
}

#: Exact links by a prefix filter over rare shingles, components by closure. The other nine run tokenizer files, learned models or kernels that SQL lacks.
NEAR_DUPS = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS c, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 1),
tokens AS (SELECT c, n, unnest(s) AS t FROM classes),
often AS (SELECT t, count(*) AS k FROM tokens GROUP BY t),
ranked AS (SELECT c, n, t, row_number() OVER (PARTITION BY c ORDER BY k, t) AS place FROM tokens JOIN often USING (t)),
heads AS (SELECT c, n, t FROM ranked WHERE place <= n - (85 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.c AS a, b.c AS b FROM heads a JOIN heads b ON a.t = b.t AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM pairs JOIN classes x ON x.c = a JOIN classes y ON y.c = b WHERE 100 * len(list_intersect(x.s, y.s)) >= 85 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b),
roots AS (SELECT a AS c, min(b) AS root FROM reach GROUP BY a)
SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(root, sets.doc_id) AS component_id, coalesce(root, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN classes ON classes.s = list_sort(sets.s) LEFT JOIN roots ON roots.c = classes.c
"""

ORACLE_SQL: dict[str, str] = {"op10_minhash_near_dups": NEAR_DUPS}
