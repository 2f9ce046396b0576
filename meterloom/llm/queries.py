"""The registered queries of this subpackage: each applies an operator, with production parameters,
to its whole table. SQL has what DuckDB can say of a result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, level_packing, lexical, licenses, lm, mixing, multi_index, ngram_join, packing, pii, quality, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, new = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = F.col(new["size"]) * F.col(new["copies"])
    return out.select("doc_id", *[F.col(new[c]).alias(c) for c in ("size", "source_size", "target")], taken.alias("taken"), F.col(new["copies"]).alias("copies"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


#: A conversation that says the template's control strings; it comes as a record of another layout.
CONTROL_RECORD = '{"id": -7, "messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat.canonical(table(spark, sf_dir, "conversations"))
    more = spark.range(1).select(F.lit(CONTROL_RECORD).alias("record"))
    return chat.digest(chat.format_conversations(conversations.unionByName(chat.canonical(more))))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents"), kinds="kinds")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_level_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_packing.pack_online(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_license_scan,
        op3_ngram_jaccard_join,
        op4_source_mixing,
        op5_lm_scoring,
        op6_chat_formatting,
        op7_embedding_near_dedup,
        op8_quality_rules,
        op9_pii_pseudonyms,
        op10_url_filter,
        op11_lexical_search,
        op12_hard_negatives,
        op13_level_packing,
    )
}

_W = r"'[^\x20\x09-\x0D]+'"

_TERM, _UPPER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SQL = {
    "op4_source_mixing": f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_W})), 0)::BIGINT AS size, coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(md5(text), 'null') || '|' || coalesce(source, 'null') AS k FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS ss FROM d GROUP BY source),
w AS (SELECT source, ss, 1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS w, sum(ss) OVER () AS total FROM s),
o AS (SELECT *, coalesce(sum(3 * ss) OVER (ORDER BY ss::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY ss::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
f AS (SELECT before, rest FROM o WHERE (total - before) * w <= 3 * ss * rest ORDER BY ss::DOUBLE / w LIMIT 1),
t AS (SELECT source, ss, CASE WHEN (total - f.before) * w > 3 * ss * f.rest THEN (3 * ss)::DOUBLE ELSE (total - f.before)::DOUBLE * w / f.rest::DOUBLE END AS target FROM o, f),
r AS (SELECT d.doc_id, d.size, t.ss, t.target, CASE WHEN t.ss > 0 THEN t.target / t.ss ELSE 0 END AS rate,
  ('0x' || substr(md5(k || '|' || row_number() OVER (PARTITION BY k) || '|mix'), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, ss::BIGINT AS source_size, target, (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT AS copies,
  (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM r""",
    "op3_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, {_W}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS cls FROM g GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY cls) AS class_id, count(*) OVER (PARTITION BY cls) AS n_copies FROM n),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE both_ >= 0.8 * (x.n + y.n - both_)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(c.class_id, w.doc_id) AS class_id, coalesce(c.n_copies, 1)::BIGINT AS n_copies,
  (SELECT count(*) FROM l WHERE l.a = w.doc_id)::BIGINT AS n_links, (SELECT min(b) FROM r WHERE r.a = w.doc_id) AS component_id
FROM w LEFT JOIN c USING (doc_id)""",
    "op6_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'prompter' THEN 'user' ELSE role END, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(k, r)),
e AS (SELECT *, regexp_replace(regexp_replace(replace(role, '\', '\\'), '(<)(s>|/s>|\|)|(\|)(>)|(\[)(INST\]|/INST\])', '\1\3\5\\\2\4\6', 'g'), '', '') AS er,
  regexp_replace(replace(text, '\', '\\'), '(<)(s>|/s>|\|)|(\|)(>)|(\[)(INST\]|/INST\])', '\1\3\5\\\2\4\6', 'g') AS et FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length(er) + length(et) + 10)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
    "op11_lexical_search": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}') AS w FROM documents),
n AS (SELECT doc_id, len(w)::BIGINT AS n, w FROM d WHERE len(w) > 0),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}'))) AS t FROM benchmark),
p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM n) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t, nn),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll))))::BIGINT AS score FROM q JOIN p USING (t) JOIN f USING (t), g GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3""",
    "op7_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id""",
}
