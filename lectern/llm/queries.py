"""The registered queries of the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, chat_format, collocations, decontaminate, fertility, language_id, line_dedup, minmax, ngram_join, sharding, token_count, token_output, yinyang
from lectern.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.conversation_digest(table(spark, sf_dir, "conversations"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_count_digest(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_digest(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_file_digest(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_digest(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_digest(table(spark, sf_dir, "documents"))


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster_digest(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_decontamination, op2_sharding, op3_chat_format, op4_line_dedup, op5_token_counts,
        op6_quality_rules, op7_bpe, op8_token_output, op9_language_id, op10_ngram_join,
        op11_yinyang, op12_collocations, op13_minmax,
    )
    return {f.__name__: f for f in own}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS k, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bw),
dw AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hits AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM dw) JOIN win USING (k, g)),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY 1),
covered AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS at_word FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

_GUARD = r"regexp_replace({0}, '(<\|(?:turn|end|line)\|\\*|</?s\\*|\[/?INST\\*)([>\]])', '\1\\\2', 'g')"
OP3_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(16 + length(replace({_GUARD.format("role")}, chr(10), '<|line|>')) + length({_GUARD.format("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

def _linked_sql(words: int, percent: int, more: str = "") -> str:
    """Components of documents by all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + {words - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
r AS (SELECT a AS doc_id, b AS seen FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id{more}
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(seen) AS low FROM r GROUP BY 1) m ON m.doc_id = d.doc_id"""


OP10_SQL = _linked_sql(4, 85)
OP13_SQL = _linked_sql(3, 85, ", d.doc_id = component_id AS kept")



def _op11_sql(k: int = yinyang.K, rounds: int = yinyang.ROUNDS, dims: int = yinyang.DIMS, scale: int = yinyang.SCALE) -> str:
    """One table of distances, one of nearest centroids and one of means for each round."""
    parts = [
        f"e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS cluster, q AS c FROM e QUALIFY cluster < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"a{i} AS (SELECT vec_id, q, cluster, d FROM (SELECT vec_id, q, cluster, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e CROSS JOIN c{i})"
            " QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1)"
        )
        if i < rounds:
            parts += [
                f"m{i} AS (SELECT cluster, i, CAST(floor(sum(q[i]) / count(*)) AS BIGINT) AS x FROM a{i}, range(1, {dims + 1}) t(i) GROUP BY 1, 2)",
                f"c{i + 1} AS (SELECT cluster, coalesce(n, c) AS c FROM c{i} LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS n FROM m{i} GROUP BY 1) USING (cluster))",
            ]
    return f"""WITH {", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in parts)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


OP11_SQL = _op11_sql()

OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w CROSS JOIN range(1, 5) t(k) WHERE len(w) >= k) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND f >= 30),
s AS (SELECT c.lang, phrase, size, a, w, j, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS j FROM c) c
  JOIN (SELECT lang, phrase AS lp, f FROM g) l ON l.lang = c.lang AND lp = array_to_string(w[1:j], ' ')
  JOIN (SELECT lang, phrase AS rp, f FROM g) r ON r.lang = c.lang AND rp = array_to_string(w[j + 1:], ' ')),
best AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i FROM c CROSS JOIN range(2, 4) u(m) WHERE m < size) GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN inside USING (lang, phrase) JOIN t USING (lang)
WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT) QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """Tokenisers, hash functions and fitted models are beyond SQL; tests hold those queries against plain versions."""
    return {
        "op1_decontamination": OP1_SQL, "op3_chat_format": OP3_SQL, "op10_ngram_join": OP10_SQL,
        "op11_yinyang": OP11_SQL, "op12_collocations": OP12_SQL, "op13_minmax": OP13_SQL,
    }
