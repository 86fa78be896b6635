"""One registered query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The path of an installed public tokenizer file; all workers have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import document_path, license_scan

    docs = _table(spark, sf_dir, "documents")
    return license_scan(docs.select("doc_id", document_path().alias("path"), "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(_table(spark, sf_dir, "documents"))


def op4_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k_search

    return top_k_search(_table(spark, sf_dir, "embeddings"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import document_fingerprints

    return document_fingerprints(_table(spark, sf_dir, "documents"))


def op5_whole_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import document_fingerprints

    return document_fingerprints(_table(spark, sf_dir, "documents"), whole=True)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import WEIGHTS, document_levels, mix_sources

    mixed = mix_sources(_table(spark, sf_dir, "documents"), document_levels(), WEIGHTS)
    return mixed.where("copies > 0").select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import read_token_digests, write_token_shards

    shards = write_token_shards(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return read_token_digests(shards)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_classifier

    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import piece_digests

    return piece_digests(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_digests, secret_spans

    return secret_digests(secret_spans(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_top_k_search": op4_top_k_search,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op5_whole_fingerprints": op5_whole_fingerprints,
    "op6_mix_sources": op6_mix_sources,
    "op7_token_shards": op7_token_shards,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_sentence_pieces": op9_sentence_pieces,
    "op10_secret_scan": op10_secret_scan,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""

_FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(min(text), '') AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
n AS (
  SELECT doc_id, text, length(text) AS n_chars,
    coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following,
    coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id
  FROM d
), e AS (
  SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(following, 1, n_chars // 2) AS edited FROM n
), own AS (
  SELECT DISTINCT doc_id, 0 AS side, term FROM (SELECT doc_id, unnest({_WORDS.format("lower(text)")}) AS term FROM e)
), words AS (
  SELECT * FROM own UNION ALL
  SELECT DISTINCT doc_id, 1 AS side, term FROM (SELECT doc_id, unnest({_WORDS.format("lower(edited)")}) AS term FROM e)
), lexicon AS (
  SELECT term FROM own GROUP BY term
  HAVING count(*) >= greatest(2.0, 0.0005 * (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL))
     AND count(*) <= 0.05 * (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL)
), parts AS (
  SELECT term, r FROM lexicon, (SELECT unnest(range(32)) AS r) WHERE substr(md5(r || ':' || term), 1, 2) < '02'
), signed AS (
  SELECT doc_id, side, r, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS s
  FROM words JOIN parts USING (term) GROUP BY doc_id, side, r
), prints AS (
  SELECT doc_id, side, list(coalesce(s, '.') ORDER BY r) AS f
  FROM (SELECT doc_id, side, r FROM e, (SELECT unnest([0, 1]) AS side), (SELECT unnest(range(32)) AS r))
  LEFT JOIN signed USING (doc_id, side, r) GROUP BY doc_id, side
), pairs AS (
  SELECT e.*, a.f AS a, b.f AS b, c.f AS c, x.text AS next_text
  FROM e JOIN prints a ON a.doc_id = e.doc_id AND a.side = 0 JOIN prints b ON b.doc_id = e.doc_id AND b.side = 1
  JOIN prints c ON c.doc_id = e.next_id AND c.side = 0 JOIN d x ON x.doc_id = e.next_id
), told AS (
  SELECT *, list_filter(list_zip(a, b), lambda p: p[1] <> '.' OR p[2] <> '.') AS ab, list_filter(list_zip(a, c), lambda p: p[1] <> '.' OR p[2] <> '.') AS ac
  FROM pairs
)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(a, '-') AS fingerprint, array_to_string(b, '-') AS edited_fingerprint,
  CASE WHEN text = edited THEN 1.0::DOUBLE WHEN len(ab) = 0 THEN 0.0::DOUBLE
    ELSE len(list_filter(ab, lambda p: p[1] = p[2]))::DOUBLE / len(ab) END AS near_edited,
  CASE WHEN text = next_text THEN 1.0::DOUBLE WHEN len(ac) = 0 THEN 0.0::DOUBLE
    ELSE len(list_filter(ac, lambda p: p[1] = p[2]))::DOUBLE / len(ac) END AS near_next
FROM told
"""


def _mix_sql() -> str:
    levels, sql = ["domain", "lang", "source"], ""
    from .mixing import WEIGHTS

    for i, level in enumerate(levels):
        weight = " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in WEIGHTS.get(level, {}).items())
        weight = f"CASE {weight} ELSE 1 END" if weight else "1"
        up, own = levels[:i], ", ".join(levels[: i + 1])
        part = f"PARTITION BY {', '.join(up)}" if up else ""
        joined = f"JOIN b{i} USING ({', '.join(up)})" if up else ", b0"
        sql += f"""
n{i} AS (SELECT {own}, sum(cap) AS cap, {weight} AS weight FROM leaves GROUP BY {own}),
o{i} AS (
  SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM n{i} {joined} WINDOW w AS ({part} ORDER BY cap / weight, {level})
), p{i} AS (
  SELECT *, min(CASE WHEN cap * open <= weight * greatest(budget - spent, 0) THEN 1 ELSE 0 END)
    OVER ({part} ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM o{i}
), b{i + 1} AS (
  SELECT {own}, CAST(CASE WHEN filled = 1 THEN cap ELSE greatest(weight * (budget - sum(filled * cap) OVER ({part}))
    // sum((1 - filled) * weight) OVER ({part}), 0) END AS HUGEINT) AS budget FROM p{i}
),"""
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN md5(coalesce(source, '')) < '6' THEN 'web' WHEN md5(coalesce(source, '')) < 'c' THEN 'forum' ELSE 'books' END AS domain,
    CAST(coalesce(len({_WORDS.format("text")}), 0) AS BIGINT) AS n_tokens
  FROM documents WHERE doc_id IS NOT NULL
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens) AS tokens, 2 * sum(n_tokens) AS cap FROM t GROUP BY domain, lang, source
), b0 AS (SELECT least(sum(tokens) // 2, sum(cap)) AS budget FROM leaves),{sql}
quota AS (
  SELECT domain, lang, source, budget // tokens AS whole, budget % tokens AS rest
  FROM leaves JOIN b3 USING (domain, lang, source) WHERE budget > 0
), k AS (
  SELECT t.*, whole, rest, sum(n_tokens) OVER (
    PARTITION BY domain, lang, source ORDER BY md5('17:' || whole || ':' || doc_id)) AS upto
  FROM t JOIN quota USING (domain, lang, source)
), c AS (
  SELECT *, CAST(whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM k
)
SELECT doc_id, domain, lang, source, n_tokens, copies FROM c WHERE copies > 0
"""


ORACLE_SQL: dict[str, str] = {
    "op4_top_k_search": _TOP_K,
    "op5_document_fingerprints": _FINGERPRINTS,
    "op6_mix_sources": _mix_sql(),
}
