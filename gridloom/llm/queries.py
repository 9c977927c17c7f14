"""The registered queries of the corpus operators, and their DuckDB equivalents where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codebooks, fingerprints, infill, langid, mixing, nearjoin, pieces, pii, secrets, substrings, suffixes, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs, secrets.fit(docs)))


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@_query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_next(_table(spark, sf_dir, "documents"))


@_query
def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pii.pseudonymise(docs, key="corpus-key-1")
    return done.select("doc_id", "text", *pii.counted(done))


@_query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.plan(mixing.sized(docs)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op4_mix_sources"] = r"""
WITH items AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM items GROUP BY source
), weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM sources
), filled AS (
  SELECT *, row_number() OVER o AS position,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, rank)
), leveled AS (
  SELECT *, cap / weight <= level AS is_full FROM filled
), targets AS (
  SELECT *, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT min_by(level, position) FROM leveled WHERE NOT is_full) END AS target FROM leveled
), streams AS (
  SELECT i.*, t.rank, t.source_size, t.target,
         sum(size) OVER (PARTITION BY i.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM items i JOIN targets t ON i.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, CASE WHEN target > 0 THEN CAST(cum + c * source_size AS DOUBLE) / target ELSE 0 END AS finish
  FROM streams CROSS JOIN (VALUES (0), (1)) AS v(c)
), queued AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, c, k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM copies
)
SELECT doc_id, CAST(any_value(size) AS BIGINT) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(coalesce(sum(size) FILTER (WHERE spent <= (SELECT sum(size) * 1.5 FROM items)), 0) AS BIGINT) AS taken
FROM queued GROUP BY doc_id, source, k
"""


@_query
def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op2_warc_round_trip"] = r"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS b FROM pages
), firsts AS (
  SELECT h, min(page_id) AS first_id FROM hashed GROUP BY h
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
         + 16 * CAST(substr(b, 5 * i + 1, 1) AS BIGINT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS BIGINT) + 4 * CAST(substr(b, 5 * i + 3, 1) AS BIGINT)
         + 2 * CAST(substr(b, 5 * i + 4, 1) AS BIGINT) + CAST(substr(b, 5 * i + 5, 1) AS BIGINT) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM hashed JOIN firsts USING (h)
"""


@_query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL["op9_exact_top_k"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


#: The tokenizer file; the driver reads it and ships the model, whose size is fixed.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@_query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.round_trip(docs, pieces.load(PIECE_MODEL))
    return found.select("doc_id", "n_pieces", "pieces_sha256", "decoded_sha256", "exact")


@_query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.link(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty; rows without doc_id come last; rows equal in both are one document."""
    found = suffixes.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty and stay plain; a row without doc_id draws as "null"."""
    return infill.digest(infill.transform(_table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE_SQL["op12_fill_in_middle"] = r"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(t) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM tokens
), placed AS (
  SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
  SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:], '') AS suffix FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut
"""


@_query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null, hold null or non-finite components or differ in length take no part."""
    return codebooks.compress(_table(spark, sf_dir, "embeddings"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after the other, each an assignment and its new entries."""

    def assigned(book: str) -> str:
        return f"""(SELECT p.vec_id, p.label, p.part, p.x, min({{'d': list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'entry': c.entry}}) AS m
  FROM p JOIN {book} c USING (part) GROUP BY ALL)"""

    steps = [
        f"""a{i} AS MATERIALIZED {assigned(f"c{i}")}, n{i} AS (
  SELECT part, entry, list(mean ORDER BY place) AS x FROM (
    SELECT part, m.entry AS entry, place, CAST(floor(CAST(sum(x[place]) AS DOUBLE) / count(*)) AS BIGINT) AS mean
    FROM a{i}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS place) GROUP BY ALL) GROUP BY ALL
), c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN n{i} n USING (part, entry))"""
        for i in range(rounds)
    ]
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, label, part, e[part * (len(e) // {parts}) + 1 : (part + 1) * (len(e) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS part)
), c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < {entries}
), {", ".join(steps)}, z AS (
  SELECT vec_id, label, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM {assigned(f"c{rounds}")} GROUP BY ALL
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM z
"""


ORACLE_SQL["op13_vector_codes"] = _codes_sql()
