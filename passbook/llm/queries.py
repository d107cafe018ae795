"""Registered queries of the text operators, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attribution import line_tokens
from .classlm import score_texts
from .common import table
from .crosspolytope import nearest
from .dedup import exact_duplicates
from .lines import drop_common_lines
from .negatives import hard_negatives
from .packing import Limits, pack_documents
from .phrases import collocations
from .pieces import encode_sampled
from .pii import find_spans, fit_span_model
from .simhash import near_duplicates
from .toxicity import score, train
from .warc import ENTITIES, HIDDEN, LANGUAGE, LINES, LINK, TAGS, TITLE, derivatives, responses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query("op1_sampled_pieces")
def op1_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document: how many pieces, a checksum of the ids, and that they decode back."""
    docs = table(spark, sf_dir, "documents")
    return encode_sampled(docs, sharpness=1.0, seed=42).select("doc_id", "n_pieces", "ids_crc32", "lossless")


@query("op2_class_ngram_scores")
def op2_class_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the class model learnt from those outside the held-out seventh."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_texts(table(spark, sf_dir, "documents"), held_out)


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), Limits(tokens=1024))


@query("op4_pii_weak_supervision")
def op4_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = find_spans(docs, fit_span_model(docs))
    numbers = [f"n_{k}" for k in ("email", "ip", "card", "phone")]
    digest = F.sha2(F.encode("base_spans", "UTF-8"), 256)
    return found.select("doc_id", *numbers, digest.alias("base_sha256"), "spans")


@query(
    "op6_exact_dedup",
    r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""",
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"), all_digests=True).drop("twins")


@query("op7_simhash_anchor_cover")
def op7_simhash_anchor_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its 3-word SimHash and its class of links within two bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=2)


@query("op10_token_attribution")
def op10_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token across a line's end belongs to the line it starts in."""
    return line_tokens(table(spark, sf_dir, "documents"), "first")


@query("op8_subsequence_toxicity")
def op8_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of those outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    machine = train(docs, table(spark, sf_dir, "labels").where(~held_out))
    read = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return score(read, machine).select("doc_id", "held_out", "score", "predicted")


@query("op5_cross_polytope_neighbours")
def op5_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, among all others."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_phrase_collocations",
    rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(list_transform(string_split_regex({LOWERED}, '[.,;:!?\x0A-\x0D]'),
                               lambda p: list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> ''))) AS w
  FROM documents
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
sized AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS size FROM pieces),
runs AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM sized WHERE len(w) >= size
), often AS (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
parted AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE size > 1),
starts AS (SELECT lang, size, w, a, unnest(range(1, size)) AS i FROM parted),
inner_runs AS (
  SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(2, size)) AS m FROM starts) WHERE i + m - 1 <= size
), longer AS (SELECT lang, phrase, max(a) AS most FROM inner_runs GROUP BY ALL),
left_over AS (
  SELECT p.* FROM parted p LEFT JOIN longer USING (lang, phrase)
  WHERE most IS NULL OR CAST(most AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80
), cuts AS (
  SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM left_over)
), halves AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r,
         CAST(CAST(c.a AS HUGEINT) * 2000000 // (CAST(h.f AS HUGEINT) + t.f) AS BIGINT) AS score
  FROM cuts c JOIN often h ON h.lang = c.lang AND h.phrase = c.head JOIN often t ON t.lang = c.lang AND t.phrase = c.tail
), weakest AS (
  SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest JOIN totals USING (lang)
QUALIFY rank <= 2000
""",
)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 phrases of 2 to 4 words that hold together most firmly."""
    return collocations(table(spark, sf_dir, "documents"), longest=4, least=30, top=2000).drop("some_key", "some_byte")


@query(
    "op12_line_dedup",
    rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split({LOWERED}, chr(10))) AS key, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents
), keyed AS (SELECT doc_id, place, line, trim(key, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more share: counts, and a digest of what stays."""
    kept = drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query(
    "op13_hard_negatives",
    """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM pairs WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.alike
 AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
""",
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rows of another label in the window below each of the first five positives of every anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_decoded(text: str) -> str:
    for name, sign in ENTITIES:
        text = f"replace({text}, {_quoted(name)}, {_quoted(sign)})"
    return text


def _sql_line(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[ \t\r\n\f\x0b]+', ' ', 'g'), ' ')"


def _sql_urn(name: str) -> str:
    parts = ", ".join(f"substr(md5({name}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || concat_ws('-', {parts}) || '>'"


def _sql_text() -> str:
    text = "payload"
    for pattern, by in ((HIDDEN, "''"), (LINES, "chr(10)"), (TAGS, "''")):
        text = f"regexp_replace({text}, {_quoted(pattern)}, {by}, 'g')"
    text = rf"regexp_replace({_sql_decoded(text)}, '[ \t\r\f\x0b]+', ' ', 'g')"
    return rf"trim(regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"


_CRLF = "chr(13) || chr(10)"
_LINK = _sql_line(_sql_decoded("x"))
OP9_SQL = rf"""
WITH source AS (
  SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS payload,
         'sha256:' || sha256(coalesce(html, '')) AS source_digest
  FROM pages
), named AS (
  SELECT *, {_sql_urn("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || uri || '|' || source_digest")} AS refers_to,
         regexp_extract(uri, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0) AS origin,
         regexp_extract(uri, '^[^?#]*', 0) AS path,
         'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: '
           || CAST(strlen(payload) AS VARCHAR) || {_CRLF} AS source_headers,
         list_transform(regexp_extract_all(payload, {_quoted(LINK)}, 1), lambda x: {_LINK}) AS raw
  FROM source
), linked AS (
  SELECT *, list_transform(raw, lambda l: CASE
      WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN l
      WHEN starts_with(l, '//') THEN regexp_extract(uri, '^[A-Za-z0-9+.-]*:', 0) || l
      WHEN starts_with(l, '/') THEN origin || l
      WHEN starts_with(l, '#') OR starts_with(l, '?') THEN path || l
      WHEN path = origin THEN origin || '/' || l
      ELSE regexp_extract(path, '^.*/', 0) || l END) AS links,
    {_sql_urn("'metadata|' || refers_to")} AS about_id, {_sql_urn("'conversion|' || refers_to")} AS text_id
  FROM named
), records AS (
  SELECT *, 'metadata' AS record_type, about_id AS record_id, text_id AS concurrent_to,
    'application/warc-fields' AS content_type,
    'title: ' || {_sql_line(_sql_decoded(f"regexp_extract(payload, {_quoted(TITLE)}, 1)"))} || {_CRLF}
      || 'language: ' || {_sql_line(f"regexp_extract(payload, {_quoted(LANGUAGE)}, 1)")} || {_CRLF}
      || 'outlinks: ' || CAST(len(links) AS VARCHAR) || {_CRLF}
      || coalesce(array_to_string(list_transform(links, lambda l: 'outlink: ' || l || {_CRLF}), ''), '') AS block
  FROM linked
  UNION ALL
  SELECT *, 'conversion', text_id, about_id, 'text/plain; charset=utf-8', {_sql_text()} FROM linked
)
SELECT page_id, record_type, record_id, refers_to, uri AS refers_to_target_uri,
       '1970-01-01T00:00:00Z' AS refers_to_date, concurrent_to, source_headers, source_digest, content_type,
       CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, block
FROM records
"""


@query("op9_warc_derivatives", OP9_SQL)
def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and conversion records of every page."""
    return derivatives(responses(table(spark, sf_dir, "pages")))
