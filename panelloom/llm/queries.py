"""The queries op1 .. op13 over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_trie, exact_dedup, merkle, near_dedup, packing, pieces, pii, quality, resample, suffix_dedup, token_store, top_inner, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


def vocabulary(name: str) -> str:
    """Where a vocabulary file of the public tokenizers lies."""
    return public_tokenizers.path(name)


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


@query("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents)
WINDOW same AS (PARTITION BY norm)
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = exact_dedup.decisions(docs).withColumnRenamed("digest", "text_sha256")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_store.read(spark, token_store.write(docs, vocabulary("byte_bpe_50k.json")))


@query()
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_dedup.near_duplicates(docs)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = {"_pl_p": "doc_evidence", "_pl_host": "host_share", "_pl_path": "path_share", "_pl_good": "good", "_pl_kept": "kept"}
    found = quality.classify(docs, labels, carry=["doc_id"])
    return found.select("doc_id", *(F.col(k).alias(v) for k, v in names.items()))


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
""")
def op6_top_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner.top_inner(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_FOLD = r"trim(regexp_replace(regexp_replace({}, '[\t\r\f\x0B ]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"


def _decode_sql(text: str) -> str:
    for name, sign in warc.ENTITIES.items():
        text = "replace({}, '{}', '{}')".format(text, name, sign.replace("'", "''"))
    # References by number, the ampersand's among them, in one step.
    parts, found = f"regexp_split_to_array(t, '{warc.NUMERIC}')", f"regexp_extract_all(t, '{warc.NUMERIC}')"
    number = "CASE WHEN lower(e[3]) = 'x' THEN CAST('0x' || e[4:-2] AS BIGINT) ELSE CAST(e[3:-2] AS BIGINT) END"
    sign = f"""CASE WHEN n BETWEEN 1 AND 55295 OR n BETWEEN 57344 AND 1114111
      THEN translate(chr(CAST(n AS INTEGER)), '{warc.OLD_FROM}', '{warc.OLD_TO}') ELSE chr(65533) END"""
    signs = f"list_transform(list_transform({found}, lambda e: {number}), lambda n: {sign})"
    joined = f"list_aggregate(list_transform(list_zip({parts}, {signs}), lambda z: z[1] || coalesce(z[2], '')), 'string_agg', '')"
    return f"list_transform([replace({text}, '&amp;', '&#38;')], lambda t: {joined})[1]"


def _uuid_sql(parts: str) -> str:
    return f"""(SELECT '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-a' || substr(h, 18, 3)
        || '-' || substr(h, 21, 12) || '>' FROM (SELECT sha256({parts}) AS h))"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_TEXT_SQL = f"regexp_replace(regexp_replace(regexp_replace(payload, {_quoted(warc._GONE)}, '', 'g'), {_quoted(warc._LINE)}, chr(10), 'g'), {_quoted(warc._TAG)}, '', 'g')"
_LINE_SQL = "replace({}, chr(10), ' ')"

WARC_SQL = f"""
WITH response AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS payload, chr(13) || chr(10) AS nl, chr(10) AS lf,
         'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=UTF-8' || nl || 'Content-Length: ' || strlen(payload) AS head,
         {_uuid_sql("'response' || lf || coalesce(CAST(page_id AS VARCHAR), '') || lf || coalesce(url, '') || lf || payload")} AS response_id
  FROM pages
), held AS (
  SELECT *, 'sha256:' || sha256(payload) AS payload_digest, 'sha256:' || sha256(head || nl || nl || payload) AS source_digest,
         {_FOLD.format(_LINE_SQL.format(_decode_sql(f"regexp_extract(payload, {_quoted(warc._TITLE)}, 1)")))} AS title,
         regexp_extract(payload, {_quoted(warc._LANG)}, 1) AS language,
         list_transform(regexp_extract_all(payload, {_quoted(warc._LINK)}, 1),
           lambda x: 'outlink: ' || {_FOLD.format(_LINE_SQL.format(_decode_sql("x")))} || nl) AS links
  FROM response
), block AS (
  SELECT page_id, response_id, target_uri, payload_digest, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
         'source-block-digest: ' || source_digest || nl || 'source-payload-digest: ' || payload_digest || nl
         || list_aggregate(list_transform(string_split(head, nl), lambda x: 'source-header: ' || x || nl), 'string_agg', '')
         || 'title: ' || title || nl || 'language: ' || language || nl
         || coalesce(list_aggregate(links, 'string_agg', ''), '') AS block, lf
  FROM held
  UNION ALL
  SELECT page_id, response_id, target_uri, payload_digest, 'conversion', 'text/plain; charset=UTF-8',
         {_FOLD.format(_decode_sql(_TEXT_SQL))}, lf
  FROM held
)
SELECT page_id, warc_type, {_uuid_sql("warc_type || lf || response_id")} AS record_id, response_id AS refers_to, target_uri,
       '{warc.NO_DATE}' AS warc_date, content_type, CAST(strlen(block) AS BIGINT) AS content_length,
       'sha256:' || sha256(block) AS block_digest, payload_digest AS source_payload_digest, block
FROM block
"""


@query(WARC_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


@query()
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query()
def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pieces.round_trips(docs, vocabulary("piece_bpe_32k.model"))


@query()
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The unsigned crc32 of a text's UTF-8 bytes: one step for each byte, from a table of the steps of all bytes.
_CRC_TABLE_SQL = """crc_steps AS (
  SELECT list(v ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)))"""


def _crc_sql(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"""


RESAMPLE_SQL = f"""
WITH {_CRC_TABLE_SQL},
texts AS (
  SELECT 0 AS target, row_number() OVER () AS id, doc_id, text FROM documents
  UNION ALL SELECT 1, -row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT target, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM texts
), runs AS (
  SELECT target, id, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS feature
  FROM words, range(1, 4) r(n)
), counted AS (SELECT target, id, feature, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (SELECT feature, {_crc_sql("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM counted), crc_steps),
buckets AS (
  SELECT bucket, sum(k) FILTER (target = 0) AS s, sum(k) FILTER (target = 1) AS t FROM counted JOIN hashed USING (feature) GROUP BY bucket
), totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM buckets),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM buckets, totals
), weights AS (
  SELECT id, sum(k) AS n, sum(k * gain) AS weight FROM counted JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY id
), scored AS (
  SELECT w.id, doc_id, len(w) >= 20 AS fit, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
      + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words w LEFT JOIN weights USING (id) WHERE target = 0
), placed AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fit) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""


@query(RESAMPLE_SQL)
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample.resample(docs, target)


_FIELD_SQL = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"


def _leaf_sql(n_chars: str) -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    return f"sha256({' || '.join(map(_FIELD_SQL.format, fields))})"


MERKLE_SQL = f"""
WITH RECURSIVE {_CRC_TABLE_SQL},
leaves AS (
  SELECT row_number() OVER () AS id, doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN {_crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS changed
  FROM documents, crc_steps
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes AS (
  SELECT lang, 0 AS level, rank, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, level + 1, rank // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY rank))
  FROM nodes WHERE n > 1 GROUP BY lang, level, rank // 2, n
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, count(*) OVER () AS langs FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, place, langs, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (langs + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM tops WHERE langs > 1 GROUP BY level, place // 2, langs
), siblings AS (
  SELECT p.id, 0 AS top, b.level, p.rank >> b.level & 1 AS digit, b.h
  FROM placed p JOIN nodes b ON b.lang IS NOT DISTINCT FROM p.lang AND b.n > 1 AND b.rank = xor(p.rank >> b.level, 1)
  UNION ALL
  SELECT p.id, 1, b.level, s.place >> b.level & 1, b.h
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN tops b ON b.langs > 1 AND b.place = xor(s.place >> b.level, 1)
), steps_up AS (
  SELECT p.id, 0 AS top, nd.level FROM placed p JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) nd ON nd.lang IS NOT DISTINCT FROM p.lang
  UNION ALL SELECT p.id, 1, t.level FROM placed p, (SELECT DISTINCT level FROM tops WHERE langs > 1) t
), ways AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY top, level) AS step, digit, h
  FROM steps_up LEFT JOIN siblings USING (id, top, level)
), folded AS (
  SELECT id, 0 AS step, coalesce(changed, leaf) AS h FROM placed
  UNION ALL
  SELECT f.id, f.step + 1, sha256(CASE WHEN w.h IS NULL THEN f.h WHEN w.digit = 1 THEN w.h || f.h ELSE f.h || w.h END)
  FROM folded f JOIN ways w ON w.id = f.id AND w.step = f.step + 1
)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN tops r ON r.langs = 1
LEFT JOIN (SELECT id, string_agg(h, '' ORDER BY step) AS proof FROM ways GROUP BY id) q ON q.id = p.id
JOIN (SELECT id, arg_max(h, step) AS h FROM folded GROUP BY id) f ON f.id = p.id
"""


@query(MERKLE_SQL)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.prove(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


@query()
def op13_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = bpe_trie.round_trip(docs, vocabulary("word_bpe_49k.json"))
    decimal = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
