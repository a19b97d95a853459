"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunspan.llm import bpe, divergence, embeddings, importance, jaccard, licenses, media, mixing, quality, secrets, substring, toxicity, warc
from sunspan.llm._arrow import shared_dir, stored
from sunspan.llm._labels import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.transcode(docs, "text", public_tokenizers.path(TOKENIZER))
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "mix_slot", "mix_pos", "mix_exact")


ORACLES["op3_mixing"] = """
WITH RECURSIVE docs AS (
    SELECT doc_id, source, coalesce('=' || source, '') AS key,
           md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':0') AS h
    FROM documents),
counted AS (SELECT key, count(*) AS n_rows, pow(CAST(count(*) AS DOUBLE), 0.5) AS weight FROM docs GROUP BY key),
asked AS (SELECT key, n_rows, weight / sum(weight) OVER () * 100000 AS asked FROM counted),
shares AS (SELECT key, n_rows, CASE WHEN asked >= 2 THEN asked * (100000 - (SELECT count(*) FROM asked WHERE asked < 2)) / (SELECT sum(asked) FROM asked WHERE asked >= 2) ELSE 1 END AS share FROM asked),
parts AS (
    SELECT key, n_rows, row_number() OVER (ORDER BY key) AS i,
           CAST(floor(share) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, key) <= 100000 - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS p FROM shares),
lists AS (
    SELECT list(p ORDER BY i) AS ps, CAST(sum(p) AS BIGINT) AS whole,
           least(100000, max(CAST(ceil(ceil(n_rows / 16.0) * (SELECT sum(p) FROM parts) / p) AS BIGINT))) AS length FROM parts),
fold(t, done, j) AS (
    SELECT CAST(-1 AS BIGINT), list_transform(ps, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM lists
    UNION ALL
    SELECT t + 1, list_transform(range(1, len(ps) + 1), lambda i: CAST(done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END AS BIGINT)), pick
    FROM (SELECT t, done, ps,
                 list_min(list_transform(
                     list_filter(range(1, len(ps) + 1), lambda i: done[i] * whole < (t + 2) * ps[i]),
                     lambda i: ((done[i] + 1) * whole + ps[i] - 1) // ps[i] * 10000 + i)) % 10000 AS pick
          FROM fold, lists WHERE t < length - 1)),
slots AS (SELECT s.key, s.n_rows, l.length, f.t AS slot, row_number() OVER (PARTITION BY f.j ORDER BY f.t) - 1 AS k,
                 count(*) OVER (PARTITION BY f.j) AS q
          FROM fold f JOIN parts s ON s.i = f.j CROSS JOIN lists l WHERE f.t >= 0),
first_empty AS (
    SELECT min(floor(ceil(n_rows / 16.0) / q) * length + slot) AS e FROM slots
    WHERE k = CAST(ceil(n_rows / 16.0) AS BIGINT) % q),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY h, doc_id) - 1 AS number FROM docs),
placed AS (
    SELECT n.doc_id, n.source, CAST((n.number // 16) // s.q * s.length + s.slot AS BIGINT) AS mix_slot,
           CAST(n.number % 16 AS BIGINT) AS mix_pos
    FROM numbered n JOIN slots s ON s.key = n.key AND s.k = (n.number // 16) % s.q)
SELECT doc_id, source, mix_slot, mix_pos, mix_slot < e AS mix_exact FROM placed, first_empty
"""


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, "text").drop("text")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.span_text("secret_spans", secrets.KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text("secret_spans").alias("spans"),
    )


@query
def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = stored(media.store_text(docs, "text"), "media")
    read = media.read_media(kept).withColumn("payload", media.whole_payload())
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";", F.concat(F.lit("frames="), F.size("frame_offsets")), F.concat(F.lit("samples="), "samples"), F.concat(F.lit("rate="), "sample_rate"),
            F.concat(F.lit("crc_bad="), "crc_bad"), F.concat(F.lit("seek="), F.sha2(F.array_join(F.col("frame_offsets").cast("array<string>"), ",").cast("binary"), 256)),
        ).alias("feature"),
    )


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    records = warc.read_records(spark, path)
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", F.sha2("record", 256).alias("record_sha256"))


_UUID = "'urn:uuid:' || {0}[1:8] || '-' || {0}[9:12] || '-8' || {0}[14:16] || '-8' || {0}[18:20] || '-' || {0}[21:32]"
_END = "chr(13) || chr(10)"
ORACLES["op7_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(url, ''), '[\\r\\n]', '%0A', 'g') AS url,
                  sha1(coalesce(html, '')) AS h, sha256(coalesce(html, '')) AS s FROM pages),
f AS (SELECT html, min(page_id) AS first_id, min_by(url, page_id) AS first_url FROM p GROUP BY html),
d AS (SELECT p.*, f.first_id, f.first_url, octet_length(encode(p.html)) AS n, p.page_id <> f.first_id AS again,
             sha256(p.page_id || '|' || p.s) AS mine, sha256(f.first_id || '|' || p.s) AS theirs,
             list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 CAST(1 + ((CAST('0x' || substr(p.h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS UBIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) AS BIGINT), 1)),
                 'string_agg', '') AS digest
      FROM p JOIN f ON p.html = f.html)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to,
       sha256('WARC/1.1' || {_END} || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || {_END}
           || 'WARC-Record-ID: <' || {_UUID.format("mine")} || '>' || {_END} || 'WARC-Date: {warc.EPOCH}' || {_END} || 'WARC-Target-URI: ' || url || {_END}
           || 'WARC-Payload-Digest: sha1:' || digest || {_END}
           || CASE WHEN again THEN 'WARC-Profile: {warc.REVISIT_PROFILE}' || {_END} || 'WARC-Refers-To: <' || {_UUID.format("theirs")} || '>' || {_END}
                || 'WARC-Refers-To-Target-URI: ' || first_url || {_END} || 'WARC-Refers-To-Date: {warc.EPOCH}' || {_END} ELSE '' END
           || 'Content-Type: text/html' || {_END} || 'Content-Length: ' || CASE WHEN again THEN 0 ELSE n END || {_END} || {_END}
           || CASE WHEN again THEN '' ELSE html END || {_END} || {_END}) AS record_sha256
FROM d
"""


@query
def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", k=13)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_documents(table(spark, sf_dir, "documents"), "doc_id", "text", k=5, percent=75)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", (3, 1))
    scored = toxicity.score(docs, model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", toxicity.predicted().alias("predicted"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", (5, 0))
    scored = quality.score(docs, model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", quality.predicted().alias("predicted"))


@query
def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.95)


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")
    base = F.filter("license_places", lambda p: p["phrase"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("license_places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("license_places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


@query
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LOWER_SQL = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op11_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({LOWER_SQL.format("text")}, '{divergence.TERM}') AS ts FROM documents),
terms AS (SELECT doc, lang, source, term, count(*) AS n FROM (SELECT doc, lang, source, unnest(ts) AS term FROM d) t GROUP BY ALL),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(*) >= 30),
groups AS (SELECT DISTINCT lang, source FROM d),
grid AS (SELECT g.lang, g.source, k.term, coalesce(sum(t.n), 0) AS n
         FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN terms t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term
         GROUP BY g.lang, g.source, k.term),
shares AS (SELECT *, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p,
                  1 + 1000000000 * (sum(n) OVER (PARTITION BY lang, term) + 5)
                      // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang, source)) AS q FROM grid),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f
          FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.f, 0) AS BIGINT) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN apart f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
found AS (SELECT * FROM pairs UNION ALL
          SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM placed WHERE part = 'pair' OR rank <= 50
"""

ALNUM_SQL = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WHERE = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {0}), lambda c, b: xor(c >> 8, CAST(tab[CAST(1 + (xor(c, b) & 255) AS BIGINT)] AS BIGINT)))"

ORACLES["op13_importance"] = f"""
WITH RECURSIVE bits(i, k, c) AS (
    SELECT range, 0, CAST(range AS BIGINT) FROM range(256)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
w AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, {ALNUM_SQL.format(LOWER_SQL.format("text"))} AS ws FROM documents
      UNION ALL SELECT 'b', -row_number() OVER (), NULL, {ALNUM_SQL.format(LOWER_SQL.format("text"))} FROM benchmark),
features AS (
    SELECT side, r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w),
bags AS (SELECT side, r, f, count(*) AS n FROM features GROUP BY side, r, f),
names AS (SELECT f, hex(encode(f)) AS h, octet_length(encode(f)) AS size FROM (SELECT DISTINCT f FROM bags) t),
hashed AS (SELECT f, xor({_WHERE.format("list_transform(range(0, size), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))")}, 4294967295) % 10000 AS bucket
           FROM names, crc),
counts AS (SELECT h.bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END) AS t
           FROM bags g JOIN hashed h ON h.f = g.f GROUP BY h.bucket),
wholes AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM counts),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM counts, wholes),
sums AS (SELECT g.r, sum(g.n) AS n, sum(g.n * x.gain) AS total FROM bags g JOIN hashed h ON h.f = g.f JOIN gains x ON x.bucket = h.bucket WHERE g.side = 'd' GROUP BY g.r),
noise AS (SELECT w.*, CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS g FROM w WHERE side = 'd'),
scored AS (SELECT d.doc_id, len(d.ws) >= 20 AS able, coalesce(s.n, 0) AS n_features,
                  coalesce(s.total // s.n - CASE WHEN s.total < 0 AND s.total % s.n <> 0 THEN 1 ELSE 0 END, 0) AS weight, d.g FROM noise d LEFT JOIN sums s ON s.r = d.r),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY weight + g DESC, doc_id) AS place, 25 * count(*) FILTER (WHERE able) OVER () // 100 AS k FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + g AS BIGINT) AS score, CASE WHEN able AND place <= k THEN place END AS rank FROM placed
"""

WORDS_SQL = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op2_jaccard"] = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, {WORDS_SQL.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS h FROM grams GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM sets),
heads AS (SELECT g.doc_id, g.g FROM grams g JOIN classes c ON c.doc_id = g.doc_id AND c.class_id = c.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM heads a JOIN heads b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT a, a FROM ways UNION SELECT r.id, l.b FROM reach r JOIN ways l ON l.a = r.other),
least_of AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component_id, c.class_id, d.doc_id) AS component_id, coalesce(c.class_id, d.doc_id) AS class_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN classes c ON c.doc_id = d.doc_id LEFT JOIN least_of l ON l.id = c.class_id
"""

ORACLES["op9_substring"] = f"""
WITH w AS (SELECT doc_id, {WORDS_SQL.format("text")} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13) t),
firsts AS (SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s),
gone AS (SELECT DISTINCT x.doc_id, x.i + k.k AS i FROM windows x JOIN firsts f ON f.s = x.s AND f.first_id < x.doc_id CROSS JOIN (SELECT range AS k FROM range(13)) k),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
marked AS (SELECT x.doc_id, x.word, x.i, g.i IS NOT NULL AS removed FROM words x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i),
kept AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(sum(CASE WHEN removed THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
                coalesce(string_agg(CASE WHEN removed THEN NULL ELSE word END, ' ' ORDER BY i), '') AS text FROM marked GROUP BY doc_id)
SELECT w.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
