"""The queries of this subpackage, one for each operator, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, codes, jaccard, kneser, licenses, mixing, novelty, rans, sketch, transport, variants, warc
from .shared import light_batches, staged, text_or_empty


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    light_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: each document's place, length and checksum."""
    return rans.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, alike at 0.8 or more in five-word n-grams."""
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "copies")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts decoded from them, as digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, offsets="ends")
    decoded = bpe.decode(encoded.select("doc_id", "ids", "ends"), ranks, offsets="ends")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents under the model of the trusted ones, and whether each is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = kneser.classify(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "perplexity", "threshold", F.col("keep").cast("int").alias("keep"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents by patience alignment with the templates."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    printed = F.transform("licenses", lambda s: F.format_string("%s:%d:%d:%.3f", s.license, s.start, s.end, s.coverage))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(printed, ",").alias("licenses"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts of the fixed kinds, their digest, and all spans."""
    found = novelty.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    printed = lambda s: F.concat_ws(":", s.kind, s.start, s.end)
    base = F.filter("spans", lambda s: s.kind != "novel")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, novelty.KINDS),
        F.sha2(F.array_join(F.transform(base, printed), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", printed), ",").alias("spans"),
    )


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all documents stored as transport streams in a media column, and what is read back from it."""
    data = F.encode(text_or_empty("text"), "UTF-8").alias("data")
    stored = staged(transport.store(table(spark, sf_dir, "documents").select("doc_id", data)), "media")
    pts = F.transform(F.array(F.lit(0), F.size("pts") - 1), lambda i: F.get("pts", i))
    return transport.load(stored).select(
        "doc_id",
        F.col("media_bytes").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("packets="), "packets"), F.concat(F.lit("errors="), "counter_errors"), F.concat(F.lit("pts="), F.array_join(pts.cast("array<string>"), "-")), F.concat(F.lit("access="), F.array_join(F.transform("random_access", lambda r: F.concat_ws("@", r.pts, r.offset)), ","))).alias("feature"),
    )


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by weights of their sources."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS ident,
    row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS ordinal, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source
), r AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, (sum(words) OVER ())::BIGINT AS total FROM s
), k AS (
  SELECT *, 3.0 * words / w AS ratio,
    (sum(3 * words) OVER (ORDER BY 3.0 * words / w, source NULLS LAST ROWS UNBOUNDED PRECEDING))::BIGINT - 3 * words AS capped,
    (sum(w) OVER (ORDER BY 3.0 * words / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_w
  FROM r
), l AS (
  SELECT (total - capped)::DOUBLE AS remaining, open_w::DOUBLE AS open_w FROM k
  WHERE (total - capped) * w <= 3 * words * open_w ORDER BY ratio, source NULLS LAST LIMIT 1
), t AS (
  SELECT r.source, r.words, least(r.w::DOUBLE * l.remaining / l.open_w, (3 * r.words)::DOUBLE) AS target FROM r CROSS JOIN l
), x AS (
  SELECT d.doc_id, d.size, t.words AS source_size, t.target, CASE WHEN t.words > 0 THEN t.target / t.words ELSE 0.0 END AS rate,
    ('0x' || substr(md5('8:' || ident || ':' || ordinal), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM x
"""


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages with repeated payloads stored once, read back."""
    found = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM original AS again FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN original END AS refers_to
FROM r
"""


def op10_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of all documents and of their edited texts, and their likeness."""
    found = sketch.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch.printed(F.col("sketch")).alias("fingerprint"),
        sketch.printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketch.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketch.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        sketch.distinct_count(F.col("sketch")).alias("n_shingles"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors, their errors and the codebooks' digest."""
    return codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def _op11_sql() -> str:
    """Rounds of assignments and floors of means, one after the other."""
    far = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = "SELECT rid, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (SELECT p.rid, p.part, b.entry, {far} AS dist FROM p JOIN b{k} b ON p.part = b.part) GROUP BY rid, part"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 4096)::BIGINT) AS x, row_number() OVER (ORDER BY vec_id, embedding) AS rid FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        "p AS MATERIALIZED (SELECT rid, k AS part, x[k * (len(x) // 8) + 1 : (k + 1) * (len(x) // 8)] AS x FROM v CROSS JOIN (SELECT unnest(range(8)) AS k))",
        "b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= 16)",
    ]
    for k in range(codes.ROUNDS):
        steps += [
            f"a{k} AS MATERIALIZED ({near.format(far=far, k=k)})",
            f"m{k} AS MATERIALIZED (SELECT part, entry, list(m ORDER BY pos) AS x FROM (SELECT a.part, a.entry, pos, floor(sum(c)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT rid, part, unnest(x) AS c, unnest(range(len(x))) AS pos FROM p) u JOIN a{k} a ON a.rid = u.rid AND a.part = u.part GROUP BY a.part, a.entry, pos) GROUP BY part, entry)",
            f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)",
        ]
    last = codes.ROUNDS
    steps += [
        f"z AS ({near.format(far=far, k=last)})",
        "c AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM z GROUP BY rid)",
        f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last})",
    ]
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (rid) CROSS JOIN h"


def op12_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings as examples of a reply each, read back from what is stored."""
    said = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.formatted(turns.unionByName(hard)))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'
), u AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
      + length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, ':', '')) + (length(role) - length(replace(role, '</turn>', ''))) // 7
      + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x) - 2)), 0) + 14 AS chars
  FROM t
), s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM u)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples, coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS expanded_chars
FROM s GROUP BY conv_id
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words and forms."""
    return variants.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))
), r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), d AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS said, count(*) AS times FROM r WHERE length(run) >= 6 GROUP BY doc_id, run
), y AS (
  SELECT run, times, flatten(list_transform(string_split(said, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 | (unicode(c) >> 6))::BIGINT, (128 | (unicode(c) & 63))::BIGINT] END)) AS bytes FROM d
), h AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM y CROSS JOIN crc
), w AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, times FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), s AS MATERIALIZED (SELECT word, n, i, word[1 : i] || word[i + 2 :] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
o AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM s a JOIN s b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM s JOIN w ON s.rest = w.word UNION SELECT w.word, s.word, s.n FROM s JOIN w ON s.rest = w.word
), g AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS best, max(other_n) AS best_n FROM o GROUP BY word),
f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM w LEFT JOIN g USING (word)),
c AS (SELECT word, word AS root, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.form)
SELECT f.word, f.form, c.root, n, n_near, form_n FROM f JOIN c ON c.word = f.word AND c.form IS NULL
"""


QUERIES = {
    f.__name__: f
    for f in (op1_rans_tokens, op2_kneser_ney, op3_license_scan, op4_secret_scan, op5_jaccard_join, op6_byte_bpe, op7_transport_streams, op8_source_mix, op9_warc_revisits, op10_bottom_k, op11_vector_codes, op12_chat_examples, op13_spelling_variants)
}

SQL = {"op8_source_mix": OP8_SQL, "op9_warc_revisits": OP9_SQL, "op11_vector_codes": _op11_sql(), "op12_chat_examples": OP12_SQL, "op13_spelling_variants": OP13_SQL}
