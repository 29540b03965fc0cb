"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalkit.llm import (bpe, fingerprint, hard_negatives, html_text, langid, lm_score, merkle, mixing, near_dup,
                         piece_bpe, quality, token_count, token_files)
from evalkit.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


@register("op1_source_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.copies(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op6_token_count")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_count.token_counts(docs, tokenizer_file("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@register("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode_documents(docs, tokenizer_file("byte_bpe_50k.tiktoken"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), keep_text=False)
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "char_distance", "word_distance")


@register("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    predicted = langid.predict(docs, langid.train(docs))
    held = F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return predicted.select("doc_id", held, "lang_pred", "score")


@register("op4_main_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", "n_chars")


@register("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = token_files.token_folder(spark)
    found = token_files.write(docs, tokenizer_file("word_bpe_49k.json"), folder)
    return token_files.read(found, folder)


@register("op10_fingerprint")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = fingerprint.with_edited(fingerprint.with_next(docs))
    rows = edited.withColumn("edited_sketch", fingerprint.sketch(F.col("edited")))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint.as_string(F.col("sketch")).alias("fingerprint"),
                       fingerprint.as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
                       *[F.coalesce(fingerprint.likeness(F.col("sketch"), F.col(other)), F.lit(0.0)).alias(name)
                         for other, name in (("edited_sketch", "near_edited"), ("next_sketch", "near_next"))])


@register("op9_near_duplicates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op7_lm_score", oracle="""
WITH words AS (
  SELECT rid, doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w
  FROM (SELECT row_number() OVER () AS rid, doc_id,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
total AS (SELECT count(*) AS n FROM words),
uni AS (SELECT w, count(*) AS c FROM words GROUP BY w),
pairs AS (SELECT *, lag(w) OVER (PARTITION BY rid ORDER BY pos) AS prev FROM words),
seen AS (SELECT prev, w, count(*) AS c FROM pairs WHERE prev IS NOT NULL GROUP BY prev, w),
logs AS (
  SELECT p.rid, CASE WHEN p.prev IS NULL THEN ln(u.c / t.n)
                     WHEN s.c >= 2 THEN ln(s.c / q.c) ELSE ln(0.4) + ln(u.c / t.n) END AS l
  FROM pairs p CROSS JOIN total t JOIN uni u ON u.w = p.w
  LEFT JOIN seen s ON s.prev = p.prev AND s.w = p.w LEFT JOIN uni q ON q.w = p.prev)
SELECT d.doc_id, count(l) AS n_words, round(avg(l), 6) AS lm_score
FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) d LEFT JOIN logs USING (rid)
GROUP BY d.rid, d.doc_id
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.withColumn("lm_score", F.round("lm_score", 6))


@register("op13_piece_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = piece_bpe.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"), arrays=False)
    return encoded.select("doc_id", piece_bpe.n_ids(F.col("packed")).alias("n_tokens"),
                          F.sha2("packed", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _leaf_sql(text: str) -> str:
    def written(c: str) -> str:
        c = f"CAST({c} AS VARCHAR)"
        return f"coalesce(CAST(octet_length(encode({c})) AS VARCHAR) || ':' || {c}, '-')"
    return f"sha256({' || '.join(map(written, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


def _crc_table_sql() -> str:
    """The table of crc32: eight steps over the bits of every byte."""
    rows = "(SELECT n, n AS c FROM range(256) r(n))"
    for _ in range(8):
        rows = f"(SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM {rows})"
    return f"SELECT list(c ORDER BY n) AS t FROM {rows}"


@register("op12_merkle_manifest", oracle=f"""
WITH RECURSIVE crc AS ({_crc_table_sql()}),
rows AS (
  SELECT row_number() OVER () AS rid, *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, x: xor(a >> 8, t[CAST((xor(a, x) & 255) + 1 AS INTEGER)])) AS rest
  FROM documents, crc),
leaves AS (
  SELECT rid, doc_id, lang, {_leaf_sql('text')} AS leaf,
    CASE WHEN xor(rest, 4294967295) % 3 = 0
         THEN {_leaf_sql(f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')")} END AS other FROM rows),
ranked AS (
  SELECT *, coalesce(other, leaf) AS presented, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
lv(g, l, i, d) AS (
  SELECT g, 0, pos, leaf FROM ranked UNION ALL
  SELECT g, l + 1, i >> 3, sha256(string_agg(d, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM lv) x WHERE n > 1 GROUP BY g, l, i >> 3),
sub AS (SELECT g, l AS h, min(d) AS d FROM lv GROUP BY g, l HAVING count(*) = 1),
tp(l, i, d) AS (
  SELECT 0, g, d FROM sub UNION ALL
  SELECT l + 1, i >> 3, sha256(string_agg(d, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS n FROM tp) x WHERE n > 1 GROUP BY l, i >> 3),
root AS (SELECT d FROM tp ORDER BY l DESC LIMIT 1), top AS (SELECT max(l) AS h FROM tp),
runs AS (
  SELECT rid, lv.l AS k, pos >> (3 * lv.l) AS own, lv.i, lv.d
  FROM ranked r JOIN sub s USING (g) JOIN lv ON lv.g = r.g AND lv.l < s.h AND lv.i >> 3 = pos >> (3 * lv.l + 3)
  UNION ALL
  SELECT rid, s.h + tp.l, g >> (3 * tp.l), tp.i, tp.d
  FROM ranked r JOIN sub s USING (g), tp, top WHERE tp.l < top.h AND tp.i >> 3 = g >> (3 * tp.l + 3)),
proof AS (SELECT rid, string_agg(d, '' ORDER BY k, i) AS p FROM runs WHERE i <> own GROUP BY rid),
fold(rid, k, d) AS (
  SELECT rid, 0, presented FROM ranked UNION ALL
  SELECT f.rid, f.k + 1, sha256(string_agg(CASE WHEN r.i = r.own THEN f.d ELSE r.d END, '' ORDER BY r.i))
  FROM fold f JOIN runs r ON r.rid = f.rid AND r.k = f.k GROUP BY f.rid, f.k),
folded AS (SELECT rid, arg_max(d, k) AS d FROM fold GROUP BY rid)
SELECT doc_id, leaf, s.d AS subroot, root.d AS root, sha256(coalesce(p, '')) AS proof_sha256, f.d AS folded_root,
  f.d = root.d AS verified
FROM ranked r JOIN sub s USING (g) JOIN folded f USING (rid) LEFT JOIN proof USING (rid), root
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    audited = merkle.audit(docs, tampered, merkle.lowered(F.col("text")))
    return audited.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@register("op11_hard_negatives", oracle="""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id AS id,
        CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score FROM a, e WHERE a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score,
        row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS slot FROM s WHERE same),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, slot ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE slot <= 5 AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.whole_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)
