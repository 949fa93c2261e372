"""What the driver runs: one query for each operator over its whole table, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, embedding_dedup, exact_dedup, jaccard_join, language_id, mixing, packing, periodic_runs, quality, sentencepiece_codec, sharding, suffix_dedup, token_alignment
from ._shared import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text, shards, seed = F.col("text"), 16, 17
    placed = sharding.shuffle_into_shards(docs, shards, seed)
    return placed.select(
        "doc_id",
        sharding.text_bytes(text).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        sharding.shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.9)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.fold(F.col("doc_id")).eqNullSafe(1)
    langs, model = language_id.train(docs.filter(~held_out))
    told = language_id.predict(docs.select("doc_id", "text"), langs, model)
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: The vocabulary of op5 and of the pipeline.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec_report(table(spark, sf_dir, "documents"), sentencepiece_codec.load(MODEL_FILE))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


#: A conversation that holds the template's own control strings.
ODD_TURN = r"\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TURN).alias("text"))
    windows = chat_format.format_windows(turns.unionByName(odd))
    # Each window is read back by itself; then a conversation's parts are put in order.
    turn = rf"{chat_format.OPEN}(\d+) ([^<>]*){chat_format.BETWEEN}([^<]*){chat_format.CLOSE}"
    got = lambda i: F.regexp_extract_all("formatted", F.lit(turn), F.lit(i))
    told = F.zip_with(got(2), got(3), lambda r, t: F.concat(chat_format.unescaped_role(r), F.lit("\n"), chat_format.unescaped(t), F.lit("\n")))
    part = F.struct("window", F.size(got(1)).cast("long").alias("n"), F.concat_ws("", told).alias("told"), chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("loss"), F.char_length("formatted").cast("long").alias("chars"))
    whole = windows.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    joined = lambda k: F.concat_ws("", F.col(f"p.{k}"))
    total = lambda k: F.aggregate(f"p.{k}", F.lit(0).cast("long"), lambda a, b: a + b)
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(joined("told"), 256).alias("turns_sha256"),
        F.char_length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.classify(docs, table(spark, sf_dir, "labels"), columns=["doc_id", "lang"])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    # Words are counted once; of the texts only those of rows without an id are needed further.
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(text).alias("words"), F.when(F.col("doc_id").isNull(), text).alias("text"))
    return mixing.training_order(mixing.curriculum(stored(docs, "mix-documents"), size_col="words")).select("doc_id", "size", "source_size", "target", "taken")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_classes(docs, width=3, num=9, den=10).select("doc_id", "n_shingles", "component_id", "n_links")


#: The two vocabularies of op11.
A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", MODEL_FILE


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, _ = token_alignment.align(table(spark, sf_dir, "documents"), A_FILE, B_FILE, keep_groups=False)
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(planted).withColumn("best", periodic_runs.strongest(F.col("runs")))
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(told, lambda r: F.concat(r, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The vocabulary of op13.
WORDS_FILE = "/opt/tokenizers/word_bpe_49k.json"


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORDS_FILE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


ORACLES = {
    "op12_periodic_runs": r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, doc_id::VARCHAR AS id FROM documents
), h AS (
  SELECT doc_id, w, len(w)::BIGINT AS n, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, flatten([[ascii(id[j])::UBIGINT, 0, 0, 0, 0, 0, 0, 0] FOR j IN range(1, length(id) + 1)])),
    lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384::UBIGINT)))::BIGINT AS h FROM d
), a AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM h),
i AS (SELECT doc_id, n, w, a, 1 + (n - a) // (3 + g % 8) AS p, unnest(range(n)) AS i FROM a),
x AS (SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word FROM i),
m AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
  FROM x JOIN x y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 3
), s AS (
  SELECT doc_id, q, min(i) AS start, max(i) + 1 - min(i) + q AS length FROM m GROUP BY doc_id, q, island HAVING max(i) + 1 - min(i) + q >= greatest(24, 3 * q)
), r AS (
  SELECT * FROM s WHERE NOT EXISTS (
    SELECT 1 FROM s z WHERE z.doc_id = s.doc_id AND z.q < s.q AND s.q % z.q = 0 AND z.start <= s.start AND z.start + z.length >= s.start + s.length)
), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / q DESC, start, q) AS rn FROM r),
t AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS told,
         max(start) FILTER (rn = 1) AS start, max(length) FILTER (rn = 1) AS length, max(q) FILTER (rn = 1) AS period FROM o GROUP BY doc_id
), c AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.q AND x.i < r.start + r.length) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e, label FROM embeddings
), good AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reached(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), reached(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op3_suffix_dedup": """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, unnest(range(0, greatest(octet_length(b) - 99, 0))) AS s FROM d
), k AS (
  SELECT w.doc_id, s, md5_number(substring(h, 2 * s + 1, 200)) AS g FROM w JOIN d USING (doc_id)
), f AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1 AS again FROM k
), r AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM f WHERE again),
p AS (SELECT doc_id, s, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM r),
q AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS e FROM p GROUP BY ALL),
o AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM q),
t AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - a)::BIGINT AS n_removed, max(e) AS last,
         string_agg(substring(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM o JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)""",
    "op6_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), k AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k""",
    "op7_chat_format": r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 1 AS tokens,
         replace(replace(text, '&', '&amp;'), '<', '&lt;') AS body, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS shown
  FROM raw
), system AS (SELECT conv_id, tokens AS charged FROM numbered WHERE n = 1 AND role = 'system'),
placed AS (
  SELECT x.*, n = 1 AND role = 'system' AS leads, coalesce(charged, 0) AS charged,
         sum(CASE WHEN n = 1 AND role = 'system' THEN 0 ELSE tokens END) OVER (PARTITION BY x.conv_id ORDER BY n ROWS UNBOUNDED PRECEDING)
         - CASE WHEN n = 1 AND role = 'system' THEN 0 ELSE tokens END AS before
  FROM numbered x LEFT JOIN system s ON s.conv_id IS NOT DISTINCT FROM x.conv_id
), taken(conv_id, n, start, used) AS (
  SELECT conv_id, n, n, tokens FROM placed WHERE n = 1
  UNION ALL
  SELECT x.conv_id, x.n, CASE WHEN f.fits THEN t.start ELSE x.n END, CASE WHEN f.fits THEN t.used + x.tokens ELSE x.tokens END
  FROM taken t JOIN placed x ON x.conv_id IS NOT DISTINCT FROM t.conv_id AND x.n = t.n + 1,
  LATERAL (SELECT t.used + x.tokens <= CASE WHEN t.start = 1 THEN 768 ELSE greatest(1, 768 - 192 - x.charged) END AS fits) f
), windows AS (
  SELECT x.*, t.start AS w, length(body) + length(shown) + length(x.n::VARCHAR) AS inner_chars
  FROM placed x JOIN taken t ON t.conv_id IS NOT DISTINCT FROM x.conv_id AND t.n = x.n
), firsts AS (SELECT conv_id, w, min(before) AS first_before, sum(tokens) AS total FROM windows GROUP BY ALL),
starts AS (
  SELECT *, lead(first_before) OVER o AS next_before, lead(total) OVER o AS next_total FROM firsts WINDOW o AS (PARTITION BY conv_id ORDER BY w)
), costs AS (
  SELECT x.conv_id, x.inner_chars + length('<turn ') + 1 + length('>' || chr(10)) + length('</turn>' || chr(10))
         + CASE WHEN NOT x.leads AND s.next_before - x.before <= least(192, greatest(0, 768 - x.charged - s.next_total))
           THEN x.inner_chars + length('<again ') + 1 + length('>' || chr(10)) + length('</turn>' || chr(10)) ELSE 0 END
         + CASE WHEN x.leads THEN (SELECT count(*) FROM firsts f WHERE f.conv_id = x.conv_id AND f.w > 1)
           * (length('<again 1 system>' || chr(10)) + length(x.body) + length('</turn>' || chr(10))) ELSE 0 END AS chars
  FROM windows x JOIN starts s ON s.conv_id IS NOT DISTINCT FROM x.conv_id AND s.w = x.w
), total AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM costs GROUP BY 1),
told AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss
  FROM placed GROUP BY 1
)
SELECT t.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM told t JOIN total ON total.conv_id IS NOT DISTINCT FROM t.conv_id""",
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('29:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS rank FROM d GROUP BY source
), w AS (SELECT *, (rank % 3 + 1)::BIGINT AS weight, sum(source_size) OVER ()::BIGINT AS total, sum(rank % 3 + 1) OVER ()::BIGINT AS total_weight FROM s),
o AS (
  SELECT *, (total - 3 * coalesce(sum(source_size) OVER f, 0))::BIGINT AS remains, (total_weight - coalesce(sum(weight) OVER f, 0))::BIGINT AS remains_weight FROM w
  WINDOW f AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), p AS (SELECT *, weight * remains > 3 * source_size * remains_weight AS stops FROM o),
q AS (
  SELECT *, max(CASE WHEN NOT stops THEN remains END) OVER () AS rest, max(CASE WHEN NOT stops THEN remains_weight END) OVER () AS rest_weight FROM p
), t AS (
  SELECT source, source_size, CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE (weight * rest)::DOUBLE / rest_weight::DOUBLE END AS target FROM q
), r AS (
  SELECT d.*, (sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::DOUBLE AS start FROM d
)
SELECT doc_id, size, source_size, target,
       (size * CASE WHEN source_size > 0 AND size > 0
                    THEN greatest(0, least(3, ceil((target - start - size::DOUBLE / 2) / nullif(source_size, 0)::DOUBLE))) ELSE 0 END)::BIGINT AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
