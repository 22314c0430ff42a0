"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.llm import bytebpe, chat, divergence, langid, mixing, packing, pivots, quality, simhash, sketch, spelling, urlfilter, wavelet
from leafscan.llm.common import merged_like, table


def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


def op3_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedding = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").where(pivots.usable(embedding))
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), pivots.quantised(embedding).alias("v"))
    return pivots.top_k(vectors, F.col("vec_id") % 50 == 0)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = merged_like(bytebpe.encode(docs, decoded=True), docs)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, _ = quality.fit(docs)
    return merged_like(quality.classified(docs, weights, keep=("doc_id",)), docs)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold(F.col("doc_id")) == 2
    found = merged_like(langid.identified(docs, langid.fit(docs.where(~held_out)), keep=("doc_id",)), docs)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.write_and_read(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op9_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.assembled(chat.formatted(chat.swapped_replies(table(spark, sf_dir, "conversations"))))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["from"].cast("string"), s["to"].cast("string"))), " ")
    return pairs.select("pair_id", "prompt", "chosen", "rejected", *[shown(F.col(c)).alias(c) for c in ("chosen_spans", "rejected_spans")])


def op10_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.edited(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch.fingerprint(F.col("sketch")).alias("fingerprint"),
        sketch.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketch.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketch.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mixed(table(spark, sf_dir, "documents")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_duplicates": op1_simhash_near_duplicates,
    "op2_url_filter": op2_url_filter,
    "op3_pivot_top_k": op3_pivot_top_k,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_weak_label_quality": op6_weak_label_quality,
    "op7_language_id": op7_language_id,
    "op8_wavelet_shards": op8_wavelet_shards,
    "op9_preference_chat": op9_preference_chat,
    "op10_scaled_sketch": op10_scaled_sketch,
    "op11_source_divergence": op11_source_divergence,
    "op12_source_mix": op12_source_mix,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op3_pivot_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS row, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.row <> q.row
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_preference_chat": """
        WITH t AS (
            SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
            FROM conversations
        ), last AS (
            SELECT conv_id, turn, text FROM t WHERE role = 'assistant'
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1
        ), known AS (
            SELECT l.conv_id, l.turn, l.text, p.text AS reply FROM last l LEFT JOIN last p ON p.conv_id = xor(l.conv_id, 1)
        ), sides AS (
            SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM t
            UNION ALL
            SELECT t.conv_id, 'rejected', t.turn, t.role,
                   CASE WHEN t.role = 'assistant' AND t.turn = k.turn AND t.text = k.text AND k.reply IS NOT NULL
                        THEN k.reply ELSE t.text END
            FROM t LEFT JOIN known k ON k.conv_id IS NOT DISTINCT FROM t.conv_id
        ), turns AS (
            SELECT pair_id, turn, role, text, count(*) FILTER (side = 'chosen') AS chosen, count(*) FILTER (side = 'rejected') AS rejected
            FROM sides GROUP BY ALL
        ), shared AS (
            SELECT *, CASE WHEN pair_id IS NULL THEN row_number() OVER (ORDER BY turn, role, text) END AS alone,
                   min(CASE WHEN chosen <> rejected THEN turn END) OVER (PARTITION BY pair_id) AS first
            FROM turns
        ), parts AS (
            SELECT *, 'prompt' AS part, chosen AS copies FROM shared WHERE first IS NULL OR turn < first
            UNION ALL SELECT *, 'chosen', chosen FROM shared WHERE turn >= first
            UNION ALL SELECT *, 'rejected', rejected FROM shared WHERE turn >= first
        ), made AS (
            SELECT pair_id, alone, part, turn, role, k,
                   '<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS rendered
            FROM parts, unnest(range(copies)) AS u(k)
        ), placed AS (
            SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, alone, part ORDER BY turn, role, rendered, k ROWS UNBOUNDED PRECEDING) - length(rendered) AS begins FROM made
        ), joined AS (
            SELECT pair_id, alone, part, string_agg(rendered, '' ORDER BY turn, role, rendered, k) AS whole,
                   string_agg(CASE WHEN role = 'assistant' THEN (begins + instr(rendered, chr(10))) || ':' || (begins + length(rendered) - 1) END, ' ' ORDER BY begins) AS spans
            FROM placed GROUP BY ALL
        )
        SELECT pair_id, coalesce(max(whole) FILTER (part = 'prompt'), '') AS prompt, coalesce(max(whole) FILTER (part = 'chosen'), '') AS chosen,
               coalesce(max(whole) FILTER (part = 'rejected'), '') AS rejected, coalesce(max(spans) FILTER (part = 'chosen'), '') AS chosen_spans,
               coalesce(max(spans) FILTER (part = 'rejected'), '') AS rejected_spans
        FROM joined GROUP BY pair_id, alone
    """,
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), t AS (
            SELECT doc, lang, source, unnest(terms) AS term FROM d
        ), kept AS (
            SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 30
        ), groups AS (
            SELECT DISTINCT lang, source FROM d
        ), grid AS (
            SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n
            FROM groups g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) c USING (lang, source, term)
        ), sums AS (
            SELECT *, sum(n) OVER (PARTITION BY lang, source) AS words, count(*) OVER (PARTITION BY lang, source) AS kept, sum(lang_n) OVER (PARTITION BY lang, source) AS lang_words FROM grid
        ), priced AS (
            SELECT lang, source, term, n, CAST(1 + 1000000000 * (n + 5)::HUGEINT // (words + 5 * kept) AS BIGINT) AS p,
                   CAST(1 + 1000000000 * (lang_n + 5)::HUGEINT // (lang_words + 5 * kept) AS BIGINT) AS q
            FROM sums
        ), apart AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        ), terms AS (
            SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM priced WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
            FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
        )
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
    "op12_source_mix": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
        ), s AS (
            SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS most
            FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
        ), filled AS (  -- as the level rises, sources reach their most in the order of most / weight
            SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER filling, 0) AS num, sum(weight) OVER () - coalesce(sum(weight) OVER filling, 0) AS den
            FROM s WINDOW filling AS (ORDER BY most / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), level AS (
            SELECT num, den FROM filled WHERE most * den >= weight * num ORDER BY most / weight, weight, source NULLS LAST LIMIT 1
        ), goals AS (
            SELECT source, source_size, most * den < weight * num AS above,
                   CASE WHEN most * den < weight * num THEN CAST(most AS DOUBLE) ELSE CAST(weight * num AS DOUBLE) / den END AS target,
                   CASE WHEN most * den < weight * num THEN most ELSE weight * num // den END AS budget
            FROM (SELECT s.*, level.num, level.den FROM s, level)
        ), streams AS (
            SELECT d.*, g.source_size, g.target, g.budget, epoch * g.source_size + sum(size) OVER (
                       PARTITION BY d.source, epoch ORDER BY md5(epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size, row ROWS UNBOUNDED PRECEDING) AS ends
            FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source, range(3) AS e(epoch)
        )
        SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(ends, budget) - (ends - size))) AS BIGINT) AS taken
        FROM streams GROUP BY row, doc_id, size, source_size, target
    """,
    "op13_spelling_variants": r"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, run, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
            GROUP BY ALL
        ), hexed AS (
            SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs WHERE length(run) >= 5
        ), bits AS (
            SELECT run, n, list_transform(range(0, 4 * length(h)), lambda k: (CAST('0x' || substr(h, CAST(2 * (k // 8) + 1 AS BIGINT), 2) AS BIGINT) // CAST(power(2, k % 8) AS BIGINT)) % 2) AS bits
            FROM hexed
        ), digests AS (
            SELECT run, n, xor(4294967295, list_reduce(bits, lambda c, bit: xor(c // 2, 3988292384 * ((c + bit) % 2)), CAST(4294967295 AS BIGINT))) AS digest FROM bits
        ), damaged AS (
            SELECT CASE WHEN digest % 97 = 0 THEN substr(run, 1, CAST(digest % length(run) AS BIGINT)) || substr(run, CAST(digest % length(run) + 2 AS BIGINT)) ELSE run END AS word, n AS times FROM digests
        ), words AS (
            SELECT word, CAST(sum(times) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
        ), lacking AS (
            SELECT DISTINCT word, n, substr(word, 1, CAST(k AS BIGINT)) || substr(word, CAST(k + 2 AS BIGINT)) AS rest, k FROM words, unnest(range(0, length(word))) AS u(k)
        ), near AS (
            SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM lacking a JOIN lacking b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
            UNION
            SELECT a.word, a.n, b.word, b.n FROM lacking a JOIN words b ON a.rest = b.word
            UNION
            SELECT b.word, b.n, a.word, a.n FROM lacking a JOIN words b ON a.rest = b.word
        ), best AS (
            SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near
            QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1
        ), told AS (
            SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
            FROM words w LEFT JOIN best b ON w.word = b.word
        ), chain AS (
            SELECT word, word AS root, 0 AS steps FROM told
            UNION ALL
            SELECT c.word, t.form, c.steps + 1 FROM chain c JOIN told t ON t.word = c.root WHERE t.form IS NOT NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM told JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) USING (word)
    """,
}
