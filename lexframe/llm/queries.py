"""The registered queries of the corpus operators, with their SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.llm import (
    decontaminate, embedding_dedup, html_blocks, language_id, license_scan, merkle, mixing, quality_classifier,
    quality_rules, simhash, token_counts, vector_codes, warc,
)
from lexframe.llm.common import LOWER, UPPER, held_out

TOKENIZER = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = warc.plan_records(_table(spark, sf_dir, "pages"))
    read = warc.read_archives(warc.write_archives(planned), with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_blocks.extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_policy(quality_rules.ledger(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures"
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path(TOKENIZER))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_table(spark, sf_dir, "documents")).drop("times")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.learn(docs)
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    altered = {"n_chars": merkle.altered_count(F.col("n_chars"), F.col("doc_id"))}
    return merkle.manifest(docs.select(*merkle.FIELDS), tampered=altered)


QUERIES = {
    "op1_quality_classifier": quality,
    "op2_warc": archives,
    "op3_html_extraction": main_text,
    "op4_quality_rules": rules,
    "op5_token_counts": tokens,
    "op6_license_scans": licenses,
    "op7_decontamination": contamination,
    "op8_source_mixing": mixture,
    "op9_simhash": near_duplicates,
    "op10_language_id": languages,
    "op11_embedding_dedup": near_vectors,
    "op12_vector_codes": codes,
    "op13_merkle_manifest": signed,
}

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"

WARC_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), c AS (
  SELECT payload_digest AS d, max(page_id) AS top FROM p WHERE payload_bytes >= {warc.MIN_REVISIT}
  GROUP BY 1 HAVING count(*) > 1 AND max(page_id) IS NOT NULL
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p LEFT JOIN c ON payload_digest = d
"""

RULES_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM d
), u AS (
  SELECT *, CASE WHEN len(list_distinct(g)) = len(g) THEN [] ELSE
    list_transform(list_filter(map_entries(list_histogram(g)), lambda e: e.value > 1), lambda e: e.key) END AS again
  FROM g
), p AS (
  SELECT *, CASE WHEN len(again) = 0 THEN [] ELSE
    list_filter(range(1, len(w) - 1), lambda i: list_contains(again, g[i])) END AS places
  FROM u
), m AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
    len(list_distinct(flatten(list_transform(places, lambda i: [i, i + 1, i + 2])))) AS n_repeat_words,
    len(regexp_extract_all(t, '!!([\x20\x09-\x0D]|$)')) AS n_shout
  FROM p
), f AS (
  SELECT *, (n_words < 50) AS f0, (100 * n_repeat_words > 50 * n_words) AS f1, (100 * n_symbols > 10 * word_chars) AS f2,
    (100 * n_dup_lines > 60 * n_lines) AS f3, (word_chars > 20 * n_words) AS f4, (2 * word_chars < 3 * n_words) AS f5,
    (100 * n_shout > 40 * n_words) AS f6
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
  NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f6) AS kept,
  CAST(f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT + 64 * f6::INT AS BIGINT) AS failures
FROM f
"""

CONTAMINATION_SQL = rf"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_ALNUM}') AS w FROM benchmark
), n AS (
  SELECT item_id, least(len(w), {decontaminate.WINDOW}) AS k,
    unnest(list_transform(range(1, greatest(len(w) - {decontaminate.WINDOW} + 1, 1) + 1),
      lambda i: array_to_string(list_slice(w, i, i + {decontaminate.WINDOW} - 1), ' '))) AS s
  FROM b WHERE len(w) > 0
), d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_ALNUM}') AS w
  FROM documents
), x AS (
  SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM n)
), h AS (
  SELECT DISTINCT r, i, k, item_id FROM x JOIN n USING (k)
  WHERE array_to_string(list_slice(w, i, i + k - 1), ' ') = s
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM h WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

MIX_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
    CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), text, ''))[1:15] AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS most,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), fill AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS per_weight, true AS more
  UNION ALL
  SELECT step + 1, greatest(per_weight, again), again > per_weight FROM (
    SELECT f.step, f.per_weight,
      CASE WHEN sum(CASE WHEN most < f.per_weight * w THEN 0 ELSE w END) = 0 THEN 0 ELSE
        CAST(sum(source_size) - sum(CASE WHEN most < f.per_weight * w THEN most ELSE 0 END) AS DOUBLE)
        / CAST(sum(CASE WHEN most < f.per_weight * w THEN 0 ELSE w END) AS DOUBLE) END AS again
    FROM s, fill f WHERE f.more GROUP BY ALL)
), t AS (
  SELECT source, source_size, least((SELECT max(per_weight) FROM fill) * w, CAST(most AS DOUBLE)) AS target FROM s
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies,
    target - CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END * source_size AS rest
  FROM t
), g AS (
  SELECT source, h, sum(size) AS m, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS after
  FROM d WHERE size > 0 GROUP BY source, h
), e AS (
  SELECT r.source, h + CASE WHEN (rest - (after - m)) * 2 > m THEN 1 ELSE 0 END AS below
  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source WHERE after - m <= rest AND rest < after
)
SELECT doc_id, size, source_size, target,
  size * (copies + CASE WHEN h < coalesce(below, 0) THEN 1 ELSE 0 END) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

LINKS_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), u AS MATERIALIZED (
  SELECT r, label, v, len(v) AS n FROM v WHERE label IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.n = b.n AND a.r <> b.r
  WHERE list_cosine_similarity(a.v, b.v) >= {embedding_dedup.THRESHOLD}
), reach AS (
  SELECT r AS a, r AS b FROM v
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = v.r) AS n_links, component_id,
  vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (r)
"""


def _codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """Every round of the codebooks written out, integers only."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, p, list_slice(q, p * (len(q) // {parts}) + 1, (p + 1) * (len(q) // {parts})) AS v FROM kept, range({parts}) AS t(p)
), book0 AS MATERIALIZED (
  SELECT p, e, v FROM parts JOIN (
    SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}) USING (r)
)"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT r, x.p AS p, any_value(x.v) AS v,
    min(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) * {entries} + e) AS best
  FROM parts x JOIN book{k} b ON x.p = b.p GROUP BY r, x.p
)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (
  SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY i) AS v FROM (
    SELECT p, best % {entries} AS e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS c
    FROM (SELECT p, best, v, unnest(range(1, len(v) + 1)) AS i FROM near{k}) GROUP BY ALL) GROUP BY p, e
), book{k + 1} AS MATERIALIZED (
  SELECT b.p AS p, b.e AS e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e
)""")
    return "WITH " + ", ".join(steps) + f""", coded AS (
  SELECT r, string_agg(printf('%02x', CAST(best % {entries} AS INTEGER)), '' ORDER BY p) AS code,
    CAST(sum(best // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


# the CRC-32 of a decimal number: bytes are xored in, -1 stands for a shift by one bit
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
  string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""


def _manifest_sql() -> str:
    plain = " || ".join(map(_field_sql, merkle.FIELDS))
    altered = plain.replace(_field_sql("n_chars"), _field_sql(f"(n_chars + CASE WHEN {_CRC_SQL} % 7 = 0 THEN 1 ELSE 0 END)"))
    up = """SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (size + 1) // 2
  FROM {0} WHERE size > 1 GROUP BY tree, lvl, pos // 2, size"""
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size
  FROM (SELECT doc_id, coalesce('1' || lang, '0') AS tree, sha256({plain}) AS leaf,
          sha256(CASE WHEN doc_id IS NULL THEN {plain} ELSE {altered} END) AS altered FROM documents)
), nodes AS (
  SELECT tree, 0 AS lvl, pos, leaf AS h, size FROM d UNION ALL {up.format("nodes")}
), grown AS MATERIALIZED (SELECT * FROM nodes
), roots AS MATERIALIZED (
  SELECT tree AS name, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM grown WHERE size = 1
), tops AS (
  SELECT '' AS tree, 0 AS lvl, pos, subroot AS h, size FROM roots UNION ALL {up.format("tops")}
), topped AS MATERIALIZED (SELECT * FROM tops
), walk AS (
  SELECT row_number() OVER () AS r, doc_id, leaf, tree, altered AS h, pos, 0 AS lvl, size, false AS top, '' AS proof, tree AS name FROM d
  UNION ALL
  SELECT w.r, w.doc_id, w.leaf, CASE WHEN done THEN '' ELSE w.tree END, CASE WHEN done THEN w.h
      WHEN w.pos % 2 = 0 THEN sha256(w.h || coalesce(s.h, '')) ELSE sha256(s.h || w.h) END,
    CASE WHEN done THEN g.pos ELSE w.pos // 2 END, CASE WHEN done THEN 0 ELSE w.lvl + 1 END,
    CASE WHEN done THEN g.size ELSE (w.size + 1) // 2 END, w.top OR done,
    w.proof || CASE WHEN done THEN '' ELSE coalesce(s.h, '') END, w.name
  FROM (SELECT *, size = 1 AS done FROM walk WHERE size > 1 OR NOT top) w JOIN roots g ON g.name = w.name
  LEFT JOIN (SELECT tree, lvl, pos, h FROM grown UNION ALL SELECT tree, lvl, pos, h FROM topped) s
    ON s.tree = w.tree AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1)
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM walk JOIN roots USING (name), (SELECT h AS root FROM topped WHERE size = 1) WHERE walk.top AND walk.size = 1
"""


CODES_SQL = _codes_sql()
MANIFEST_SQL = _manifest_sql()

ORACLES = {
    "op2_warc": WARC_SQL,
    "op4_quality_rules": RULES_SQL,
    "op7_decontamination": CONTAMINATION_SQL,
    "op8_source_mixing": MIX_SQL,
    "op11_embedding_dedup": LINKS_SQL,
    "op12_vector_codes": CODES_SQL,
    "op13_merkle_manifest": MANIFEST_SQL,
}
