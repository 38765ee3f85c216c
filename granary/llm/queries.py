"""The registered queries of this subpackage: thin calls of its operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import backoff_lm, decontaminate, entropy_mix, exact_dedup, gru_langid, importance_resampling, license_scan, merkle_manifest, quality_rules, repair_tokens, rindex_dedup, simhash_dedup, warc_store

from granary.llm.common import crc_class


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.round_trip(_table(spark, sf_dir, "pages"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op5_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return backoff_lm.score(docs, held_out=crc_class(F.col("doc_id"), 7) == 2)


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_gru_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_class(F.col("doc_id"), 4) == 2, F.lit(False))
    found = gru_langid.identify(docs, learnable=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_tokens.round_trip(_table(spark, sf_dir, "documents"))


def op9_rindex_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rindex_dedup.mark(_table(spark, sf_dir, "documents")).drop("spans")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.kept_by(quality_rules.BASE)).alias("base_failed"),
        quality_rules.kept_by(quality_rules.STRICT).alias("kept"),
        "fail_bits",
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verify(_table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, concat_ws(chr(10), ws[i], ws[i + 1], ws[i + 2]) AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
hits AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) >= 2),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hits) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(again.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN again USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 14 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_words > 1000000 THEN 64 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""

OP3_SQL = """
WITH p AS (
  SELECT page_id, sha1(encode(coalesce(html, ''))) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner
  FROM pages)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM p
"""

#: crc32 of a list of byte values, a table lookup for each byte.
CRC_SQL = """crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda n : list_reduce(range(8), lambda c, i : xor(c >> 1, 3988292384 * (c & 1)), n)) AS t)"""
_CRC = "xor(list_reduce({bytes}, lambda c, b : xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
#: Levels of a tree of three: more than any table here needs.
_LEVELS = 20


def _op11_sql() -> str:
    stated = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR) END"
    leaf = lambda text: "sha256(concat(" + ", ".join(stated(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"

    def tree(name: str, of: str) -> str:
        """Levels of the trees in table of (tree, idx, digest): a level ends in one node that stays as it is."""
        levels, level = "", f"SELECT 0 AS level, tree, idx, digest, count(*) OVER (PARTITION BY tree) AS n FROM {of}"
        for k in range(_LEVELS):
            levels += f"{name}{k} AS MATERIALIZED ({level}),\n"
            level = f"SELECT {k + 1} AS level, tree, idx // 3 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest, (any_value(n) + 2) // 3 AS n FROM {name}{k} WHERE n > 1 GROUP BY tree, idx // 3"
        return levels + f"{name} AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM {name}{k}' for k in range(_LEVELS))}),\n"

    def climb(start: str, name: str, nodes: str) -> str:
        """Siblings, and the digest folded so far, from rows of start (doc_id, tree, idx, fold, proof) up through all levels."""
        steps, before = "", start
        for k in range(_LEVELS - 1):
            runs = f"SELECT tree, idx // 3 AS run, list(digest ORDER BY idx) AS ds FROM {nodes} WHERE level = {k} AND n > 1 GROUP BY 1, 2"
            left, right = "array_to_string(ds[:idx % 3], '')", "array_to_string(ds[idx % 3 + 2:], '')"
            steps += f"""{name}{k} AS MATERIALIZED (SELECT s.* REPLACE (CASE WHEN ds IS NULL THEN idx ELSE idx // 3 END AS idx, CASE WHEN ds IS NULL THEN fold ELSE sha256(concat({left}, fold, {right})) END AS fold,
              CASE WHEN ds IS NULL THEN proof ELSE concat(proof, {left}, {right}) END AS proof) FROM {before} s LEFT JOIN ({runs}) r ON r.tree = s.tree AND r.run = s.idx // 3),\n"""
            before = f"{name}{k}"
        return steps

    last = _LEVELS - 2
    return f"""WITH {CRC_SQL},
d AS MATERIALIZED (SELECT *, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf, {_CRC.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x : ascii(x)::BIGINT)")} % 2 = 0 AS struck FROM documents, crc_table),
e AS MATERIALIZED (SELECT doc_id, tree, leaf, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, CASE WHEN struck THEN {leaf("replace(text, chr(10), '')")} ELSE leaf END AS now FROM d),
leaves AS MATERIALIZED (SELECT tree, idx, leaf AS digest FROM e),
{tree('a', 'leaves')}tops AS MATERIALIZED (SELECT tree AS of_tree, digest FROM a WHERE n = 1), sources AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY of_tree) - 1 AS idx, digest, of_tree FROM tops),
{tree('b', '(SELECT tree, idx, digest FROM sources)')}start AS (SELECT doc_id, tree, idx, leaf, now AS fold, '' AS proof FROM e),
{climb('start', 's', 'a')}middle AS (SELECT x.doc_id, '' AS tree, o.idx, leaf, o.digest AS subroot, fold, proof FROM s{last} x JOIN sources o ON o.of_tree = x.tree),
{climb('middle', 'u', 'b')}done AS (SELECT doc_id, leaf, subroot, (SELECT digest FROM b WHERE n = 1) AS root, sha256(proof) AS proof_sha256, fold AS folded_root FROM u{last})
SELECT *, folded_root = root AS verified FROM done"""


OP11_SQL = _op11_sql()

OP12_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY bare ORDER BY n DESC, doc_id NULLS LAST) AS place, first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""

OP13_SQL = rf"""
WITH {CRC_SQL},
texts AS (SELECT doc_id AS id, true AS own, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
w AS (SELECT row_number() OVER () AS r, id, own, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS ws FROM texts),
f AS MATERIALIZED (SELECT r, own, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i : ws[i] || ' ' || ws[i + 1]))) AS feature FROM w),
b AS MATERIALIZED (SELECT feature, {_CRC.format(bytes="list_transform(range(1, strlen(feature) + 1), lambda i : ('0x' || hex(encode(feature))[2 * i - 1:2 * i])::BIGINT)")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f), crc_table),
p AS MATERIALIZED (SELECT r, own, bucket, count(*) AS n FROM f JOIN b USING (feature) GROUP BY ALL),
s AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t, coalesce((SELECT sum(n) FROM p WHERE own), 0)::DOUBLE AS of_s, coalesce((SELECT sum(n) FROM p WHERE NOT own), 0)::DOUBLE AS of_t FROM p GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (of_s + 10000)) / ((s + 1) * (of_t + 10000))))::BIGINT AS gain FROM s),
m AS (SELECT r, floor(sum(gain * n)::DOUBLE / sum(n))::BIGINT AS weight FROM p JOIN g USING (bucket) WHERE own GROUP BY 1),
h AS (SELECT r, id AS doc_id, len(ws) AS n_words, greatest(2 * len(ws) - 1, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(id::VARCHAR, 'null'))[:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN m USING (r) WHERE own),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, (SELECT 25 * count(*) // 100 FROM h WHERE n_words >= 20) AS drawn FROM h)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM k
"""

QUERIES = {
    "op1_license_scan": op1_license_scan, "op2_decontaminate": op2_decontaminate, "op3_warc_store": op3_warc_store,
    "op4_simhash_dedup": op4_simhash_dedup, "op5_backoff_lm": op5_backoff_lm, "op6_entropy_mix": op6_entropy_mix, "op7_gru_langid": op7_gru_langid, "op8_repair_tokens": op8_repair_tokens,
    "op9_rindex_dedup": op9_rindex_dedup, "op10_quality_rules": op10_quality_rules, "op11_merkle_manifest": op11_merkle_manifest, "op12_exact_dedup": op12_exact_dedup,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE_SQL = {"op3_warc_store": OP3_SQL, "op10_quality_rules": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_importance_resampling": OP13_SQL}
