"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import exact_dedup, jaccard_join, license_scan, line_dedup, merkle, mixing, packing, quality_rules, secret_scan, token_files, toxicity, turn_repair, warc_shards
from tapeloom.llm.common import scratch_path, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.links_of_similar(table(spark, sf_dir, "documents"))


def op2_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "warc")
    warc_shards.write_warc(table(spark, sf_dir, "pages"), root)
    return warc_shards.read_warc(spark, root, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("row")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired(table(spark, sf_dir, "conversations"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = scratch_path(spark, "ids")
    token_files.write_ids(table(spark, sf_dir, "documents"), root, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_ids(spark, root, with_ids=False).drop("ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_warc_shards": op2_warc_shards,
        "op3_line_dedup": op3_line_dedup,
        "op4_license_scan": op4_license_scan,
        "op5_toxicity": op5_toxicity,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_packing": op7_packing,
        "op8_source_mixing": op8_source_mixing,
        "op9_quality_rules": op9_quality_rules,
        "op10_secret_scan": op10_secret_scan,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_turn_repair": op12_turn_repair,
        "op13_token_files": op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": OP3_SQL,
        "op6_exact_dedup": OP6_SQL,
        "op11_merkle_manifest": op11_sql(),
    }


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line,
         translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
s AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.doc_id, l.pos, l.line, (s.k IS NOT NULL AND l.doc_id <> s.first) AS gone FROM l LEFT JOIN s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def forest_sql(name: str, leaves: str, levels: int) -> str:
    """Relations of a forest's levels: <name>0 from ``leaves`` (tree, i, node), and for each level the text left and right of a node."""
    parts = [f"{name}0 AS (SELECT tree, i, node, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
    for k in range(levels):
        parts.append(f"""{name}s{k} AS (SELECT tree, i, n,
  coalesce(string_agg(node, '') OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(node, '') OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})""")
        parts.append(f"""{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, i // 8 AS i,
  CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY i)) ELSE max(node) END AS node FROM {name}{k} GROUP BY ALL))""")
    return ",\n".join(parts)


def fold_sql(name: str, start: str, levels: int) -> str:
    """<name>f<levels> has the rows of ``start`` (tree, i, f, p, ...) with f folded up to the root and p lengthened by all siblings."""
    parts = [f"{name}f0 AS (SELECT * FROM {start})"]
    for k in range(levels):
        parts.append(f"""{name}f{k + 1} AS (SELECT c.* REPLACE (c.i // 8 AS i, CASE WHEN s.n > 1 THEN sha256(s.l || c.f || s.r) ELSE c.f END AS f, c.p || s.l || s.r AS p)
  FROM {name}f{k} c JOIN {name}s{k} s ON c.tree = s.tree AND c.i = s.i)""")
    return ",\n".join(parts)


def op11_sql(levels: int = 9, languages: int = 4) -> str:
    """Levels suffice for 8 ** levels rows of a language and 8 ** languages languages."""
    given = {c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")}
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = given | {"text": given["text"].replace("text", small)}
    shift = "list_reduce(range(8)::UBIGINT[], lambda x, b: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END, xor(c, d))"
    crc = f"list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda t: ascii(t)::UBIGINT), lambda c, d: {shift}, 4294967295::UBIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({" || ".join(given.values())}) AS node,
  CASE WHEN xor({crc}, 4294967295::UBIGINT) % 3 = 0 THEN sha256({" || ".join(changed.values())}) END AS other FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS i FROM d),
{forest_sql("a", "o", levels)},
u AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, node, tree AS of FROM a{levels}),
{forest_sql("b", "u", languages)},
g AS (SELECT tree, i, doc_id, node AS leaf, coalesce(other, node) AS f, '' AS p FROM o),
{fold_sql("a", "g", levels)},
h AS (SELECT u.tree, u.i, c.doc_id, c.leaf, c.f, c.p, u.node AS subroot FROM a{f"f{levels}"} c JOIN u ON u.of = c.tree),
{fold_sql("b", "h", languages)}
SELECT c.doc_id, c.leaf, c.subroot, r.node AS root, sha256(c.p) AS proof_sha256, c.f AS folded_root, c.f = r.node AS verified
FROM bf{languages} c, b{languages} r
"""
