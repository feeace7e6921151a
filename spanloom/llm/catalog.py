"""Queries over whole tables, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import exact, fim, html, language, lines, merkle, mixing, packing, quality, secrets, setsketch, simhash, spans
from spanloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, max_distance=3)
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op4_line_dedup"] = """
WITH rows AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM rows
), keyed AS (
  SELECT doc_id, line, i, translate(
    trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), held AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.line, k.i, coalesce(k.doc_id > h.owner, false) AS gone
  FROM keyed k LEFT JOIN held h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("norm_sha256").alias("text_sha256"))


ORACLES["op5_exact_dedup"] = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = [n for n, r in enumerate(secrets.RULES) if r.base]
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size("spans") - F.size(F.array_remove(kinds, n))).cast("bigint").alias(f"n_{secrets.RULES[n].kind}") for n in base
    ]
    return found.select(
        "doc_id", *counts,
        F.sha2(secrets.written(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.drop("text", "lang")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", language.held_out(F.col("doc_id")).alias("held_out")
    )
    net = language.fit(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    return language.identify(docs.select("doc_id", "text", "held_out"), net).drop("text")


@query
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_removed", "n_words", "n_words_removed", "removed", F.col("kept_text").alias("text"))


@query
def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), width=2, least=0.8)


ORACLES["op11_setsketch"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
    ELSE list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) END AS s FROM w
), classes AS (
  SELECT min(doc_id) AS node, md5(array_to_string(list_sort(s), chr(10))) AS class, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY class
), held AS (
  SELECT node, len(s) AS n, unnest(s) AS shingle FROM classes
), common AS (
  SELECT a.node AS a, b.node AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared
  FROM held a JOIN held b ON a.shingle = b.shingle AND a.node < b.node AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.node, b.node
), links AS (
  SELECT a, b FROM common WHERE 100 * shared >= 80 * (n + m - shared)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT node, node AS root FROM classes UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b
), named AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT x.doc_id, len(x.s) AS n_shingles, coalesce(n.root, x.doc_id) AS component_id, x.doc_id = coalesce(n.root, x.doc_id) AS kept
FROM sets x
LEFT JOIN classes c ON len(x.s) > 0 AND c.class = md5(array_to_string(list_sort(x.s), chr(10)))
LEFT JOIN named n ON n.node = c.node
"""


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLES["op12_fill_in_middle"] = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), h AS (
  SELECT *, len(units) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
    ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM u
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(units[1:lo], '') AS prefix, array_to_string(units[lo + 1:hi], '') AS middle,
    array_to_string(units[hi + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form != 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.check_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _merkle_sql(levels: int = 4, top_levels: int = 2) -> str:
    """The manifest with a step per level; enough for 16 ** levels leaves of a source and 16 ** top_levels sources."""
    value = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
    parts = [value.format(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join([*parts, value.format(text)])})"

    steps = [f"""crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[(ascii(c) >> i) & 1 FOR i IN range(8)]
      FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), ''), '') IF c != ''])::BIGINT[]),
    lambda s, b: xor(s >> 1, CASE WHEN (xor(s, b) & 1) = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295) AS crc FROM documents
), leaves AS (
  SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN crc % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS fold FROM crc
), ids AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, fold) - 1 AS pos FROM leaves
), n0 AS (
  SELECT source AS grp, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS total FROM ids
), f0 AS (
  SELECT doc_id, source, pos AS id, source AS grp, pos, leaf, fold, '' AS proof FROM ids
)"""]

    def lifted(k: int) -> str:
        group, place = "n.grp IS NOT DISTINCT FROM f.grp", f"n.pos // 16 = f.pos // 16"
        return f"""n{k + 1} AS (
  SELECT grp, pos // 16 AS pos, CASE WHEN any_value(total) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h,
    (any_value(total) + 15) // 16 AS total FROM n{k} GROUP BY grp, pos // 16
), f{k + 1} AS (
  SELECT f.doc_id, f.source, f.id, f.grp, f.pos // 16 AS pos, any_value(f.leaf) AS leaf,
    CASE WHEN any_value(n.total) > 1 THEN sha256(string_agg(CASE WHEN n.pos = f.pos THEN f.fold ELSE n.h END, '' ORDER BY n.pos))
      ELSE any_value(f.fold) END AS fold,
    any_value(f.proof) || coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos != f.pos), '') AS proof
  FROM f{k} f JOIN n{k} n ON {group} AND {place} GROUP BY f.doc_id, f.source, f.id, f.grp, f.pos // 16, f.pos
)"""

    steps += [lifted(k) for k in range(levels)]
    t = levels + 1
    steps.append(f"""subs AS (
  SELECT grp AS source, h AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM n{levels}
), n{t} AS (
  SELECT 0 AS grp, place AS pos, subroot AS h, total FROM subs
), f{t} AS (
  SELECT f.doc_id, f.source, f.id, 0 AS grp, s.place AS pos, f.leaf, f.fold, f.proof
  FROM f{levels} f JOIN subs s ON s.source IS NOT DISTINCT FROM f.source
)""")
    steps += [lifted(k) for k in range(t, t + top_levels)]
    end = t + top_levels
    return f"""WITH {', '.join(steps)}
SELECT f.doc_id, f.leaf, s.subroot, n.h AS root, sha256(f.proof) AS proof_sha256, f.fold AS folded_root, f.fold = n.h AS verified
FROM f{end} f JOIN subs s ON s.source IS NOT DISTINCT FROM f.source CROSS JOIN n{end} n"""


ORACLES["op13_merkle_manifest"] = _merkle_sql()
