"""Registered queries of the subpackage: opN_<name> -> (spark, sf_dir) -> DataFrame,
and their DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (cuckoo_dedup, fm_decontam, gga_packing, html_gbt, masked_lm, periodic_runs, poisson_mix, prefix_trie,
                         simhash_popcount, suffix_hash_dedup, token_planes, toxicity, url_templates)
from tessera.llm.common import scratch_path, table, written


def op1_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (SELECT text_sha256, arg_min(doc_id, (-pts, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN k USING (text_sha256)
"""


def op2_html_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_gbt.extract_main_text(pages, html_gbt.train(pages))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_planes.write_token_files(table(spark, sf_dir, "documents"), path, token_planes.public_tokenizer(),
                                   end_id=2, order_by="doc_id")
    return token_planes.read_token_files(spark, path)


def op5_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = poisson_mix.write_mixed(docs, poisson_mix.tempered_weights(docs), scratch_path(spark, "mixed"))
    return mixed.select("doc_id", "source", F.round("rate", 6).alias("rate"), "n_copies", "copy", "shuffle_key")


OP6_SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT source, (sqrt(n) / (SELECT sum(sqrt(n)) FROM n)) * (SELECT sum(n) FROM n) / n AS rate FROM n),
q AS (SELECT source, rate, greatest(1, ceil(rate / 500))::INT AS pieces, rate / greatest(1, ceil(rate / 500)) AS m FROM r),
c AS (SELECT source, sum(exp(CASE WHEN i = 0 THEN 0 ELSE i * ln(m) END - m - lgamma(i + 1))) OVER (PARTITION BY source ORDER BY i) AS cdf
      FROM (SELECT source, m, unnest(range(0, (ceil(m + 12 * sqrt(m)) + 31)::INT)) AS i FROM q)),
l AS (SELECT source, list(cdf) AS cdf FROM c GROUP BY 1),
u AS (SELECT doc_id, d.source, q.rate, l.cdf, unnest(range(0, q.pieces)) AS j FROM documents d JOIN q ON d.source IS NOT DISTINCT FROM q.source
      JOIN l ON d.source IS NOT DISTINCT FROM l.source),
k AS (SELECT doc_id, source, rate, sum(len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT / 4503599627370496.0)))::INT AS n_copies
      FROM u GROUP BY ALL)
SELECT doc_id, source, round(rate, 6) AS rate, n_copies, copy::INT AS copy,
       md5('order42:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(0, n_copies)) AS copy FROM k)
"""


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"))


def _op7_sql() -> str:
    """The tree level by level, as in the operator."""
    levels = ["t1", "t2", "t3"]
    ctes = ["""u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)""",
            """h AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)""",
            """r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                     WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                     WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                     WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
                     regexp_replace(regexp_replace(path, '[0-9a-f]{12,}', '<x>', 'g'), '[0-9]+', '<n>', 'g') AS typed FROM h)""",
            "v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS known FROM r)",
            """s0 AS (SELECT host, typed, count(*) FILTER (known = 'block') AS b, count(*) FILTER (known = 'allow') AS a,
                      coalesce(string_split(typed, '/')[2], '<none>') AS t1, coalesce(string_split(typed, '/')[3], '<none>') AS t2,
                      coalesce(string_split(typed, '/')[4], '<none>') AS t3,
                      CASE WHEN len(string_split(typed, '/')) > 4 THEN '**' ELSE '' END AS tail FROM v GROUP BY ALL)"""]
    last = "s0"
    for d, t in enumerate(levels):
        above = ", ".join(["host", *levels[:d]])
        ctes += [f"m{d} AS (SELECT {above} FROM (SELECT DISTINCT {above}, {t} FROM {last}) GROUP BY {above} HAVING count(*) > 20)",
                 f"w{d} AS (SELECT s.* REPLACE (CASE WHEN {t} <> '<none>' AND ({above}) IN (SELECT ({above}) FROM m{d}) THEN '*' ELSE {t} END AS {t}) FROM {last} s)"]
        last = f"w{d}"
    for d, t in reversed(list(enumerate(levels))):
        above = ", ".join(["host", *levels[:d]])
        ctes += [f"k{d} AS (SELECT {above}, {t}, sum(b) AS kb, sum(a) + sum(b) AS kn FROM {last} GROUP BY ALL HAVING sum(a) + sum(b) > 0)",
                 f"p{d} AS (SELECT {above}, sum(kb) / sum(kn) AS p FROM k{d} GROUP BY ALL)",
                 f"x{d} AS (SELECT {above}, {t} FROM k{d} JOIN p{d} USING ({above}) WHERE abs(kb / kn - p) <= 1.96::DOUBLE * sqrt(p * (1 - p) / kn) + 0.5::DOUBLE / kn)",
                 f"y{d} AS (SELECT s.* REPLACE (CASE WHEN ({above}, {t}) IN (SELECT ({above}, {t}) FROM x{d}) THEN '~' ELSE {t} END AS {t}) FROM {last} s)"]
        last = f"y{d}"
    nodes = ["host", "t1", "t2", "t3", "tail"]
    ctes += [f"g0 AS (SELECT host, t1, t2, t3, tail, sum(b) AS b, sum(a) AS a, (SELECT (coalesce(sum(b), 0) + 1) / (coalesce(sum(a) + sum(b), 0) + 4.0::DOUBLE) FROM {last}) AS share FROM {last} GROUP BY ALL)"]
    for d in range(1, 6):
        node = ", ".join(nodes[:d])
        ctes.append(f"g{d} AS (SELECT * EXCLUDE (share), (sum(b) OVER (PARTITION BY {node}) + 4.0::DOUBLE * share) / (sum(a + b) OVER (PARTITION BY {node}) + 4.0::DOUBLE) AS share FROM g{d - 1})")
    ctes += ["j AS (SELECT host, t1, t2, t3, tail, share > 0.5 AS reject FROM g5)",
             f"e AS (SELECT host, typed, reject FROM {last} JOIN j USING (host, t1, t2, t3, tail))"]
    return ("WITH " + ",\n".join(ctes) + "\nSELECT page_id, host, path, rule, coalesce(known, CASE WHEN reject THEN 'block' "
            "ELSE 'allow' END) AS verdict FROM v JOIN e USING (host, typed)")


OP7_SQL = _op7_sql()


def op8_fm_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", fm_decontam.n_hit().alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        fm_decontam.items_sha256().alias("items_sha256"),
                        fm_decontam.is_contaminated().alias("contaminated"))


OP8_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(ws[i:i + 12], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 11))) AS i FROM b WHERE len(ws) > 0)),
o AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) CROSS JOIN (SELECT DISTINCT k FROM p)
  WHERE i + k - 1 <= len(ws)),
m AS (SELECT DISTINCT doc_id, i, p.k, item_id FROM o JOIN p USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op9_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_popcount.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash_popcount.fp_hex().alias("fingerprint"), "component_id")


def op10_suffix_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_hash_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = written(prefix_trie.turn_arrays(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.trie(prefix_trie.with_borrowed_heads(arrays))


OP11_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT conv_id, turn, md5(octet_length(encode(role)) || ':' || role || text) AS id,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM t),
own AS (SELECT conv_id, list({'id': id, 'w': w} ORDER BY turn NULLS FIRST, id) AS turns FROM k GROUP BY 1),
-- CRC-32: its table of 256 from the polynomial 0xEDB88320, then byte by byte
crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM range(256) r(i)),
h AS (
  SELECT conv_id, turns, (xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
         lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 4)::BIGINT AS h FROM own, crc_table),
seq AS (
  SELECT h.conv_id, list_concat(coalesce(l.turns[:h.h], []), h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN own l ON l.conv_id = h.conv_id - h.conv_id % 20),
pre AS (
  SELECT conv_id, d, len(turns) AS n, sha256(array_to_string(list_transform(turns[:d], lambda x: x.id), ',')) AS node,
         CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(turns[:d - 1], lambda x: x.id), ',')) END AS parent,
         CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM seq)),
nodes AS (
  SELECT node, parent, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM pre GROUP BY 1, 2, 3),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
-- every node with every node on the way to it, by its smallest member's turns
above AS (SELECT f.node, f.n_children, (f.n_convs - 1) * f.w AS saved, p.node AS top
          FROM full_nodes f JOIN pre p ON p.conv_id = f.conv_id AND p.d <= f.d),
sums AS (SELECT top AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY 1)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums USING (node) LEFT JOIN full_nodes p ON p.node = f.parent
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), periodic_runs.planted_periods)
    best = periodic_runs.strongest()
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        periodic_runs.runs_sha256().alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_gga_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = gga_packing.pack(table(spark, sf_dir, "documents"), token_planes.public_tokenizer("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cuckoo_dedup": op1_cuckoo_dedup,
    "op2_html_gbt": op2_html_gbt,
    "op3_toxicity": op3_toxicity,
    "op4_token_planes": op4_token_planes,
    "op5_masked_lm": op5_masked_lm,
    "op6_poisson_mix": op6_poisson_mix,
    "op7_url_templates": op7_url_templates,
    "op8_fm_decontam": op8_fm_decontam,
    "op9_simhash_popcount": op9_simhash_popcount,
    "op10_suffix_hash_dedup": op10_suffix_hash_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_gga_packing": op13_gga_packing,
}
ORACLES: dict[str, str] = {
    "op1_cuckoo_dedup": OP1_SQL,
    "op6_poisson_mix": OP6_SQL,
    "op7_url_templates": OP7_SQL,
    "op8_fm_decontam": OP8_SQL,
    "op11_prefix_trie": OP11_SQL,
}
