"""The thin ``opN_*`` queries: each applies one operator to its whole table.

``QUERIES`` maps a name to ``f(spark, sf_dir) -> DataFrame``; ``ORACLE`` holds
DuckDB SQL for those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import common, decontaminate, fingerprint, license, linefreq, mixing, ngram_join, packing, periodic, sharding, substring, tokenbin, toxicity, trie
from netloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


@_query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op3_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS gram
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), s AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT n FROM g) AS l, unnest(range(1, len(w) - n + 2)) AS t(i)
), h AS (
  SELECT s.doc_id, s.i, s.n, g.item_id FROM s JOIN g ON s.gram = g.gram AND s.n = g.n
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id
), m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linefreq.drop_boilerplate(table(spark, sf_dir, "pages"))
    return kept.select("page_id", "host", "n_lines", "n_dropped", common.sha256_hex(F.col("kept")).alias("kept_sha256"))


ORACLE["op6_line_dedup"] = rf"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)', 1)) AS host,
    list_filter(list_transform(string_split(replace(coalesce(html, ''), '<', chr(10) || '<'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages
), n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
l AS (SELECT host, line, count(*) AS held FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
c AS (SELECT host, list(line) AS common FROM l JOIN n USING (host) WHERE held > 1 AND held > pages * {linefreq.RATIO}::DOUBLE GROUP BY host),
k AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(common, []::VARCHAR[]), x)) AS kept FROM p LEFT JOIN c ON p.host = c.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k
"""


@_query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "shard", "shard_bytes")


ORACLE["op7_sharding"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    substr(((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT)::BIT)::VARCHAR, 5) AS h
  FROM documents
), nodes AS (
  SELECT depth, substr(h, 1, depth) AS prefix, sum(n_bytes) AS bytes, min(h) = max(h) AS single
  FROM d, unnest(range(0, 61)) AS t(depth) GROUP BY ALL
), leaf AS (
  SELECT doc_id, n_bytes, min(depth) AS depth, h FROM d, nodes
  WHERE nodes.prefix = substr(h, 1, depth) AND (bytes <= {sharding.SHARD_BYTES} OR single) GROUP BY ALL
)
SELECT doc_id, n_bytes, substr(h, 1, depth) AS shard, bytes::BIGINT AS shard_bytes FROM leaf JOIN nodes USING (depth) WHERE nodes.prefix = substr(h, 1, depth)
"""


@_query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


ORACLE["op9_source_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce('=' || doc_id::VARCHAR, '-') || '|' || coalesce('=' || source, '-') || '|' || coalesce('=' || text, '-')) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS everything,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onwards FROM s
), f AS (SELECT *, (everything - before) / onwards AS level, 3 * source_size <= (everything - before) / onwards * weight AS filled FROM o),
t AS (
  SELECT source, source_size, CASE WHEN filled THEN (3 * source_size)::DOUBLE ELSE least(max(CASE WHEN NOT filled THEN level END) OVER () * weight, 3 * source_size) END::DOUBLE AS target FROM f
), r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3) ELSE 0 END AS rate,
    (('0x' || substr(md5('{mixing.SEED}:' || key || ':' || row_number() OVER (PARTITION BY key)), 1, 13))::BIGINT)::DOUBLE / 4503599627370496 AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(rate) + (coin < rate - floor(rate))::INT) * size)::BIGINT AS taken FROM r
"""


@_query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


ORACLE["op5_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * both_have >= 85 * (p.n + q.n - both_have)),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT l.b AS a, r.c FROM r JOIN l ON l.a = r.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c)::BIGINT AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY ALL
"""


@_query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


ORACLE["op8_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM d, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50
), f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g),
c AS (SELECT DISTINCT doc_id, p FROM f, unnest(range(i, i + 50)) AS t(p) WHERE first < doc_id),
k AS (
  SELECT w.doc_id, count(*) AS n_kept, string_agg(w.w[p], ' ' ORDER BY p) AS kept
  FROM d AS w, unnest(range(1, len(w.w) + 1)) AS t(p) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = w.doc_id AND c.p = t.p) GROUP BY w.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


@_query
def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(table(spark, sf_dir, "documents"))


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(license.document_paths(table(spark, sf_dir, "documents")))


#: CRC-32 in SQL: its table of 256 values from the polynomial, and the value of a string of digits.
_CRC = """k AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""
_CRC_OF = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


@_query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.report(table(spark, sf_dir, "conversations"))


ORACLE["op11_conversation_trie"] = rf"""
WITH {_CRC}, t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, conv_id - conv_id % {trie.GROUP} AS base, {_CRC_OF.format("conv_id::VARCHAR")} % {trie.MOST} AS h FROM (SELECT DISTINCT conv_id FROM t), k),
r AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h
), q AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, md5(length(role) || ':' || role || text) AS k,
    len(regexp_extract_all(text, '[^ 	-
]+')) AS words FROM r
), p AS (
  SELECT conv_id, d, md5(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node, words FROM q
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), n AS (SELECT d AS depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY d, node),
u AS (SELECT n.depth, n.node, p.node AS parent FROM n JOIN p ON p.conv_id = n.conv_id AND p.d = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM u GROUP BY ALL),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, node)),
subtree AS (
  SELECT p.d AS depth, p.node, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * own.words) AS saved
  FROM own JOIN p ON p.conv_id = own.conv_id AND p.d <= own.depth GROUP BY ALL
), e AS (
  SELECT depth, node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max(d) AS depth, arg_max(node, d) AS node FROM p GROUP BY conv_id) GROUP BY ALL
)
SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN subtree USING (depth, node) LEFT JOIN e USING (depth, node) LEFT JOIN u USING (depth, node) LEFT JOIN n AS up ON up.depth = own.depth - 1 AND up.node = u.parent
"""


@_query
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


ORACLE["op13_periodic_runs"] = rf"""
WITH {_CRC}, d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w, {_CRC_OF.format("doc_id::VARCHAR")} AS h FROM documents, k
), g AS (SELECT doc_id, w, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS moved FROM d),
r AS (SELECT *, CASE WHEN moved THEN g % n ELSE n END AS a, CASE WHEN moved THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM g),
x AS (SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word FROM r, unnest(range(n)) AS t(i)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM x JOIN x AS y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * {periodic.TIMES} <= x.n),
s AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM e)
  GROUP BY doc_id, p, island HAVING count(*) + p >= greatest({periodic.LEAST}, {periodic.TIMES} * p)
), u AS (SELECT doc_id, start, length, min(p) AS period FROM s GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, i FROM u, unnest(range(start + period, start + length)) AS t(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
every AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM u GROUP BY doc_id),
best AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""
