"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_decontaminate import op1_decontaminate
from .op2_warc_normalise import op2_warc_normalise
from .op3_token_shards import op3_token_shards
from .op4_suffix_dedup import op4_suffix_dedup
from .op5_language_id import op5_language_id
from .op6_substring_dedup import op6_substring_dedup
from .op7_sentencepiece import op7_sentencepiece
from .op8_toxicity import op8_toxicity
from .op9_jaccard_join import op9_jaccard_join
from .op10_fingerprints import op10_fingerprints
from .op11_ball_kmeans import op11_ball_kmeans
from .op12_jump_shards import op12_jump_shards
from .op13_fill_in_middle import op13_fill_in_middle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_warc_normalise, op3_token_shards, op4_suffix_dedup, op5_language_id, op6_substring_dedup, op7_sentencepiece,
        op8_toxicity, op9_jaccard_join, op10_fingerprints, op11_ball_kmeans, op12_jump_shards, op13_fill_in_middle,
    )
}


def _rounds(n: int) -> str:
    """CTEs a1, c1, ... a(n + 1): nearest centroids, then floors of exact means, n times."""
    out = []
    for i in range(1, n + 2):
        out.append(f"""
d{i} AS (SELECT row, vec_id, x, number, CAST(list_sum(list_transform(range(1, 65), lambda k: (x[k] - y[k]) * (x[k] - y[k]))) AS BIGINT) AS d FROM v, c{i - 1}),
a{i} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(number, {{'d': d, 'n': number}}) AS cluster, min(d) AS distance FROM d{i} GROUP BY row)""")
        if i <= n:
            out.append(f"""
s{i} AS (SELECT cluster, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, 65) AS t(k) GROUP BY cluster, k),
m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY k) AS y FROM s{i} GROUP BY cluster),
c{i} AS (SELECT number, coalesce(m.y, c.y) AS y FROM c{i - 1} AS c LEFT JOIN m{i} AS m ON m.cluster = c.number)""")
    return ",".join(out)


#: The others tokenise, learn, or score alignments and sketches; tests/llm holds them against brute force.
SQL: dict[str, str] = {
    "op2_warc_normalise": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p),
c AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(s, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> k) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM c""",
    "op4_suffix_dedup": """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, i, substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS byte, CASE WHEN 2 * (i + 100) <= length(x) THEN md5(substr(x, CAST(2 * i + 1 AS BIGINT), 200)) END AS w FROM (SELECT doc_id, x, unnest(range(length(x) // 2)) AS i FROM t)),
f AS (SELECT *, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM b),
g AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS edge FROM g),
r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE edge) AS spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY 1)
SELECT t.doc_id, coalesce(n, 0) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM t LEFT JOIN r ON t.doc_id = r.doc_id""",
    "op6_substring_dedup": """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
b AS (SELECT doc_id, i, x[i] AS word, CASE WHEN i + 19 <= len(x) THEN array_to_string(x[i:i + 19], ' ') END AS w FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM t)),
f AS (SELECT *, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM b),
g AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY 1)
SELECT t.doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN r ON t.doc_id = r.doc_id""",
    "op9_jaccard_join": """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
m AS (SELECT doc_id, x, min(doc_id) OVER (PARTITION BY x) AS rep, count(*) OVER (PARTITION BY x) AS copies FROM t),
s AS (SELECT DISTINCT doc_id, array_to_string(x[i:i + 4], ' ') AS g FROM (SELECT doc_id, x, unnest(range(1, greatest(len(x) - 4, 1) + 1)) AS i FROM m WHERE doc_id = rep AND len(x) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 5 * k >= 4 * (u.n + v.n - k)),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
class AS (SELECT a, min(b) AS least FROM reach GROUP BY 1),
links AS (SELECT l.a, sum(c.copies) AS n FROM l JOIN m c ON c.doc_id = l.b GROUP BY 1)
SELECT m.doc_id, least(m.rep, coalesce(class.least, m.rep)) AS class_id, m.rep AS copy_of, CAST(coalesce(links.n, 0) + m.copies - 1 AS BIGINT) AS n_links FROM m LEFT JOIN class ON class.a = m.rep LEFT JOIN links ON links.a = m.rep""",
    "op11_ball_kmeans": f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS number, x AS y FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT 16)),{_rounds(3)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(y, ',')) AS centroid_sha256 FROM a4 JOIN c3 ON c3.number = a4.cluster""",
    "op12_jump_shards": """
WITH RECURSIVE k AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS HUGEINT) AS key FROM documents),
jumps AS (SELECT row, key, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM k
UNION ALL SELECT row, next, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((next >> 33) + 1 AS DOUBLE))) AS BIGINT) FROM (SELECT row, b, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jumps WHERE j < 17)),
s AS (SELECT row, max(b) FILTER (WHERE b < 16) AS shard, max(b) AS grown FROM jumps GROUP BY row),
crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i)) AS z),
crc AS (SELECT row, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, x: xor(c >> 8, z[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM k, crc_table)
SELECT doc_id, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM k JOIN s USING (row) JOIN crc USING (row)""",
    "op13_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+'), lambda x: length(x)) AS w,
CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(w) AS n, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
e AS (SELECT *, CAST(coalesce(list_sum(w[1:least(h1 % (n + 1), h2 % (n + 1))]), 0) AS BIGINT) AS p, CAST(coalesce(list_sum(w[1:greatest(h1 % (n + 1), h2 % (n + 1))]), 0) AS BIGINT) AS q FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, p) || '<S>' || substr(t, q + 1) || '<M>' || substr(t, p + 1, q - p)
ELSE '<S>' || substr(t, q + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, q - p) END) AS output_sha256, sha256(t) AS restored_sha256 FROM e""",
}
