"""DuckDB SQL for the registered queries that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"



def _cluster_rounds(clusters: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """Lloyd's rounds, every vector against every centroid."""
    square = f"list_sum([CAST((v.q[i] - c.q[i]) * (v.q[i] - c.q[i]) AS BIGINT) FOR i IN range(1, {dim + 1})])"
    steps = [f"""
v AS (SELECT row_number() OVER () AS r, vec_id, q FROM (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({dim} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = {dim} AND len(embedding) = {dim})),
c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (
  SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v ORDER BY h, q LIMIT {clusters}))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (SELECT v.r, c.c, {square} AS d FROM v, c{i} c) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
  SELECT best.c AS c, i, sum(x) AS s, count(*) AS n FROM (
    SELECT best, unnest(q) AS x, unnest(range({dim})) AS i FROM a{i} JOIN v USING (r)) GROUP BY ALL) GROUP BY c),
c{i + 1} AS (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)""")
    last = f"a{rounds}"
    return "WITH" + ",".join(steps) + f"""
SELECT v.vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM {last} JOIN v USING (r) JOIN c{rounds} c ON c.c = best.c"""


ORACLE: dict[str, str] = {
    "op2_warc": """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id
      FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages))""",
    "op3_repeats": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
win AS (SELECT doc_id, i, md5_number(array_to_string(words[i:i + 49], ' ')) AS h FROM (
  SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM again),
each AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
kept AS (SELECT e.doc_id, e.i, e.word, g.i IS NULL AS stays FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i)
SELECT w.doc_id, CAST(count(k.i) AS BIGINT) AS n_words, CAST(count(k.i) FILTER (NOT k.stays) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(k.word, ' ' ORDER BY k.i) FILTER (k.stays), '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id GROUP BY w.doc_id""",
    "op9_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words
           FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g FROM (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS first FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.first, w.doc_id)) AS component_id,
       least(w.doc_id, coalesce(c.first, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp c ON c.doc_id = w.doc_id""",
    "op11_heap_clusters": _cluster_rounds(),
    "op12_prefix_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 by bits: a byte is added, then eight shifts
crc AS (SELECT DISTINCT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
          string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
          lambda a, x: xor(xor(a, x) >> 1, CAST(3988292384 AS BIGINT) * (xor(a, x) & 1))), CAST(4294967295 AS BIGINT)) % 4 AS h FROM t),
parts AS (SELECT c.conv_id, 0 AS own, t.* EXCLUDE conv_id FROM crc c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.p <= c.h
          UNION ALL SELECT c.conv_id, 1, t.* EXCLUDE conv_id FROM crc c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h),
r AS (SELECT conv_id, row_number() OVER w AS d, len({_WORDS.format("text")}) AS words,
             list(md5(len(role) || ':' || role || text)) OVER (w ROWS UNBOUNDED PRECEDING) AS path
      FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY own, p)),
m AS (SELECT conv_id, d, words, md5(array_to_string(path, ',')) AS k FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM crc),
ends AS (SELECT d, k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
         FROM (SELECT * FROM m QUALIFY d = max(d) OVER (PARTITION BY conv_id)) GROUP BY d, k),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM m GROUP BY d, k),
linked AS (SELECT n.*, up.conv_id AS parent FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.d = n.d - 1 LEFT JOIN n up ON up.d = m.d AND up.k = m.k),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL),
each AS (SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN kids USING (conv_id, d)),
sub AS (SELECT up.d, up.k, count(*) FILTER (e.n_children = 0) AS n_leaves, sum((e.n_convs - 1) * e.words) AS saved
        FROM each e JOIN m up ON up.conv_id = e.conv_id AND up.d <= e.d GROUP BY up.d, up.k)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM each JOIN sub USING (d, k) LEFT JOIN ends USING (d, k)""",
}
