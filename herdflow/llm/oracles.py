"""DuckDB SQL for the corpus queries that SQL can express."""

# Draws per leaf of the tree, CRC-32 by its byte table, slots in hash order.
SHARDS_SQL = """
WITH tbl AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
             FROM range(256) r(i)),
leaves AS (SELECT s AS leaf, (s // 8) || '/' || (s // 4) || '/' || s AS path FROM range(17) r(s)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
        coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents),
draws AS (SELECT rid, leaf, -ln((CAST('0x' || substr(md5(k || ':' || path), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS draw
          FROM d, leaves),
picks AS (SELECT rid, arg_min(leaf, draw) FILTER (leaf < 16) AS shard, arg_min(leaf, draw) AS grown FROM draws GROUP BY rid),
b AS (SELECT rid, doc_id, k, strlen(text) + 1 AS size,
        list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM d),
c AS (SELECT b.* EXCLUDE (bytes), xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
      FROM b, tbl)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY md5('slot:' || k), doc_id, size, text_crc32) - 1 AS BIGINT) AS slot,
  CAST(grown AS INTEGER) AS grown_shard
FROM c JOIN picks USING (rid)
"""

# Natural shares: blocks of 8 rows per source, every block released at slot
# floor(i*T/b) and due by ceil((i+1)*T/b), earliest deadline first over all slots.
MIXING_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS src,
        md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM documents),
plan AS (SELECT src, n, n / sum(n) OVER () AS w, row_number() OVER (ORDER BY src) AS s, (n + 7) // 8 AS k
         FROM (SELECT src, count(*) AS n FROM d GROUP BY src)),
one AS (SELECT list(k ORDER BY s) AS ks, CAST(sum(k) AS BIGINT) AS slots FROM plan),
sim AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(ks, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM one
  UNION ALL
  SELECT t, list_transform(done, lambda x, i: x + CASE WHEN i = pick THEN 1 ELSE 0 END), pick
  FROM (SELECT sim.t + 1 AS t, sim.done AS done, list_min(list_transform(one.ks, lambda x, i:
          CASE WHEN sim.done[i] < x AND (sim.done[i] * one.slots) // x <= sim.t + 1
               THEN (((sim.done[i] + 1) * one.slots + x - 1) // x) * 1000000 + i END)) % 1000000 AS pick
        FROM sim, one WHERE sim.t + 1 < one.slots)),
times AS (SELECT t, pick AS s, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM sim WHERE t >= 0),
ranked AS (SELECT d.doc_id, d.source, plan.*, row_number() OVER (PARTITION BY d.src ORDER BY digest, doc_id) - 1 AS rank
           FROM d JOIN plan ON d.src = plan.src)
SELECT doc_id, source, true AS in_mix, w AS target_weight, rank // 8 AS block, ((rank // 8) * slots) // k AS release,
  ((rank // 8 + 1) * slots + k - 1) // k AS deadline, times.t AS slot, rank % 8 AS place
FROM ranked CROSS JOIN one JOIN times ON times.s = ranked.s AND times.j = rank // 8
"""

# BM25-like sums in whole numbers over all documents that share a term.
RANKED_SQL = r"""
WITH terms AS (SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
counted AS (SELECT rid, doc_id, term, count(*) AS tf FROM terms GROUP BY rid, doc_id, term),
tf AS (SELECT *, CAST(sum(tf) OVER (PARTITION BY rid) AS BIGINT) AS n FROM counted),
total AS (SELECT count(DISTINCT rid) AS docs, CAST(sum(tf) AS BIGINT) AS size FROM tf),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // size)))) AS BIGINT) AS score
  FROM items JOIN tf ON items.term = tf.term JOIN weighed ON items.term = weighed.term, total GROUP BY item_id, rid, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

# Every pair of a query and another row.
INNER_PRODUCTS_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""

# Words one edit apart share what is left without one code point; CRC-32 by its
# byte table; chains of forms by recursion.
VARIANTS_SQL = r"""
WITH RECURSIVE tbl AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
             FROM range(256) r(i)),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS raw FROM documents),
low AS (SELECT k, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY 1, 2),
b AS (SELECT run, n, list_transform(regexp_extract_all(hex(encode(k || ':' || run)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM low),
c AS (SELECT run, n, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM b, tbl),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM c),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
form AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, top,
    CASE WHEN top >= 5 * n THEN pick END AS form
  FROM words LEFT JOIN (SELECT near.word, n_near, top, min(other) FILTER (other_n = top) AS pick FROM near JOIN best ON near.word = best.word GROUP BY ALL) x ON words.word = x.word),
chain AS (SELECT word, word AS root FROM form UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON chain.root = form.word WHERE form.form IS NOT NULL),
depth AS (SELECT chain.word, chain.root FROM chain JOIN form ON chain.root = form.word WHERE form.form IS NULL)
SELECT form.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CASE WHEN form IS NOT NULL THEN top END AS form_n FROM form JOIN depth ON form.word = depth.word
"""
