"""DuckDB SQL for the operators that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

URL_FILTER = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS raw, r FROM rest
), urls AS (
  SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM parts
), rules(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), ranked AS (
  SELECT u.page_id, u.host, u.path, q.rhost || q.rpath AS rule, q.verdict,
         row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(q.rhost || q.rpath) DESC) AS n
  FROM urls u JOIN rules q ON (u.host = q.rhost OR ends_with(u.host, '.' || q.rhost)) AND starts_with(u.path, q.rpath)
)
SELECT u.page_id, u.host, u.path, k.rule, coalesce(k.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN ranked k ON k.page_id = u.page_id AND k.n = 1
"""

MULTI_INDEX = """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: CASE WHEN z[1] = z[2] THEN 0 ELSE 1 END)) AS INTEGER) AS distance
  FROM codes q JOIN codes c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

EXACT_DEDUP = r"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), best AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM rows
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM best
"""

#: crc32 by the table of its bytes, which is made by eight shifts of each; only of distinct features.
RESAMPLE = rf"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
), texts AS (
  SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark
), worded AS (
  SELECT side, id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), featured AS (
  SELECT side, id, len(w) AS n_words, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM worded
), counted AS (
  SELECT side, id, feature, count(*) AS n FROM featured GROUP BY ALL
), bytes AS (
  SELECT feature, list_transform(range(octet_length(encode(feature))), lambda i: CAST('0x' || substr(hex(encode(feature)), 2 * i + 1, 2) AS BIGINT)) AS b
  FROM (SELECT DISTINCT feature FROM counted)
), hashed AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table
), sizes AS (
  SELECT sum(n) FILTER (side = 'd') AS big_s, coalesce(sum(n) FILTER (side = 'b'), 0) AS big_t FROM counted
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(sum(n) FILTER (side = 'b'), 0) + 1)::DOUBLE * (any_value(big_s) + 10000)::DOUBLE / ((coalesce(sum(n) FILTER (side = 'd'), 0) + 1)::DOUBLE * (any_value(big_t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM counted JOIN hashed USING (feature), sizes GROUP BY bucket
), weighed AS (
  SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight
  FROM counted JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT d.id AS doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM worded d LEFT JOIN weighed USING (id) WHERE d.side = 'd'
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r.rank <= 25 * r.n // 100 THEN r.rank END AS rank FROM scored s LEFT JOIN ranked r USING (doc_id)
"""


def centroids(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """A pair of steps for each round: nearest centroids, then floored means."""

    def nearest(n: int) -> str:
        return f"""a{n} AS (
  SELECT vec_id, v, arg_min(cluster, struct_pack(d := distance, c := cluster)) AS cluster, min(distance) AS distance FROM (
    SELECT vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM kept, c{n}
  ) GROUP BY vec_id, v
)"""

    steps = []
    for n in range(rounds):
        steps.append(nearest(n))
        steps.append(f"""m{n + 1} AS (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
    SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{n}) GROUP BY cluster, i
  ) GROUP BY cluster
), c{n + 1} AS (
  SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n + 1} m USING (cluster)
)""")
    steps.append(nearest(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM kept ORDER BY sha256('{seed}:' || vec_id) LIMIT {k}
), {", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps)}
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""
