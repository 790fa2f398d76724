"""DuckDB SQL of the clustering, divergence and decontamination queries."""


def centroids(k: int = 16, size: int = 64, rounds: int = 3) -> str:
    """The rounds of k-means, written out one after another."""
    nearest = "list_transform(c.cs, lambda m: list_sum(list_transform(list_zip(v.q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS q, embedding AS raw FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"c0 AS MATERIALIZED (SELECT list(q ORDER BY h NULLS LAST, raw) AS cs FROM (SELECT q, raw, sha256('1:' || vec_id) AS h FROM kept ORDER BY h NULLS LAST, raw LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS MATERIALIZED (SELECT vec_id, q, {nearest} AS ds FROM kept v, c{r} c)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, q, list_position(ds, list_min(ds)) AS j, list_min(ds) AS d FROM d{r})")
        if r < rounds:
            parts.append(
                f"""m{r} AS (SELECT j, list(CAST(((s - ((s % n) + n) % n) // n) AS HUGEINT) ORDER BY p) AS m FROM (
    SELECT j, p, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(range(1, {size + 1})) AS p, unnest(q) AS x FROM a{r}) GROUP BY j, p) GROUP BY j)"""
            )
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT list(coalesce(m, c.cs[i]) ORDER BY i) AS cs FROM (SELECT cs, unnest(range(1, len(cs) + 1)) AS i FROM c{r}) c LEFT JOIN m{r} ON j = i)")
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(j - 1 AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.cs[j], ',')) AS centroid_sha256
FROM a{rounds}, c{rounds} c"""
    )


DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
said AS MATERIALIZED (SELECT doc, lang, source, term, count(*) AS n FROM (SELECT doc, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term FROM said GROUP BY 1, 2 HAVING count(*) >= 10),
grps AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
counts AS MATERIALIZED (SELECT s.lang, s.source, s.term, CAST(sum(s.n) AS BIGINT) AS c FROM said s JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM counts GROUP BY 1, 2),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 2)) // (coalesce(n, 0) + 2 * v) AS HUGEINT) AS p
  FROM grps g JOIN kept k ON k.lang = g.lang JOIN sizes z ON z.lang = g.lang
    LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (SELECT lang, term, CAST(sum(c) AS BIGINT) AS c FROM counts GROUP BY 1, 2),
wholes AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM whole GROUP BY 1),
q AS (SELECT w.lang, w.term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (w.c + 2)) // (n + 2 * v) AS HUGEINT) AS q FROM whole w JOIN wholes USING (lang) JOIN sizes USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(f), 0) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
      SELECT x.lang, x.source AS s, y.source AS o, CAST(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS BIGINT) AS f
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) f ON f.lang = a.lang AND f.s = a.source AND f.o = b.source
  GROUP BY 1, 2, 3, 4),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(((p.p - q) * (p.p - q)) // (p.p + q) AS BIGINT) AS value
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE c > 0 AND p.p > q)
SELECT * FROM (
  SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 10
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
items AS (
  SELECT DISTINCT item, len(s) AS len, array_to_string(s, ' ') AS s FROM (SELECT item, w[i:i + least(10, len(w)) - 1] AS s FROM (
    SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
windows AS MATERIALIZED (SELECT DISTINCT len, s FROM items),
lens AS (SELECT DISTINCT len FROM windows),
spots AS (SELECT row, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM d, lens WHERE len(w) >= len),
hits AS MATERIALIZED (SELECT row, i, len, s FROM (SELECT row, i, len, array_to_string(w[i:i + len - 1], ' ') AS s FROM spots) JOIN windows USING (len, s)),
covered AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + len)) AS p FROM hits) GROUP BY 1),
found AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits JOIN items USING (len, s)) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN found USING (row)
"""
