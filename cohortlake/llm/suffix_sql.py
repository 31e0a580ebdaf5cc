"""The result of the suffix dedup query in DuckDB SQL: every window hashed, without filters or sorting of suffixes."""

ORACLE = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS rn, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT rn, c, substr(h, 2 * c + 1, 1198) AS h FROM (SELECT rn, h, unnest(range(0, len(h) // 2 - 99, 500)) AS c FROM d WHERE len(h) >= 200)),
w AS (SELECT rn, c + s AS s, md5(substr(h, 2 * s + 1, 200)) AS k FROM (SELECT rn, c, h, unnest(range(0, len(h) // 2 - 99)) AS s FROM e)),
f AS (SELECT k, min(rn * 4294967296 + s) AS first FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT w.rn, w.s FROM w JOIN f USING (k) WHERE w.rn * 4294967296 + w.s > f.first),
g AS (SELECT rn, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rn ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT rn, s, sum(new) OVER (PARTITION BY rn ORDER BY s) AS n FROM g),
p AS (SELECT rn, n, min(s) AS a, max(s) + 100 AS z FROM i GROUP BY rn, n),
q AS (SELECT rn, n, z AS a, coalesce(lead(a) OVER (PARTITION BY rn ORDER BY a), 4294967296) AS z FROM p UNION ALL SELECT rn, 0, 0, min(a) FROM p GROUP BY rn),
t AS (SELECT q.rn, string_agg(substr(d.h, (2 * q.a + 1)::BIGINT, (2 * (least(q.z, len(d.h) // 2) - q.a))::BIGINT), '' ORDER BY q.a) AS h FROM q JOIN d USING (rn) GROUP BY q.rn),
c AS (SELECT rn, count(*) AS n, sum(z - a) AS removed FROM p GROUP BY rn)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(c.removed, 0)::BIGINT AS n_removed, coalesce(c.n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t.h, d.h))) AS kept_sha256
FROM d LEFT JOIN c USING (rn) LEFT JOIN t USING (rn)"""
