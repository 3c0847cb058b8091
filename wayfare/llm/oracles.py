"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from wayfare.llm.licenses import PHRASES, TEMPLATES, sequence, tokens
from wayfare.llm.secrets import ACCESS, ALPHABETS, ASSIGN, BINS, CANDIDATE, HALF, HEX

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLES: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + 9], ' ') AS s
       FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS s
       FROM d, lens, unnest(range(1, len(w) - m + 2)) AS t(i)),
hit AS (SELECT DISTINCT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.m = bw.m),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(range(i, i + m)) AS t(k) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
               string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
""",
    "op7_minhash_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
      FROM d, unnest(range(1, greatest(2, len(w) - 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
""",
    "op4_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, unnest(range(0, greatest(0, len(h) // 2 - 49))) AS t(i)),
least AS (SELECT s, min(doc_id) AS least FROM s GROUP BY s),
gone AS (SELECT doc_id, i FROM s JOIN least USING (s) WHERE doc_id > least),
edge AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + 50 OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
         FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edge),
span AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, run),
gap AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY a)
        UNION ALL SELECT d.doc_id, coalesce(max(b), 0), len(any_value(h)) // 2 FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op5_license_scan": f"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
p AS (SELECT * FROM (VALUES {", ".join(f"({x.split()}, '{label}')" for x, label in PHRASES.items())}) AS t(p, label)),
b AS (SELECT doc_id, i - 1 AS i, label FROM d, p, unnest(range(1, len(w) - len(p) + 2)) AS t(i) WHERE w[i : i + len(p) - 1] = p),
n AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, list_sort(list(DISTINCT label)) AS l FROM b GROUP BY doc_id),
t AS (SELECT * FROM (VALUES {", ".join(f"('{label}', {sorted(tokens(x))}, {-(-100 * len(sequence(x)) // 80)})" for label, x in TEMPLATES)}) AS t(label, words, k)),
m AS (SELECT doc_id, label, max(len(list_intersect(words, w[i : i + k - 1])) / len(words)) AS share
      FROM d JOIN t ON 100 * len(list_intersect(words, w)) >= 80 * len(words), unnest(range(1, len(w) + 1)) AS u(i)
      GROUP BY doc_id, label, words HAVING 100 * max(len(list_intersect(words, w[i : i + k - 1]))) >= 80 * any_value(len(words))),
s AS (SELECT doc_id, max(share) AS share, list(DISTINCT label) AS l FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_base, n.a::BIGINT AS first_word, n.b::BIGINT AS last_word,
       coalesce(array_to_string(n.l, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(n.l, []), coalesce(s.l, [])))), ',') AS labels,
       CASE WHEN n.n > 0 THEN 1.0 ELSE coalesce(s.share, 0) END::DOUBLE AS score
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
""",
    "op3_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS kind, string_split_regex(t, {_quoted(x)}) AS p, regexp_extract_all(t, {_quoted(x)}) AS m, regexp_extract_all(t, {_quoted(x)}, {g}) AS g FROM d WHERE regexp_matches(t, {_quoted(x)})" for i, (x, g) in enumerate(((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (CANDIDATE, 0))))}),
s AS (SELECT doc_id, kind, (list_sum(list_transform(p[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0))::BIGINT AS a, length(m[i]) AS n, g[i] AS part
      FROM k, unnest(range(1, len(m) + 1)) AS u(i)),
base AS (SELECT doc_id, kind, a, a + n AS b FROM s WHERE kind IN (1, 2) OR kind = 0 AND length(part) >= 6),
cand AS (SELECT *, row_number() OVER () AS id, CASE {" ".join(f"WHEN translate(part, '{x}', '') = '' THEN '{x}'" for x in ALPHABETS.values())} ELSE '{"".join(sorted(set("".join(ALPHABETS.values()))))}' END AS al
         FROM s WHERE kind = 3 AND regexp_matches(part, '[0-9]') AND regexp_matches(part, '[A-Za-z]')),
ch AS (SELECT id, n::DOUBLE AS n, length(al)::DOUBLE AS k, i, part[i] AS c, instr(al, part[i]) - 1.0::DOUBLE AS v, instr(al, part[i + 1]) - 1.0::DOUBLE AS w, i < n AS more FROM cand, unnest(range(1, n + 1)) AS u(i)),
sq AS (SELECT id, sum(x * x)::DOUBLE AS squares FROM (SELECT id, c, count(*) AS x FROM ch GROUP BY ALL) GROUP BY id),
mo AS (SELECT id, any_value(n) AS n, any_value(k) AS k, avg(v) AS mean, count(*) FILTER (v >= k / 2)::DOUBLE AS h, 1.0 + count(*) FILTER (more AND (v >= k / 2) <> (w >= k / 2)) AS turns FROM ch GROUP BY id),
se AS (SELECT id, sum((v - mean) * (v - mean)) AS power, sum((v - mean) * (w - mean)) FILTER (more) AS lag FROM ch JOIN mo USING (id) GROUP BY id),
st AS (SELECT id, n, 2 * h * (n - h) AS pairs, turns, (lag / greatest(power, 1e-9) + 1 / n) * sqrt(n) AS z3,
              (pow(greatest(squares * k / n - n, 0) / (k - 1), 1 / 3::DOUBLE) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS z1 FROM mo JOIN sq USING (id) JOIN se USING (id)),
zs AS (SELECT id, n, unnest([z1, (turns - (pairs / n + 1)) / sqrt(greatest(pairs * (pairs - n) / (n * n * (n - 1)), 1e-9)), z3]) AS z FROM st),
ps AS (SELECT id, n, 1 / (1 + 0.2316419 * abs(z)) AS t, exp(-z * z / 2) / 2.5066282746310002 AS phi FROM zs),
ys AS (SELECT id, any_value(n) AS n, -sum(ln(least(1, greatest(1e-100, 2 * phi * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))))) AS y FROM ps GROUP BY id),
bi AS (SELECT id, (CASE WHEN n >= 64 THEN 2 WHEN n >= 32 THEN 1 ELSE 0 END) AS cl, greatest(0, least({BINS}, floor(20 * (y - ln(1 + y + y * y / 2)))))::INTEGER AS bin FROM ys),
co AS (SELECT cl, bin, count(*) AS x FROM bi GROUP BY ALL),
cu AS (SELECT cl, bin, sum(x) OVER (PARTITION BY cl ORDER BY bin) AS taken, coalesce(sum(x) FILTER (bin < {HALF}) OVER (PARTITION BY cl), 0) / (1 - exp(-{HALF} / 20::DOUBLE)) AS drawn FROM co),
mx AS (SELECT cl, max(bin) AS most FROM cu WHERE 1 - drawn * (1 - exp(-(bin + 1) / 20::DOUBLE)) / taken <= 0.05 GROUP BY cl),
found AS (SELECT doc_id, kind, a, b FROM base UNION ALL
          SELECT doc_id, 3, a, a + n FROM cand JOIN bi USING (id) JOIN mx USING (cl) WHERE bin <= most AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = cand.doc_id AND base.a < cand.a + cand.n AND cand.a < base.b)),
told AS (SELECT *, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || a || ':' || b AS said FROM found),
sums AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
                string_agg(said, ',' ORDER BY a, kind, b) FILTER (kind < 3) AS own, string_agg(said, ',' ORDER BY a, kind, b) AS every FROM told GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN sums USING (doc_id)
""",
}
