"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from anomalytics.llm.url_filter import URL

STRIP = r"'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$'"


def lower_ascii(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP3 = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored
)
SELECT query_id, CAST(n AS INTEGER) AS "rank", vec_id, score FROM ranked WHERE n <= 5
"""

OP4 = f"""
WITH parsed AS (
  SELECT page_id, url, lower(regexp_extract(url, '{URL}', 1)) AS host, regexp_extract(url, '{URL}', 2) AS path,
         TIMESTAMP '2024-01-01' + to_days(CAST((page_id * 7919) % 730 AS INTEGER)) AS fetched_at
  FROM pages
), named AS (
  SELECT DISTINCT host AS pattern, 'host' AS category FROM parsed WHERE host <> ''
  UNION
  SELECT DISTINCT host || '/' || string_split(path, '/')[2], 'path' FROM parsed
  WHERE host <> '' AND len(string_split(path, '/')) > 1 AND string_split(path, '/')[2] <> ''
), numbered AS (
  SELECT *, CAST('0x' || substr(md5(pattern), 1, 6) AS BIGINT) AS m FROM named
), spans AS (      -- written out: the first listing ends when the host is taken off or listed again, whichever is first
  SELECT pattern, category, m % 500 AS a, least(m % 500 + 20 + m % 90, CASE WHEN m % 2 = 0 THEN m % 500 + 200 END) AS b
  FROM numbered WHERE category = 'host' AND m % 3 = 0
  UNION ALL
  SELECT pattern, category, m % 500 + 200, NULL FROM numbered WHERE category = 'host' AND m % 3 = 0 AND m % 2 = 0
  UNION ALL
  SELECT pattern, category, m % 600, NULL FROM numbered WHERE category = 'path' AND m % 5 = 0
), hits AS (
  SELECT p.page_id, p.url, p.fetched_at, s.category, s.pattern
  FROM parsed p JOIN spans s
    ON (CASE WHEN s.category = 'host' THEN p.host = s.pattern OR ends_with(p.host, '.' || s.pattern)
             ELSE starts_with(p.host || regexp_replace(p.path, '/+', '/', 'g') || '/', s.pattern || '/') END)
   AND date_diff('day', TIMESTAMP '2024-01-01', p.fetched_at) >= s.a
   AND (s.b IS NULL OR date_diff('day', TIMESTAMP '2024-01-01', p.fetched_at) < s.b)
)
SELECT p.page_id, p.url, p.fetched_at, count(h.pattern) > 0 AS blocked, count(h.pattern) AS n_active,
       coalesce(string_agg(DISTINCT h.category, ',' ORDER BY h.category), '') AS categories,
       coalesce(string_agg(DISTINCT h.pattern, ',' ORDER BY h.pattern), '') AS patterns
FROM (SELECT DISTINCT page_id, url, fetched_at FROM parsed) p LEFT JOIN hits h
  ON p.page_id IS NOT DISTINCT FROM h.page_id AND p.url IS NOT DISTINCT FROM h.url
 AND p.fetched_at IS NOT DISTINCT FROM h.fetched_at
GROUP BY p.page_id, p.url, p.fetched_at
"""

OP9 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), first AS (
  SELECT payload_digest, min(page_id) AS page_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.page_id IS NULL OR f.page_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.page_id <> p.page_id THEN f.page_id END AS refers_to
FROM p LEFT JOIN first f USING (payload_digest)
"""

#: rows (doc_id, pos, line, key) of every line, and the keys that go with the document that keeps them
LINES = f"""
split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {{documents}}
), line AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split
), keyed AS (
  SELECT *, {lower_ascii(f"regexp_replace(line, {STRIP}, '', 'g')")} AS key FROM line
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS dropped FROM keyed k LEFT JOIN repeated r USING (key)
), rejoined AS (
  SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS kept
  FROM judged GROUP BY doc_id
)"""

OP10 = f"""
WITH {LINES.format(documents="documents")}
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM rejoined
"""


#: a document's words are dealt with in two turns: what of [start, end) of the turn is under the source's target
OP11 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2 * sum(size) AS cap,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
         CAST(sum(sum(size)) OVER () AS DOUBLE) * 3 / 2 AS budget
  FROM d GROUP BY source
), filled AS (
  SELECT *, CAST(budget - coalesce(sum(cap) OVER before, 0) AS DOUBLE) AS remaining, CAST(sum(w) OVER onward AS DOUBLE) AS sharing
  FROM s
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT min_by(remaining / sharing, CAST(cap AS DOUBLE) / w) AS level FROM filled WHERE cap * sharing > remaining * w
), t AS (
  SELECT source, source_size, CASE WHEN cap * sharing > remaining * w THEN w * level ELSE CAST(cap AS DOUBLE) END AS target
  FROM filled LEFT JOIN level ON true
), q AS (
  SELECT source, doc_id, size, count(*) AS copies, size * count(*) AS words,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)), 1, 15) AS BIGINT) AS key
  FROM d GROUP BY source, doc_id, size
), placed AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size) - words AS start FROM q
), dealt AS (
  SELECT p.source, p.doc_id, p.size, t.source_size, t.target,
         greatest(0, least(words, CAST(floor(target) AS BIGINT) - start)) // copies
         + greatest(0, least(words, CAST(floor(target) AS BIGINT) - start - source_size)) // copies AS taken
  FROM placed p JOIN t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken
FROM d JOIN dealt ON d.source IS NOT DISTINCT FROM dealt.source AND d.doc_id IS NOT DISTINCT FROM dealt.doc_id AND d.size = dealt.size
"""

OP13 = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array({lower_ascii("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
), counted AS (
  SELECT lang, sum(len(w)) AS n FROM split GROUP BY lang
), started AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), occurring AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS size
  FROM started, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)
), known AS (
  SELECT lang, phrase, size, count(*) AS f FROM occurring GROUP BY ALL HAVING count(*) >= 30
), cut AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
         array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM known, (SELECT unnest([1, 2, 3]) AS k) WHERE k < size
), scored AS (
  SELECT cut.lang, cut.phrase, a, k, h.f AS l, t.f AS r, CAST(2000000::HUGEINT * a // (h.f + t.f) AS BIGINT) AS score
  FROM cut JOIN known h ON h.lang = cut.lang AND h.phrase = head JOIN known t ON t.lang = cut.lang AND t.phrase = tail
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS place FROM lowest s
  WHERE NOT EXISTS (
    SELECT 1 FROM known o WHERE o.lang = s.lang AND o.size >= 3 AND len(string_split(s.phrase, ' ')) < o.size
      AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * o.f >= 80 * s.a)
)
SELECT lang, place AS "rank", phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN counted USING (lang) WHERE place <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3, "op4_url_filter": OP4, "op9_warc": OP9, "op10_line_dedup": OP10, "op11_mix": OP11,
            "op13_collocations": OP13}
