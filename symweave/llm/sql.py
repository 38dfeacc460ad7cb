"""DuckDB counterparts of the training-data queries that SQL can express."""

OP1 = r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM cut),
windows AS (
  SELECT doc_id, i, word, CASE WHEN count(*) OVER ahead = 35 THEN md5(string_agg(word, ' ') OVER ahead) END AS run
  FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
),
counted AS (SELECT doc_id, i, word, run IS NOT NULL AND count(*) OVER (PARTITION BY run) > 1 AS again FROM windows),
judged AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM counted),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS left_over
  FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

OP10 = r"""
WITH rows AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM rows WINDOW g AS (PARTITION BY text_sha256)
"""

#: Thirty-two halvings find the exponent; the entropy aimed at is 0.9 of the largest possible one and the limit four repeats.
OP5 = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
         CAST('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, '-'), coalesce(text, ''))), 1, 15) AS BIGINT) AS tie
  FROM documents
),
totals AS (SELECT source, sum(n)::DOUBLE AS total, CAST(ceil(sqrt(count(*))) AS BIGINT) AS blocks FROM rows GROUP BY source HAVING sum(n) > 0),
corpus AS (SELECT sum(total) AS words, list(total / (SELECT sum(total) FROM totals)) AS p FROM totals),
halved AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN enough THEN mid ELSE low END, CASE WHEN enough THEN high ELSE mid END
  FROM (
    SELECT step, low, high, mid, ln(scale) - logs / scale >= 0.9 * ln(len(p)) AS enough
    FROM (
      SELECT step, low, high, (low + high) / 2 AS mid, p, list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2))) AS scale,
             list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2) * ln(pow(x, (low + high) / 2)))) AS logs
      FROM halved, corpus WHERE step < 32
    )
  )
),
even AS (
  SELECT CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= 0.9 * ln(len(p)) - 1e-12 THEN 1.0
              ELSE (SELECT low FROM halved WHERE step = 32) END AS alpha, p FROM corpus
),
held AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN most <= 4 THEN low ELSE mid END, CASE WHEN most <= 4 THEN mid ELSE high END
  FROM (
    SELECT step, low, high, (low + high) / 2 AS mid,
           list_max(list_transform(p, lambda x: pow(x, (low + high) / 2) / x)) / list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2))) AS most
    FROM held, corpus WHERE step < 32
  )
),
chosen AS (
  SELECT CASE WHEN list_max(list_transform(p, lambda x: pow(x, alpha) / x)) / list_sum(list_transform(p, lambda x: pow(x, alpha))) > 4 * (1 + 1e-12)
              THEN (SELECT high FROM held WHERE step = 32) ELSE alpha END AS alpha FROM even
),
quotas AS (
  SELECT source, total, blocks, pow(total / words, alpha) / (SELECT sum(pow(total / words, alpha)) FROM totals, corpus, chosen) AS weight, words
  FROM totals, corpus, chosen
),
mix AS (
  SELECT source, blocks, weight, floor(round(weight * words, 6) / total) AS passes, round(weight * words, 6) - floor(round(weight * words, 6) / total) * total AS rest
  FROM quotas
),
placed AS (SELECT r.*, coalesce(weight, 0.0) AS weight, tie % blocks AS block, passes, rest FROM rows r LEFT JOIN mix m ON r.source IS NOT DISTINCT FROM m.source),
sums AS (SELECT source, block, passes, rest, sum(n) AS held FROM placed WHERE block IS NOT NULL GROUP BY ALL),
turns AS (
  SELECT *, CAST('0x' || substr(md5(concat_ws(':', '20', pass::BIGINT::VARCHAR, coalesce(source, '-'), block::VARCHAR)), 1, 15) AS BIGINT) AS turn
  FROM (SELECT *, unnest(generate_series(0, passes::BIGINT)) AS pass FROM sums)
),
ranked AS (
  SELECT *, row_number() OVER w AS place, coalesce(sum(held) OVER (PARTITION BY source, pass ORDER BY turn, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM turns WINDOW w AS (PARTITION BY source, pass ORDER BY turn, block)
),
ends AS (
  SELECT source, block, CASE WHEN rest - before <= 0 THEN 0.0 WHEN held <= rest - before THEN NULL ELSE rest - before END AS open FROM ranked WHERE pass = passes
),
counted AS (
  SELECT p.*, coalesce(passes, 0) + CASE WHEN passes IS NULL THEN 0 WHEN e.open IS NULL THEN 1 WHEN e.open <= 0 THEN 0
      WHEN sum(n) OVER (PARTITION BY p.source, p.block ORDER BY md5(concat_ws(':', '20', passes::BIGINT::VARCHAR, tie::VARCHAR))[1:15], doc_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= e.open THEN 1 ELSE 0 END AS copies
  FROM placed p LEFT JOIN ends e ON p.source IS NOT DISTINCT FROM e.source AND p.block = e.block
),
copied AS (SELECT *, unnest(CASE WHEN copies > 0 THEN generate_series(0, copies::BIGINT - 1) ELSE [NULL::BIGINT] END) AS pass FROM counted)
SELECT doc_id, c.source, n AS n_tokens, round(weight, 9) AS weight, copies::INT AS copies, (c.pass + 1)::INT AS pass, r.place::INT AS block,
       CASE WHEN c.pass IS NOT NULL THEN row_number() OVER (PARTITION BY c.source, c.block, c.pass ORDER BY md5(concat_ws(':', '20', c.pass::VARCHAR, tie::VARCHAR))[1:15], doc_id) END::INT AS position
FROM copied c LEFT JOIN ranked r ON c.source IS NOT DISTINCT FROM r.source AND c.block = r.block AND c.pass = r.pass
"""

OP7 = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
patterns AS (
  SELECT * FROM (VALUES ('email', 1), ('ip', 2), ('card', 3), ('phone', 4)) AS p(kind, rank)
),
found AS (
  SELECT doc_id, kind, rank, unnest(m) AS hit, generate_subscripts(m, 1) AS k, parts
  FROM (SELECT doc_id, kind, rank, CASE kind WHEN 'email' THEN regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 'ip' THEN regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')
               WHEN 'card' THEN regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+') ELSE regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') END AS m,
               CASE kind WHEN 'email' THEN regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 'ip' THEN regexp_split_to_array(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')
               WHEN 'card' THEN regexp_split_to_array(t, '[0-9](?:[\x20-]?[0-9])+') ELSE regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]') END AS parts
        FROM texts, patterns)
),
ends AS (
  SELECT doc_id, kind, rank, hit, regexp_replace(hit, '[^0-9]', '', 'g') AS digits,
         sum(length(parts[k]) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS stop FROM found
),
base AS (
  SELECT doc_id, kind, rank, hit, digits, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop FROM ends
  WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN list_max(list_transform(string_split(hit, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE coalesce(try_cast(x[-9:] AS INT), 0) END)) <= 255
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
        CASE WHEN (length(digits) - i) % 2 = 0 THEN digits[i]::INT WHEN digits[i]::INT * 2 > 9 THEN digits[i]::INT * 2 - 9 ELSE digits[i]::INT * 2 END)) % 10 = 0
    ELSE length(digits) BETWEEN 9 AND 15 END
),
shown AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY rank, start) AS base
  FROM base GROUP BY doc_id
),
words AS (
  SELECT doc_id, word, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY k) - length(word))::BIGINT AS start
  FROM (SELECT doc_id, unnest(w) AS word, unnest(g[1:len(w)]) AS gap, generate_subscripts(w, 1) AS k
        FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, regexp_split_to_array(t, '[^\x20\x09-\x0D]+') AS g FROM texts))
),
terms AS (SELECT doc_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, start, start + length(word) AS stop FROM words),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM terms GROUP BY term),
near AS (
  SELECT doc_id, term, start, stop FROM terms t
  WHERE doc_id IN (SELECT doc_id FROM base) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.start < t.stop AND t.start < b.stop)
),
entities AS (
  SELECT DISTINCT doc_id, concat(kind, ':', CASE WHEN kind IN ('email', 'ip') THEN lower(hit) ELSE digits END) AS entity FROM base
),
numbers AS (SELECT entity, count(*) AS n FROM entities GROUP BY entity),
total AS (SELECT count(*)::DOUBLE AS total FROM documents),
told AS (
  SELECT entity, term, c >= df AS exact FROM (
    SELECT e.entity, s.term, n, df, count(*) AS c FROM (SELECT DISTINCT doc_id, term FROM near) s JOIN entities e USING (doc_id) JOIN numbers USING (entity) JOIN df USING (term)
    GROUP BY ALL
  ), total WHERE n < total AND df <= pow(total, 1 - 0.8) * pow(n, 0.8) * (1 + 1e-9) AND log2(c * total / (df * n)) >= 0.8 * log2(total / n)
),
marked AS (
  SELECT n.doc_id, n.start, n.stop, bool_or(exact) AS exact FROM near n JOIN entities e USING (doc_id) JOIN told USING (entity, term) GROUP BY ALL
),
extra AS (
  SELECT doc_id, string_agg(concat(CASE WHEN exact THEN 'remove' ELSE 'generalise' END, ':', start, ':', stop), ',' ORDER BY exact, start, stop) AS extra FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, concat_ws(',', base, extra) AS spans
FROM documents LEFT JOIN shown USING (doc_id) LEFT JOIN extra USING (doc_id)
"""

#: What of op3_flac SQL can express.
PAYLOADS = r"""
WITH padded AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, coalesce(text, '') AS t FROM documents
),
sized AS (SELECT doc_id, n, t, greatest(1, (n + 191) // 192) * 192 AS size FROM padded)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(concat(t, repeat(' ', size - n))) AS payload_sha256 FROM sized
"""

#: Every anchor against every row, in whole numbers.
OP12 = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
),
ranked AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""

#: What the given pages mark as the article, block by block, with the two references that they use; other pages need the template deduction.
OP11 = r"""
WITH article AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS body FROM pages),
blocks AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h[1-6])>'),
    lambda b: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts
  FROM article
),
texts AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda b: b <> ''), chr(10) || chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""
