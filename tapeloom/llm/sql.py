"""DuckDB SQL for the queries of this folder that SQL can express."""

# A-Z lower-cased; words of ASCII digits, letters and everything beyond ASCII; windows of ten words or a whole shorter item.
CONTAMINATION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE item_id IS NOT NULL AND len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, dw.n, i FROM doc_windows dw JOIN item_windows iw ON dw.n = iw.n AND dw.gram = iw.gram),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# Rates from bytes by source, Poisson steps summed from logarithms, one uniform number a document from an MD5 hash.
MIXTURE = r"""
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0))::BIGINT AS bytes FROM documents GROUP BY source),
named AS (SELECT source, bytes, CASE source WHEN 'src0' THEN 0.15::DOUBLE WHEN 'src1' THEN 0.08::DOUBLE WHEN 'src2' THEN 0.08::DOUBLE WHEN 'src3' THEN 0.02::DOUBLE WHEN 'src4' THEN 0.06::DOUBLE END AS w FROM sizes),
whole AS (SELECT sum(bytes)::DOUBLE AS all_bytes, sum(bytes) FILTER (w IS NULL) AS other_bytes, coalesce(sum(w) FILTER (bytes > 0), 0) AS named_share FROM named),
rates AS (SELECT source, CASE WHEN bytes > 0 THEN (CASE WHEN w IS NOT NULL THEN CASE WHEN coalesce(other_bytes, 0) > 0 THEN w ELSE w / named_share END
  ELSE (1 - named_share) * bytes / other_bytes END) * all_bytes / bytes ELSE 0 END AS rate FROM named, whole),
parted AS (SELECT source, greatest(ceil(rate / 500), 1)::BIGINT AS parts, rate / greatest(ceil(rate / 500), 1) AS rate FROM rates),
steps AS (SELECT source, parts, k, sum(CASE WHEN rate > 0 THEN exp(CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) END - rate - lgamma(k + 1.0)) ELSE 1 END) OVER (PARTITION BY source ORDER BY k) AS step
  FROM (SELECT source, parts, rate, unnest(range(0, CASE WHEN rate > 0 THEN ceil(rate + 10 * sqrt(rate) + 30)::BIGINT + 1 ELSE 1 END)) AS k FROM parted)),
lists AS (SELECT source, parts, list(step ORDER BY k) AS steps FROM steps GROUP BY source, parts),
drawn AS (SELECT doc_id, d.source, coalesce(strlen(text), 0)::BIGINT AS n_bytes, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS name, steps, parts
  FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
copies AS (SELECT *, list_sum(list_transform(range(1, parts + 1), lambda k: len(list_filter(steps, lambda s: s <= (('0x' || substr(md5('17' || CASE WHEN k > 1 THEN ':' || k ELSE '' END || '|' || name), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0))))::BIGINT AS n FROM drawn)
SELECT doc_id, source, replica::INTEGER AS replica, md5('17:order|' || name || '|' || replica) AS shuffle_key, n_bytes
FROM (SELECT *, unnest(range(1, n + 1)) AS replica FROM copies WHERE n > 0)
"""

URLS = r"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
site(host_rule, path_rule, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
word(w) AS (SELECT unnest(['adult', 'porn', 'sex', 'xxx', 'casino', 'bets', 'betting', 'poker', 'gambling', 'spam', 'viagra', 'pills', 'warez'])),
fits AS (SELECT host, path, host_rule || path_rule AS rule, verdict, 1000 + length(host_rule || path_rule) AS rank FROM (SELECT DISTINCT host, path FROM split), site
    WHERE (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule)
  UNION ALL SELECT host, path, '*' || w || '*', 'block', length(w) FROM (SELECT DISTINCT host, path FROM split), word WHERE list_contains(regexp_split_to_array(host, '[.-]'), w)),
best AS (SELECT host, path, rule, verdict, row_number() OVER (PARTITION BY host, path ORDER BY rank DESC, rule) AS n FROM fits)
SELECT page_id, s.host, s.path, CASE WHEN b.rule NOT LIKE '*%' THEN b.rule END AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM split s LEFT JOIN best b ON b.n = 1 AND s.host = b.host AND s.path = b.path
"""

# Base32 of a SHA-1, five bits a letter.
ARCHIVE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, body, sha1(body) AS hex FROM p),
letters AS (SELECT hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + (((('0x' || substr(hex || '000', (5 * i // 4)::BIGINT + 1, 3))::BIGINT) >> (12 - 5 - (5 * i % 4)))::BIGINT & 31)::BIGINT, 1)), '') AS payload_digest FROM (SELECT DISTINCT hex FROM h)),
g AS (SELECT body, max(page_id) AS original FROM p GROUP BY body)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original IS NULL OR page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original IS NULL OR page_id IS NOT DISTINCT FROM original THEN NULL ELSE original END AS refers_to
FROM h JOIN letters USING (hex) JOIN g USING (body)
"""

# The table of CRC-32 (polynomial 0xEDB88320, low bit first), for one byte a step.
_CRC = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda s, b: xor(s >> 1, 3988292384 * (s & 1))) AS v FROM range(256) r(i)))"""

# Letters beyond ASCII are two UTF-8 bytes here, the first of them 0xC3.
SPELLINGS = "WITH RECURSIVE " + _CRC + r""",
runs AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents WHERE text IS NOT NULL) GROUP BY ALL),
hashed AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
  lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ((ord(c) & 63) | 128)::BIGINT] END))), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) AS h FROM runs, crc),
typed AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM hashed),
v AS (SELECT word, sum(times)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
pair AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN v ON c.rest = v.word UNION SELECT v.word, c.word FROM cut c JOIN v ON c.rest = v.word),
near AS (SELECT p.word, p.other, o.n, row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS place, count(*) OVER (PARTITION BY p.word) AS n_near FROM pair p JOIN v o ON p.other = o.word),
judged AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN e.n >= 5 * v.n THEN other END AS form, CASE WHEN e.n >= 5 * v.n THEN e.n END AS form_n
  FROM v LEFT JOIN near e ON v.word = e.word AND place = 1),
way AS (SELECT word, word AS root, 0 AS hops FROM judged UNION ALL SELECT w.word, j.form, hops + 1 FROM way w JOIN judged j ON w.root = j.word WHERE j.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN (SELECT word, arg_max(root, hops) AS root FROM way GROUP BY word) USING (word)
"""

TRIE = "WITH " + _CRC + r""",
conv AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
named AS (SELECT conv_id, turns, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) % 9 AS h FROM conv, crc),
built AS (SELECT c.conv_id, list_concat(coalesce(g.turns[1:h], []), c.turns[h + 1:]) AS turns FROM named c LEFT JOIN conv g ON g.conv_id = c.conv_id - c.conv_id % 5),
start AS (SELECT conv_id, d, turns[1:d] AS seq, len(turns) = d AS last FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)),
node AS (SELECT seq, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM start GROUP BY seq, d),
kids AS (SELECT seq[1:d - 1] AS seq, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.seq[d].t) END AS saved FROM node n LEFT JOIN kids USING (seq)),
totals AS (SELECT seq[1:a] AS seq, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT seq, n_children, saved, unnest(range(0, d + 1)) AS a FROM own) GROUP BY ALL)
SELECT o.conv_id, o.d AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, sha256(o.ends) AS ends_sha256
FROM own o JOIN totals USING (seq) LEFT JOIN node p ON o.d > 0 AND p.seq = o.seq[1:o.d - 1] AND p.d = o.d - 1
"""
