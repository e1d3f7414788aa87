"""The operators that SQL can express, as SQL over the same tables."""

OP9 = r"""
WITH turns AS (
  SELECT conv_id AS pair_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS said
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
replies AS (SELECT pair_id, turn, said FROM turns WHERE said.role = 'assistant'),
places AS (
  SELECT pair_id, arg_min(turn, (md5(pair_id || ':' || turn), turn)) AS place,
    min(md5(pair_id || ':' || turn)) < '8' AS chosen_goes_on
  FROM replies GROUP BY pair_id),
placed AS (SELECT t.*, place, chosen_goes_on FROM turns t JOIN places p ON t.pair_id = p.pair_id),
chosen AS (SELECT pair_id, turn, said FROM placed WHERE turn <= place OR chosen_goes_on),
rejected AS (
  SELECT pair_id, turn, said FROM placed WHERE turn < place OR (turn > place AND NOT chosen_goes_on)
  UNION ALL
  SELECT p.pair_id, p.place, {'role': 'assistant', 'text': coalesce(b.text, '')}
  FROM places p LEFT JOIN (
    SELECT pair_id, said.text AS text FROM placed WHERE turn < place
    QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY said.role = 'assistant' DESC, turn DESC) = 1) b
  ON p.pair_id = b.pair_id),
both_sides AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, c.said AS c, r.said AS r
  FROM chosen c FULL JOIN rejected r ON c.pair_id = r.pair_id AND c.turn = r.turn),
forks AS (SELECT pair_id, min(turn) AS fork FROM both_sides WHERE c IS DISTINCT FROM r GROUP BY pair_id),
parts AS (
  SELECT s.pair_id, turn, 'prompt' AS part, c AS said FROM both_sides s LEFT JOIN forks f ON s.pair_id = f.pair_id
  WHERE fork IS NULL OR turn < fork
  UNION ALL
  SELECT s.pair_id, turn, 'chosen', c FROM both_sides s JOIN forks f ON s.pair_id = f.pair_id
  WHERE turn >= fork AND c IS NOT NULL
  UNION ALL
  SELECT s.pair_id, turn, 'rejected', r FROM both_sides s JOIN forks f ON s.pair_id = f.pair_id
  WHERE turn >= fork AND r IS NOT NULL),
made AS (
  SELECT pair_id, part, turn, said.role AS role,
    '<|' || regexp_replace(said.role, '[^A-Za-z0-9_]', '', 'g') || '|>' || chr(10) AS header,
    replace(said.text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM parts)
SELECT pair_id, part, turn, role, header || body AS rendered,
  CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(header) ELSE 0 END AS INTEGER) AS mask_start,
  CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(header) + length(body) ELSE 0 END AS INTEGER)
    AS mask_end
FROM made
"""

STRENGTH = """
  SELECT round(coalesce(CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 1000.0) END, 1000.0), 3) AS m
  FROM (SELECT (spread - p * (1 - p) * (k - 1)) / nullif(p * (1 - p) * (n - squares / n - (k - 1)), 0) AS rho
        FROM (SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE / nullif(sum(n), 0)::DOUBLE AS p, count(*)::DOUBLE AS k,
                sum(n * n)::DOUBLE AS squares,
                sum(bad * bad / n::DOUBLE) - sum(bad)::DOUBLE * (sum(bad)::DOUBLE / nullif(sum(n), 0)::DOUBLE) AS spread
              FROM {level}))
"""

SECOND_LEVEL = """
  SELECT unnest(string_split(labels, ' ')) || '.' || country AS name FROM (VALUES
    ('ar', 'com edu gob net org'), ('at', 'ac co gv or'), ('au', 'asn com edu gov id net org'),
    ('br', 'com edu gov net org'), ('cn', 'ac com edu gov net org'), ('es', 'com edu gob nom org'),
    ('fr', 'asso com gouv nom'), ('hk', 'com edu gov net org'), ('id', 'ac co go or sch web'),
    ('il', 'ac co gov net org'), ('in', 'ac co edu firm gen gov ind net nic org res'),
    ('jp', 'ac ad co ed go gr lg ne or'), ('kr', 'ac co go ne or pe re'), ('mx', 'com edu gob net org'),
    ('my', 'com edu gov net org'), ('nz', 'ac co geek gen govt iwi maori net org school'),
    ('pl', 'com edu gov net org'), ('pt', 'com edu gov org'), ('sg', 'com edu gov net org'),
    ('th', 'ac co go in net or'), ('tr', 'com edu gov net org'), ('tw', 'com edu gov net org'),
    ('ua', 'com edu gov net org'), ('uk', 'ac co gov ltd me net nhs org plc police sch'),
    ('za', 'ac co gov net org web')) t(country, labels)
"""

OP10 = r"""
WITH second_level AS (""" + SECOND_LEVEL + r"""),
located AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages)),
bares AS (
  SELECT host, bare, string_split(bare, '.') AS labels, regexp_matches(bare, '^([0-9.]+|\[[^\]]*\])\z') AS address
  FROM (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '\.?(:[0-9]*)?\z', '') AS bare
        FROM located WHERE host <> '')),
registered AS (
  SELECT host, suffix, CASE WHEN address THEN bare
      ELSE array_to_string(labels[-len(string_split(suffix, '.')) - 1:], '.') END AS domain
  FROM (SELECT b.*, CASE WHEN address THEN '' ELSE coalesce(s.name, labels[-1]) END AS suffix
        FROM bares b LEFT JOIN second_level s ON array_to_string(labels[-2:], '.') = s.name)),
labelled AS (
  SELECT l.host, b.bad FROM (SELECT DISTINCT page_id, host FROM located WHERE page_id IS NOT NULL AND host <> '') l
  JOIN (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
        WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id) b ON l.page_id = b.doc_id),
hosts AS (
  SELECT host, domain, suffix, count(*) AS n, sum(bad)::BIGINT AS bad
  FROM labelled JOIN registered USING (host) GROUP BY host, domain, suffix),
domains AS (
  SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY suffix),
overall AS (SELECT (coalesce(sum(bad), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2)::DOUBLE AS mean FROM hosts),
m_suffix AS (""" + STRENGTH.format(level="suffixes") + r"""),
m_domain AS (""" + STRENGTH.format(level="domains") + r"""),
m_host AS (""" + STRENGTH.format(level="hosts") + r"""),
p_suffix AS (
  SELECT suffix, (bad + m * mean) / (n + m) AS mean FROM suffixes, overall, m_suffix),
p_domain AS (
  SELECT domain, (bad + m * p.mean) / (n + m) AS mean
  FROM domains d JOIN p_suffix p ON d.suffix = p.suffix, m_domain),
p_host AS (
  SELECT host, bad + m * p.mean AS a, n - bad + m * (1 - p.mean) AS b
  FROM hosts h JOIN p_domain p ON h.domain = p.domain, m_host),
known AS (
  SELECT n.host, coalesce(h.a, m * coalesce(d.mean, s.mean, o.mean)) AS a,
    coalesce(h.b, m * (1 - coalesce(d.mean, s.mean, o.mean))) AS b
  FROM registered n LEFT JOIN p_host h ON n.host = h.host LEFT JOIN p_domain d ON n.domain = d.domain
  LEFT JOIN p_suffix s ON n.suffix = s.suffix, overall o, m_host),
bounds AS (
  SELECT host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bad_bound FROM known),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
         ('allow', 'org', '/fr/')),
fits AS (
  SELECT host, path, arg_max({'rule': rule_host || rule_path, 'verdict': verdict}, length(rule_host || rule_path)) AS fit
  FROM (SELECT DISTINCT host, path FROM located) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, l.host, l.path, fit.rule AS rule,
  coalesce(fit.verdict, CASE WHEN bad_bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM located l LEFT JOIN fits f ON l.host = f.host AND l.path = f.path LEFT JOIN bounds b ON l.host = b.host
"""

# the text of the given pages stands in their <article>, in p and h1 elements, with only these two references in it
OP13 = r"""
WITH cut AS (
  SELECT page_id, url, regexp_split_to_array(
    regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?(?:p|h1)\b[^>]*>') AS pieces
  FROM pages),
plain AS (
  SELECT page_id, url, list_transform(pieces, lambda p: trim(regexp_replace(replace(replace(
    regexp_replace(regexp_replace(p, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'),
    '\s+', ' ', 'g'))) AS pieces FROM cut),
joined AS (
  SELECT page_id, url, coalesce(array_to_string(list_filter(pieces, lambda p: p <> ''), chr(10)), '') AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM joined
"""


def _rounds(n: int) -> str:
    """The assignments and means of n rounds of k-means over (k, r, p) parts and (k, e, c) entries, compared in full."""
    nearest = """a{0} AS MATERIALIZED (
  SELECT k, r, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT p.k, p.r, b.e, list_dot_product(p, p) + list_dot_product(c, c) - 2 * list_dot_product(p, c) AS d
    FROM parts p JOIN b{0} b ON p.k = b.k) GROUP BY k, r)"""
    moved = """m{0} AS (
  SELECT k, e, list(v ORDER BY i) AS c FROM (
    SELECT k, e, i, floor(sum(v) / count(*)) AS v FROM (
      SELECT a.k, a.e, unnest(p) AS v, generate_subscripts(p, 1) AS i FROM a{0} a JOIN parts USING (k, r))
    GROUP BY k, e, i) GROUP BY k, e),
b{1} AS MATERIALIZED (
  SELECT b.k, b.e, coalesce(m.c, b.c) AS c FROM b{0} b LEFT JOIN m{0} m ON b.k = m.k AND b.e = m.e)"""
    steps = [nearest.format(k) + ",\n" + moved.format(k, k + 1) for k in range(n)]
    return ",\n".join([*steps, nearest.format(n)])


OP12 = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, w, row_number() OVER (ORDER BY vec_id NULLS LAST, w) AS r FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (
  SELECT r, k, list_slice(w, k * len(w) // 4 + 1, (k + 1) * len(w) // 4) AS p FROM kept, range(4) t(k)),
b0 AS MATERIALIZED (SELECT k, r - 1 AS e, p AS c FROM parts WHERE r <= 256),
{_rounds(4)},
coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY k) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY k, e, i))
   FROM (SELECT k, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM b4)) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""

OP11 = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
runs AS (
  SELECT lang, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS phrase FROM (
    SELECT lang, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM pieces, range(1, 6) s(size))),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(list_slice(ws, 1, k), ' ') AS first,
    array_to_string(list_slice(ws, k + 1, size), ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, n,
    ((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN f l ON c.lang = l.lang AND c.first = l.phrase JOIN f r ON c.lang = r.lang AND c.rest = r.phrase
  JOIN totals t ON c.lang = t.lang),
worst AS (
  SELECT lang, phrase, a, n, unnest(arg_min({'l': l, 'r': r, 'score': score}, (score, k)))
  FROM scored GROUP BY lang, phrase, a, n),
inner_runs AS (
  SELECT lang, array_to_string(list_slice(ws, i, i + part - 1), ' ') AS phrase, max(a) AS longer FROM (
    SELECT *, unnest(range(1, size - part + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS part FROM candidates))
  GROUP BY 1, 2)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, n,
    score
  FROM worst w LEFT JOIN inner_runs i ON w.lang = i.lang AND w.phrase = i.phrase WHERE longer IS NULL OR longer < a)
WHERE rank <= 2000
"""
