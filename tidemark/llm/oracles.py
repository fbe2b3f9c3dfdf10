"""Expected results of the operators as DuckDB SQL over the same tables."""

_WORD = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_RATE_RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > n_words",
    "lines": "2 * n_dup_lines > n_lines",
}


def _host_quality() -> str:
    fails = ", ".join(f"sum(CASE WHEN {rule} THEN 1 ELSE 0 END) AS f_{n}" for n, rule in _RATE_RULES.items())
    moments = ", ".join(
        f"sum(f_{n}) / sum(n_docs) AS m_{n}, sum(f_{n} * f_{n} / n_docs) / sum(n_docs) - (sum(f_{n}) / sum(n_docs)) ** 2 AS v_{n}"
        for n in _RATE_RULES
    )

    def rate(n: str) -> str:
        s = f"(m_{n} * (1 - m_{n}) / v_{n} - 1)"
        return (
            f"CASE WHEN v_{n} > 0 AND {s} > 0 THEN (f_{n} + m_{n} * {s}) / (n_docs + {s}) "
            f"WHEN v_{n} > 0 THEN f_{n} / n_docs ELSE m_{n} END"
        )

    fits = " AND ".join(
        f"({rate(n)}) <= least(0.5, m_{n} + greatest(3 * sqrt(greatest(v_{n}, 0)), 0.1))" for n in _RATE_RULES
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
t AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM t) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_WORD}')),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l GROUP BY r),
c AS (SELECT d.doc_id, d.source, len(ws) AS n_words,
  length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
h AS (SELECT source, count(*) AS n_docs, {fails} FROM c WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT {moments} FROM h),
v AS (SELECT source, {fits} AS ok FROM h, p),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(ok, true) AS kept
FROM b LEFT JOIN v USING (source)""".replace("\\\\x", "\\x")


_LINES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS raw,
  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
m AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l),
s AS (SELECT * FROM m WHERE line <> ''),
wide AS (SELECT line FROM s GROUP BY line HAVING count(DISTINCT source) >= 10),
gone AS (SELECT r, i FROM s WHERE line IN (SELECT line FROM wide)),
g AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(raw, chr(10) ORDER BY i) AS text FROM m
  WHERE (r, i) NOT IN (SELECT (r, i) FROM gone) GROUP BY r)
SELECT doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
  coalesce(g.n, 0) AS n_removed, CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN g USING (r) LEFT JOIN kept USING (r)"""

_DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS ws FROM documents),
b AS (SELECT item_id,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, ws[i:i + least(10, len(ws)) - 1] AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
t AS (SELECT r, n, i, ws[i:i + n - 1] AS g
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
o AS (SELECT r, i, t.n, item_id FROM t JOIN p ON t.g = p.g AND t.n = p.n),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM o) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS last FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM q LEFT JOIN m USING (payload_digest)"""

_URLS = f"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://')
  THEN substring(url, instr(url, '://') + 3) END AS rest FROM pages),
x AS (SELECT r, page_id,
  coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
f AS (SELECT x.r, rules.host || rules.path AS rule, verdict,
  row_number() OVER (PARTITION BY x.r ORDER BY length(rules.host || rules.path) DESC, length(rules.host) DESC) AS n
  FROM x JOIN rules ON (x.host = rules.host OR ends_with(x.host, '.' || rules.host))
    AND starts_with(x.path, rules.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM x LEFT JOIN (SELECT * FROM f WHERE n = 1) USING (r)"""

_MERKLE = """
WITH RECURSIVE n AS (SELECT row_number() OVER () AS r, *, CAST(doc_id AS VARCHAR) AS id FROM documents),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(id, ''), lambda d: ord(d)::BIGINT)),
  lambda c, d: list_reduce(list_prepend(xor(c, d), range(8)),
    lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS crc FROM n),
t AS (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM c),
l AS (SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS claim
  FROM (SELECT *, coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head FROM t)),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY source) AS m FROM l),
low(source, level, pos, h, m) AS (
  SELECT source, 0, pos, leaf, m FROM p
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (m + 2) // 3
  FROM low WHERE m > 1 GROUP BY source, level, pos // 3, m),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS m
  FROM low WHERE m = 1),
high(level, pos, h, m) AS (
  SELECT 0, pos, subroot, m FROM s
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (m + 2) // 3
  FROM high WHERE m > 1 GROUP BY level, pos // 3, m),
lows AS (SELECT source, level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM low WHERE m > 1 GROUP BY ALL),
highs AS (SELECT level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM high WHERE m > 1 GROUP BY ALL),
climb(r, source, level, pos, h, proof) AS (
  SELECT r, source, 0, pos, claim, '' FROM p
  UNION ALL
  SELECT r, c.source, c.level + 1, c.pos // 3,
    sha256(array_to_string(hs[:c.pos % 3], '') || c.h || array_to_string(hs[c.pos % 3 + 2:], '')),
    proof || array_to_string(hs[:c.pos % 3], '') || array_to_string(hs[c.pos % 3 + 2:], '')
  FROM climb c JOIN (SELECT source, level, run, hs FROM lows) x
    ON c.source IS NOT DISTINCT FROM x.source AND c.level = x.level AND c.pos // 3 = x.run),
done AS (SELECT r, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climb GROUP BY r),
up(r, level, pos, h, proof) AS (
  SELECT p.r, 0, s.pos, done.h, done.proof FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source JOIN done ON p.r = done.r
  UNION ALL
  SELECT r, u.level + 1, u.pos // 3,
    sha256(array_to_string(hs[:u.pos % 3], '') || u.h || array_to_string(hs[u.pos % 3 + 2:], '')),
    proof || array_to_string(hs[:u.pos % 3], '') || array_to_string(hs[u.pos % 3 + 2:], '')
  FROM up u JOIN highs x ON u.level = x.level AND u.pos // 3 = x.run),
ends AS (SELECT r, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM up GROUP BY r),
root AS (SELECT h AS root FROM high WHERE m = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, ends.h AS folded_root, ends.h = root AS verified
FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source JOIN ends ON p.r = ends.r, root"""

_PHRASES = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p),
sums AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 30),
cuts AS (SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f x ON x.lang = c.lang AND x.k = j AND x.phrase = array_to_string(ws[:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.phrase = array_to_string(ws[j + 1:], ' ')),
best AS (SELECT lang, phrase, a, l, r, score::BIGINT AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
parts AS (SELECT lang, a, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM c))),
covered AS (SELECT lang, phrase, max(a) AS longest FROM parts GROUP BY ALL),
left_over AS (SELECT best.* FROM best LEFT JOIN covered USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sums USING (lang) WHERE rank <= 2000"""

#: Fitted models, token ids, repeated passages and linked components have no SQL; tests hold them
#: against brute force.
ORACLES = {
    "op1_host_quality": _host_quality(),
    "op5_decontamination": _DECONTAMINATION,
    "op8_warc": _WARC,
    "op9_line_dedup": _LINES,
    "op10_url_filter": _URLS,
    "op11_collocations": _PHRASES,
    "op13_merkle_manifest": _MERKLE,
}
