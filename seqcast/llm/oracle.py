"""The queries that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

from seqcast.llm import quality, urlfilter

ORACLE: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op7_decontamination"] = f"""
WITH d AS (SELECT doc_id, coalesce({_ALNUM.format("text")}, []) AS w FROM documents),
     i AS (SELECT item_id, {_ALNUM.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
     iw AS (SELECT DISTINCT item_id, w[k : k + least(10, len(w)) - 1] AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
     dw AS (SELECT doc_id, k, n, w[k : k + n - 1] AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
     hit AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (win)),
     words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
     items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                      string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"

ORACLE["op1_near_duplicates"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, shingle FROM (
             SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                   ELSE [array_to_string(w[k : k + 4], ' ') FOR k IN range(1, len(w) - 3)] END) AS shingle FROM d)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     link AS (SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 85 * (x.n + y.n - i)),
     reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u),
     low AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN low USING (doc_id)
"""

ORACLE["op3_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
     win AS (SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS win
             FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
     low AS (SELECT win, min(doc_id) AS low FROM win GROUP BY win),
     hit AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM win JOIN low USING (win) WHERE low < doc_id),
     words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLE["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
     r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM r
"""

ORACLE["op9_line_dedup"] = r"""
WITH d AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
     win AS (SELECT doc_id, k, h, l[k : k + h - 1] AS run
             FROM (SELECT doc_id, l, h, unnest(range(1, len(l) - h + 2)) AS k FROM d, (VALUES (1), (2), (3)) t(h) WHERE len(l) >= h)),
     long AS (SELECT * FROM win WHERE h = 3 OR list_sum([len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) FOR x IN run]) >= 50),
     ord AS (SELECT doc_id, k, h, row_number() OVER (PARTITION BY run ORDER BY doc_id, k) AS nth FROM long),
     gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + h)) AS k FROM ord WHERE nth > 1),
     line AS (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS k FROM d),
     kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY k) AS x FROM line ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
     n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n IS NULL THEN coalesce(text, '') ELSE coalesce(x, '') END) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

# The phrases, signs and limits of the line rules, which the module of the operator documents.
_SEPARATORS = ", ".join(f"'{s}'" for s in quality.SEPARATORS)
_ENDINGS = "".join("\\" + e if e in "]\\" else "''" if e == "'" else e for e in quality.ENDINGS)
_NOTICES = " OR ".join(f"contains(lower(x), '{p}')" for p in quality.NOTICES)
_SYMBOLS = "length(regexp_replace({}, '[^#*$%&|<>]', '', 'g'))"

ORACLE["op8_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("text")} AS w FROM documents),
     l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
     lw AS (SELECT doc_id, x, {_WORDS.format("x")} AS w, row_number() OVER (PARTITION BY doc_id, x ORDER BY k) AS nth FROM l),
     c AS (SELECT *, len(w) AS n, {_SYMBOLS.format("x")} AS symbols,
                  length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) AS upper_case, length(regexp_replace(x, '[^\p{{Ll}}]', '', 'g')) AS lower_case,
                  length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM lw),
     j AS (SELECT doc_id, chars, nth > 1 AND n > 0 AS repeated,
                  n = 0 OR nth > 1
                  OR len(list_filter(w, lambda y: y IN ({_SEPARATORS}))) >= greatest(1, 0.2e0 * n)
                  OR symbols >= greatest(2, 0.5e0 * n)
                  OR (upper_case >= 18 AND upper_case >= 0.9e0 * greatest(20, upper_case + lower_case))
                  OR (n >= 10 AND (len(list_filter(w, lambda y: y = list_aggregate(w, 'mode'))) >= 0.5e0 * n
                                   OR len(list_filter(range(1, n), lambda i: w[i] = w[i + 1])) >= 0.5e0 * n))
                  OR (n <= 40 AND ({_NOTICES}))
                  OR (n <= 2 AND NOT regexp_matches(x, '[{_ENDINGS}][\x20\x09-\x0D]*$')) AS failed FROM c),
     t AS (SELECT doc_id, count(*) FILTER (repeated) AS dup, coalesce(sum(chars) FILTER (NOT failed), 0) AS stays FROM j GROUP BY doc_id),
     win AS (SELECT doc_id, k, array_to_string(w[k : k + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) >= 8)),
     again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1),
     r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM again) GROUP BY doc_id),
     b AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, {_SYMBOLS.format("text")} AS n_symbols FROM d),
     f AS (SELECT b.*, dup, stays, coalesce(r.n, 0) AS again, n_words < 20 OR 100 * coalesce(r.n, 0) > 30 * n_words AS base_failed
           FROM b JOIN t USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines,
       again::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND stays >= 0.5e0 * word_chars AS kept,
       CASE WHEN word_chars > 0 THEN stays::DOUBLE / word_chars ELSE 0.0e0 END AS kept_share
FROM f
"""

ORACLE["op11_hard_negatives"] = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_sum([a.q[k] * b.q[k] FOR k IN range(1, len(a.q) + 1)])::BIGINT AS s
           FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
     p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p AS positive_id, row_number() OVER (PARTITION BY p.a, p ORDER BY s DESC, b)::INTEGER AS rank,
       b AS negative_id, ps AS positive_score, s AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 30 * ps <= 100 * s AND 100 * s <= 90 * ps
QUALIFY rank <= 10
"""

# One step of the checksum for each of the eight bits of a byte.
_CRC = "xor(list_reduce([4294967295] || [ord(d)::BIGINT FOR d IN string_split({}, '')], lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

ORACLE["op12_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS l
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
     h AS (SELECT conv_id, l, {_CRC.format("conv_id::VARCHAR")} % 9 AS h FROM t),
     c AS (SELECT h.conv_id, coalesce(b.l[1 : h], []) || h.l[h + 1 :] AS l FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5),
     cut AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS depth FROM c),
     node AS (SELECT md5(l[1 : depth]::VARCHAR) AS key, depth, min(conv_id) AS conv_id, count(*) AS n,
                     any_value(CASE WHEN depth > 0 THEN md5(l[1 : depth - 1]::VARCHAR) END) AS up,
                     any_value(CASE WHEN depth > 0 THEN strlen(l[depth].t) ELSE 0 END) AS bytes,
                     sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len(l)), '')) AS ends,
                     any_value([md5(l[1 : k]::VARCHAR) FOR k IN range(0, depth + 1)]) AS path
              FROM cut GROUP BY key, depth),
     kids AS (SELECT up AS key, count(*) AS n FROM node GROUP BY up),
     below AS (SELECT over AS key, sum((n - 1) * bytes) AS saved, count(*) FILTER (leaf) AS leaves
               FROM (SELECT unnest(path) AS over, node.n, bytes, kids.n IS NULL AS leaf FROM node LEFT JOIN kids USING (key)) GROUP BY over)
SELECT node.conv_id, node.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, node.n::BIGINT AS n_convs,
       coalesce(kids.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, node.ends AS ends_sha256
FROM node LEFT JOIN node parent ON parent.key = node.up LEFT JOIN kids ON kids.key = node.key JOIN below ON below.key = node.key
"""

_PATTERNS = [(rf"(^|$|[^a-z0-9]){r[1:-1]}(^|$|[^a-z0-9])" if r.startswith("^") else rf"^([^/]*[.])?{r[2:-1]}(^|$|[^a-z0-9])", r, v) for r, v in urlfilter.PATTERN_RULES]
_SITE_VALUES = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in urlfilter.SITE_RULES)
_PATTERN_VALUES = ", ".join(f"('{e}', '{r}', '{v}')" for e, r, v in _PATTERNS)

ORACLE["op13_url_filters"] = rf"""
WITH r(host, path, verdict) AS (VALUES {_SITE_VALUES}),
     f(expression, pattern, verdict) AS (VALUES {_PATTERN_VALUES}),
     p AS (SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')")} AS host,
                  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
     s AS (SELECT page_id, max({{'n': len(r.host || r.path), 'rule': r.host || r.path, 'verdict': verdict}}) AS best
           FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id),
     q AS (SELECT page_id, max({{'allows': verdict = 'allow', 'pattern': pattern, 'verdict': verdict}}) AS best
           FROM p JOIN f ON regexp_matches({_LOWER.format("host || path")}, expression) GROUP BY page_id)
SELECT p.page_id, host, path, s.best.rule AS rule, q.best.pattern AS pattern, coalesce(s.best.verdict, q.best.verdict, 'allow') AS verdict
FROM p LEFT JOIN s USING (page_id) LEFT JOIN q USING (page_id)
"""
