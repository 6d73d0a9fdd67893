"""DuckDB SQL for the queries that SQL can express."""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGEST = " || ".join(f"substr('{_B32}', 1 + cast((('0x' || substr(h, {1 + 5 * (i // 4)}, 5))::bigint >> {15 - 5 * (i % 4)}) & 31 as integer), 1)" for i in range(32))

OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h FROM p),
b AS (SELECT *, {_DIGEST} AS payload_digest, max(page_id) OVER (PARTITION BY h) AS best FROM d)
SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes, payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM b
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
s AS (SELECT key, min(doc_id) AS best FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, best IS NOT NULL AND doc_id <> best AS dropped FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_SEARCH_WORDS = "string_split_regex(trim(regexp_replace(" + _LOWER.format("coalesce(text, '')") + ", '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ')"

OP7 = f"""
WITH d AS (SELECT doc_id, list_filter({_SEARCH_WORDS}, lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter({_SEARCH_WORDS}, lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
m AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS win FROM d, m WHERE len(w) >= m),
h AS (SELECT doc_id, item_id, i, dw.m AS m FROM dw JOIN bw USING (m, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS s FROM d WHERE len(w) >= 13),
f AS (SELECT s, min(doc_id) AS best FROM win GROUP BY s),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN f USING (s) WHERE doc_id > best),
l AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT l.doc_id, word, p, hit.p IS NOT NULL AS gone FROM l LEFT JOIN hit USING (doc_id, p)),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def shingle_links(source: str) -> str:
    """CTEs sets(doc_id, n), links(a, b) and comp(doc_id, component_id) over ``source``(doc_id, text)."""
    return f"""
jw AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM {source}),
sh AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM jw WHERE len(w) > 0),
sets AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)"""


OP8 = f"""
WITH RECURSIVE {shingle_links("documents")}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

_COLLOCATION_WORDS = "list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '')"

OP11 = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, {_COLLOCATION_WORDS} AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, unnest([1, 2, 3, 4]) AS u(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::bigint AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT c.*, u.k AS k, array_to_string(w[1:u.k], ' ') AS x, array_to_string(w[u.k + 1:], ' ') AS y FROM c, unnest([1, 2, 3]) AS u(k) WHERE u.k < size),
s AS (SELECT cuts.lang, cuts.phrase, a, cuts.k AS k, p.f AS l, q.f AS r, ((2000000::hugeint * a) // (p.f::hugeint + q.f))::bigint AS score
      FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = x JOIN f q ON q.lang = cuts.lang AND q.phrase = y),
weak AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, a, unnest(list_concat([array_to_string(w[i:i + 1], ' ') FOR i IN range(1, size)], CASE WHEN size = 4 THEN [array_to_string(w[1:3], ' '), array_to_string(w[2:4], ' ')] ELSE [] END)) AS phrase FROM c WHERE size > 2),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT weak.* FROM weak LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100::hugeint * longer < 80::hugeint * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

_SHARE = "1 + ((1000000000::hugeint * (coalesce({}, 0) + 5)) // ({} + 5 * v))::bigint"

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
h AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
c AS (SELECT lang, source, term, count(*) AS times FROM t JOIN h USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM h GROUP BY lang),
n AS (SELECT lang, source, sum(times)::hugeint AS n FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(times)::hugeint AS n FROM c GROUP BY lang),
lc AS (SELECT lang, term, sum(times)::hugeint AS times FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, term, coalesce(c.times, 0) AS times, {_SHARE.format("c.times", "coalesce(n.n, 0)")} AS p
      FROM g JOIN h USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, {_SHARE.format("times", "ln.n")} AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
sums AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::bigint AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE times > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::integer AS rank FROM both_parts QUALIFY part = 'pair' OR rank <= 50
"""

ORACLES = {"op1_warc_index": OP1, "op3_substring_dedup": OP3, "op6_line_dedup": OP6, "op7_decontamination": OP7, "op8_jaccard_join": OP8, "op11_collocations": OP11, "op12_source_divergence": OP12}
