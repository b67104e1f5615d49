"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from strata.llm import url_filter

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BENCH_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
one AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
tri AS (SELECT *, lag(word) OVER o AS before, CASE WHEN i <= n - 2 THEN word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o END AS g FROM one WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hit AS (SELECT doc_id, i, word = before AS same, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS h FROM tri),
cov AS (SELECT doc_id, same, h OR coalesce(lag(h) OVER o, false) OR coalesce(lag(h, 2) OVER o, false) AS c FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, count(*) FILTER (WHERE c) AS n_repeat_words, count(*) FILTER (WHERE same) AS same FROM cov GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
dup AS (SELECT doc_id, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines FROM ln),
s AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, n_dup_lines, n_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(same, 0) AS same, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS uppers
  FROM d JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (letters > 0 AND 2 * uppers > letters) OR word_chars < 2 * n_words OR word_chars > 25 * n_words
    OR (n_dup_lines > 3 AND 2 * n_dup_lines > n_lines) OR (n_words > 1 AND 5 * same > n_words)) AS kept FROM b"""

DECONTAMINATION = rf"""
WITH dw AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents), bw AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
ww AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, s FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM ww) WHERE (n, s) IN (SELECT (n, s) FROM iw)),
cov AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit JOIN iw USING (n, s)) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov ON cov.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
one AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
win AS (SELECT doc_id, i, n, word, CASE WHEN i <= n - 34 THEN sha256(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS g FROM one),
hit AS (SELECT doc_id, i, word, g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 AS h FROM win),
cov AS (SELECT doc_id, i, word, bool_or(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS c FROM hit),
k AS (SELECT doc_id, count(*) FILTER (WHERE c) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT c) AS kept FROM cov GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

#: The payload's digest in base32: 160 bits of the hexadecimal SHA-1, five at a time.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
q AS (SELECT page_id, h, x, max(page_id) OVER (PARTITION BY x) AS last,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(0, 5), lambda j: (((strpos('0123456789abcdef', substr(x, CAST((5 * k + j) // 4 + 1 AS INTEGER), 1)) - 1) >> CAST(3 - (5 * k + j) % 4 AS INTEGER)) & 1) * [16, 8, 4, 2, 1][j + 1])) AS INTEGER) + 1, 1)), '') AS digest FROM p)
SELECT page_id, strlen(h) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM q"""

_EMB = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x, len(embedding) // 16 AS w FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))"


def _round(k: int) -> str:
    """Assignment ``a{k}`` to the entries ``b{k}``, and the entries after it."""
    return f""", d{k} AS (SELECT i, p, min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + entry) AS best FROM q JOIN b{k} USING (p) GROUP BY i, p),
a{k} AS (SELECT i, p, CAST(best % 64 AS BIGINT) AS entry, best // 64 AS error FROM d{k}),
s{k} AS (SELECT p, entry, pos, CAST(floor(sum(x) / count(*)) AS BIGINT) AS c, sum(x) AS total, count(*) AS n FROM (SELECT p, entry, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{k} JOIN q USING (i, p)) GROUP BY ALL),
m{k} AS (SELECT p, entry, list((total - ((total % n) + n) % n) // n ORDER BY pos) AS c FROM s{k} GROUP BY p, entry),
b{k + 1} AS (SELECT p, entry, CASE WHEN m{k}.c IS NULL THEN b{k}.c ELSE list_transform(m{k}.c, lambda x: CAST(x AS BIGINT)) END AS c FROM b{k} LEFT JOIN m{k} USING (p, entry))"""


#: Vectors have no id of their own here: ``i`` numbers the rows.
VECTOR_CODES = f"""{_EMB},
n AS (SELECT row_number() OVER (ORDER BY vec_id, x) - 1 AS i, * FROM e),
q AS (SELECT i, p, x[p * w + 1 : p * w + w] AS v FROM n, range(16) t(p)),
b0 AS (SELECT p, i AS entry, v AS c FROM q WHERE i < 64){_round(0)}{_round(1)}{_round(2)},
f AS (SELECT i, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(error) AS BIGINT) AS error FROM a2 GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) FROM b2) AS codebooks_sha256 FROM n JOIN f USING (i)"""


def _url_parts(table: str) -> str:
    own = "split_part(translate(substr(url, instr(url, '://') + 3), '?#', '##'), '#', 1)"
    return f"""(SELECT *, CASE WHEN instr(url, '://') > 0 THEN translate(split_part({own}, '/', 1), '{_UP}', '{_LOW}') ELSE '' END AS host,
  CASE WHEN instr(url, '://') > 0 AND instr({own}, '/') > 0 THEN substr({own}, instr({own}, '/')) ELSE '' END AS path FROM (SELECT * REPLACE (coalesce(url, '') AS url) FROM {table}))"""


def _url_buckets(text: str, seed: int) -> str:
    points = f"list_transform(string_split('^' || {text} || '$', ''), lambda c: CAST(unicode(c) AS BIGINT))"
    return f"list_transform(range(1, greatest(length({text}), 1) + 1), lambda i: ((({points})[i] * 8191 + coalesce(({points})[i + 1], 0)) * 8191 + coalesce(({points})[i + 2], 0)) * 31 + {seed}) "


def _url_features() -> str:
    return " || ".join(f"list_transform({_url_buckets(c, s)}, lambda v: v % 1000003 % {url_filter.BUCKETS})" for c, s in zip(("host", "path"), url_filter.SEEDS))


_LAB = ", ".join(f"('{u}', {y})" for u, y in url_filter.LABELLED)
_RULE = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])))

#: The regression is fitted here too, by the same descent.
URL_FILTER = f"""
WITH RECURSIVE lab(url, y) AS (VALUES {_LAB}),
l AS (SELECT row_number() OVER (ORDER BY host, path, y) AS r, y, {_url_features()} AS f FROM {_url_parts("lab")}),
c AS (SELECT r, b, count(*) AS c FROM (SELECT r, unnest(f) AS b FROM l) GROUP BY r, b),
n AS (SELECT r, sqrt(sum(c * c)) AS n FROM c GROUP BY r),
g AS (SELECT x.r AS i, z.r AS j, sum(x.c * z.c) AS g FROM c AS x JOIN c AS z USING (b) GROUP BY 1, 2),
k AS (SELECT x.r AS i, list(coalesce(g, 0) / (x.n * z.n) + 1 ORDER BY z.r) AS k FROM n AS x CROSS JOIN n AS z LEFT JOIN g ON g.i = x.r AND g.j = z.r GROUP BY 1),
t AS (SELECT 0 AS step, (SELECT list(k ORDER BY i) FROM k) AS k, (SELECT list(y ORDER BY r) FROM l) AS y, list_transform((SELECT list(y) FROM l), lambda v: 0.0::DOUBLE) AS a
  UNION ALL SELECT step + 1, k, y, list_transform(a, lambda v, r: v - {url_filter.RATE} * ({url_filter.PENALTY} * v + (1 / (1 + exp(-list_dot_product(k[r], a))) - y[r]) / len(a))) FROM t WHERE step < {url_filter.STEPS}),
fit AS (SELECT unnest(a) AS a, generate_subscripts(a, 1) AS r FROM t WHERE step = {url_filter.STEPS}),
w AS (SELECT b, round(sum(a * c / n) * {url_filter.SCALE}) AS w FROM c JOIN n USING (r) JOIN fit USING (r) GROUP BY b),
p AS (SELECT row_number() OVER () AS i, page_id, host, path, {_url_features()} AS f FROM {_url_parts("pages")}),
s AS (SELECT i, sum(c * coalesce(w, 0)) / {url_filter.SCALE} / sqrt(sum(c * c)) + (SELECT sum(a) FROM fit) AS s FROM (SELECT i, b, count(*) AS c FROM (SELECT i, unnest(f) AS b FROM p) GROUP BY i, b) LEFT JOIN w USING (b) GROUP BY i),
v AS (SELECT page_id, host, path, CASE {_RULE} END AS rule, s FROM p JOIN s USING (i))
SELECT page_id, host, path, split_part(rule, ' ', 2) AS rule, coalesce(split_part(rule, ' ', 1), CASE WHEN s >= 0 THEN 'block' ELSE 'allow' END) AS verdict FROM v"""

COLLOCATIONS = rf"""
WITH p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS t FROM documents)),
w AS (SELECT lang, row_number() OVER () AS i, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
one AS (SELECT lang, i, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM w),
tri AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM one WINDOW o AS (PARTITION BY i ORDER BY j)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM (SELECT lang, x AS phrase, 1 AS k FROM tri UNION ALL SELECT lang, x || ' ' || y, 2 FROM tri UNION ALL SELECT lang, x || ' ' || y || ' ' || z, 3 FROM tri) WHERE phrase IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM one GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, phrase, a, w, j FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, j, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM cut
  JOIN f AS x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1 : j], ' ') JOIN f AS y ON y.lang = cut.lang AND y.phrase = array_to_string(w[j + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, phrase, max(a) AS o FROM (SELECT lang, a, array_to_string(w[i : i + 1], ' ') AS phrase FROM c, range(1, 3) t(i) WHERE k = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o IS NULL OR 100 * o < 50 * a QUALIFY rank <= 2000"""
