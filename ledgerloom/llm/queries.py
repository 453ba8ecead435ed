"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import hashlib

from ledgerloom.sources.scratch import shared_dir
from ledgerloom.sources.tables import table

from . import archives, bpe, decontamination, katz, language, neardup, phrases, prefixes, quality, secrets, sharding, suffixes, urls


def secret_ledger(spark, sf_dir: str) -> str:
    return f"{shared_dir(spark)}/secret_ledger/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


def op1_language_id(spark, sf_dir):
    return language.language_of_documents(table(spark, sf_dir, "documents"))


def op2_katz_backoff(spark, sf_dir):
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark, sf_dir):
    """Each table has its ledger in the shared folder: a second run over it scans what is new."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"), ledger=secret_ledger(spark, sf_dir))


def op7_url_filters(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op8_decontamination(spark, sf_dir):
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_phrases(spark, sf_dir):
    """The best phrases of each language of all documents; nulls, ties and empty tables as in ``collocations``."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark, sf_dir):
    """The trie of all rebuilt conversations; nulls, ties, repeated rows and empty tables as in ``conversation_trie``."""
    return prefixes.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_warc(spark, sf_dir):
    """All pages through legacy archives and WARC ones; nulls, ties, repeated rows and empty tables as in ``archive_pages``."""
    return archives.archive_pages(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_katz_backoff, op3_suffix_dedup, op4_simhash, op5_quality_rules, op6_secret_scans, op7_url_filters, op8_decontamination, op9_sharding, op10_byte_bpe, op11_phrases, op12_prefix_trie, op13_warc)}

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
GRAMS = r"list_filter(regexp_split_to_array({0}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')".format(LOWER.format("coalesce(text, '')"))
STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
URL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents), win AS (SELECT doc_id, i, w[i:i + 7] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
dup AS (SELECT doc_id, x FROM win GROUP BY 1, 2 HAVING count(*) > 1), hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN dup USING (doc_id, x), range(8) AS r(k) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, len(list_filter(w, lambda x: list_contains([{STOPS}], lower(x)))) AS stops FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, array_to_string(list_filter([CASE WHEN n_words < 20 THEN 'n_words' END, CASE WHEN coalesce(n_repeat_words / nullif(n_words, 0), 0) > 0.30 THEN 'repeat_ratio' END,
  CASE WHEN coalesce(word_chars / nullif(n_words, 0), 0) < 2 OR coalesce(word_chars / nullif(n_words, 0), 0) > 25 THEN 'mean_word_chars' END, CASE WHEN coalesce(n_symbols / nullif(word_chars, 0), 0) > 0.10 THEN 'symbol_ratio' END,
  CASE WHEN coalesce(n_dup_lines / nullif(n_lines, 0), 0) > 0.50 THEN 'dup_line_ratio' END, CASE WHEN coalesce(stops / nullif(n_words, 0), 0) < 0.01 THEN 'stop_ratio' END], lambda x: x IS NOT NULL), ',') AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM b
"""


def _secrets_sql() -> str:
    found = []
    for rank, r in enumerate(secrets.TWIN_RULES):
        p = r.pattern.replace("'", "''")
        found.append(f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS g, regexp_split_to_array(t, '{p}') AS gap, {r.least} AS least FROM d")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(found)}), i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
s AS (SELECT doc_id, rank, kind, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n FROM i WHERE length(g[i]) >= least),
j AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || a + n, ',' ORDER BY a, rank) AS spans, string_agg(kind || ':' || a || ':' || a + n, ',' ORDER BY a, rank) FILTER (WHERE rank < 3) AS base FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (doc_id)
"""


URLS = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages), h AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS h FROM u),
p AS (SELECT page_id, {LOWER.format("h")} AS host, regexp_extract(substr(rest, length(h) + 1), '^([^?#]*)', 1) AS path FROM h), r(rh, rp, v) AS (VALUES {URL_RULES}),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {GRAMS} AS w FROM documents), b AS (SELECT item_id, {GRAMS} AS w FROM benchmark), bs AS (SELECT *, least(13, len(w)) AS k FROM b WHERE len(w) > 0), bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bs)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bs) ks WHERE len(w) >= k)), m AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, x)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1), t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents), w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1), g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, range(1, 5) AS r(k) WHERE len(w) >= k),
f AS (SELECT lang, g, k, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30), c AS (SELECT lang, g, k, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT c.lang, c.g, c.a, x.f AS l, y.f AS r, CAST((2000000 * CAST(c.a AS HUGEINT)) // (x.f + y.f) AS BIGINT) AS score, j FROM (SELECT *, unnest(range(1, k)) AS j FROM c) AS c JOIN f AS x ON x.lang = c.lang AND x.g = array_to_string(c.w[1:j], ' ') JOIN f AS y ON y.lang = c.lang AND y.g = array_to_string(c.w[j + 1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS g, max(a) AS longest FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) AS q(m) WHERE m < k) AS q GROUP BY 1, 2)
SELECT * FROM (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank, b.g AS phrase, a, l, r, n, score FROM b JOIN n ON n.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.g = b.g WHERE longest IS NULL OR 100 * longest < 80 * a) AS t WHERE rank <= 2000
"""

#: CRC-32 bit by bit.
CRC32 = "xor(list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
PREFIXES = f"""
WITH k AS (SELECT conv_id, turn, coalesce(role, '') AS role, strlen(coalesce(text, '')) AS bytes, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS key FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS p FROM k), c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {CRC32.format("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM k),
r AS (SELECT c.conv_id, p, bytes, key FROM c JOIN t ON t.conv_id = c.base AND p <= h UNION ALL SELECT c.conv_id, p, bytes, key FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
s AS (SELECT conv_id, row_number() OVER w AS d, bytes, string_agg(key, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING) UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM s),
m AS (SELECT path, d, max(bytes) AS bytes, count(*) AS n, min(conv_id) AS conv_id, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends FROM e GROUP BY 1, 2),
kids AS (SELECT left(path, 64 * (d - 1)) AS path, count(*) AS n FROM m WHERE d > 0 GROUP BY 1), u AS (SELECT left(m.path, 64 * j) AS path, sum((m.n - 1) * bytes) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM m) AS m LEFT JOIN kids ON kids.path = m.path GROUP BY 1)
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, m.ends AS ends_sha256
FROM m LEFT JOIN m AS q ON m.d > 0 AND q.d = m.d - 1 AND q.path = left(m.path, 64 * (m.d - 1)) LEFT JOIN kids ON kids.path = m.path JOIN u ON u.path = m.path
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS digest, sha256(coalesce(html, '')) AS content FROM pages),
l AS (SELECT content, max(page_id) AS last FROM p WHERE bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM p LEFT JOIN l USING (content)
"""

#: DuckDB twins of the queries that SQL can express. 1 to 4, 9 and 10 have none and are checked against brute force.
ORACLES: dict[str, str] = {"op5_quality_rules": QUALITY, "op6_secret_scans": _secrets_sql(), "op7_url_filters": URLS, "op8_decontamination": DECONTAMINATION, "op11_phrases": PHRASES, "op12_prefix_trie": PREFIXES, "op13_warc": WARC}
