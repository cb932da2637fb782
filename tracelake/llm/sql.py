"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

#: Words as the contracts have them: lower case for A to Z alone, split at six kinds of blank.
_WORDS = r"""
    SELECT doc_id, list_filter(
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda w: w <> '') AS w
    FROM documents"""

NEARDUP_SQL = f"""
WITH RECURSIVE words AS ({_WORDS}),
grams AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g
    FROM words),
exploded AS (SELECT doc_id, unnest(g) AS s FROM grams),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM exploded a JOIN exploded b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM common
    JOIN grams x ON x.doc_id = a JOIN grams y ON y.doc_id = b
    WHERE 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
edges AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach AS (
    SELECT doc_id AS u, doc_id AS v FROM grams
    UNION
    SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
comp AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM grams JOIN comp ON u = doc_id
"""

WARC_SQL = """
WITH p AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND original <> page_id THEN original END AS refers_to
FROM o
"""

#: All counts are in the table, once-seen ones too, so every bigram of the corpus is found.
LM_SQL = f"""
WITH words AS ({_WORDS}),
tokens AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM words),
pairs AS (SELECT doc_id, i, t, lag(t) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM tokens),
one AS (SELECT t, count(*) AS n FROM tokens GROUP BY t),
two AS (SELECT p, t, count(*) AS n FROM pairs WHERE p IS NOT NULL GROUP BY p, t),
total AS (SELECT count(*) AS n FROM tokens),
scored AS (
    SELECT pairs.doc_id, CASE WHEN pairs.p IS NULL THEN log10(u.n) - log10(total.n) ELSE log10(two.n) - log10(c.n) END AS s
    FROM pairs CROSS JOIN total JOIN one u ON u.t = pairs.t LEFT JOIN one c ON c.t = pairs.p LEFT JOIN two ON two.p = pairs.p AND two.t = pairs.t),
sums AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM scored GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, round(coalesce(s, 0), 3) AS log10_score, round(s / n, 5) AS mean_log10
FROM documents d LEFT JOIN sums ON sums.doc_id = d.doc_id
"""

#: As LM_SQL with trigrams and all counts: a trigram, or at a text's second word a bigram, is always in the table of its own corpus.
LM_TRIGRAMS_SQL = f"""
WITH words AS ({_WORDS}),
tokens AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM words),
runs AS (SELECT doc_id, t, lag(t) OVER seq AS p, lag(t, 2) OVER seq AS q FROM tokens WINDOW seq AS (PARTITION BY doc_id ORDER BY i)),
one AS (SELECT t, count(*) AS n FROM tokens GROUP BY t),
two AS (SELECT p, t, count(*) AS n FROM runs WHERE p IS NOT NULL GROUP BY p, t),
three AS (SELECT q, p, t, count(*) AS n FROM runs WHERE q IS NOT NULL GROUP BY q, p, t),
total AS (SELECT count(*) AS n FROM tokens),
scored AS (
    SELECT runs.doc_id, CASE
        WHEN runs.q IS NOT NULL THEN log10(three.n) - log10(before.n)
        WHEN runs.p IS NOT NULL THEN log10(two.n) - log10(c.n)
        ELSE log10(u.n) - log10(total.n) END AS s
    FROM runs CROSS JOIN total JOIN one u ON u.t = runs.t LEFT JOIN one c ON c.t = runs.p
    LEFT JOIN two ON two.p = runs.p AND two.t = runs.t LEFT JOIN two before ON before.p = runs.q AND before.t = runs.p
    LEFT JOIN three ON three.q = runs.q AND three.p = runs.p AND three.t = runs.t),
sums AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM scored GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, round(coalesce(s, 0), 3) AS log10_score, round(s / n, 5) AS mean_log10
FROM documents d LEFT JOIN sums ON sums.doc_id = d.doc_id
"""
