"""SQL (DuckDB) for the queries that SQL can say, over whole tables."""

from __future__ import annotations

from spindrift.llm.licenses import BASE, RULES, keyword

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT x AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id, x = min(y) AS kept FROM r LEFT JOIN n ON n.doc_id = x GROUP BY x
"""


def _spread(pattern: str) -> str:
    """A rule's pattern for words with a space on either side each, so that matches in a row do not share one."""
    return " " + pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + " "


_RULES = ", ".join(f"('{label}', {rank}, '{keyword(p)}', '{_spread(p)}')" for label, rank, p in RULES)
_BASE = "|".join(_spread(p) for p in BASE)
_NAMED = "CASE trim(replace(m, '  ', ' ')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BASE.items()) + " END"
_PLACES = """list_transform(range(1, len(ms) + 1), lambda i: CAST(list_sum(list_transform(segs[1:i], lambda x: (length(x) - length(replace(x, ' ', ''))) // 2)) + coalesce(list_sum(list_transform(ms[1:(i - 1)], lambda x: (length(x) - length(replace(x, ' ', ''))) // 2)), 0) AS BIGINT))"""

LICENSES = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, ' ' || array_to_string(w, '  ') || ' ' AS t, ' ' || array_to_string(w, ' ') || ' ' AS plain FROM w),
b0 AS (SELECT doc_id, string_split_regex(t, '{_BASE}') AS segs, regexp_extract_all(t, '{_BASE}') AS ms FROM d WHERE regexp_matches(t, '{_BASE}')),
b AS (SELECT doc_id, {_PLACES} AS places, list_transform(ms, lambda m: {_NAMED}) AS names FROM b0),
rules AS (SELECT * FROM (VALUES {_RULES}) AS v(label, rank, key, re)),
h0 AS (SELECT doc_id, label, rank, string_split_regex(t, re) AS segs, regexp_extract_all(t, re) AS ms FROM d JOIN rules ON contains(plain, key) AND regexp_matches(t, re)),
h1 AS (SELECT doc_id, label, rank, unnest({_PLACES}) AS s, unnest(list_transform(ms, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2)) AS k FROM h0),
h AS (SELECT doc_id, label, rank, s, s + k AS e FROM h1),
kept AS (SELECT * FROM h a WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id = a.doc_id AND o.rank >= a.rank AND o.s <= a.s AND o.e >= a.e AND (o.s <> a.s OR o.e <> a.e OR o.rank <> a.rank))),
all_ AS (SELECT doc_id, label, rank FROM kept UNION ALL SELECT doc_id, unnest(names), 2 FROM b),
g AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(rank) AS top FROM all_ GROUP BY doc_id)
SELECT d.doc_id, n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
 coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE coalesce(top, 0) WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.8 ELSE 0.95 END AS DOUBLE) AS score
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id
"""

ORACLES = {"op3_minhash_neardup": NEAR_DUPLICATES, "op8_licenses": LICENSES}
