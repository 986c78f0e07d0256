"""SQL of the queries that SQL can express."""

from __future__ import annotations

from .license_scan import CONTAINED, PHRASES, TEMPLATES
from .line_rules import LEAST_WORDS, MOST_DOCUMENTS, MOST_REPEATED

_WORD, _BLANK = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"\n[\x20\x09-\x0D]*\n"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _phrase(words: list[str]) -> str:
    return "(" + " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(words)) + ")"


_PLACES = " OR ".join(_phrase(p.split()) for p in PHRASES)
_LABEL = "CASE " + " ".join(f"WHEN w[i] = '{p.split()[0]}' THEN '{label}'" for p, label in PHRASES.items()) + " END"
_TEMPLATES = ", ".join(f"('{label}', {_list(sorted(set(t.split())))})" for label, t in TEMPLATES)

LICENSES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, '{_WORD}') AS w, string_split_regex(t, '{_BLANK}') AS bs FROM d),
p AS (SELECT r, doc_id, w, bs, list_filter(range(1, len(w) + 1), lambda i: {_PLACES}) AS pl FROM w),
b AS (SELECT r, doc_id, len(w) AS n_words, len(pl) AS n_base, list_min(pl) - 1 AS first_word, list_max(pl) - 1 AS last_word, list_sort(list_distinct(list_transform(pl, lambda i: {_LABEL}))) AS own FROM p),
k AS (SELECT r, list_distinct(regexp_extract_all(u, '{_WORD}')) AS u FROM (SELECT r, unnest(bs) AS u FROM w) q),
h AS (SELECT r, label, max(len(list_intersect(u, ws)) / len(ws)) AS c FROM k, (VALUES {_TEMPLATES}) v(label, ws) WHERE len(list_intersect(u, ws)) >= ceil({CONTAINED} * len(ws) - 1e-9) GROUP BY r, label),
g AS (SELECT r, list(label) AS more, max(c) AS best FROM h GROUP BY r)
SELECT doc_id, n_words, n_base, first_word, last_word, array_to_string(own, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(own, coalesce(more, [])))), ',') AS labels,
CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0) END AS score FROM b LEFT JOIN g USING (r)"""

_SPACES, _SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"

LINE_RULES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, CAST(source AS VARCHAR) AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{_SOLID}+') AS w FROM d),
g AS (SELECT r, i, w[i:i + 4] AS x FROM w, unnest(range(1, len(w) - 3)) q(i)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS k FROM g) q WHERE k > 1),
v AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM c, range(5) s(j) GROUP BY r),
l AS (SELECT r, source, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SOLID}')) AS ls FROM d),
k AS (SELECT r, source, ls, md5(array_to_string(list_transform(ls, lambda x: regexp_replace(trim(lower(x), ' '), '{_SPACES}+', ' ', 'g')), chr(10))) AS mark FROM l),
e AS (SELECT r, source, mark, unnest(ls) AS line FROM k),
n AS (SELECT r, source, mark, line, regexp_replace(trim(lower(line), ' '), '{_SPACES}+', ' ', 'g') AS h, len(regexp_extract_all(line, '{_SOLID}+')) AS words FROM e),
u AS (SELECT source, h FROM n GROUP BY source, h HAVING count(DISTINCT mark) > {MOST_DOCUMENTS}),
x AS (SELECT n.r, sum(n.words) AS removed_words FROM n JOIN u ON n.h = u.h AND n.source IS NOT DISTINCT FROM u.source GROUP BY n.r),
p AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM n GROUP BY r),
s AS (SELECT d.r, doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACES}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
FROM d JOIN w USING (r) LEFT JOIN p USING (r) LEFT JOIN v USING (r) LEFT JOIN x USING (r)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - removed_words >= {LEAST_WORDS} AS kept, removed_words FROM f"""
