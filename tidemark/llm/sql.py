"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.licenses import COVERAGE, SLACK, STRETCH, rows_of_templates
from tidemark.llm.quality_rules import RULES, STOP_WORDS

_SPACE = r"[^\x20\x09-\x0D]+"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quality_rules() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    bounds = {r.name: " AND ".join([f"{r.metric} >= {r.low}"] * (r.low is not None) + [f"{r.metric} <= {r.high}"] * (r.high is not None)) for r in RULES}
    failed = ", ".join(f"CASE WHEN NOT coalesce({test}, true) THEN '{name}' END" for name, test in bounds.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_SPACE}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i:i + 7]) AS n FROM g),
c AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM h WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
CAST(len(list_filter(words, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',', {failed}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f"""


def decontamination() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_LETTERS}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_LETTERS}') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, w[i:i + 9] AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
pos AS (SELECT r, n, i, w[i:i + n - 1] AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, n, i, item FROM pos JOIN win USING (g)),
cov AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, n, i FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""


def license_scan() -> str:
    rows = ", ".join(f"({i}, '{label}', '{text}', {str(exact).lower()})" for i, label, text, exact in rows_of_templates())
    found = "r, template, label, exact, size"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_LETTERS}') AS w FROM documents),
t AS (SELECT *, string_split(text, ' ') AS w FROM (VALUES {rows}) x(template, label, text, exact)),
tp AS (SELECT template, label, exact, len(w) - 1 AS size, i - 1 AS place, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)),
p AS (SELECT r, i - 1 AS p, w[i] AS a, w[i + 1] AS b FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d)),
hit AS (SELECT {found}, place, p, p - place AS diagonal FROM p JOIN tp USING (a, b)),
full_match AS (SELECT {found}, diagonal FROM hit GROUP BY ALL HAVING count(*) = size),
loose AS (SELECT DISTINCT {found}, diagonal FROM hit h WHERE NOT exact AND NOT EXISTS (SELECT 1 FROM full_match f WHERE f.r = h.r AND f.template = h.template AND f.diagonal = h.diagonal)),
win AS (SELECT a.r, a.template, a.label, a.exact, a.size, a.diagonal AS low, b.diagonal AS high FROM loose a JOIN loose b ON a.r = b.r AND a.template = b.template AND b.diagonal BETWEEN a.diagonal AND a.diagonal + greatest({SLACK}, a.size // {STRETCH})),
enough AS (SELECT w.* FROM win w WHERE (SELECT count(*) FROM hit h WHERE h.r = w.r AND h.template = w.template AND h.diagonal BETWEEN w.low AND w.high) >= {COVERAGE} * (w.size + 1) / 2),
both_words AS (SELECT w.*, h.place, h.p FROM enough w JOIN loose l ON l.r = w.r AND l.template = w.template AND l.diagonal BETWEEN w.low AND w.high JOIN hit h ON h.r = l.r AND h.template = l.template AND h.diagonal = l.diagonal),
mg AS (SELECT {found}, low AS start, high, len(list_distinct(list_concat(list(place), list(place + 1)))) AS placed, len(list_distinct(list_concat(list(p), list(p + 1)))) AS stood, max(p) - min(p) + 2 AS stretch FROM both_words GROUP BY ALL),
s AS (SELECT r, label, exact, diagonal AS start, 1.0::DOUBLE AS score FROM full_match
UNION ALL SELECT r, label, exact, start, placed / (size + 1)::DOUBLE FROM mg WHERE placed / (size + 1)::DOUBLE >= {COVERAGE}::DOUBLE AND stood >= {COVERAGE}::DOUBLE * stretch),
o AS (SELECT r, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN o USING (r)"""


def clustering(rounds: int = 3, clusters: int = 16) -> str:
    """Each round is a pair of tables: who is nearest to which centroid, and where the centroids go."""

    def nearest(n: int) -> str:
        away = "CAST(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS BIGINT)"
        return f"a{n} AS (SELECT r, vec_id, k.v, c, {away} AS d FROM k, c{n} c QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"

    def moved(n: int) -> str:
        mean = "CAST((s - ((s % m) + m) % m) // m AS BIGINT)"
        sums = f"s{n} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS m FROM a{n}, range(1, 65) t(i) GROUP BY c, i)"
        return f"{sums}, m{n} AS (SELECT c, list({mean} ORDER BY i) AS v FROM s{n} GROUP BY c), c{n + 1} AS (SELECT o.c, coalesce(w.v, o.v) AS v FROM c{n} o LEFT JOIN m{n} w ON w.c = o.c)"

    steps = ", ".join(f"{nearest(n)}, {moved(n)}" for n in range(rounds))
    return f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM k QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= {clusters}),
{steps}, {nearest(rounds)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""


def all_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality_rules(), "op7_decontamination": decontamination(), "op10_license_scan": license_scan(), "op13_hamerly": clustering()}
