"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from .common import ASCII_UPPER
from .license_scan import BASE, COVERAGE, DENSITY, SLACK, TEMPLATES, K

OP5 = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP3 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON b.vec_id <> a.vec_id AND len(a.q) = len(b.q)
    WHERE a.vec_id % 100 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""



def _op10() -> str:
    """Base places, votes of k-grams along diagonals and verified spans, by joins of the words themselves."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    words = lambda text: (
        f"regexp_extract_all(translate({text}, '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    )
    grams = f"list_transform(range(0, greatest(len(w) - {K - 1}, 0)), lambda i: array_to_string(w[i + 1 : i + {K}], ' '))"
    templates = ", ".join(f"({n}, {quoted(label)}, {quoted(text)})" for n, (label, text) in enumerate(TEMPLATES))

    def places(phrase: str) -> str:
        test = " AND ".join(f"w[i + {n}] = {quoted(part)}" for n, part in enumerate(phrase.split(), 1))
        return f"list_filter(range(0, len(w)), lambda i: coalesce({test}, false))"

    named = {label: f"at_{label}" for label in BASE.values()}
    return f"""
WITH tw AS (SELECT template, label, {words("txt")} AS w FROM (VALUES {templates}) AS v(template, label, txt)),
tg AS (SELECT template, label, len(w) AS size, unnest({grams}) AS gram, unnest(range(0, greatest(len(w) - {K - 1}, 0))) AS tpos FROM tw),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT rid, unnest({grams}) AS gram, unnest(range(0, greatest(len(w) - {K - 1}, 0))) AS pos FROM d),
m AS (SELECT rid, template, label, size, pos, pos - tpos AS diagonal FROM g JOIN tg USING (gram)),
f AS (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {SLACK} THEN 0 ELSE 1 END AS fresh
    FROM (SELECT DISTINCT rid, template, diagonal FROM m)
), r AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM f),
x AS (
    SELECT m.rid, m.template, m.label, m.size, r.run, m.pos + j AS word, m.pos + j - m.diagonal AS tword
    FROM m JOIN r ON r.rid = m.rid AND r.template = m.template AND r.diagonal = m.diagonal, (SELECT unnest(range(0, {K})) AS j)
), s AS (
    SELECT rid, label, count(DISTINCT tword)::DOUBLE / size AS coverage, count(DISTINCT word) AS here,
        min(word) AS first_k, max(word) - {K - 1} AS last_k
    FROM x GROUP BY rid, template, label, size, run
), l AS (
    SELECT rid, list(DISTINCT label) AS more, max(coverage) AS best, min(first_k) AS span_first, max(last_k) AS span_last
    FROM s WHERE coverage >= {COVERAGE} AND here::DOUBLE / (last_k + {K} - first_k) >= {DENSITY} GROUP BY rid
), b AS (
    SELECT rid, doc_id, len(w) AS n_words, {", ".join(f"{places(p)} AS {named[label]}" for p, label in BASE.items())} FROM d
), c AS (
    SELECT *, {" || ".join(named.values())} AS places,
        list_filter([{", ".join(f"CASE WHEN len({at}) > 0 THEN {quoted(label)} END" for label, at in named.items())}], lambda y: y IS NOT NULL) AS found
    FROM b
)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
    array_to_string(list_sort(found), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(found || coalesce(more, []))), ',') AS labels,
    CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score, span_first, span_last
FROM c LEFT JOIN l USING (rid)
"""


ORACLE_SQL: dict[str, str] = {"op3_exact_top_k": OP3, "op5_exact_dedup": OP5, "op10_license_scan": _op10()}
