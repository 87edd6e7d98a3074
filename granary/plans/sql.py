"""Pieces of SQL for DuckDB that mirror the Column functions."""

from __future__ import annotations

from granary.functions.text import EDGE, MARKED, TYPE_ALTERNATION, WHITE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q(WHITE + '+')}, ' ', 'g'), ' ')"


def edges(x: str, signs: str = EDGE) -> str:
    return f"trim({x}, {q(signs)})"


def dedup_key(x: str) -> str:
    signs = " ,.;:-|\"'"
    return edges(f"lower({squeeze(x)})", signs)


def marked_ratio(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    letters = f"length(regexp_replace({low}, '\\P{{L}}', '', 'g'))"
    return f"CASE WHEN {letters} = 0 THEN 0.0 ELSE length(regexp_replace({low}, '[^{MARKED}]', '', 'g')) / {letters} END"


def token_estimate(x: str) -> str:
    s = squeeze(x)
    return f"CASE WHEN {s} = '' THEN 0 ELSE greatest(1, CAST(trunc(CAST(len(string_split({s}, ' ')) AS DOUBLE) * CAST(1.35 AS DOUBLE)) AS INTEGER)) END"


def terms(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '([\\p{{L}}\\p{{N}}_]+)', 1), lambda t: len(t) > 1)"


def top(inner: str, k: int, order: str = "score DESC, id") -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY {order}) AS INTEGER) AS rank FROM ({inner})) WHERE rank <= {k}"


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


def bm25(docs: str, queries: str, k: int, k1: float = 1.5, b: float = 0.75, keep_self: bool = True) -> str:
    """docs: SELECT id, text; queries: SELECT qid, text."""
    return f"""
        WITH d AS (SELECT id, {terms('text')} AS t FROM ({docs})),
        stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM d),
        p AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM d),
        tf AS (SELECT id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        qt AS (SELECT qid, unnest(list_distinct({terms('text')})) AS term FROM ({queries})),
        w AS (SELECT qt.qid, tf.id, ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf.tf * {k1 + 1} / (tf.tf + {k1} * (1 - {b} + {b} * dl / avg_len)) AS w
              FROM qt JOIN tf USING (term) JOIN df USING (term), stats {'' if keep_self else 'WHERE qt.qid <> tf.id'})
        {top("SELECT qid, id, round(sum(CAST(w AS DOUBLE)), 6) AS score FROM w GROUP BY qid, id HAVING round(sum(CAST(w AS DOUBLE)), 6) > 0", k)}
    """


__all__ = ["TYPE_ALTERNATION", "bm25", "cosine", "dedup_key", "edges", "marked_ratio", "q", "squeeze", "terms", "token_estimate", "top"]
