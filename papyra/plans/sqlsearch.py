"""DuckDB text of the search flow (oracle for ``papyra.operators.retrieval``)."""

from __future__ import annotations

from papyra.functions import encode as E
from papyra.operators import retrieval as R
from papyra.plans import sqltext as S

QUERIES_CTE = ("qs AS (SELECT conv_id * 100 + turn AS query_id, text AS query FROM conversations "
               "WHERE role = 'user')")


def filters_sql(opts: R.SearchOptions) -> str:
    ok = ["TRUE"]
    if opts.category_filter:
        lst = "[" + ", ".join(S.q(c) for c in opts.category_filter) + "]"
        ok.append(f"list_has_any(categories, {lst})")
    dates = ["TRUE"]
    if opts.start_date is not None:
        dates.append(f"update_date >= TIMESTAMP '{opts.start_date} 00:00:00'")
    if opts.end_date is not None:
        dates.append(f"update_date <= TIMESTAMP '{opts.end_date} 00:00:00'")
    if opts.years_back is not None:
        dates.append(f"update_date >= DATE '{opts.asof}' - INTERVAL {opts.years_back} YEAR")
    return "(" + " AND ".join(ok) + " AND (update_date IS NULL OR (" + " AND ".join(dates) + ")))"


def search_ctes(opts: R.SearchOptions, tag: str = "") -> list[str]:
    """CTEs ending in ``res{tag}`` (the projected result rows). Expects
    ``papers`` and ``qs`` to exist."""
    t = tag
    out = [f"qx{t} AS (SELECT query_id, query, "
           f"{S.expand_query('query') if opts.use_query_expansion else 'query'} AS expanded "
           f"FROM qs WHERE NOT {S.is_blank('query')})"]
    out.append(S.encode_cte(f"qe1{t}", f"qx{t}", "query_id", "query"))
    if opts.use_query_expansion:
        out.append(S.encode_cte(f"qe2{t}", f"qx{t}", "query_id", "expanded"))
        out.append(f"""qv{t} AS (SELECT x.query_id, x.query,
  CASE WHEN x.expanded <> x.query THEN {S.blend('a.vec', 'b.vec', E.ORIGINAL_WEIGHT, E.EXPANDED_WEIGHT)}
  ELSE a.vec END AS qvec
  FROM qx{t} x JOIN qe1{t} a ON a.query_id = x.query_id JOIN qe2{t} b ON b.query_id = x.query_id)""")
    else:
        out.append(f"qv{t} AS (SELECT x.query_id, x.query, a.vec AS qvec FROM qx{t} x "
                   f"JOIN qe1{t} a ON a.query_id = x.query_id)")
    pre = opts.filter_mode == "pre"
    out.append(f"corpus{t} AS (SELECT * FROM papers" + (f" WHERE {filters_sql(opts)})" if pre else ")"))
    out.append(S.encode_cte(f"dv{t}", f"corpus{t}", "doc_id", "combined_text"))
    pool = f"least({opts.pool}, (SELECT count(*) FROM corpus{t}))"
    out.append(f"""hits{t} AS (SELECT * FROM (
  SELECT q.query_id, d.doc_id, round({S.cosine('q.qvec', 'd.vec')}, 6) AS cosine,
    row_number() OVER (PARTITION BY q.query_id ORDER BY round({S.cosine('q.qvec', 'd.vec')}, 6) DESC, d.doc_id) AS crank
  FROM qv{t} q CROSS JOIN dv{t} d) WHERE crank <= {pool})""")
    if opts.use_reranking:
        out.append(f"""pairs{t} AS (SELECT h.query_id, h.doc_id, h.cosine,
  {S.overlap_score('q.query', S.rerank_text('p.title', 'p.abstract'))} AS raw
  FROM hits{t} h JOIN qv{t} q ON q.query_id = h.query_id JOIN corpus{t} p ON p.doc_id = h.doc_id)""")
        out.append(f"""cand{t} AS (SELECT query_id, doc_id, cosine,
  round((raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w + 1e-8), 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS candidate_rank
  FROM pairs{t} WINDOW w AS (PARTITION BY query_id))""")
    else:
        out.append(f"cand{t} AS (SELECT query_id, doc_id, cosine, cosine AS score, crank AS candidate_rank "
                   f"FROM hits{t})")
    post = f" AND {filters_sql(opts)}" if not pre else ""
    out.append(f"""acc{t} AS (SELECT * FROM (
  SELECT c.query_id, c.doc_id, c.score, c.candidate_rank, p.id, p.title, p.abstract, p.authors,
    p.categories, p.update_date,
    row_number() OVER (PARTITION BY c.query_id ORDER BY c.candidate_rank) AS rank
  FROM cand{t} c JOIN corpus{t} p ON p.doc_id = c.doc_id
  WHERE c.score >= {opts.threshold}{post}) WHERE rank <= {opts.k})""")
    if opts.generate_summaries:
        s = S.rule_summary("abstract")
        out.append(f"""summ{t} AS (SELECT *, CASE WHEN _s <> '' AND row_number() OVER (
    PARTITION BY query_id, _s <> '' ORDER BY rank) <= {R.MAX_SUMMARIES_PER_SEARCH} THEN _s END AS ai_summary
  FROM (SELECT *, {s} AS _s FROM acc{t}))""")
    else:
        out.append(f"summ{t} AS (SELECT *, CAST(NULL AS VARCHAR) AS ai_summary FROM acc{t})")
    arxiv = S.extract_arxiv_id("id")
    out.append(f"""res{t} AS (SELECT query_id, CAST(rank AS INTEGER) AS rank,
  CAST(candidate_rank AS INTEGER) AS candidate_rank, doc_id, id AS document_id, title, abstract,
  authors, categories, {S.clamp01('score')} AS similarity_score,
  strftime(update_date, '%Y-%m-%dT%H:%M:%S') AS update_date, {arxiv} AS arxiv_id,
  CASE WHEN {arxiv} IS NOT NULL THEN '{'https://arxiv.org/abs/'}' || {arxiv} END AS abstract_url,
  CASE WHEN {arxiv} IS NOT NULL THEN '{'https://arxiv.org/pdf/'}' || {arxiv} || '.pdf' END AS pdf_url,
  FALSE AS pdf_available, ai_summary FROM summ{t})""")
    return out


def with_search(opts: R.SearchOptions, extra: list[str] | None = None, language=None) -> str:
    ctes = [S.raw_cte(), S.flagged_cte(language), S.papers_cte(), QUERIES_CTE] + search_ctes(opts)
    return "WITH " + ",\n".join(ctes + (extra or [])) + "\n"


RESULT_COLS = ("query_id, rank, candidate_rank, doc_id, document_id, title, similarity_score, update_date, "
               "arxiv_id, abstract_url, pdf_url, pdf_available, ai_summary, "
               "array_to_string(authors, '|') AS authors, array_to_string(categories, '|') AS categories")
