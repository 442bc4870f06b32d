"""Search: query expansion, retrieval, rerank, filters, summaries, results.

``search`` answers a whole table of queries at once. The plan is

    queries --expand/encode--> query vectors (size-checked)
    vectors --exact or clustered k-NN--> top ``pool`` candidates per query,
    written once as narrow (query, doc, score) rows
    candidate ids --semi-join--> the papers that were hit, cleaned only then and
    written once; candidates meet their tokens and filter flags
    --(rerank: pair scorer, min-max window)--> candidate rank
    --> threshold / category / date filters
    --row_number--> first ``top_k`` accepted, which then get titles and abstracts,
    the first 5 a summary

No text is in a shuffle by query before the cut.

The corpus is never copied. With a stored index (``Corpus.centroids``) only
the probed clusters are read; without one the papers are encoded in the scan.

Filters run after the candidate cut by default (``filter_mode="post"``, the
reference's meaning, compensated by over-fetching x3 with filters and x5 with
rerank); ``filter_mode="pre"`` applies them to the corpus first (full recall).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import encode as E
from papyra.functions import text as T
from papyra.functions import vectors as V
from papyra.operators import celltree as C
from papyra.operators import knn as K
from papyra.session import materialize

TOP_K_RESULTS = 10
SIMILARITY_THRESHOLD = 0.3
MAX_SUMMARIES_PER_SEARCH = 5
RERANK_CAP = 100
FILTER_OVERFETCH = 3
RERANK_OVERFETCH = 5


@dataclass(frozen=True)
class SearchOptions:
    top_k: int | None = None                 # None -> 10
    min_similarity: float | None = None      # None -> 0.3
    category_filter: tuple[str, ...] | None = None
    start_date: dt.date | None = None
    end_date: dt.date | None = None
    years_back: int | None = None
    asof: dt.date = dt.date(2024, 12, 31)
    generate_summaries: bool = True
    use_reranking: bool = True
    use_query_expansion: bool = True
    filter_mode: str = "post"
    rerank_cap: int = RERANK_CAP             # candidates that are re-scored; top_k at least
    scorer: object = field(default=None, compare=False)   # (query_col, text_col) -> Column

    @property
    def k(self) -> int:
        return TOP_K_RESULTS if self.top_k is None else self.top_k

    @property
    def threshold(self) -> float:
        return SIMILARITY_THRESHOLD if self.min_similarity is None else self.min_similarity

    @property
    def pool(self) -> int:
        """Candidates fetched per query: x3 with filters, x5 with rerank, the
        latter bounded by ``rerank_cap`` but never below ``top_k``."""
        mult = max(FILTER_OVERFETCH if self.has_filters and self.filter_mode == "post" else 1,
                   RERANK_OVERFETCH if self.use_reranking else 1)
        size = self.k * mult
        return min(size, max(self.rerank_cap, self.k)) if self.use_reranking else size

    @property
    def has_filters(self) -> bool:
        return bool(self.category_filter) or any(
            x is not None for x in (self.start_date, self.end_date, self.years_back))


def query_vectors(queries: DataFrame, expand: bool, text_col: str = "query",
                  dim: int = E.ENCODER_DIM) -> DataFrame:
    """``(query_id, query, expanded, qvec)``; blank queries are dropped.

    With expansion the query vector is 0.7 * enc(query) + 0.3 * enc(expanded),
    re-normalised, when a dictionary term matched; else enc(query).
    """
    q = queries.where(~T.is_blank(text_col)).select("query_id", F.col(text_col).alias("query"))
    q = q.withColumn("expanded", E.expand_query("query") if expand else F.col("query"))
    q = E.hash_encode(q, "query", "v_query", dim)
    if expand:
        q = E.hash_encode(q, "expanded", "v_expanded", dim)
        blended = V.blend("v_query", "v_expanded", E.ORIGINAL_WEIGHT, E.EXPANDED_WEIGHT)
        q = q.withColumn("qvec", F.when(F.col("expanded") != F.col("query"), blended)
                         .otherwise(F.col("v_query"))).drop("v_expanded")
    else:
        q = q.withColumn("qvec", F.col("v_query"))
    return q.drop("v_query")


def doc_vectors(papers: DataFrame, text_col: str = "combined_text", dim: int = E.ENCODER_DIM) -> DataFrame:
    """``(doc_id, vec)`` with the built-in encoder."""
    return E.hash_encode(papers.select("doc_id", text_col), text_col, "vec", dim).select("doc_id", "vec")


def passes_filters(opts: SearchOptions) -> F.Column:
    ok = F.lit(True)
    if opts.category_filter:
        ok = ok & F.arrays_overlap("categories", F.array(*[F.lit(c) for c in opts.category_filter]))
    d = F.col("update_date")
    date_ok = F.lit(True)
    if opts.start_date is not None:
        date_ok = date_ok & (d >= F.lit(opts.start_date).cast("timestamp"))
    if opts.end_date is not None:
        date_ok = date_ok & (d <= F.lit(opts.end_date).cast("timestamp"))
    if opts.years_back is not None:
        date_ok = date_ok & (d >= F.add_months(F.lit(opts.asof), -12 * opts.years_back).cast("timestamp"))
    return ok & (d.isNull() | date_ok)


def best_per_query(pairs: DataFrame, opts: SearchOptions) -> DataFrame:
    """Adds ``score`` and ``candidate_rank`` to (query_id, doc_id, cosine, rank, raw, ...)
    rows: without rerank the cosine and its rank, else ``raw``, the pair score, min-max
    normalised over a query's candidates. The rows should be narrow: they are shuffled
    by query."""
    if not opts.use_reranking:
        return pairs.withColumns({"score": F.col("cosine"), "candidate_rank": F.col("rank")}).drop("rank", "raw")
    w = Window.partitionBy("query_id")
    order = w.orderBy(F.col("raw").desc(), F.col("doc_id"))
    norm = (F.col("raw") - F.min("raw").over(w)) / (F.max("raw").over(w) - F.min("raw").over(w) + 1e-8)
    return pairs.drop("rank").withColumns({"score": V.round_score(norm), "candidate_rank": F.row_number().over(order)})


@dataclass(frozen=True)
class Corpus:
    """What is searched: ``papers`` (cleaned, with doc_id; may be a plan over raw
    records), ``vectors`` (doc_id, vec) and, for a clustered index, its
    ``centroids`` and a ``cluster_id`` on the vectors; without ``n_probe`` the
    clusters probed grow with their number (``knn.default_probes``). ``cells`` is a cell
    index over the doc_ids (``celltree``): its stop rule decides what is read, and the
    vectors themselves are not needed. ``rows_of(ids)`` gives the papers of a table of doc_ids; where papers come from raw records it should
    join before it cleans."""
    papers: DataFrame
    vectors: DataFrame | None
    centroids: DataFrame | None = None
    n_probe: int | None = None
    rows_of: object = field(default=None, compare=False)
    cells: C.CellIndex | None = field(default=None, compare=False)

    def rows(self, ids: DataFrame) -> DataFrame:
        return self.rows_of(ids) if self.rows_of else self.papers.join(ids, "doc_id", "left_semi")


def prepare_corpus(papers: DataFrame, dv: DataFrame | None = None, centroids: DataFrame | None = None,
                   n_probe: int | None = None, rows_of=None, cells: C.CellIndex | None = None) -> Corpus:
    """Vectors come from ``dv`` (a stored index), from ``cells`` or from the built-in
    encoder over title and abstract, inside the scan."""
    if dv is None and cells is None:
        text = F.col("combined_text") if "combined_text" in papers.columns \
            else F.concat(F.col("title"), F.lit(". "), F.col("abstract"))
        dv = doc_vectors(papers.select("doc_id", text.alias("combined_text")))
    return Corpus(papers, dv, centroids, n_probe, rows_of, cells)


def retrieve(qv: DataFrame, corpus: Corpus, pool: int, n_queries: int | None = None,
             dim: int | None = E.ENCODER_DIM) -> DataFrame:
    """``(query_id, doc_id, cosine, rank)``: the ``pool`` best papers per query."""
    if corpus.cells is not None:
        hits = C.search(corpus.cells, qv, pool, query_vec_col="qvec")[0].withColumnRenamed("id", "doc_id")
    elif corpus.centroids is None:
        hits = K.exact_knn(corpus.vectors, qv, pool, id_col="doc_id", vec_col="vec", query_vec_col="qvec",
                           dim=dim, n_queries=n_queries)
    else:
        vectors = corpus.vectors.select(F.col("doc_id").alias("id"), "vec", "cluster_id")
        n_probe = corpus.n_probe or K.default_probes(corpus.centroids.count())
        hits = K.clustered_knn(vectors, corpus.centroids, qv, pool, n_probe, query_vec_col="qvec") \
            .withColumnRenamed("id", "doc_id")
    return hits.select("query_id", "doc_id", F.col("score").alias("cosine"), "rank")


def hit_papers(corpus: Corpus, ids: DataFrame, opts: SearchOptions) -> DataFrame:
    """The papers that were hit, written once, one row per ``doc_id`` (the first by id),
    with what the candidates need of their texts: ``_text`` (tokens, or the text
    itself for a plugged scorer), ``_ok`` (passes the filters) and ``_has`` (an abstract)."""
    rows = corpus.rows(ids)
    text = E.rerank_text("title", "abstract")
    ok = passes_filters(opts) if opts.filter_mode == "post" else F.lit(True)
    wide = materialize(rows.withColumns({
        "_text": F.array_distinct(E.tokens(text)) if opts.scorer is None else text,
        "_ok": F.coalesce(ok, F.lit(False)), "_has": F.coalesce(F.col("abstract"), F.lit("")) != "",
        "_h": F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), "_m": F.monotonically_increasing_id()}), "hit-papers")
    # the choice moves numbers, not texts
    first = Window.partitionBy("doc_id").orderBy("id", "_h", "_m")
    extra = wide.select("doc_id", "id", "_h", "_m").withColumn("_n", F.row_number().over(first)).where("_n > 1").select("_m")
    return wide.join(extra, "_m", "left_anti").drop("_m", "_h") if extra.limit(1).count() else wide.drop("_m", "_h")


def _retrieved(queries: DataFrame, corpus: Corpus, opts: SearchOptions, hits: DataFrame | None,
               papers: DataFrame | None = None):
    """(narrow candidate rows, the papers behind them)."""
    live = queries.where(~T.is_blank("query")).select("query_id", "query")
    if hits is None:
        if opts.filter_mode == "pre":
            allowed = corpus.papers.where(passes_filters(opts)).select("doc_id")
            # the cells hold papers of all kinds: filters before the cut need the vectors
            vectors = corpus.vectors if corpus.vectors is not None \
                else C.vectors_of(corpus.cells).withColumnRenamed("id", "doc_id")
            corpus = replace(corpus, vectors=vectors.join(allowed, "doc_id", "left_semi"), cells=None)
        qv = query_vectors(queries, opts.use_query_expansion)
        # narrow rows, queries x pool; read for the ids and for the join
        hits = materialize(retrieve(qv, corpus, opts.pool, live.count()), "hits")
    if papers is None:
        papers = hit_papers(corpus, hits.select("doc_id").distinct(), opts)
    if opts.use_reranking:
        # queries go to the texts, which are dealt once, by paper; both stay behind: only the
        # score goes on, written where it is the built-in one, so that the joins' shuffle files go
        asked = live.withColumn("_q", F.array_join(F.array_distinct(E.tokens("query")), " ") if opts.scorer is None else F.col("query"))
        score = opts.scorer or (lambda q, t: E.overlap_of_tokens(F.filter(F.split(q, " "), lambda x: x != ""), t))
        pairs = hits.join(asked.drop("query"), "query_id").join(papers.select("doc_id", "_ok", "_has", "_text"), "doc_id") \
            .withColumn("raw", score(F.col("_q"), F.col("_text"))).drop("_q", "_text")
        if opts.scorer is None:
            pairs = materialize(pairs, "pairs")
    else:
        pairs = hits.join(papers.select("doc_id", "_ok", "_has"), "doc_id").join(live.select("query_id"), "query_id", "left_semi") \
            .withColumn("raw", F.lit(None).cast("double"))
    return best_per_query(pairs, opts), papers


def candidates(queries: DataFrame, corpus: Corpus, opts: SearchOptions, hits: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, cosine, raw, score, candidate_rank) of each query's candidate
    papers, before the threshold and the filters. ``hits`` may pass (query_id, doc_id,
    cosine, rank) rows that have been retrieved before."""
    return _retrieved(queries, corpus, opts, hits)[0].drop("_ok", "_has")


def search(queries: DataFrame, papers: DataFrame | None, opts: SearchOptions = SearchOptions(),
           dv: DataFrame | None = None, corpus: Corpus | None = None, hits: DataFrame | None = None,
           wide: DataFrame | None = None) -> DataFrame:
    """Results per query: ``query_id, rank, candidate_rank, doc_id`` + the
    result fields. ``papers`` must carry ``doc_id``. ``corpus`` passes a stored
    index (vectors, centroids or cells) or one shared between runs; ``wide`` the
    ``hit_papers`` of runs that share their hits, filters and scorer."""
    if corpus is None:
        corpus = prepare_corpus(papers, dv)
    found, wide = _retrieved(queries, corpus, opts, hits, wide)
    found = found.where((F.col("score") >= opts.threshold) & F.col("_ok")).select(
        "query_id", "doc_id", "score", "candidate_rank", "_has")
    acc = Window.partitionBy("query_id").orderBy("candidate_rank")
    found = found.withColumn("rank", F.row_number().over(acc)).where(F.col("rank") <= opts.k)
    if opts.generate_summaries:
        # the extractive summary is empty exactly when the abstract is, so the
        # slots are chosen first and only those rows are summarised
        slot = Window.partitionBy("query_id", "_has").orderBy("rank")
        found = found.withColumn("_slot", F.col("_has") & (F.row_number().over(slot) <= MAX_SUMMARIES_PER_SEARCH))
        summary = F.when(F.col("_slot"), T.rule_summary("abstract"))
    else:
        summary = F.lit(None).cast("string")
    # titles and abstracts join the accepted rows only
    full = found.drop("_has").join(wide.drop("_text", "_ok", "_has"), "doc_id").withColumn("ai_summary", summary)
    return result_projection(full)


def similar_papers(probes: DataFrame, papers: DataFrame | None, top_k: int = 5, opts: SearchOptions = SearchOptions(),
                   corpus: Corpus | None = None) -> DataFrame:
    """The papers most like each probe (a table with ``doc_id``): a search with
    the title and the first 500 characters of the abstract as the query, without
    expansion, for top_k + 1 results; the probe itself is taken out. ``opts`` sets
    rerank, threshold, filters and summaries. Unknown probes have no rows."""
    if corpus is None:
        corpus = prepare_corpus(papers)
    known = corpus.rows(probes.select("doc_id").distinct())
    queries = materialize(known.select(F.col("doc_id").alias("query_id"), F.col("id").alias("_self"),
                                       E.rerank_text("title", "abstract").alias("query")), "probes")
    res = search(queries.select("query_id", "query"), None, corpus=corpus, opts=replace(
        opts, top_k=top_k + 1, use_query_expansion=False))
    own = queries.select("query_id", "_self").distinct()
    others = res.join(own, "query_id").where(F.col("document_id") != F.col("_self")).drop("_self")
    w = Window.partitionBy("query_id").orderBy("rank")
    return others.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def result_projection(hits: DataFrame) -> DataFrame:
    """The exported result row (score clamp, identifier, URLs)."""
    arxiv = T.extract_arxiv_id("id")
    pdf_available = F.col("pdf_available") if "pdf_available" in hits.columns else F.lit(False)
    return hits.select(
        "query_id", "rank", "candidate_rank", "doc_id",
        F.col("id").alias("document_id"), "title", "abstract", "authors", "categories",
        T.clamp01("score").alias("similarity_score"),
        F.date_format("update_date", "yyyy-MM-dd'T'HH:mm:ss").alias("update_date"),
        arxiv.alias("arxiv_id"),
        F.when(arxiv.isNotNull(), T.abstract_url(arxiv)).alias("abstract_url"),
        F.when(arxiv.isNotNull(), T.pdf_url(arxiv)).alias("pdf_url"),
        (arxiv.isNotNull() & pdf_available).alias("pdf_available"),
        "ai_summary")


def envelope(queries: DataFrame, results: DataFrame, summaries_enabled: bool = True) -> DataFrame:
    """Per query (also queries without hits): totals, summaries, mean score, cost."""
    per = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("total_results"),
        F.count_if(F.col("ai_summary").isNotNull()).alias("ai_summaries_count"),
        F.count_if(F.col("pdf_available")).alias("downloadable_pdfs"),
        F.avg("similarity_score").alias("avg_sim"))
    out = queries.select("query_id").join(per, "query_id", "left")
    n = F.coalesce(F.col("total_results"), F.lit(0))
    return out.select(
        "query_id", n.alias("total_results"),
        F.coalesce("ai_summaries_count", F.lit(0)).alias("ai_summaries_count"),
        F.coalesce("downloadable_pdfs", F.lit(0)).alias("downloadable_pdfs"),
        F.round(F.coalesce("avg_sim", F.lit(0.0)), 6).alias("average_similarity"),
        cost_per_search(n, summaries_enabled).alias("estimated_cost"))


# Token budget of the cost estimate.
INDIVIDUAL_SUMMARY_MAX_TOKENS = 150
BATCH_SUMMARY_MAX_TOKENS = 300
PROMPT_TOKENS = 200
BATCH_PROMPT_TOKENS = 500
USD_PER_1K_TOKENS = 0.002


def cost_per_search(n_results, summaries_enabled: bool = True) -> F.Column:
    """Estimated USD: min(n,5) x (150+200) + 300 + 500 tokens at $0.002/1k."""
    if not summaries_enabled:
        return F.lit(0.0)
    tokens = (F.least(n_results, F.lit(MAX_SUMMARIES_PER_SEARCH))
              * (INDIVIDUAL_SUMMARY_MAX_TOKENS + PROMPT_TOKENS)
              + BATCH_SUMMARY_MAX_TOKENS + BATCH_PROMPT_TOKENS)
    return F.round(tokens / 1000.0 * USD_PER_1K_TOKENS, 8)


def search_overview(queries: DataFrame, papers: DataFrame | None, asof: dt.date, opts: SearchOptions = SearchOptions(),
                    corpus: Corpus | None = None) -> DataFrame:
    """One row per query, also without hits: result ids in order, totals, mean
    score, cost, the rule-based overview and whether rerank was used."""
    from papyra.operators.results import batch_digest, digest_rows
    res = materialize(digest_rows(search(queries, papers, opts, corpus=corpus), "document_id"), "results")
    ids = res.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))),
                                                  lambda x: x["document_id"]).alias("results"))
    return queries.select("query_id", "query").join(ids, "query_id", "left") \
        .join(envelope(queries, res, opts.generate_summaries), "query_id") \
        .join(batch_digest(queries, res, asof), "query_id") \
        .select("query_id", "query", F.coalesce("results", F.array().cast("array<string>")).alias("results"),
                F.col("digest").alias("overview"), "total_results", "downloadable_pdfs", "ai_summaries_count",
                "estimated_cost", "average_similarity", F.lit(opts.use_reranking).alias("used_reranking"))


def compare_methods(queries: DataFrame, papers: DataFrame, top_k: int = 5,
                    base: SearchOptions = SearchOptions(), corpus: Corpus | None = None) -> DataFrame:
    """Plain, expanded, expanded + rerank runs tagged with ``method``. The corpus
    is scanned once: plain and expanded query vectors are two queries of one
    retrieval, and the runs differ in what they do with its hits."""
    if corpus is None:
        corpus = prepare_corpus(papers)
    runs = [("basic", replace(base, top_k=top_k, use_reranking=False, use_query_expansion=False)),
            ("expanded", replace(base, top_k=top_k, use_reranking=False, use_query_expansion=True)),
            ("expanded_rerank", replace(base, top_k=top_k, use_reranking=True, use_query_expansion=True))]
    both = None
    for expand in (False, True):
        qv = query_vectors(queries, expand).select(F.struct(F.lit(expand).alias("e"), F.col("query_id").alias("q"))
                                                   .alias("s"), "qvec").select(F.to_json("s").alias("query_id"), "qvec")
        both = qv if both is None else both.unionByName(qv)
    pool = max(o.pool for _, o in runs)
    keyed = F.from_json("query_id", _key_schema(queries))
    hits = materialize(retrieve(both, corpus, pool).withColumn("s", keyed).select(
        F.col("s.e").alias("expanded"), F.col("s.q").alias("query_id"), "doc_id", "cosine", "rank"), "hits")
    wide, out = hit_papers(corpus, hits.select("doc_id").distinct(), base), None        # written once for all runs
    for name, o in runs:
        mine = hits.where((F.col("expanded") == F.lit(o.use_query_expansion)) & (F.col("rank") <= o.pool)).drop("expanded")
        r = search(queries, papers, o, corpus=corpus, hits=mine, wide=wide).withColumn("method", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


def _key_schema(queries: DataFrame) -> str:
    return f"e boolean, q {queries.schema['query_id'].dataType.simpleString()}"
