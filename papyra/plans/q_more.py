"""Queries of the file formats, exports, index life cycle and plug-in points:
written or built from the driver tables, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import encode as E
from papyra.functions import plugins as PL
from papyra.functions import vectors as V
from papyra.operators import analytics as AN
from papyra.operators import index as IX
from papyra.operators import knn as K
from papyra.operators import papers as P
from papyra.plans import adapters as A
from papyra.plans import sqltext as S
from papyra.plans.catalog import register
from papyra.plans.q_io import scratch
from papyra.plans.q_ingest import papers
from papyra.plans.q_vectors import K_NN, VEC, _rank_sql
from papyra.session import materialize
from papyra.sources import arrays as JA
from papyra.sources import digests as DG
from papyra.sources import files as FS
from papyra.streaming import incremental as INC

WP = S.with_papers()
RAW = f"WITH {S.raw_cte()} "
ROWS_PER_ARRAY = 200


def jsonl_folder(spark, sf_dir):
    path = scratch(spark, "raw-jsonl")
    FS.save_json_lines(A.raw_papers(spark, sf_dir), path)
    return path


# ---- sources and sinks ------------------------------------------------------

@register("mixed_format_scan", RAW + "SELECT id, title, update_date, authors FROM raw")
def mixed_format_scan(spark, sf_dir):
    """One folder of JSON-lines files and JSON-array files, formats found per
    file: papers with an odd id as lines, the others in arrays."""
    path = scratch(spark, "raw-mixed")
    raw = A.raw_papers(spark, sf_dir)
    FS.save_json_lines(raw.where("doc_id % 2 = 1"), f"{path}/lines")
    write_arrays(raw.where("doc_id % 2 = 0"), f"{path}/arrays")
    back = FS.read_raw(spark, path)
    return FS.good_records(back).select("id", "title", "update_date", "authors")


def write_arrays(raw, path):
    """JSON-array files of about ``ROWS_PER_ARRAY`` records each."""
    groups = raw.count() // ROWS_PER_ARRAY + 1
    arrays = raw.withColumn("_g", F.pmod(F.xxhash64("doc_id"), F.lit(groups))).groupBy("_g").agg(
        F.to_json(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in raw.columns]))).alias("value"))
    arrays.repartition(groups, "_g").write.partitionBy("_g").text(path)


@register("array_ranges", RAW + "SELECT id, title, update_date, authors, TRUE AS several_ranges_a_file FROM raw")
def array_ranges(spark, sf_dir):
    """JSON-array files read in ranges of 64 KB by several tasks each."""
    path = scratch(spark, "raw-arrays")
    write_arrays(A.raw_papers(spark, sf_dir), path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("65536", "1024")):
            spark.conf.set(n, v)
        files = FS.list_files(spark, path)
        back = materialize(FS.good_records(JA.read_arrays(spark, files)), "array-rows")
        ranges = JA.segments(spark, files).select("file", "at").distinct().count()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    return back.select("id", "title", "update_date", "authors", F.lit(ranges > 2 * len(files)).alias("several_ranges_a_file"))


@register("bounded_load", RAW + "SELECT id, title FROM raw ORDER BY id LIMIT 200")
def bounded_load(spark, sf_dir):
    """The first 200 records by id (the limit is the feature)."""
    return FS.load_json_lines(spark, jsonl_folder(spark, sf_dir), max_lines=200).select("id", "title")


@register("exploratory_scan", RAW + """SELECT id, CAST(length(title) AS INTEGER) AS title_chars, CAST(length(abstract) AS INTEGER) AS abstract_chars,
  CAST(3 AS INTEGER) AS n_categories FROM raw ORDER BY id LIMIT 20""")
def exploratory_scan(spark, sf_dir):
    """First records with their sizes (the limit is the feature)."""
    return FS.scan(spark, jsonl_folder(spark, sf_dir), 20)


EXPORT_SQL = WP + "SELECT id, title, array_to_string(authors, '|') AS authors, text_length FROM papers"


@register("json_export", EXPORT_SQL)
def json_export(spark, sf_dir):
    path = scratch(spark, "export-json")
    p = papers(spark, sf_dir).select("id", "title", "authors", "text_length")
    FS.export(p, path, "json")
    return spark.read.schema(p.schema).json(path).withColumn("authors", F.array_join("authors", "|"))


@register("csv_export", EXPORT_SQL)
def csv_export(spark, sf_dir):
    """Arrays as JSON text, one header row; read back with the same options."""
    path = scratch(spark, "export-csv")
    FS.export(papers(spark, sf_dir).select("id", "title", "authors", "text_length"), path, "csv")
    back = FS.read_csv(spark, path, "id string, title string, authors string, text_length int")
    return back.withColumn("authors", F.array_join(F.from_json("authors", "array<string>"), "|"))


@register("metrics_sink", WP + """SELECT count(*) AS total_papers, avg(text_length) AS avg_text_length,
  avg(word_count) AS avg_word_count FROM papers""")
def metrics_sink(spark, sf_dir):
    path = scratch(spark, "metrics")
    m = AN.corpus_stats(papers(spark, sf_dir))
    FS.save_metrics(m, path)
    return FS.load_metrics(spark, path, m.schema)


def source_files(spark, sf_dir):
    """One text file a source: its name, rows, characters and first id."""
    path = scratch(spark, "source-files")
    facts = A.table(spark, sf_dir, "documents").groupBy("source").agg(
        F.concat_ws(",", "source", F.count("*"), F.sum(F.length("text")), F.min("doc_id")).alias("value"))
    facts.write.partitionBy("source").text(path)
    return path


SOURCE_FILES = ("f AS (SELECT source, source || ',' || count(*) || ',' || CAST(sum(length(text)) AS BIGINT) || ',' "
                "|| min(doc_id) || chr(10) AS body FROM documents GROUP BY source)")


def file_source():
    return F.regexp_extract("path", "source=([^/]+)/", 1)


@register("file_digests", f"WITH {SOURCE_FILES} SELECT source, length(body) AS length, md5(body) AS digest FROM f")
def file_digests(spark, sf_dir):
    """md5 of every file of a folder (whole contents)."""
    d = FS.file_digests(spark, source_files(spark, sf_dir), "md5")
    return d.select(file_source().alias("source"), "length", "digest")


@register("range_digests", """WITH f AS (SELECT source, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS body
  FROM documents GROUP BY source)
SELECT source, strlen(body) AS length, length(body) - length(replace(body, chr(10), '')) AS lines,
  md5(body || CAST(strlen(body) AS VARCHAR)) AS quick_digest, TRUE AS same_in_any_ranges, TRUE AS several_ranges FROM f""")
def range_digests(spark, sf_dir):
    """A file a source, digested in ranges of 2 KB and again as Spark cuts it: one
    digest; the quick digest of files up to a MiB is that of their bytes and size."""
    path = scratch(spark, "source-texts")
    docs = A.table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value") \
        .write.partitionBy("source").text(path)
    files = FS.list_files(spark, path)
    whole = materialize(DG.file_digests(spark, files).select("path", F.col("digest").alias("_whole")), "digests")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("2048", "256")):
            spark.conf.set(n, v)
        found = materialize(DG.ranges(spark, files), "ranges")
        cut = materialize(DG.file_digests(spark, files, found=found), "digests")
        ranges = found.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    return cut.join(whole, "path").join(ranges, "path").select(
        file_source().alias("source"), "length", "lines", "quick_digest",
        (F.col("digest") == F.col("_whole")).alias("same_in_any_ranges"), (F.col("_n") > 1).alias("several_ranges"))


@register("source_manifest", "SELECT DISTINCT source FROM documents WHERE source IN ('src1', 'src2')")
def source_manifest(spark, sf_dir):
    """Files to reprocess: the stored manifest was taken before src1 changed
    and with another sample size for src2."""
    cur = FS.manifest(spark, source_files(spark, sf_dir))
    stored = cur.withColumn("digest", F.when(file_source() == "src1", F.lit("old")).otherwise(F.col("digest"))) \
        .withColumn("sample_size", F.when(file_source() == "src2", F.lit(10).cast("long")))
    return FS.changed_files(cur, stored).select(file_source().alias("source"))


# ---- index life cycle -------------------------------------------------------

HYBRID_SQL = S.with_papers(extra=S.encode_cte("et", "papers", "doc_id", "title") + ",\n"
                           + S.encode_cte("ea", "papers", "doc_id", "abstract")) + f"""
SELECT * FROM (SELECT doc_id, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS bucket, round(unnest(vec), 6) AS weight
  FROM (SELECT t.doc_id, {S.blend('t.vec', 'a.vec', E.TITLE_WEIGHT, E.ABSTRACT_WEIGHT)} AS vec
        FROM et t JOIN ea a ON a.doc_id = t.doc_id)) WHERE weight <> 0"""


def long_form(df, key):
    out = df.select(key, F.posexplode("vec").alias("bucket", "weight")).withColumn("weight", V.round_score("weight"))
    return out.where("weight <> 0")


@register("hybrid_encode", HYBRID_SQL)
def hybrid_encode(spark, sf_dir):
    """Title and abstract encoded apart, blended 0.4 / 0.6; nonzero buckets."""
    p = papers(spark, sf_dir)
    enc = INC.encode_papers(p, hybrid=True)
    return long_form(enc.join(p.select("id", "doc_id"), "id"), "doc_id")


@register("index_build_stats", WP + """SELECT 'hash256' AS model, count(DISTINCT id) AS total_vectors,
  CAST(256 AS INTEGER) AS dimension, CAST(1 AS BIGINT) AS n_clusters, TRUE AS built, FALSE AS built_again, TRUE AS rebuilt
FROM papers""")
def index_build_stats(spark, sf_dir):
    """First build, a second one that does nothing, a forced rebuild."""
    path = scratch(spark, "index-build")
    p = papers(spark, sf_dir)
    done = [INC.build_index(p, path), INC.build_index(p, path), INC.build_index(p, path, force=True)]
    stats = IX.index_stats(INC.read_index(spark, path))
    return stats.select("*", *[F.lit(x).alias(n) for x, n in zip(done, ("built", "built_again", "rebuilt"))])


def two_arrivals(spark, sf_dir, hybrid=False):
    """Papers dated before 2024 first, then the whole set."""
    base = scratch(spark, "stream")
    src, index, stats = f"{base}/incoming", f"{base}/index", f"{base}/stats"
    raw = A.raw_papers(spark, sf_dir).drop("doc_id")
    for name, part in (("a", raw.where(F.col("update_date") < "2024")), ("b", raw)):
        part.write.mode("append").json(f"{src}/{name}")
        INC.start_index_stream(spark, f"{src}/{name}", index, f"{base}/ck-{name}", stats, language=None, hybrid=hybrid,
                               stream=name, max_files_per_trigger=1_000_000).awaitTermination()
    return index, stats


@register("stream_index_update", f"WITH {S.raw_cte()}, {S.flagged_cte()}, " + """
p AS (SELECT DISTINCT id, update_date < '2024' AS early FROM flagged WHERE reject_reason IS NULL),
n AS (SELECT count(*) FILTER (early) AS n1, count(*) AS n2 FROM p)
SELECT 'a' AS stream, CAST(0 AS BIGINT) AS existing, n1 AS added, CAST(0 AS BIGINT) AS duplicates, n1 AS total_after FROM n
UNION ALL SELECT 'b', n1, n2 - n1, n1, n2 FROM n""")
def stream_index_update(spark, sf_dir):
    """Structured Streaming ingest of raw papers in two arrivals: existing /
    added / duplicates / total of each."""
    _, stats = two_arrivals(spark, sf_dir)
    return spark.read.parquet(stats).select("stream", "existing", "added", "duplicates", "total_after")


@register("index_update_final", S.with_papers(extra=S.encode_cte("enc", "papers", "id", "combined_text")) + """
SELECT * FROM (SELECT id, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS bucket,
  round(unnest(vec), 6) AS weight FROM enc) WHERE weight <> 0""")
def index_update_final(spark, sf_dir):
    """Ids and vectors of the index after both arrivals."""
    index, _ = two_arrivals(spark, sf_dir)
    return long_form(INC.current_index(spark, index), "id")


@register("index_replay", WP + """SELECT count(DISTINCT id) AS vectors, count(DISTINCT id) AS keys,
  count(DISTINCT id) AS first_keys, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS existing, count(DISTINCT id) AS added,
  CAST(0 AS BIGINT) AS duplicates FROM papers""")
def index_replay(spark, sf_dir):
    """Every paper twice, with different texts under one id, added as one batch and
    then again in another row order: one vector and one key an id, the same texts and
    counters."""
    base = scratch(spark, "index-replay")
    p = papers(spark, sf_dir)
    batch = p.unionByName(p.withColumn("combined_text", F.concat(F.lit("again "), "combined_text")))
    INC.add_batch(batch.repartition(7, "title"), f"{base}/index", stats_path=f"{base}/stats", batch_id=1)
    once = materialize(INC.read_index(spark, f"{base}/index").select("id", "text_md5"), "once")
    INC.add_batch(batch.repartitionByRange(5, F.desc("abstract")), f"{base}/index", stats_path=f"{base}/stats", batch_id=1)
    now = INC.read_index(spark, f"{base}/index").select("id", "text_md5")
    keys = INC.key_table(spark, f"{base}/index").all()
    count = F.count(F.lit(1)).alias("n")
    return spark.read.parquet(f"{base}/stats").select(
        now.agg(count).scalar().alias("vectors"), keys.agg(count).scalar().alias("keys"),
        keys.where("first").agg(count).scalar().alias("first_keys"),
        now.exceptAll(once).agg(count).scalar().alias("changed"), "existing", "added", "duplicates")


LIFE_K = 5


@register("index_clustered_life", S.with_papers(extra=S.encode_cte("enc", "papers", "id", "combined_text")) + f"""
SELECT query_id, id, score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, id) AS rn FROM (SELECT q.id AS query_id, d.id, round({S.cosine('q.vec', 'd.vec')}, 6) AS score
  FROM (SELECT * FROM enc WHERE right(id, 1) = '0') q CROSS JOIN enc d)) WHERE rn <= {LIFE_K}""")
def index_clustered_life(spark, sf_dir):
    """Trained clusters over the early papers, the others added by a stream, the index
    compacted, then searched with all clusters probed: the exact neighbours."""
    base = scratch(spark, "index-life")
    raw = A.raw_papers(spark, sf_dir).drop("doc_id")
    early = P.build_papers(raw.where(F.col("update_date") < "2024"), language=None)
    INC.build_index(early, f"{base}/index", clustered=True, n_clusters=12)
    raw.write.json(f"{base}/incoming")
    INC.start_index_stream(spark, f"{base}/incoming", f"{base}/index", f"{base}/ck", language=None,
                           max_files_per_trigger=1_000_000).awaitTermination()
    INC.compact_index(spark, f"{base}/index", f"{base}/compact")
    vectors, centroids = IX.read_index(spark, f"{base}/compact")
    q = vectors.where(F.col("id").endswith("0")).select(F.col("id").alias("query_id"), "vec")
    return K.clustered_knn(vectors.select("id", "vec", "cluster_id"), centroids, q, LIFE_K, 12)


@register("reuse_check", WP + """SELECT doc_id FROM papers p
WHERE NOT (doc_id IN (SELECT doc_id FROM labels) AND doc_id % 2 = 1 AND doc_id % 5 <> 0)""")
def reuse_check(spark, sf_dir):
    """Papers to encode: no stored vector under (id, model, hybrid, text hash).
    Stored: papers in ``labels``, those with an even id under an older text and
    every fifth by another model."""
    p = papers(spark, sf_dir)
    old = p.join(A.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    stored = old.select("id", F.when(F.col("doc_id") % 5 == 0, "other").otherwise("hash256").alias("model"),
                        F.lit(True).alias("hybrid"),
                        F.md5(F.when(F.col("doc_id") % 2 == 0, F.concat("combined_text", F.lit("#")))
                              .otherwise(F.col("combined_text"))).alias("text_md5"))
    return IX.needs_encoding(p, stored, "hash256", True).select("doc_id")


@register("index_timestamps", """SELECT 'm64' AS model, count(*) AS total_vectors, CAST(64 AS INTEGER) AS dimension,
  count(DISTINCT label) AS n_clusters, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(min(vec_id % 100) AS INTEGER)) AS created_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(max(vec_id % 100) AS INTEGER)) AS last_updated FROM embeddings""")
def index_timestamps(spark, sf_dir):
    v = A.vectors(spark, sf_dir).withColumnRenamed("label", "cluster_id").withColumn(
        "added_at", F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(F.col("id") % 100).cast("int")))
    return IX.index_stats(v, ts_col="added_at")


@register("ivf_all_probes", f"""WITH {VEC},
s AS (SELECT q.id AS query_id, d.id AS id, round({S.cosine('q.vec', 'd.vec')}, 6) AS score FROM v q CROSS JOIN v d)
{_rank_sql('s', K_NN)}""")
def ivf_all_probes(spark, sf_dir):
    """Clustered index trained by k-means, every cluster probed: the exact result."""
    v = A.vectors(spark, sf_dir)
    assigned, cen = K.kmeans_index(v)
    return K.clustered_knn(assigned, cen, v.withColumnRenamed("id", "query_id"), K_NN, cen.count())


# ---- extension points -------------------------------------------------------

def _letters():
    import numpy as np
    return lambda texts: np.array([[t.count("a"), t.count("e"), len(t)] for t in texts], float)


def _length_ratio():
    import numpy as np
    return lambda qs, ts: np.array([min(len(q), len(t)) / max(len(q), len(t), 1) for q, t in zip(qs, ts)])


def _titles():
    return lambda titles, abstracts: [t[:20] if len(a) % 3 else None for t, a in zip(titles, abstracts)]


@register("plugin_encoder", WP.rstrip() + f""", v AS (SELECT doc_id, {S.normalize('''[CAST(length(title) - length(replace(title, 'a', '')) AS DOUBLE),
  CAST(length(title) - length(replace(title, 'e', '')) AS DOUBLE), CAST(length(title) AS DOUBLE)]''')} AS vec FROM papers)
SELECT doc_id, round(vec[1], 6) AS a, round(vec[2], 6) AS e, round(vec[3], 6) AS n FROM v""")
def plugin_encoder(spark, sf_dir):
    """A model encoder through the plug-in slot (letter counts of the title)."""
    enc = PL.encoder(_letters, "letters")(papers(spark, sf_dir).select("doc_id", "title"), "title")
    return enc.select("doc_id", *[V.round_score(F.col("vec")[i]).alias(c) for i, c in enumerate("aen")])


@register("plugin_scorer", WP + """SELECT doc_id, round(least(length(title), length(abstract)) /
  greatest(length(title), length(abstract), 1), 6) AS score FROM papers""")
def plugin_scorer(spark, sf_dir):
    """A pair scorer through the plug-in slot (length ratio of title and abstract)."""
    score = PL.pair_scorer(_length_ratio, "length-ratio")
    return papers(spark, sf_dir).select("doc_id", score(F.col("title"), F.col("abstract")).alias("score"))


@register("plugin_summarizer", WP + f"""SELECT doc_id, CASE WHEN length(abstract) % 3 <> 0 AND left(title, 20) <> ''
  THEN left(title, 20) ELSE {S.rule_summary('abstract')} END AS summary FROM papers""")
def plugin_summarizer(spark, sf_dir):
    """A summariser through the plug-in slot; where it fails, the rule summary."""
    return PL.summarizer(_titles, "titles")(papers(spark, sf_dir).select("doc_id", "title", "abstract")) \
        .select("doc_id", "summary")


@register("describe_text", WP.rstrip() + """, c AS (SELECT 'title' AS "column", title AS v, count(*) AS n FROM papers GROUP BY title
  UNION ALL SELECT 'lang', array_to_string(categories, ' '), count(*) FROM papers GROUP BY 2),
t AS (SELECT "column", CAST(sum(n) AS BIGINT) AS "count", count(*) AS "unique", max(n) AS freq FROM c GROUP BY ALL),
m AS (SELECT "column", v AS top FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS r FROM c) WHERE r = 1)
SELECT "column", 'count' AS stat, CAST("count" AS VARCHAR) AS value FROM t
UNION ALL SELECT "column", 'unique', CAST("unique" AS VARCHAR) FROM t
UNION ALL SELECT "column", 'top', top FROM m
UNION ALL SELECT "column", 'freq', CAST(freq AS VARCHAR) FROM t""")
def describe_text(spark, sf_dir):
    """count, unique, top and freq of text columns."""
    p = papers(spark, sf_dir).withColumn("lang", F.array_join("categories", " "))
    return AN.describe_text(p, ["title", "lang"])

