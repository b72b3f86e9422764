"""Vector search, contexts, prompts, text indexes.

The vectors of `embeddings` stand in for an encoder's output: a text takes the vector with its number, and numbers
beyond the last vector start again, so every row of `documents` (complaint index) and `pages` (guideline index) has one.
Queries are the mean vectors per label.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from catalog.base import Tables, day, int4, num, nums, query, whole
from catalog.exploring import SIMS
from catalog.scalars import CHUNKS_SQL, score_col
from catalog.standins import COMPLAINTS, MASTER_SQL, PANEL_SQL, complaints, master, panel
from placewise import settings
from placewise.operators import inverted as I
from placewise.operators import semantic
from placewise.operators import texts as X
from placewise.operators import upsert as U
from placewise.operators import vectors as V
from placewise.operators.clean import available
from placewise.operators.explore import location_stats
from placewise.session import scratch_path
from placewise.sources import readers
from placewise.plans import answer as A
from placewise.plans import reports as R
from placewise.functions.columns import stringify_metadata


# SQL compares rounded distances, so that equal vectors tie on both sides.
DIGITS = 9
search = partial(V.vector_search, digits=DIGITS)


def asked(t: Tables):
    """One query vector per label."""
    return V.mean_vectors(t.embeddings, "label").withColumnRenamed("label", "query_id")


def texts(t: Tables):
    return t.documents


def vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("zip_code"))


def complaint_hits(t: Tables, k: int = 5, **options):
    return search(complaint_index(t), asked(t), k, **options)


def with_vector(t: Tables, rows):
    """Each row of (id, ...) with the vector of its number."""
    number = F.pmod("id", t.embeddings.agg(F.count("*")).scalar())
    return rows.withColumn("vec", number).join(vectors(t).withColumnRenamed("id", "vec"), "vec").drop("vec")


def complaint_index(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text", "lang")
    return with_vector(t, docs).select(
        "id", "text", "embedding", stringify_metadata(["zip_code", "lang"]).alias("metadata"), "zip_code", "lang"
    )


def guideline_index(t: Tables):
    return with_vector(t, t.pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"))).select("id", "text", "embedding")


# distances are rounded before ranking, on both sides
def hits_sql(name: str, k: int, source: str = "", where: str = "TRUE") -> str:
    number = "x.id" if source else "s.vec_id"
    return f"""{name} AS (SELECT * FROM (SELECT c AS query_id, {number} AS id, round(1 - s, 9) AS distance, s.label, {'x.* EXCLUDE (id, vec),' if source else ''}
    row_number() OVER (PARTITION BY c ORDER BY round(1 - s, 9), {number}) AS rank FROM sims s {source} WHERE {where}) WHERE rank <= {k})"""


_DOCS = "JOIN (SELECT doc_id AS id, doc_id % (SELECT count(*) FROM embeddings) AS vec, text, lang FROM documents) x ON x.vec = s.vec_id"
_PAGES = "JOIN (SELECT page_id AS id, page_id % (SELECT count(*) FROM embeddings) AS vec, html AS text FROM pages) x ON x.vec = s.vec_id"


@query("vector_search", f"WITH {SIMS}, {hits_sql('h', 5)} SELECT query_id, id, {num('distance')}, {int4('rank')} FROM h")
def vector_search(t: Tables):
    return search(vectors(t), asked(t))


@query("rank_topk", f"WITH {SIMS}, {hits_sql('h', 3)} SELECT query_id, id, {int4('rank')} FROM h")
def rank_topk(t: Tables):
    scored, classes = V.class_scores(t.embeddings)
    pairs = scored.select(F.col("vec_id").alias("id"), F.posexplode("scores").alias("query_id", "s"))
    return V.rank_topk(pairs.withColumn("distance", F.round(1 - F.col("s"), 9)), 3).select("query_id", "id", "rank")


@query("vector_search_filtered", f"WITH {SIMS}, {hits_sql('h', 5, _DOCS, chr(39) + 'en' + chr(39) + ' = x.lang')} SELECT query_id, id, {num('distance')}, {int4('rank')} FROM h")
def vector_search_filtered(t: Tables):
    return complaint_hits(t, where=X.metadata_equals(lang="en"))


@query("vector_search_location", f"WITH {SIMS}, {hits_sql('h', 5, where='s.label = c')} SELECT query_id, id, {num('distance')}, {int4('rank')} FROM h")
def vector_search_location(t: Tables):
    queries = asked(t).withColumn("place", F.col("query_id").cast("string"))
    return search(vectors(t), queries, match=("zip_code", "place"))


@query("vector_search_text", f"WITH {SIMS}, {hits_sql('h', 5, _DOCS, 'contains(x.text, ' + chr(39) + 'tion' + chr(39) + ')')} SELECT query_id, id, {num('distance')}, {int4('rank')} FROM h")
def vector_search_text(t: Tables):
    return complaint_hits(t, where=X.document_contains("tion"))


@query("vector_search_threshold", f"WITH {SIMS}, {hits_sql('h', 5)} SELECT query_id, id, {num('distance')}, {int4('rank')} FROM h WHERE distance <= 0.3")
def vector_search_threshold(t: Tables):
    return search(vectors(t), asked(t), max_distance=0.3)


# every twentieth row against all rows
_TWENTIETHS = """sims20 AS (SELECT q.vec_id AS query_id, x.vec_id AS id, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])), 9) AS distance
    FROM embeddings q JOIN embeddings x ON q.vec_id % 20 = 0),
  hits20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM sims20) WHERE rank <= 5)"""
_HITS20 = f"WITH {_TWENTIETHS} SELECT query_id, id, {num('distance')}, {int4('rank')} FROM hits20"


def inverted_file(t: Tables) -> I.InvertedFile:
    """As many lists as the square root of the rows."""
    return I.build(vectors(t), max(1, int(t.embeddings.count() ** 0.5)))


def twentieths(t: Tables, rest: int = 0):
    return t.embeddings.where(F.col("vec_id") % 20 == rest).select(F.col("vec_id").alias("query_id"), "embedding")


@query("vector_search_approx")
def vector_search_approx(t: Tables):
    file = inverted_file(t)
    return I.search(file, twentieths(t), probes=enough_lists(t, file), digits=DIGITS)


def enough_lists(t: Tables, file: I.InvertedFile) -> int:
    """Lists that hold 95 % of the neighbours of other rows than those that are asked for."""
    return I.probes_for(file, twentieths(t, 7), 0.95)


@query("vector_search_all_lists", _HITS20)
def vector_search_all_lists(t: Tables):
    file = inverted_file(t)
    return I.search(file, twentieths(t), probes=len(file.centres), digits=DIGITS)


@query("vector_search_recall", f"WITH {_TWENTIETHS} SELECT count(DISTINCT query_id) AS queries, 1 AS enough FROM hits20")
def vector_search_recall(t: Tables):
    """Whether the approximate search finds nine tenths of the exact neighbours."""
    file, queries = inverted_file(t), twentieths(t)
    found = I.recall(I.search(file, queries, probes=enough_lists(t, file), digits=DIGITS), search(vectors(t), queries))
    return found.select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("vector_search_skipping", _HITS20)
def vector_search_skipping(t: Tables):
    """Exact search that leaves out the parts of the index that cannot hold a neighbour."""
    return I.exact_search(inverted_file(t), twentieths(t), digits=DIGITS).drop("parts_read")


@query("join_query_docs", f"WITH {SIMS}, {hits_sql('h', 5, _DOCS)} SELECT query_id, id, lang, text, {num('1 - distance', 'similarity')} FROM h")
def join_query_docs(t: Tables):
    index = complaint_index(t)
    hits = V.attach(search(index, asked(t)), index, ["lang", "text"])
    return hits.select("query_id", "id", "lang", "text", (1 - F.col("distance")).alias("similarity"))


@query("similarity_score", f"WITH {SIMS}, {hits_sql('h', 5)} SELECT query_id, id, {num('1 - distance', 'similarity')} FROM h")
def similarity_score(t: Tables):
    return search(vectors(t), asked(t)).select("query_id", "id", (1 - F.col("distance")).alias("similarity"))


@query("cosine_matrix", f"""WITH {SIMS} SELECT a.c AS id_a, b.c AS id_b, {num('sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m)))', 'similarity')}
  FROM centres a JOIN centres b USING (d) GROUP BY 1, 2""")
def cosine_matrix(t: Tables):
    return V.cosine_matrix(asked(t), "query_id")


_PLACE = f"""near AS (SELECT x.id, CAST(s.label AS VARCHAR) AS place, x.text, round(1 - s.s, 9) AS distance, row_number() OVER (PARTITION BY s.label ORDER BY round(1 - s.s, 9), x.id) AS rank
  FROM sims s {_DOCS} WHERE c = (SELECT min(c) FROM centres))"""


@query("retrieval_summary", f"""WITH {SIMS}, {_PLACE}, n AS (SELECT * FROM near)
  SELECT place, count(*) AS total_complaints, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) FILTER (rank <= 5) AS recent, string_agg(text, '|' ORDER BY rank) FILTER (rank <= 10) AS issues FROM n GROUP BY 1""")
def retrieval_summary(t: Tables):
    # the first label's mean vector stands in for the generic location query
    generic = asked(t).orderBy("query_id").first()["embedding"]
    near = F.round(1 - V.similarities(F.col("embedding"), [generic])[0], DIGITS)
    out = X.retrieval_summary(complaint_index(t), near, F.col("zip_code"))
    return out.select(
        "place", "total_complaints", F.array_join(F.col("recent_complaints")["id"].cast("array<string>"), ",").alias("recent"),
        F.array_join("sample_issues", "|").alias("issues"),
    )


def ranked(t: Tables, k: int = 5, g: int = 3):
    """Complaint and guideline hits with their payload."""
    c, p = complaint_index(t), guideline_index(t)
    queries = asked(t)
    return (
        V.attach(search(c, queries, k), c, ["text", "metadata"]),
        V.attach(search(p, queries, g), p, ["text"]),
    )


_CONTEXT = f"""{SIMS}, {hits_sql('hc', 5, _DOCS)}, {hits_sql('hg', 3, _PAGES)},
  lc AS (SELECT query_id, string_agg(CAST(rank AS VARCHAR) || '. ' || text || ' (Location: ' || CAST(label AS VARCHAR) || ', Date: N/A)' || chr(10), '' ORDER BY rank) AS a FROM hc GROUP BY 1),
  lg AS (SELECT query_id, string_agg(text || chr(10) || chr(10), '' ORDER BY rank) AS b FROM hg GROUP BY 1),
  context AS (SELECT lc.query_id, '## Relevant Historical Complaints' || chr(10) || a || chr(10) || '## Relevant Health Guidelines' || chr(10) || b AS context FROM lc JOIN lg ON lc.query_id = lg.query_id)"""


@query("context_string", f"WITH {_CONTEXT} SELECT query_id, context FROM context")
def context_string(t: Tables):
    return X.context_string(*ranked(t))


@query("answer_sources", f"""WITH {SIMS}, {hits_sql('hc', 3, _DOCS)}, {hits_sql('hg', 2, _PAGES)}
  SELECT query_id, {int4('rank', 'place')}, 'complaint' AS kind, id, text FROM hc UNION ALL SELECT query_id, CAST(rank + 3 AS INTEGER), 'guideline', id, text FROM hg""")
def answer_sources(t: Tables):
    return X.answer_sources(*ranked(t)).select("query_id", "place", "kind", "id", "text")


@query("union_sources", f"WITH {SIMS}, {hits_sql('hc', 3, _DOCS)}, {hits_sql('hg', 2, _PAGES)} SELECT query_id, id, {num('distance')} FROM hc UNION ALL SELECT query_id, id, {num('distance')} FROM hg")
def union_sources(t: Tables):
    return X.answer_sources(*ranked(t)).select("query_id", "id", "distance")


def judged(t: Tables):
    """Hits of the label's mean vector; a hit is relevant when it carries the label."""
    hits = search(vectors(t), asked(t))
    return V.attach(hits, vectors(t), ["zip_code"]).withColumn("is_relevant", F.col("zip_code") == F.col("query_id").cast("string"))


@query("precision_at_k", f"WITH {SIMS}, {hits_sql('h', 5)} SELECT query_id, {num('sum(CASE WHEN label = query_id THEN 1 ELSE 0 END) / 5', 'precision')} FROM h GROUP BY 1")
def precision_at_k(t: Tables):
    return X.precision_at_k(judged(t))


@query("mean_precision", f"WITH {SIMS}, {hits_sql('h', 5)} SELECT {num('avg(p)', 'mean_precision')} FROM (SELECT sum(CASE WHEN label = query_id THEN 1 ELSE 0 END) / 5 AS p FROM h GROUP BY query_id)")
def mean_precision(t: Tables):
    return X.precision_at_k(judged(t)).agg(F.avg("precision").alias("mean_precision"))


@query("precision_by_text", f"""WITH {SIMS}, {hits_sql('h', 5, _DOCS)} SELECT query_id, {num('sum(CASE WHEN contains(text, q.r) OR contains(text, q.e) THEN 1 ELSE 0 END) / 5', 'precision')}
  FROM h JOIN (SELECT n_nationkey, substr(r_name, 1, 2) AS r, 'tion' AS e FROM nation JOIN region ON n_regionkey = r_regionkey) q ON h.query_id = q.n_nationkey GROUP BY 1""")
def precision_by_text(t: Tables):
    hits, _ = ranked(t)
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    relevance = named.select(F.col("n_nationkey").alias("query_id"), F.array(F.substring("r_name", 1, 2), F.lit("tion")).alias("relevant"))
    return X.precision_at_k(X.judge_by_text(hits, relevance))


@query("recall_at_k", f"WITH {SIMS}, {hits_sql('h', 5)} SELECT query_id, {num('sum(CASE WHEN h.label = query_id THEN 1 ELSE 0 END) / max(n)', 'recall')} FROM h JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) k ON k.label = query_id GROUP BY 1")
def recall_at_k(t: Tables):
    totals = t.embeddings.groupBy(F.col("label").alias("query_id")).agg(F.count("*").alias("relevant_rows"))
    return X.recall_at_k(judged(t), totals)


@query("mrr", f"WITH {SIMS}, {hits_sql('h', 5)} SELECT {num('avg(coalesce(1.0 / r, 0))', 'mrr')} FROM (SELECT min(CASE WHEN label = query_id THEN rank END) AS r FROM h GROUP BY query_id)")
def mrr(t: Tables):
    return X.mean_reciprocal_rank(judged(t))


def text_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query("question_prompt", f"""WITH {_CONTEXT} SELECT n_nationkey, {text_sql(chr(10) + settings.QUESTION_OPENING + chr(10) * 2 + 'Question: ')} || n_name || {text_sql(chr(10) * 2 + 'Location context: ')} || CAST(query_id AS VARCHAR)
  || {text_sql(chr(10) * 2 + settings.QUESTION_CONTEXT + chr(10))} || context || {text_sql(chr(10) * 2 + settings.QUESTION_CLOSING + chr(10))} AS prompt
  FROM nation JOIN context c ON n_nationkey % 10 = c.query_id""")
def question_prompt(t: Tables):
    # nations stand in for the questions; the ten labels' contexts serve them in turn
    rows = t.nation.join(X.context_string(*ranked(t)), F.pmod("n_nationkey", F.lit(10)) == F.col("query_id"))
    return rows.select("n_nationkey", R.question_prompt(F.col("n_name"), F.col("context"), F.col("query_id").cast("string")).alias("prompt"))


@query("summary_prompt", f"""SELECT c_custkey, {text_sql(chr(10) + settings.SUMMARY_OPENING + chr(10) + '- Risk level: ')} || CASE WHEN s < 4 THEN 'low' WHEN s < 7 THEN 'moderate' ELSE 'high' END || ' (' || printf('%.1f', s)
  || {text_sql('/10)' + chr(10) + '- Key factors: ')} || c_mktsegment || ', ' || n_name || ', ' || r_name || {text_sql(chr(10) * 2 + settings.SUMMARY_CLOSING + chr(10))} AS prompt
  FROM (SELECT *, (c_acctbal + 1000) / 1100 AS s FROM customer) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def summary_prompt(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    factors = F.array("c_mktsegment", "n_name", "r_name", "c_name")
    return rows.select("c_custkey", R.summary_prompt(score_col(), factors).alias("prompt"))


@query("report_prompt", f"""{PANEL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY zip_code ORDER BY date DESC) AS rn FROM dense),
  s AS (SELECT zip_code, max(borough) AS borough, CAST(sum(complaint_count) AS BIGINT) AS total, CAST(sum(complaint_count) FILTER (rn <= 6) AS BIGINT) AS recent FROM r GROUP BY 1)
  SELECT zip_code, {text_sql('Write a report on the rodent risk at this place. Use only the facts given here.' + chr(10) + '**Location:** ')} || zip_code || {text_sql(chr(10) + '**Overall Risk Score:** ')}
  || printf('%.1f', CAST(total / 60.0 AS DOUBLE)) || {text_sql('/10' + chr(10) * 2 + '## Historical Data' + chr(10) + '- Total complaints in area: ')} || total || {text_sql(chr(10) + '- Recent complaints (last 6 months): ')} || recent
  || {text_sql(chr(10) + '- Year-over-year trend: N/A' + chr(10) + '- Sample complaint descriptions:' + chr(10) + '  - ')} || borough || {text_sql(chr(10) + chr(10) + '## Forecast Data' + chr(10) + '- Predicted complaints (next month): ')} || recent
  || {text_sql(chr(10) + '- Predicted complaints (next 3 months): N/A' + chr(10) + '- Forecast confidence: N/A' + chr(10) + '- Trend direction: N/A' + chr(10))}
  || CASE WHEN borough = 'ASIA' THEN {text_sql(chr(10) + '## Image Analysis' + chr(10) + '- Detected evidence: rat' + chr(10) + '- Confidence: 87.5%' + chr(10) + '- **WARNING**: Rat evidence detected in uploaded image' + chr(10))} ELSE '' END
  || {text_sql(settings.REPORT_INSTRUCTIONS)} AS prompt FROM s""")
def report_prompt(t: Tables):
    places = location_stats(panel(t), labels=["borough"])
    image = F.when(F.col("borough") == "ASIA", "rat")
    prompt = R.report_prompt(
        F.col("zip_code"), F.col("total_complaints") / 60.0, F.col("total_complaints"), F.col("recent_complaints"),
        samples=F.array("borough"), next_month=F.col("recent_complaints"),
        image_class=image, image_confidence=F.lit(0.875), image_evidence=F.lit(True), context=F.lit(""),
    )
    return places.select("zip_code", prompt.alias("prompt"))


@query("full_report")
def full_report(t: Tables):
    """Assessment, yearly trend, outlook and retrieved context in one prompt per place."""
    places = t.nation.select(F.col("n_nationkey").cast("string").alias("zip_code"), F.pmod("n_nationkey", F.lit(10)).alias("query_id"))
    contexts = places.join(X.context_string(*ranked(t)), "query_id")
    return R.report_table(master(t), contexts, month=7).select("zip_code", "prompt")


@query("answer_questions")
def answer_questions(t: Tables):
    """Every benchmark text as a question to the orders' descriptors and the documents' chunks; every other one names a place."""
    rows = complaints(t, closed=False)
    docs = texts(t).select(F.col("doc_id").cast("string").alias("source"), "text")
    encoder = X.fit_text_embedding(docs)
    questions = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.when(F.pmod("item_id", F.lit(2)) == 1, F.pmod("item_id", F.lit(25)).cast("string")).alias("place"))
    indexes = {"complaints": X.build_complaint_index(rows, encoder, sparse=True), "guidelines": X.build_guideline_index(docs, encoder, separator="\n", sparse=True)}
    stored = {n: readers.read_through_cache(t.spark, scratch_path(t.spark, n), lambda d=d: d) for n, d in indexes.items()}
    out = A.answer_questions(questions, stored["complaints"], stored["guidelines"], encoder, place="place")
    return out.select("query_id", "prompt", F.size("sources").alias("sources"))


# ---- indexes over text


def _is_unit(embedding: str = "embedding"):
    """1 when the vector has length 1."""

    @F.arrow_udf(T.IntegerType())
    def run(v: pa.Array) -> pa.Array:
        if len(v) == 0:
            return pa.array([], pa.int32())
        rows = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        return pa.array((np.abs(np.linalg.norm(rows, axis=1) - 1) < 1e-3).astype(np.int32))

    return run(F.col(embedding))


@query("text_embed", "SELECT doc_id, CAST(384 AS INTEGER) AS dimension, CAST(1 AS INTEGER) AS unit FROM documents")
def text_embed(t: Tables):
    model = X.fit_text_embedding(texts(t))
    out = X.text_embed(texts(t).select("doc_id", "text"), model)
    return out.select("doc_id", F.size("embedding").alias("dimension"), _is_unit().alias("unit"))


@query("build_complaint_index", f"""WITH {COMPLAINTS} SELECT 'complaint_' || unique_key AS id, descriptor AS text, strftime(created_date, '%Y-%m-%d %H:%M:%S') AS created, borough, zip_code, status,
  CAST(384 AS INTEGER) AS dimension FROM complaints""")
def build_complaint_index(t: Tables):
    rows = complaints(t, closed=False)
    index = X.build_complaint_index(rows, X.fit_text_embedding(rows, "descriptor"))
    m = F.col("metadata")
    return index.select(
        "id", "text", m["created_date"].alias("created"), m["borough"].alias("borough"), m["zip_code"].alias("zip_code"), m["status"].alias("status"),
        F.size("embedding").alias("dimension"),
    )


@query("build_guideline_index", CHUNKS_SQL.replace("SELECT doc_id, CAST(unnest(range", "SELECT 'guideline_' || doc_id || '_' || chunk_index AS id, text, CAST(chunk_index AS VARCHAR) AS chunk_index, CAST(384 AS INTEGER) AS dimension FROM (SELECT doc_id, CAST(unnest(range") + ")")
def build_guideline_index(t: Tables):
    docs = texts(t).select(F.col("doc_id").cast("string").alias("source"), "text")
    index = X.build_guideline_index(docs, X.fit_text_embedding(docs), separator="\n")
    return index.select("id", "text", F.col("metadata")["chunk_index"].alias("chunk_index"), F.size("embedding").alias("dimension"))


@query("text_search")
def text_search(t: Tables):
    """Every benchmark text against all documents by text vectors."""
    docs = texts(t)
    model = X.fit_text_embedding(docs)
    index = X.text_embed(docs.select(F.col("doc_id").alias("id"), "text"), model)
    queries = X.text_embed(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), model)
    return V.vector_search(index, queries)


@query("index_upsert", f"""SELECT CAST(doc_id AS VARCHAR) AS id, md5(CASE WHEN doc_id % 20 = 3 THEN text || '!' ELSE text END) AS text_md5, lang, {settings.EMBEDDING_DIMENSION} AS dimension
  FROM documents WHERE doc_id % 20 <> 7""")
def index_upsert(t: Tables):
    """An index of all documents, brought up to a state in which a twentieth is changed and a twentieth is gone."""
    path, model = scratch_path(t.spark, "growing-index"), X.fit_text_embedding(t.documents)
    first = t.documents.select(F.col("doc_id").alias("id"), "text", "lang")
    embed = partial(X.text_embed, model=model)
    U.upsert(path, first, embed)
    later = first.where(F.col("id") % 20 != 7).withColumn("text", F.when(F.col("id") % 20 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    U.upsert(path, later, embed, complete=True)
    U.compact(t.spark, path, share=0.05)
    return U.read_index(t.spark, path).select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", F.size("embedding").alias("dimension"))


@query("text_embed_semantic", f"SELECT doc_id, {semantic.DIMENSION} AS dimension, 1 AS unit FROM documents WHERE regexp_matches(text, '[a-zA-Z0-9]')")
def text_embed_semantic(t: Tables):
    """Vectors from the decomposed term matrix, of all documents with a word."""
    made = semantic.semantic_embed(t.documents, semantic.fit_semantic(t.documents)).where(F.regexp_like("text", F.lit("[a-zA-Z0-9]")))
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") ** 2)
    return made.select("doc_id", F.size("embedding").alias("dimension"), (F.abs(length - 1) < 1e-4).alias("unit"))
