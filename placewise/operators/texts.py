"""Chunking, text vectors, search indexes and what is built from their hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from placewise.functions.columns import fill_text, stringify_metadata, strip
from placewise.operators.clean import available
from placewise.operators.position import with_position
from placewise.settings import (
    CHUNK_SIZE,
    COMPLAINT_METADATA,
    COMPLAINTS_HEADING,
    EMBEDDING_DIMENSION,
    GUIDELINES_HEADING,
)


def chunk_array(text: Column, size: int = CHUNK_SIZE, separator: str = "\n\n", overlap: int = 0) -> Column:
    """Paragraphs packed greedily while the open chunk plus the next one stays below `size`; stripped.

    A paragraph longer than `size` stays whole. With an `overlap` a chunk opens with that many last characters of the one
    before it, and a separator. The fold keeps finished chunks and the open one.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state, paragraph):
        fits = F.length(state["open"]) + F.length(paragraph) < size
        tail = F.concat(paragraph, F.lit(separator))
        closed = F.when(
            fits | (state["open"] == ""), state["done"]
        ).otherwise(F.concat(state["done"], F.array(strip(state["open"]))))
        carried = F.when(state["open"] == "", F.lit("")).otherwise(F.concat(F.right(strip(state["open"]), F.lit(overlap)), F.lit(separator)))
        opened = F.when(fits, F.concat(state["open"], tail)).otherwise(F.concat(carried, tail) if overlap else tail)
        return F.struct(closed.alias("done"), opened.alias("open"))

    def finish(state):
        return F.when(state["open"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(strip(state["open"]))))

    # split by a literal separator: quote it for the regular expression
    return F.aggregate(F.split(text, r"\Q" + separator + r"\E", -1), start, step, finish)


def chunk_text(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, separator: str = "\n\n", overlap: int = 0) -> DataFrame:
    """One row per chunk: the other columns, chunk_index from 0, text."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(chunk_array(F.col(text), size, separator, overlap)).alias("chunk_index", text))


def fit_text_embedding(docs: DataFrame, text: str = "text", dimension: int = EMBEDDING_DIMENSION) -> PipelineModel:
    """Hashed term counts weighted by rarity, unit length: a distributed stand-in for a sentence encoder.

    Any other encoder fits in the same place: a function that adds an `embedding` array column.
    """
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_terms", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=dimension),
        IDF(inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_unit"),
    ]
    return Pipeline(stages=stages).fit(docs.select(fill_text(F.col(text)).alias("_text")))


def text_embed(docs: DataFrame, model: PipelineModel, text: str = "text", sparse: bool = False) -> DataFrame:
    """Adds `embedding`, an array<float>; with `sparse` its length, its places other than zero and their values, which
    `vector_search` takes as well."""
    out = model.transform(docs.withColumn("_text", fill_text(F.col(text))))
    held = F.unwrap_udt("_unit")
    short = F.struct(held["size"].alias("size"), held["indices"].alias("i"), held["values"].cast("array<float>").alias("v"))
    return out.select(*docs.columns, (short if sparse else vector_to_array("_unit", "float32")).alias("embedding"))


def row_id(df: DataFrame, prefix: str, key: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """`id` from a unique key, or exactly numbered from 0 in the given total order."""
    if key is not None:
        return df.withColumn("id", F.concat(F.lit(f"{prefix}_"), F.col(key).cast("string")))
    placed = with_position(df, list(order))
    return placed.withColumn("id", F.concat(F.lit(f"{prefix}_"), (F.col("position") - 1).cast("string"))).drop("position")


def build_complaint_index(
    complaints: DataFrame,
    model: PipelineModel,
    text: str = "descriptor",
    metadata: Sequence[str] = tuple(COMPLAINT_METADATA),
    key: str | None = "unique_key",
    order: Sequence[str] = (),
    sparse: bool = False,
) -> DataFrame:
    """id, text, metadata map of the columns that exist, embedding."""
    kept = available(complaints, metadata)
    rows = row_id(complaints, "complaint", key, order).select(
        "id", fill_text(F.col(text)).alias("text"), stringify_metadata(kept).alias("metadata")
    )
    return text_embed(rows, model, sparse=sparse)


def build_guideline_index(
    docs: DataFrame, model: PipelineModel, source: str = "source", size: int = CHUNK_SIZE, separator: str = "\n\n",
    numbered: bool = False, overlap: int = 0, sparse: bool = False,
) -> DataFrame:
    """Documents to chunks with id, source, chunk index and embedding."""
    chunks = chunk_text(docs.select(F.col(source).cast("string").alias("source"), "text"), size=size, separator=separator, overlap=overlap)
    if numbered:
        rows = row_id(chunks, "guideline", order=["source", "chunk_index"])
    else:
        rows = chunks.withColumn("id", F.concat_ws("_", F.lit("guideline"), "source", "chunk_index"))
    named = F.create_map(F.lit("source"), F.col("source"), F.lit("chunk_index"), F.col("chunk_index").cast("string"))
    return text_embed(rows.select("id", "text", named.alias("metadata")), model, sparse=sparse)


def metadata_equals(**wanted: str) -> Column:
    """Conjunction of metadata equalities."""
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & (F.try_element_at("metadata", F.lit(key)) == F.lit(value))
    return out


def document_contains(part: str, text: str = "text") -> Column:
    return F.col(text).contains(part)


def retrieval_summary(
    index: DataFrame, distance: Column, place: Column, recent: int = 5, issues: int = 10
) -> DataFrame:
    """Per place the count of all its rows, its nearest hits and their texts.

    The count is an aggregate over all rows; only the listed hits are ranked, with a limit in every task first.
    """
    w = Window.partitionBy("place").orderBy("distance", "id")
    rows = index.select(place.alias("place"), "id", "text", distance.alias("distance")).where(F.col("place").isNotNull())
    hits = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(issues, recent))
    listed = F.array_sort(F.collect_list(F.struct("rank", "id", "text", "distance")))
    totals = rows.groupBy("place").agg(F.count("*").alias("total_complaints"))
    return totals.join(hits.groupBy("place").agg(listed.alias("hits")), "place").select(
        "place",
        "total_complaints",
        F.transform(
            F.slice("hits", 1, recent), lambda h: F.struct(h["id"].alias("id"), h["text"].alias("text"), h["distance"].alias("distance"))
        ).alias("recent_complaints"),
        F.slice("hits", 1, issues)["text"].alias("sample_issues"),
    )


def context_string(complaints: DataFrame | None, guidelines: DataFrame | None) -> DataFrame:
    """One context text per query from ranked hits (query_id, rank, text, metadata).

    A section appears only when the query has hits of that kind. Each query holds a few hits.
    """
    parts = []
    if complaints is not None:
        place = F.coalesce(F.try_element_at("metadata", F.lit("zip_code")), F.lit("N/A"))
        made = F.coalesce(F.try_element_at("metadata", F.lit("created_date")), F.lit("N/A"))
        line = F.concat(
            F.col("rank").cast("string"), F.lit(". "), "text", F.lit(" (Location: "), place, F.lit(", Date: "), made, F.lit(")\n")
        )
        parts.append(complaints.select("query_id", F.lit(1).alias("kind"), "rank", line.alias("line")))
    if guidelines is not None:
        parts.append(guidelines.select(
            "query_id", F.lit(2).alias("kind"), "rank", F.concat("text", F.lit("\n\n")).alias("line")
        ))
    hits = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ordered = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("kind", "rank", "line"))).alias("h"))

    def section(kind: int, heading: str) -> Column:
        own = F.filter("h", lambda x: x["kind"] == kind)
        body = F.array_join(F.transform(own, lambda x: x["line"]), "")
        return F.when(F.size(own) > 0, F.concat(F.lit(heading), body)).otherwise(F.lit(""))

    return ordered.select(
        "query_id", F.concat(section(1, COMPLAINTS_HEADING), section(2, GUIDELINES_HEADING)).alias("context")
    )


def answer_sources(complaints: DataFrame, guidelines: DataFrame, first: int = 3, second: int = 2) -> DataFrame:
    """The first complaint hits followed by the first guideline hits, with their place in the list."""
    top = complaints.where(F.col("rank") <= first).withColumns({"kind": F.lit("complaint"), "place": F.col("rank")})
    rest = guidelines.where(F.col("rank") <= second).withColumns({"kind": F.lit("guideline"), "place": F.col("rank") + first})
    return top.unionByName(rest, allowMissingColumns=True)


def judge_by_text(hits: DataFrame, relevance: DataFrame, relevant: str = "relevant") -> DataFrame:
    """Marks a hit relevant when it contains any of its query's relevant texts."""
    joined = hits.join(relevance.select("query_id", relevant), "query_id")
    return joined.withColumn("is_relevant", F.exists(relevant, lambda r: F.contains(F.col("text"), r))).drop(relevant)


def precision_at_k(judged: DataFrame, k: int = 5) -> DataFrame:
    """Per query: relevant hits among the first k, divided by k."""
    hit = (F.col("is_relevant") & (F.col("rank") <= k)).cast("int")
    return judged.groupBy("query_id").agg((F.sum(hit) / k).alias("precision"))


def recall_at_k(judged: DataFrame, totals: DataFrame, k: int = 5) -> DataFrame:
    """Per query: relevant hits among the first k, divided by the query's relevant rows."""
    hit = (F.col("is_relevant") & (F.col("rank") <= k)).cast("int")
    found = judged.groupBy("query_id").agg(F.sum(hit).alias("found"))
    return found.join(totals, "query_id").select(
        "query_id", F.when(F.col("relevant_rows") > 0, F.col("found") / F.col("relevant_rows")).alias("recall")
    )


def mean_reciprocal_rank(judged: DataFrame) -> DataFrame:
    """Mean over queries of 1 / rank of the first relevant hit, 0 when there is none."""
    first = judged.groupBy("query_id").agg(F.min(F.when(F.col("is_relevant"), F.col("rank"))).alias("r"))
    return first.agg(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"))
