"""Questions to contexts, sources and prompts, for a whole table of questions at once."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from placewise.operators.texts import answer_sources, context_string, text_embed
from placewise.operators.vectors import attach, vector_search
from placewise.plans.reports import question_prompt
from placewise.session import materialize
from placewise.settings import LOCATION_QUERY


PAYLOAD = ["text", "metadata"]


def place_hits(questions: DataFrame, index: DataFrame, encoder: PipelineModel, place: str, k: int = 5) -> DataFrame:
    """Hits of the generic location query within the zip of each question that names one."""
    local = questions.where(F.col(place).isNotNull()).select("query_id", place, F.lit(LOCATION_QUERY).alias("question"))
    placed = index.withColumn("_zip", F.try_element_at("metadata", F.lit("zip_code")))
    return vector_search(placed, text_embed(local, encoder, "question"), k, match=("_zip", place))


def complaint_context(
    questions: DataFrame, index: DataFrame, encoder: PipelineModel, place: str | None = None, k: int = 5
) -> DataFrame:
    """Ranked complaint hits per question.

    A question with a place gets the hits of the generic location query within that zip; one without
    gets the hits of its own text everywhere.
    """
    free = questions if place is None else questions.where(F.col(place).isNull())
    hits = vector_search(index, text_embed(free.select("query_id", "question"), encoder, "question"), k)
    if place is not None:
        hits = hits.unionByName(place_hits(questions, index, encoder, place, k))
    return attach(hits, index, PAYLOAD)


def answer_questions(
    questions: DataFrame,
    complaints: DataFrame,
    guidelines: DataFrame,
    encoder: PipelineModel,
    place: str | None = None,
) -> DataFrame:
    """query_id, question, context, sources (first three complaints, first two guidelines) and prompt.

    `questions` holds query_id, question and, if named, a place column; it is small, the indexes are not.
    """
    asked = text_embed(questions.select("query_id", "question"), encoder, "question")
    # each index is searched for all questions once; the hits, a few for each, are read by context and sources
    guides = materialize(attach(vector_search(guidelines, asked, 3), guidelines, PAYLOAD))
    own = vector_search(complaints, asked, 5).withColumn("use", F.lit("own"))
    hits = own if place is None else own.unionByName(place_hits(questions, complaints, encoder, place).withColumn("use", F.lit("place")))
    hits = materialize(attach(hits, complaints, PAYLOAD))
    free = questions if place is None else questions.where(F.col(place).isNull())
    context = hits.where("use = 'place'").unionByName(hits.where("use = 'own'").join(free.select("query_id").distinct(), "query_id", "left_semi"))
    contexts = context_string(context.drop("use"), guides)
    near = hits.where("use = 'own' AND rank <= 3").drop("use")
    listed = answer_sources(near, guides).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "kind", "id", "text", "distance"))).alias("sources")
    )
    rows = questions.join(contexts, "query_id", "left").join(listed, "query_id", "left")
    context = F.coalesce(F.col("context"), F.lit(""))
    prompt = question_prompt(F.col("question"), context, F.col(place) if place else None)
    return rows.select("query_id", "question", context.alias("context"), "sources", prompt.alias("prompt"))
