"""The pN_ queries of the problems on text, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import leakage, packing, sentences, sql
from quern.session import materialise


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.containers(_docs(spark, sf), packing.container_kinds(spark, f"{sf}/containers.parquet"))


def p7_kept(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts the containers hold, and what is wrong with them: containers over their capacity, texts whose
    pieces don't make them up, texts cut that would have fitted."""
    kinds = packing.container_kinds(spark, f"{sf}/containers.parquet")
    rows = materialise(
        packing.containers(_docs(spark, sf), kinds), "containers"
    ).withColumn("n", F.col("token_end") - F.col("token_start"))
    full = rows.groupBy("container_id").agg((F.sum("n") > F.max("capacity_tokens")).alias("over"))
    whole = (F.sum("n") == F.max("token_end")) & (F.min("token_start") == 0) & (F.count("*") == F.max("piece") + 1)
    docs = rows.groupBy("doc_id").agg(
        (~whole).alias("broken"), ((F.count("*") > 1) & (F.sum("n") <= max((c for _, c in kinds), default=0))).alias("cut")
    )
    over = full.agg(F.count_if("over").cast("int").alias("over_full"))
    seen = docs.agg(
        F.count("*").alias("documents"), F.count_if("broken").cast("int").alias("broken"),
        F.count_if("cut").cast("int").alias("cut_needlessly")
    )
    return seen.crossJoin(over).select("documents", "over_full", "broken", "cut_needlessly")  # one row each


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Copies and paraphrases, with the words in common and whether the answer leaked too."""
    return leakage.leaks_of(_docs(spark, sf), spark.read.parquet(f"{sf}/eval_items.parquet"), paraphrase=0.85)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of ``p8_leaks`` that are copies: twelve words in a row."""
    return p8_leaks(spark, sf).where("copied").select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(_docs(spark, sf))


def p9_order(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the sentences' spans: none at all, one that overlaps the one before it, blank ends, one that
    lies in no markdown cell."""
    docs = _docs(spark, sf)
    near = Window.partitionBy("doc_id").orderBy("sent_start", "sent_end")  # the sentences of one document
    s = sentences.sentences(docs).withColumn("before", F.lag("sent_end").over(near))
    j = s.join(docs.select("doc_id", "text", "cells"), "doc_id")
    span = F.substring(F.col("text"), F.col("sent_start") + 1, F.col("sent_end") - F.col("sent_start"))
    inside = F.exists(
        "cells",
        lambda c: (c["cell_type"] == "markdown") & (
            c["char_start"] <= F.col("sent_start")
        ) & (F.col("sent_end") <= c["char_end"])
    )
    count = lambda c: F.count_if(c).cast("int")
    return j.agg(
        count(F.col("sent_end") <= F.col("sent_start")).alias("empty"),
        count(F.coalesce(F.col("before") > F.col("sent_start"), F.lit(False))).alias("overlapping"),
        count(F.trim(span) != span).alias("blank_ends"), count(~inside).alias("outside"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p7_containers, p7_kept, p8_found, p8_leaks, p9_found, p9_order)
}
ORACLE: dict[str, str] = {"p7_kept": sql.P7_KEPT, "p8_found": sql.P8_FOUND, "p9_order": sql.P9_ORDER}
