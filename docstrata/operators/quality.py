"""Measures over graded queries, triggers and runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label() -> Column:
    """The stored label, else one from the grade; no grade, or 0.0, counts as 0.5."""
    grade = F.coalesce(F.nullif("retrieval_grade", F.lit(0.0)), F.lit(0.5))
    return F.coalesce(F.nullif("grade_label", F.lit("")), F.when(grade >= 0.7, "RELEVANT").when(grade >= 0.4, "AMBIGUOUS").otherwise("IRRELEVANT"))


def metrics(grades: DataFrame, *keys: Column | str, digits: int = 4) -> DataFrame:
    share = lambda name: F.round(F.count_if(F.col("__label") == name) / F.count(F.lit(1)), digits)
    return grades.withColumn("__label", label()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("query_count"), F.round(F.avg(F.coalesce(F.nullif("retrieval_grade", F.lit(0.0)), F.lit(0.5))), digits).alias("avg_grade_score"),
        share("RELEVANT").alias("relevant_pct"), share("AMBIGUOUS").alias("ambiguous_pct"), share("IRRELEVANT").alias("irrelevant_pct"),
    )


def panel(grades: DataFrame) -> DataFrame:
    return grades.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"), F.round(F.avg("retrieval_grade"), 6).alias("avg_grade"), F.round(F.avg("latency_ms"), 6).alias("avg_latency"),
        F.count_if(F.col("retrieval_grade") < 0.5).alias("poor"), F.count_if(~F.col("watcher_processed")).alias("unprocessed"),
    )


def triggers(grades: DataFrame, as_of: str, poor_limit: int = 20, recent_limit: int = 20, hours: int = 48) -> DataFrame:
    """Projects whose unprocessed poor grades, or grades of the last hours, reach a limit."""
    recent = F.col("created_at") >= F.expr(f"timestamp_ntz'{as_of}' - interval {hours} hours")
    counts = grades.groupBy("project_id").agg(F.count_if((F.col("retrieval_grade") < 0.5) & ~F.col("watcher_processed")).alias("poor"), F.count_if(recent & (F.col("created_at") <= F.lit(as_of).cast("timestamp_ntz"))).alias("recent"))
    return counts.withColumn("triggered", (F.col("poor") >= poor_limit) | (F.col("recent") >= recent_limit))


def improvement(grades: DataFrame, split: str) -> DataFrame:
    """Change from before to after a time: grade, share relevant, share irrelevant (a fall counts as plus)."""
    post = F.col("created_at") > F.lit(split).cast("timestamp_ntz")
    m = metrics(grades.withColumn("post", post), "project_id", "post")
    side = lambda v: m.where(F.col("post") == v).drop("post")
    a, b = side(False), side(True)
    return a.alias("a").join(b.alias("b"), "project_id").select(
        "project_id", F.round(F.col("b.avg_grade_score") - F.col("a.avg_grade_score"), 4).alias("grade_change"),
        F.round(F.col("b.relevant_pct") - F.col("a.relevant_pct"), 4).alias("relevant_change"), F.round(F.col("a.irrelevant_pct") - F.col("b.irrelevant_pct"), 4).alias("irrelevant_fall"),
    )


def newest(rows: DataFrame, key: str, order: str, n: int, tie: str = "id") -> DataFrame:
    """The n newest rows of each key."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), tie))).where(F.col("rn") <= n)


def leader_clusters(vectors: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Leaders in order of id take the later unassigned rows that are near enough (project_id, id, embedding; bounded groups)."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        m = np.array(frame["embedding"].tolist(), dtype=np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        near = (m / np.where(n == 0, 1, n)) @ (m / np.where(n == 0, 1, n)).T >= threshold - 1e-12
        leader = np.full(len(m), -1)
        for i in range(len(m)):
            if leader[i] < 0:
                leader[(leader < 0) & near[i] & (np.arange(len(m)) >= i)] = i
                leader[i] = i
        ids = frame["id"].to_numpy()
        return pd.DataFrame({"project_id": key[0], "id": ids, "leader_id": ids[leader]})

    kind = vectors.schema["id"].dataType.simpleString()
    project = vectors.schema["project_id"].dataType.simpleString()
    return vectors.groupBy("project_id").applyInPandas(run, f"project_id {project}, id {kind}, leader_id {kind}")


def grade_parts(response: Column) -> Column:
    """``LABEL|SCORE|REASON`` as a struct, with the defaults for what is missing or cannot be read."""
    p = F.split(F.trim(response), r"\|", 3)
    name = F.upper(F.trim(F.element_at(p, 1)))
    score = F.when(F.size(p) > 1, F.trim(F.try_element_at(p, F.lit(2))).try_cast("double")).otherwise(F.lit(0.5))
    known = F.when(name.isin("RELEVANT", "AMBIGUOUS", "IRRELEVANT"), name).otherwise(F.lit("AMBIGUOUS"))
    reason = F.coalesce(F.trim(F.try_element_at(p, F.lit(3))), F.lit(""))
    return F.struct(F.when(score.isNull(), F.lit("RELEVANT")).otherwise(known).alias("label"), F.coalesce(score, F.lit(0.5)).alias("grade"), F.when(score.isNull(), F.lit("")).otherwise(reason).alias("reason"))
