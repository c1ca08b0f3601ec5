"""Conversations: token budgets and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CONTEXT = 32_768
# Fixed, in the order in which a model's name is looked through.
CONTEXT_SIZES = (
    ("llama3.2", 128_000), ("llama3.1", 128_000), ("llama3", 8_192), ("mistral", 32_768), ("phi3", 128_000), ("gemma2", 8_192), ("qwen2.5", 128_000),
    ("gpt-4o", 128_000), ("gpt-4o-mini", 128_000), ("gpt-4-turbo", 128_000), ("gpt-3.5-turbo", 16_384),
    ("claude-opus-4-6", 200_000), ("claude-sonnet-4-6", 200_000), ("claude-haiku-4-5-20251001", 200_000), ("claude-3-5-sonnet-20241022", 200_000), ("claude-3-5-haiku-20241022", 200_000),
    ("gemini-2.0-flash", 1_048_576), ("gemini-1.5-pro", 2_097_152), ("gemini-1.5-flash", 1_048_576),
)


def context_size(model: Column) -> Column:
    out = None
    for key, size in CONTEXT_SIZES:
        has = F.contains(F.lower(model), F.lit(key))
        out = F.when(has, F.lit(size)) if out is None else out.when(has, F.lit(size))
    return out.otherwise(F.lit(DEFAULT_CONTEXT))


def totals(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"), F.sum("token_count").alias("total_tokens"), F.max("pos").alias("last_pos"))


def context_status(messages: DataFrame, total: Column) -> DataFrame:
    used = messages.groupBy("session_id").agg(F.sum(F.col("token_count") + 4).alias("used_tokens")).withColumn("total_tokens", total)
    left = F.greatest(F.lit(0), F.col("total_tokens") - F.col("used_tokens"))
    share = F.col("used_tokens") / F.col("total_tokens")
    return used.withColumn("remaining_tokens", left).withColumn("should_warn", (share >= 0.68) | (left < 32_000)).withColumn("should_block", (share >= 0.88) | (left < 16_000))


def split_for_compaction(messages: DataFrame) -> DataFrame:
    """Messages with ``part``: system, old (the first 60 %, two at least) or recent; sessions with up to four turns keep all as recent."""
    w = Window.partitionBy("session_id")
    chat = F.when(F.col("role") != "system", 1)
    n, i = F.count(chat).over(w), F.count(chat).over(w.orderBy("pos"))
    part = F.when(F.col("role") == "system", "system").when((n > 4) & (i <= F.greatest(F.lit(2), F.floor(n * 0.6))), "old").otherwise("recent")
    return messages.withColumn("part", part)


def compacted(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """System messages, a summary for what was old, and recent messages. ``summaries``: session_id, summary."""
    parts = split_for_compaction(messages)
    old = parts.where("part = 'old'").groupBy("session_id").agg(F.max("pos").alias("pos")).join(summaries, "session_id")
    text = F.concat(F.lit("[Conversation Summary]\n\n"), F.col("summary"))
    block = old.select("session_id", "pos", F.lit("system").alias("role"), text.alias("content"), F.lit(True).alias("compacted"))
    return parts.where("part <> 'old'").select("session_id", "pos", "role", "content", F.lit(False).alias("compacted")).unionByName(block)


def summary_input(messages: DataFrame) -> DataFrame:
    old = split_for_compaction(messages).where("part = 'old'")
    lines = old.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.upper("role"), F.lit(": "), F.substring("content", 1, 500)).alias("line")))).alias("l"))
    return lines.select("session_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("prompt"))
