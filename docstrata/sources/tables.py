"""Table maintenance on plain Parquet: upserts, inserts, deletes, schema growth. Each takes and gives whole DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from docstrata.sources.shared import stored


def content_hash(df: DataFrame, column: str = "content") -> DataFrame:
    return df.withColumn("file_hash", F.sha2(F.col(column).cast("binary"), 256))


def deduplicate(batch: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``duplicate_of``: the first id with that hash in the batch, null for the first itself.

    The first ids are aggregated before the shuffle and joined back from a table, so that Spark can split the rows of
    one content that many files have (blank ones, say).
    """
    first = stored(batch.groupBy("file_hash").agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    return batch.join(first, "file_hash", "left").withColumn("duplicate_of", F.when(F.col("__first") != F.col(id_col), F.col("__first"))).drop("__first").select(*batch.columns, "duplicate_of")


def named_like(queries: DataFrame, files: DataFrame, id_col: str, size: int = 3) -> DataFrame:
    """(query_id, ``id_col``) of the files whose ``filename`` has the query's ``name`` in it, whatever the case of either.

    Names and filenames meet by equality of runs of ``size`` characters (of as many as a shorter name has): the run of the
    name that fewest filenames hold. What meets is compared in full.
    """
    low = files.select(F.col(id_col), F.lower("filename").alias("__f"))
    asked = queries.select("query_id", F.lower("name").alias("__q")).where("__q <> ''")
    cut = lambda text, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))
    held = F.array_distinct(F.concat(*(cut(F.col("__f"), n) for n in range(1, size + 1))))
    runs = stored(low.select(id_col, "__f", F.explode(held).alias("__run")))
    often = runs.groupBy("__run").agg(F.count(F.lit(1)).alias("__n"))
    own = F.when(F.length("__q") >= size, cut(F.col("__q"), size)).otherwise(F.array("__q"))
    rare = asked.select("query_id", "__q", F.explode(own).alias("__run")).join(often, "__run").groupBy("query_id", "__q").agg(F.min_by("__run", F.struct("__n", "__run")).alias("__run"))
    return rare.join(runs, "__run").where(F.contains("__f", F.col("__q"))).select("query_id", id_col).distinct()


def unseen(batch: DataFrame, history: DataFrame) -> DataFrame:
    return batch.join(history.select("file_hash").distinct(), "file_hash", "left_anti")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key."""
    both = old.withColumn("__b", F.lit(0)).unionByName(new.withColumn("__b", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("__b"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__b", "__n")


def update_fields(old: DataFrame, new: DataFrame, key: str, *fields: str) -> DataFrame:
    """``old`` with the given fields where ``new`` has a value for them; keys that only ``new`` has are added."""
    other = new.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    joined = old.join(other, key, "full")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else c for c in old.columns))


def insert_or_ignore(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"))


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def detach(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``key`` set to null where it names a deleted row."""
    marks = gone.select(F.col(key)).distinct().withColumn("__gone", F.lit(True))
    return rows.join(marks, key, "left").withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone").select(*rows.columns)


def reassign_blank(rows: DataFrame, target: str, column: str = "project_id") -> DataFrame:
    return rows.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(target)))


def assign(docs: DataFrame, links: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects of documents from ``links`` (id, project_id), as far as both exist."""
    good = links.join(projects.select("project_id"), "project_id", "left_semi").select("id", F.col("project_id").alias("__p"))
    return docs.join(good, "id", "left").withColumn("project_id", F.coalesce("__p", "project_id")).drop("__p")


def grown(rows: DataFrame, schema: t.StructType, defaults: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns of a later schema, missing ones filled with their defaults."""
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def read_messages(spark, path: str, schema: t.StructType) -> DataFrame:
    """JSON lines, blank and malformed ones skipped; the session is a field of the lines, or else the file's name."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if "session_id" in schema.names:
        return rows
    return rows.withColumn("session_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1))


def route_files(files: DataFrame, most: int = 200 * 1024 * 1024) -> DataFrame:
    """Files (filename, length) with their mime type, whether they are accepted, and why not."""
    kind = F.lower(F.regexp_extract("filename", r"(\.[^./]+)$", 1))
    mime = F.when(kind == ".pdf", "application/pdf").when(kind.isin(".docx", ".doc"), "application/vnd.openxmlformats-officedocument.wordprocessingml.document").otherwise("text/plain")
    reason = F.when(~kind.isin(".pdf", ".docx", ".doc", ".txt"), "type").when(F.col("length") <= 0, "empty").when(F.col("length") > most, "size")
    return files.withColumn("extension", kind).withColumn("mime", mime).withColumn("reject_reason", reason)


def snapshot_versions(saves: DataFrame, counts: DataFrame) -> DataFrame:
    """Labelled saves (document_id, saved_at, label) become the next versions; unlabelled ones make none."""
    w = Window.partitionBy("document_id").orderBy("saved_at")
    return saves.where("label is not null").join(counts, "document_id", "left").select("document_id", "saved_at", "label", (F.coalesce("version_count", F.lit(0)) + F.row_number().over(w)).alias("version_no"))


def memory_notes(notes: DataFrame, projects: DataFrame) -> DataFrame:
    """A text for each project: four sections in order with their notes, or a placeholder (notes: project_id, section, note_no, content)."""
    names = ("Terminology Map", "Cross-Document Connections", "Frequently Asked Patterns", "Knowledge Gaps")
    spark = notes.sparkSession
    dimension = spark.createDataFrame(list(enumerate(names)), "section_no int, section string")
    body = notes.groupBy("project_id", "section").agg(F.array_sort(F.collect_list(F.struct("note_no", "content"))).alias("n"))
    texts = body.select("project_id", "section", F.array_join(F.transform("n", lambda x: F.concat(F.lit("- "), x["content"])), "\n").alias("body"), F.size("n").alias("count"))
    full = projects.select("project_id").distinct().crossJoin(F.broadcast(dimension)).join(texts, ["project_id", "section"], "left")  # four rows
    part = F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.coalesce("body", F.lit("_(no entries yet)_")))
    joined = full.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("section_no", part.alias("part")))).alias("p"), F.sum(F.coalesce("count", F.lit(0))).alias("entries"))
    return joined.select("project_id", "entries", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("text"))
