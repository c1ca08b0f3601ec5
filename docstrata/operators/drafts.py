"""Generated documents: sections, signatures, citations, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions import text as T

# Fixed: identifiers and titles of the sections of each document type, in order.
TEMPLATES = {
    "brd": (
        ("executive_summary", "Executive Summary"), ("business_objectives", "Business Objectives"), ("stakeholders", "Stakeholders"), ("scope", "Scope"),
        ("functional_requirements", "Functional Requirements"), ("non_functional_requirements", "Non-Functional Requirements"), ("constraints", "Constraints & Assumptions"),
        ("success_criteria", "Success Criteria"),
    ),
    "sow": (
        ("overview", "Overview"), ("scope_of_work", "Scope of Work"), ("deliverables", "Deliverables"), ("timeline", "Timeline & Milestones"),
        ("acceptance_criteria", "Acceptance Criteria"), ("payment_terms", "Payment Terms"), ("assumptions", "Assumptions & Dependencies"),
    ),
    "prd": (
        ("overview", "Overview"), ("goals", "Goals & Non-Goals"), ("user_stories", "User Stories"), ("functional_specs", "Functional Specifications"),
        ("non_functional_specs", "Non-Functional Specifications"), ("out_of_scope", "Out of Scope"), ("timeline", "Timeline & Milestones"),
    ),
    "custom": (("introduction", "Introduction"), ("key_findings", "Key Findings"), ("recommendations", "Recommendations"), ("appendix", "Appendix")),
}
TEMPLATE = TEMPLATES["sow"]


def template(kind: str) -> tuple[tuple[str, str], ...]:
    """The sections of a document type, whatever the case of its name; unknown types have those of ``custom``."""
    return TEMPLATES.get(kind.lower(), TEMPLATES["custom"])


def lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def headings(line_rows: DataFrame) -> DataFrame:
    """Lines with their heading level (1 to 3, else null) and title."""
    level = F.length(F.regexp_extract("line", r"^(#{1,3})\s+.+$", 1))
    return line_rows.withColumn("level", F.nullif(level, F.lit(0))).withColumn("title", F.nullif(T.strip(F.regexp_extract("line", r"^#{1,3}\s+(.+)$", 1)), F.lit("")))


def sections(docs: DataFrame, kind: str = "sow") -> DataFrame:
    """Sections of a document type from headings: what stands before the first is dropped; of sections with one title the last stays."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    cut = headings(lines(docs)).withColumn("section_no", F.count("level").over(w)).where("section_no > 0")
    body = cut.groupBy("doc_id", "section_no").agg(
        F.min_by("title", "line_no").alias("title"), F.min_by("level", "line_no").alias("level"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")
    )
    named = body.select("doc_id", "section_no", "level", "title", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text")).withColumn("section_id", section_id(F.col("title"), kind))
    last = Window.partitionBy("doc_id", "section_id").orderBy(F.desc("section_no"))
    return named.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def section_id(title, kind: str = "sow"):
    """The first section of the document type whose title contains, or is contained in, the heading; else a slug."""
    low = F.lower(title)
    out = None
    for name, label in template(kind):
        fits = F.contains(low, F.lit(label.lower())) | F.contains(F.lit(label.lower()), low)
        out = F.when(fits, F.lit(name)) if out is None else out.when(fits, F.lit(name))
    return out.otherwise(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}_]+", "_"), "^_+|_+$", ""))


def signatures(docs: DataFrame, kind: str = "sow") -> DataFrame:
    """A row for each section of the document type and each document, even where the document lacks it."""
    spark = docs.sparkSession
    rows = [(i, a, b) for i, (a, b) in enumerate(template(kind))]
    wished = spark.createDataFrame(rows, "section_order int, section_id string, section_title string")
    wanted = docs.select("doc_id").distinct().crossJoin(F.broadcast(wished))  # eight rows at most
    found = wanted.join(sections(docs, kind).select("doc_id", "section_id", "text"), ["doc_id", "section_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    return found.select(
        "doc_id", "section_id", "section_title", T.first_hit(F.lower(F.concat_ws(" ", "section_id", "section_title")), T.SECTION_TYPES, "general").alias("section_type"),
        F.array_join(T.words_found(text, T.DEONTIC, True), ",").alias("obligations"), F.array_join(T.words_found(text, T.PARTIES, False), ",").alias("parties"),
        F.array_join(T.defined_terms(text), ",").alias("terms"), T.section_summary(text).alias("summary"),
    )


def heading_paths(docs: DataFrame) -> DataFrame:
    """The titles above each heading, from the outermost: for each level the nearest earlier heading, if none of a smaller level came between."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    h = headings(lines(docs)).where("level is not null")
    last = {n: F.max(F.when(F.col("level") <= n, F.col("line_no"))).over(w) for n in (1, 2, 3)}
    at = {n: F.max(F.when(F.col("level") == n, F.struct("line_no", "title"))).over(w) for n in (1, 2, 3)}
    own = h.withColumns({f"l{n}": last[n] for n in last} | {f"t{n}": at[n] for n in at})
    parts = [F.when((F.col("level") >= n) & (F.col(f"t{n}.line_no") == F.col(f"l{n}")), F.col(f"t{n}.title")) for n in (1, 2, 3)]
    return own.select("doc_id", "line_no", "level", "title", F.array_join(F.array_compact(F.array(*parts)), " > ").alias("path"))


def citations(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """Markers of texts (doc_id, text) with the document that they point to; unknown ones are flagged."""
    found = cited.select(F.col("doc_id").alias("citing"), F.posexplode(T.markers(T.clean_markers(F.col("text")))).alias("pos", "chunk_id"))
    return found.join(chunks.select("chunk_id", F.col("doc_id").alias("cited")), "chunk_id", "left").withColumn("known", F.col("cited").isNotNull())


def version_delta(versions: DataFrame) -> DataFrame:
    """Lines added and removed from version to version, as multisets."""
    rows = versions.select("document_id", "version_no", F.explode(F.split("text", "\n")).alias("line")).groupBy("document_id", "version_no", "line").agg(F.count(F.lit(1)).alias("n"))
    known = versions.select("document_id", "version_no")
    later = rows.withColumn("version_no", F.col("version_no") + 1).withColumnRenamed("n", "before").join(known, ["document_id", "version_no"], "left_semi")
    both = rows.join(later, ["document_id", "version_no", "line"], "full").fillna(0, ["n", "before"]).where("version_no > 1")
    return both.groupBy("document_id", "version_no").agg(F.sum(F.greatest(F.col("n") - F.col("before"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("before") - F.col("n"), F.lit(0))).alias("removed"))
