"""Text functions as columns: tokens, sentences, filters, classifiers. All run in the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on, each named below.
# Fixed: words that a query loses.
STOP_WORDS = (
    "a an the is it in on at to for of and or but with as by from this that these those was were are be been being have has had do does did will would shall "
    "should may might can could about which who what when where how i me my we our you your he she they his her its their"
).split()
# Fixed: patterns of questions over several sources.
MULTI_HOP = (
    r"\bcompare\b", r"\bvs\.?\b", r"\bversus\b", r"\bdifference between\b", r"\bcontrast\b", r"\bhow does .+ compare\b", r"\bwhich .+ matches\b",
    r"\bacross .+ (documents?|files?|sources?)\b", r"\bboth .+ and\b", r"\bat the same time\b",
)
# Fixed: words of duty.
DEONTIC = ("shall", "must", "should", "may")
# Fixed: words for parties.
PARTIES = ("vendor", "client", "customer", "contractor", "provider", "user", "buyer", "seller", "developer", "owner", "stakeholder", "team")
# Fixed: words of an edit.
EDIT_WORDS = (
    "rewrite", "update", "change", "modify", "edit", "improve", "revise", "add", "remove", "delete", "replace", "expand", "shorten", "clarify", "make it", "make this",
    "fix", "correct", "rephrase",
)
# Fixed: patterns that ask for a document.
GENERATION = (
    r"\bgenerate\b.{0,30}\b(brd|sow|prd|document|doc|report|plan|brief)\b",
    r"\bcreate\b.{0,30}\b(brd|sow|prd|document|report)\b.{0,30}\b(for|about|based on)\b",
    r"\bwrite\b.{0,30}\b(brd|sow|prd|document|report)\b",
    r"\bdraft\b.{0,30}\b(brd|sow|prd|document)\b",
    r"\b(business requirements|statement of work|product requirements)\b",
)
# Fixed: patterns of document types, in order.
DOCUMENT_TYPES = (("brd", r"\bbrd\b|\bbusiness requirements?\b"), ("sow", r"\bsow\b|\bstatement of work\b"), ("prd", r"\bprd\b|\bproduct requirements?\b"))
# Fixed: phrases of each relation, in order.
RELATIONS = (
    ("DEFINED_AS", ("is defined as", "defined as", "refers to", "means", "is called", "is known as", "denotes", "stands for")),
    ("PART_OF", ("is part of", "part of", "belongs to", "component of", "section of", "subset of", "contained in", "consists of", "includes", "comprises")),
    ("CAUSED_BY", ("caused by", "results from", "leads to", "triggers", "causes", "produces", "generates", "results in", "due to", "because of")),
    ("MENTIONED_WITH", ("mentioned alongside", "co-occurs with", "appears with", "associated with", "alongside", "together with")),
    ("CONTRASTS_WITH", ("contrasts with", "differs from", "compared to", "versus", "unlike unlike", "in contrast", "as opposed to", "different from")),
)
# Fixed: words of each section type, in order.
SECTION_TYPES = (
    ("executive_summary", ("executive", "overview", "summary", "introduction")),
    ("scope_statement", ("scope", "objective", "goal")),
    ("deliverable", ("deliverable", "functional", "requirement", "spec")),
    ("timeline", ("timeline", "milestone", "schedule", "deadline")),
    ("acceptance_criterion", ("accept", "criterion", "criteria")),
    ("assumption_risk", ("constraint", "assumption", "risk")),
    ("technical_constraint", ("non-functional", "non_functional", "technical", "performance")),
    ("background", ("stakeholder", "background", "context")),
    ("financial", ("payment", "financial", "cost", "budget")),
)
# Fixed: labels of failures.
FAILURES = ("terminology_gap", "cross_doc_gap", "missing_concept", "buried_signal", "ok")

SPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
TOKEN = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def sentences(text: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` before white space; blank pieces go."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Index terms: runs of ASCII letters and digits or of any other non-ASCII character, ASCII letters in lower case."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TOKEN), F.lit(0))


def query_words(text: Column) -> Column:
    """Words of a query without stop words; all of them if nothing else is left."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: w != "")
    meaningful = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    return F.when(F.size(meaningful) > 0, meaningful).otherwise(words)


def match_mode(words: Column) -> Column:
    return F.when(F.size(words) <= 3, F.lit("AND")).otherwise(F.lit("OR"))


def fts_expression(words: Column) -> Column:
    quoted = F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"')))
    return F.when(F.size(words) <= 3, F.array_join(quoted, " AND ")).otherwise(F.array_join(quoted, " OR "))


def filename_filter(query: Column) -> Column:
    return F.nullif(F.regexp_extract(query, r"(?i)\bfile:([^\s]+)", 1), F.lit(""))


def source_filter(query: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(query, r"(?i)\bsource:(pdf|csv|docx|txt)\b", 1)), F.lit(""))


def without_filters(query: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(query, r"(?i)\bfile:[^\s]+", ""), r"(?i)\bsource:(pdf|csv|docx|txt)\b", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def any_match(text: Column, patterns) -> Column:
    return functools.reduce(lambda a, b: a | b, (text.rlike(f"(?i){p}") for p in patterns))


def first_hit(text: Column, groups, default: str) -> Column:
    """Name of the first group with a keyword in the text."""
    out = None
    for name, words in groups:
        has = functools.reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))
        out = F.when(has, F.lit(name)) if out is None else out.when(has, F.lit(name))
    return out.otherwise(F.lit(default))


def document_type(text: Column) -> Column:
    out = None
    for name, pattern in DOCUMENT_TYPES:
        has = text.rlike(f"(?i){pattern}")
        out = F.when(has, F.lit(name)) if out is None else out.when(has, F.lit(name))
    return F.when(any_match(text, GENERATION), out.otherwise(F.lit("custom"))).otherwise(F.lit("custom"))


def words_found(text: Column, words, whole: bool) -> Column:
    """Those of a fixed list of words that occur: whole words, or anywhere."""
    low = F.lower(text)
    hits = [F.when(text.rlike(rf"(?i)\b{w}\b") if whole else F.contains(low, F.lit(w)), F.lit(w)) for w in words]
    return F.array_compact(F.array(*hits))


def defined_terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r'(?i)"([^"]{2,50})"\s+(?:means|shall mean|refers to|is defined as)'), F.lit(1))


def section_summary(text: Column) -> Column:
    """The first two sentences of more than ten characters, else the first 200 characters."""
    parts = F.slice(F.filter(F.split(strip(text), r"(?<=[.!?])\s+"), lambda s: F.length(s) > 10), 1, 2)
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(F.substring(text, 1, 200))


def html_to_marked_text(html: Column) -> Column:
    """Citation spans to ``[SOURCE:id]``, other tags gone, at most one blank line, stripped."""
    cited = F.regexp_replace(html, r"""(?is)<span[^>]+data-chunk-id=["']([^"']+)["'][^>]*>.*?</span>""", "[SOURCE:$1]")
    return strip(F.regexp_replace(F.regexp_replace(cited, "<[^>]+>", ""), "\n{3,}", "\n\n"))


def clean_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"\[SOURCE:\s*([^\]]+?)\s*\]", "[SOURCE:$1]")


def markers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[SOURCE:([^\]]+)\]"), F.lit(1))


def failure_label(label: Column, n_texts: Column) -> Column:
    clean = F.replace(F.lower(strip(label)), F.lit(" "), F.lit("_"))
    return F.when(n_texts == 0, F.lit("missing_concept")).otherwise(F.when(clean.isin(*FAILURES), clean).otherwise(F.lit("buried_signal")))


def epoch_seconds(text: Column) -> Column:
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(text)), F.lit(0))


def cache_key(provider: Column, model: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", provider, model, F.sha2(text.cast("binary"), 256)).cast("binary"), 256)


def point_id(chunk_id: Column) -> Column:
    """The first eight bytes of SHA-256 without the top bit."""
    unsigned = F.conv(F.substring(F.sha2(chunk_id.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    half = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(unsigned >= half, unsigned - half).otherwise(unsigned).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 when a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
