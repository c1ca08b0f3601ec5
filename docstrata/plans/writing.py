"""Generated documents over the supplied tables: sections, signatures, citations, versions, intents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstrata.functions import text as T
from docstrata.operators import drafts, numbering
from docstrata.plans.registry import query
from docstrata.sources import views as V

_WS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
_HTML = "html || '<span class=\"c\" data-chunk-id=\"p' || page_id || '\">quoted' || chr(10) || 'twice</span>' || chr(10) || chr(10) || chr(10) || chr(10) || '<b>end</b>'"
# Whole texts as markdown: by its length a line is a heading (of a section of the template, or of its own words), gets a
# sentence with duties, parties and a defined term, or stays.
_MARKDOWN = (
    "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN length(l) % 5 = 0 AND length(l) > 0 THEN repeat('#', CAST(1 + length(l) // 5 % 3 AS INTEGER)) || ' ' || CASE length(l) // 15 % 6 WHEN 0 THEN 'Project Overview' WHEN 1 THEN 'Deliverables' WHEN 2 THEN 'Timeline & Milestones' WHEN 3 THEN 'payment TERMS' ELSE trim(substring(l, 1, 30)) END "
    "WHEN length(l) % 5 = 1 THEN l || ' The vendor shall deliver; the client MUST not wait. \"' || substring(l, 1, 12) || '\" means a thing.' ELSE l END), chr(10)) AS text FROM documents"
)
_LINES = f"md AS ({_MARKDOWN}), ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM md), " + (
    rf"hd AS (SELECT *, nullif(length(regexp_extract(line, '^(#{{1,3}})\s+.+$', 1)), 0) AS level, nullif(regexp_replace(regexp_extract(line, '^#{{1,3}}\s+(.+)$', 1), '^{_WS}+|{_WS}+$', '', 'g'), '') AS title FROM ln)"
)
def _sections(kind: str) -> str:
    return (
        f"{_LINES}, nb AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY i) AS section_no FROM hd), bd AS (SELECT doc_id, section_no, lower(arg_min(title, i)) AS low, string_agg(line, chr(10) ORDER BY i) AS text FROM nb WHERE section_no > 0 GROUP BY 1, 2), "
        "si AS (SELECT *, CASE "
        + " ".join(f"WHEN contains(low, '{label.lower()}') OR contains('{label.lower()}', low) THEN '{name}'" for name, label in drafts.template(kind))
        + r" ELSE regexp_replace(regexp_replace(low, '[^\p{L}\p{N}_]+', '_', 'g'), '^_+|_+$', '', 'g') END AS section_id FROM bd), "
        "sc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY section_no DESC) AS k FROM si) WHERE k = 1)"
    )


_SECTIONS = _sections("sow")
_RULES = (
    "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i)\\b{w}\\b') THEN '{w}' END" for w in T.DEONTIC) + "], lambda x: x IS NOT NULL), ',')",
    "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in T.PARTIES) + "], lambda x: x IS NOT NULL), ',')",
    r"""array_to_string(regexp_extract_all(text, '(?i)"([^"]{2,50})"\s+(?:means|shall mean|refers to|is defined as)', 1), ',')""",
)


def _first_hit(column: str, groups, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({column}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in groups) + f" ELSE '{default}' END"


def _markdown(spark, d):
    def line(x):
        n = F.length(x)
        own = F.when(F.floor(n / 15) % 6 == 0, "Project Overview").when(F.floor(n / 15) % 6 == 1, "Deliverables").when(F.floor(n / 15) % 6 == 2, "Timeline & Milestones").when(F.floor(n / 15) % 6 == 3, "payment TERMS").otherwise(F.trim(F.substring(x, 1, 30)))
        ruled = F.concat(x, F.lit(' The vendor shall deliver; the client MUST not wait. "'), F.substring(x, 1, 12), F.lit('" means a thing.'))
        return F.when((n % 5 == 0) & (n > 0), F.concat(F.repeat(F.lit("#"), (F.floor(n / 5) % 3 + 1).cast("int")), F.lit(" "), own)).when(n % 5 == 1, ruled).otherwise(x)

    return V.read(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query("x1_html_to_marked_text", rf"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<span[^>]+data-chunk-id=[\"'']([^\"'']+)[\"''][^>]*>.*?</span>', '[SOURCE:\1]', 'gis'), '<[^>]+>', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')) AS digest FROM (SELECT page_id, {_HTML} AS h FROM pages)")
def x1(spark, d):
    extra = F.concat(F.lit('<span class="c" data-chunk-id="p'), "page_id", F.lit('">quoted\ntwice</span>\n\n\n\n<b>end</b>'))
    return V.read(spark, d, "pages").select("page_id", F.md5(T.html_to_marked_text(F.concat("html", extra))).alias("digest"))


@query("x2_x3_markers", r"WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(\w+)\. ', '[SOURCE:  \1 ] ', 'g'), '\[SOURCE:\s*([^\]]+?)\s*\]', '[SOURCE:\1]', 'g') AS c FROM documents) SELECT doc_id, md5(c) AS cleaned, array_to_string(regexp_extract_all(c, '\[SOURCE:([^\]]+)\]', 1), ',') AS ids FROM m")
def x2(spark, d):
    """Each word before a full stop becomes a marker with spaces in it."""
    clean = T.clean_markers(F.regexp_replace("text", r"(\w+)\. ", "[SOURCE:  $1 ] "))
    return V.read(spark, d, "documents").select("doc_id", F.md5(clean).alias("cleaned"), F.array_join(T.markers(clean), ",").alias("ids"))


@query("x4_section_summary", rf"WITH s AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 10)[1:2] AS p FROM documents) SELECT doc_id, md5(CASE WHEN len(p) > 0 THEN array_to_string(p, ' ') ELSE substring(text, 1, 200) END) AS digest FROM s")
def x4(spark, d):
    return V.read(spark, d, "documents").select("doc_id", F.md5(T.section_summary(F.col("text"))).alias("digest"))


@query("x5_sections", f"WITH {_SECTIONS} SELECT doc_id, section_id, CAST(section_no AS INTEGER) AS section_no, md5(text) AS digest FROM sc")
def x5(spark, d):
    return drafts.sections(_markdown(spark, d)).select("doc_id", "section_id", F.col("section_no").cast("int").alias("section_no"), F.md5("text").alias("digest"))


@query(
    "x11_section_signatures",
    f"WITH {_SECTIONS}, t AS (SELECT * FROM (VALUES ('overview', 'executive_summary'), ('scope_of_work', 'scope_statement'), ('deliverables', 'deliverable'), ('timeline', 'timeline'), ('acceptance_criteria', 'acceptance_criterion'), ('payment_terms', 'financial'), ('assumptions', 'assumption_risk')) v(section_id, section_type)), "
    "w AS (SELECT d.doc_id, t.section_id, t.section_type, coalesce(sc.text, '') AS text FROM documents d CROSS JOIN t LEFT JOIN sc ON sc.doc_id = d.doc_id AND sc.section_id = t.section_id) "
    f"SELECT doc_id, section_id, section_type, {_RULES[0]} AS obligations, {_RULES[1]} AS parties, {_RULES[2]} AS terms FROM w",
)
def x11(spark, d):
    return drafts.signatures(_markdown(spark, d)).select("doc_id", "section_id", "section_type", "obligations", "parties", "terms")


_KINDS = ("BRD", "prd", "custom", "letter")  # the last is no type, so it counts as custom


def _of_kinds(body) -> str:
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, * FROM ({body(kind)})" for kind in _KINDS)


def _wished(kind: str) -> str:
    rows = ", ".join(f"('{name}', '{title}')" for name, title in drafts.template(kind))
    return (
        f"WITH {_sections(kind)}, t AS (SELECT section_id, {_first_hit("lower(section_id || ' ' || title)", T.SECTION_TYPES, 'general')} AS section_type FROM (VALUES {rows}) v(section_id, title)), "
        "w AS (SELECT d.doc_id, t.section_id, t.section_type, coalesce(sc.text, '') AS text FROM documents d CROSS JOIN t LEFT JOIN sc ON sc.doc_id = d.doc_id AND sc.section_id = t.section_id) "
        f"SELECT doc_id, section_id, section_type, {_RULES[0]} AS obligations, {_RULES[1]} AS parties, {_RULES[2]} AS terms FROM w"
    )


def _each_kind(spark, d, of):
    out = None
    for kind in _KINDS:
        part = of(_markdown(spark, d), kind).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("x6_sections_of_all_types", _of_kinds(lambda kind: f"WITH {_sections(kind)} SELECT doc_id, CAST(section_no AS INTEGER) AS section_no, section_id, md5(text) AS digest FROM sc"))
def x6_kinds(spark, d):
    return _each_kind(spark, d, drafts.sections).select("kind", "doc_id", F.col("section_no").cast("int").alias("section_no"), "section_id", F.md5("text").alias("digest"))


@query("x11_signatures_of_all_types", _of_kinds(_wished))
def x11_kinds(spark, d):
    return _each_kind(spark, d, drafts.signatures).select("kind", "doc_id", "section_id", "section_type", "obligations", "parties", "terms")


@query("x7_section_types", f"SELECT page_id, {_first_hit('lower(html)', T.SECTION_TYPES, 'general')} AS section_type FROM pages")
def x7(spark, d):
    return V.read(spark, d, "pages").select("page_id", T.first_hit(F.lower("html"), T.SECTION_TYPES, "general").alias("section_type"))


@query("x8_x9_x10_rules", f"WITH md AS ({_MARKDOWN}) SELECT doc_id, {_RULES[0]} AS deontic, {_RULES[1]} AS parties, {_RULES[2]} AS terms FROM md")
def x8(spark, d):
    x = F.col("text")
    return _markdown(spark, d).select("doc_id", F.array_join(T.words_found(x, T.DEONTIC, True), ",").alias("deontic"), F.array_join(T.words_found(x, T.PARTIES, False), ",").alias("parties"), F.array_join(T.defined_terms(x), ",").alias("terms"))


_AT = ", ".join(f"max(CASE WHEN level <= {n} THEN i END) OVER w AS l{n}, max(CASE WHEN level = {n} THEN i END) OVER w AS a{n}, last_value(CASE WHEN level = {n} THEN title END IGNORE NULLS) OVER w AS t{n}" for n in (1, 2, 3))


@query("x12_heading_paths", f"WITH {_LINES}, ap AS (SELECT doc_id, i, level, {_AT} FROM hd WHERE level IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, concat_ws(' > ', " + ", ".join(f"CASE WHEN level >= {n} AND a{n} = l{n} THEN t{n} END" for n in (1, 2, 3)) + ") AS path FROM ap")
def x12(spark, d):
    from pyspark.sql import Window

    paths = drafts.heading_paths(_markdown(spark, d))
    return paths.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).cast("long").alias("k"), "path")


@query("x13_document_assembly", "SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS position, md5('## ' || doc_id || chr(10) || chr(10) || regexp_replace(text, '^" + _WS + "+|" + _WS + "+$', '', 'g')) AS part FROM documents")
def x13(spark, d):
    """The parts of each source's document in their order, as rows: a source may hold a third of all texts."""
    numbered = numbering.numbers_within(V.read(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", "position")
    parts = V.read(spark, d, "documents").select("doc_id", F.md5(F.concat(F.lit("## "), "doc_id", F.lit("\n\n"), T.strip(F.col("text")))).alias("part"))
    return numbered.join(parts, "doc_id").select("source", "position", "part")


@query("x14_section_overlap", r"WITH s AS (SELECT DISTINCT n_name AS title FROM nation), w AS (SELECT title, list_distinct(list_filter(regexp_split_to_array(lower(title || ' the and'), '[^\p{L}\p{N}_]+'), lambda x: length(x) > 2)) AS k FROM s), b AS (SELECT item_id, list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS t FROM benchmark) SELECT title, item_id, round(len(list_intersect(k, t)) / len(k), 6) AS score FROM w CROSS JOIN b")
def x14(spark, d):
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"))
    s = V.read(spark, d, "nation").select(F.col("n_name").alias("title")).distinct().withColumn("k", F.filter(words(F.concat("title", F.lit(" the and"))), lambda w: F.length(w) > 2))
    b = V.read(spark, d, "benchmark").select("item_id", words(F.col("text")).alias("t"))
    return b.crossJoin(F.broadcast(s)).select("title", "item_id", F.round(F.size(F.array_intersect("k", "t")) / F.size("k"), 6).alias("score"))  # 25 sections


@query("x15_section_pick", r"WITH t AS (SELECT * FROM (VALUES (0, 'of the'), (1, 'and other things'), (2, 'was there')) v(k, title)), m AS (SELECT conv_id, turn, list_distinct(regexp_split_to_array(lower(text), '\s+')) AS w FROM conversations), s AS (SELECT conv_id, turn, k, len(list_intersect(w, string_split(title, ' '))) AS n FROM m CROSS JOIN t) SELECT conv_id, turn, arg_max(k, (n, -k)) AS section FROM s GROUP BY 1, 2")
def x15(spark, d):
    t = F.array(*(F.struct(F.lit(i).alias("k"), F.array(*map(F.lit, x.split())).alias("w")) for i, x in enumerate(("of the", "and other things", "was there"))))
    m = V.read(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("words"), F.explode(t).alias("t"))
    n = F.size(F.array_intersect("words", "t.w"))
    return m.groupBy("conv_id", "turn").agg(F.max_by("t.k", F.struct(n, -F.col("t.k"))).alias("section"))


_EDIT = " OR ".join(f"contains(lower(text), '{w}')" for w in T.EDIT_WORDS)


@query("x16_edit_intent", f"SELECT conv_id, turn, {_EDIT} AS edit FROM conversations")
def x16(spark, d):
    hit = F.exists(F.array(*map(F.lit, T.EDIT_WORDS)), lambda w: F.contains(F.lower("text"), w))
    return V.read(spark, d, "conversations").select("conv_id", "turn", hit.alias("edit"))


_GEN = " OR ".join(f"regexp_matches(q, '(?i){p}')" for p in T.GENERATION)


@query("x17_generation_intent", f"WITH s AS (SELECT conv_id, turn, text || CASE (conv_id + turn) % 4 WHEN 0 THEN ' please write a new BRD' WHEN 1 THEN ' draft our statement of work' WHEN 2 THEN ' generate the plan' ELSE '' END AS q FROM conversations) SELECT conv_id, turn, {_GEN} AS generates, CASE WHEN NOT ({_GEN}) THEN 'custom' WHEN regexp_matches(q, '(?i)\\bbrd\\b|\\bbusiness requirements?\\b') THEN 'brd' WHEN regexp_matches(q, '(?i)\\bsow\\b|\\bstatement of work\\b') THEN 'sow' WHEN regexp_matches(q, '(?i)\\bprd\\b|\\bproduct requirements?\\b') THEN 'prd' ELSE 'custom' END AS kind FROM s")
def x17(spark, d):
    n = (F.col("conv_id") + F.col("turn")) % 4
    q = F.concat("text", F.when(n == 0, " please write a new BRD").when(n == 1, " draft our statement of work").when(n == 2, " generate the plan").otherwise(""))
    return V.read(spark, d, "conversations").select("conv_id", "turn", T.any_match(q, T.GENERATION).alias("generates"), T.document_type(q).alias("kind"))


_SAID = ("X refers to Y", "Belongs TO", "leads to and is together with", "appears with", "in contrast", "")


@query("g4_relation_normalisation", "WITH s AS (SELECT conv_id, turn, lower(text || ' ' || CASE length(text) % 6 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_SAID)) + f" END) AS low FROM conversations) SELECT conv_id, turn, {_first_hit('low', T.RELATIONS, 'RELATED_TO')} AS relation FROM s")
def g4(spark, d):
    """Whole turns, with words of a relation at the end by their length."""
    said = F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, _SAID)), (F.length("text") % 6 + 1).cast("int")))
    return V.read(spark, d, "conversations").select("conv_id", "turn", T.first_hit(F.lower(said), T.RELATIONS, "RELATED_TO").alias("relation"))


@query("j12_citations", "WITH c AS (SELECT chunk_id, doc_id, row_number() OVER (ORDER BY chunk_id) AS k FROM v_chunks) SELECT doc_id AS citing, CASE WHEN k % 7 = 0 THEN 'none' || chunk_id ELSE chunk_id END AS chunk_id, k % 7 <> 0 AS known FROM c", "v_chunks")
def j12(spark, d):
    chunks = V.chunks(spark, d)
    ranked = _numbered(chunks)
    mark = F.concat(F.lit("cited [SOURCE: "), F.when(F.col("k") % 7 == 0, F.lit("none")).otherwise(F.lit("")), "chunk_id", F.lit(" ]"))
    return drafts.citations(ranked.select("doc_id", mark.alias("text")), chunks).select("citing", "chunk_id", "known")


def _numbered(chunks):
    """Chunks numbered over the whole table by id: range partitions, with the sizes of those before added."""
    return numbering.row_numbers(chunks.select("chunk_id", "doc_id"), "chunk_id", "k")


@query("d1_version_history", "SELECT document_id, version_no, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version_no DESC) AS k FROM v_versions) WHERE k <= 20", "v_versions")
def d1(spark, d):
    from docstrata.operators import quality

    return quality.newest(V.versions(spark, d), "document_id", "version_no", 20, "doc_id").select("document_id", "version_no", "doc_id")


@query("d2_version_delta", "WITH l AS (SELECT document_id, version_no, line, count(*) AS n FROM (SELECT document_id, version_no, unnest(string_split(text, chr(10))) AS line FROM v_versions) GROUP BY 1, 2, 3), b AS (SELECT l.document_id, l.version_no + 1 AS version_no, line, n FROM l JOIN v_versions v ON v.document_id = l.document_id AND v.version_no = l.version_no + 1), j AS (SELECT coalesce(l.document_id, b.document_id) AS document_id, coalesce(l.version_no, b.version_no) AS version_no, coalesce(l.n, 0) AS n, coalesce(b.n, 0) AS m FROM l FULL JOIN b ON l.document_id = b.document_id AND l.version_no = b.version_no AND l.line = b.line) "
       "SELECT document_id, version_no, CAST(sum(greatest(n - m, 0)) AS BIGINT) AS added, CAST(sum(greatest(m - n, 0)) AS BIGINT) AS removed FROM j WHERE version_no > 1 GROUP BY 1, 2", "v_versions")
def d2(spark, d):
    return drafts.version_delta(V.versions(spark, d))


@query("w3_next_version", "SELECT document_id, count(*) + 1 AS next_version FROM v_versions GROUP BY 1", "v_versions")
def w3(spark, d):
    return V.versions(spark, d).groupBy("document_id").agg((F.count(F.lit(1)) + 1).alias("next_version"))


@query("w5_previous_section", "SELECT document_id, version_no, lag(doc_id) OVER (PARTITION BY document_id ORDER BY version_no) AS previous_doc FROM v_versions", "v_versions")
def w5(spark, d):
    """By an equality join: a document may have very many versions."""
    v = V.versions(spark, d).select("document_id", "version_no", "doc_id")
    before = v.select("document_id", (F.col("version_no") + 1).alias("version_no"), F.col("doc_id").alias("previous_doc"))
    return v.join(before, ["document_id", "version_no"], "left").select("document_id", "version_no", "previous_doc")
