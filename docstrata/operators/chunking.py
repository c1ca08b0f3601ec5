"""Pages, chunks and parent groups of texts."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docstrata.functions import text as T

PAGE_CHARS = 3000
_ENDS = re.compile(r"(?<=[.!?])\s+")
CHUNK_TOKENS = {"text/plain": 512, "application/pdf": 768, "application/vnd.openxmlformats-officedocument.wordprocessingml.document": 512}


def virtual_pages(docs: DataFrame, empty: str = "(empty file)") -> DataFrame:
    """Slices of 3000 characters, stripped, numbered from 1; a blank text is one page that says so."""
    text = F.coalesce("text", F.lit(""))
    blank = T.strip(text) == ""
    last = F.when(blank, F.lit(0)).otherwise(F.floor((F.length(text) - 1) / PAGE_CHARS).cast("int"))
    rest = [c for c in docs.columns if c != "text"]
    sliced = F.when(F.col("__blank"), F.lit(empty)).otherwise(T.strip(F.substring("text", F.col("__i") * PAGE_CHARS + 1, F.lit(PAGE_CHARS))))
    return (
        docs.withColumn("__blank", blank).withColumn("__i", F.explode(F.sequence(F.lit(0), last)))
        .select(*rest, (F.col("__i") + 1).alias("page_number"), sliced.alias("text"))
    )


def paragraph_pages(paragraphs: DataFrame) -> DataFrame:
    """Paragraph table (doc_id, pos, text) to pages: non-blank paragraphs joined by line breaks, then cut like texts."""
    lines = paragraphs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"))
    joined = F.array_join(F.filter(F.transform("p", lambda p: p["text"]), lambda t: T.strip(t) != ""), "\n")
    return virtual_pages(lines.select("doc_id", joined.alias("text")), "(empty document)")


def rendered_tables(cells: DataFrame) -> DataFrame:
    """Cell table (doc_id, table_no, row_no, col_no, text) to one text for each table: ``|`` between cells, a line for each row."""
    row = cells.groupBy("doc_id", "table_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", F.trim(F.coalesce("text", F.lit(""))).alias("text")))).alias("c"))
    line = row.select("doc_id", "table_no", "row_no", F.array_join(F.transform("c", lambda c: c["text"]), " | ").alias("line"))
    table = line.groupBy("doc_id", "table_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("r"))
    return table.select("doc_id", "table_no", F.array_join(F.transform("r", lambda r: r["line"]), "\n").alias("text"))


def chunk_size(mime: Column, default: Column) -> Column:
    sizes = F.create_map(*(F.lit(x) for kv in CHUNK_TOKENS.items() for x in kv))
    return F.coalesce(F.try_element_at(sizes, mime), default)


def token_cost(text: str) -> int:
    return max(1, len(text) // 4)


def _runs(items: list[str], size: int, back: Callable[[list[int], int], int]) -> Iterator[str]:
    """Runs of items whose costs sum to at most ``size`` (one new item at least), from running totals and a search for each end.

    ``back`` says from which item on the next run repeats what came before an end.
    """
    total = [0, *accumulate(map(token_cost, items))]
    start = new = 0
    while new < len(items):
        end = max(new + 1, bisect_right(total, total[start] + size) - 1)
        yield " ".join(items[start:end])
        start, new = max(start, back(total, end)), end


def pack_sentences(parts: list[str], size: int, overlap: int) -> list[str]:
    """Chunks of at most about ``size`` estimated tokens.

    Neighbouring sentences that fit a chunk are packed together, and each chunk repeats as many of the last sentences as
    ``overlap`` tokens hold. A sentence that is longer than a chunk is packed by itself, word by word, each chunk repeating a
    few words (a fifth of ``overlap``, one at least); nothing is repeated across its borders.
    """
    few = max(1, overlap // 5)
    found: list[str] = []
    for long, group in groupby(parts, key=lambda s: token_cost(s) > size):
        if long:
            for sentence in group:
                found += _runs(sentence.split(), size, lambda _, end: end - few)
        else:
            found += _runs(list(group), size, lambda total, end: bisect_left(total, total[end] - overlap))
    return found


def packed(parts: Column, size: int, overlap: int) -> Column:
    """``pack_sentences`` as a column of an array of sentences: one pass in the JVM that holds the open chunk.

    The open chunk has at most ``size`` items, as each costs a token at least; ``old`` of them repeat the chunk before. Spark copies what a
    fold holds at each item, the finished chunks too, so this is for pages; the time grows with the square of a text. A null array gives null.
    """
    few = max(1, overlap // 5)
    item = lambda text, run: F.struct(text.alias("text"), T.token_estimate(text).alias("cost"), run.alias("run"))
    join = lambda own: F.array_join(F.transform(own, lambda x: x["text"]), " ")

    def items(sentence: Column, i: Column) -> Column:
        """The words of a sentence that is longer than a chunk, which are a run of their own, or the sentence."""
        words = F.filter(F.split(sentence, f"{T.SPACE}+"), lambda w: w != "")
        return F.when(T.token_estimate(sentence) > size, F.transform(words, lambda w: item(w, i))).otherwise(F.array(item(sentence, F.lit(-1))))

    def state(done: Column, own: Column, cost: Column, old: Column, run: Column) -> Column:
        return F.struct(done.alias("done"), own.alias("own"), cost.alias("cost"), old.alias("old"), run.alias("run"))

    def repeated(own: Column, run: Column) -> Column:
        """How many of the last items the next chunk begins with."""
        nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))
        fits = lambda a, x: F.struct((a["n"] + (a["sum"] + x["cost"] <= overlap).cast("int")).alias("n"), (a["sum"] + x["cost"]).alias("sum"))
        return F.when(run >= 0, F.least(F.lit(few), F.size(own))).otherwise(F.aggregate(F.reverse(own), nothing, fits, lambda a: a["n"]))

    def add(s: Column, x: Column) -> Column:
        own, new = s["own"], F.array(F.struct(x["text"].alias("text"), x["cost"].alias("cost")))
        closed = F.when(F.size(own) > 0, F.concat(s["done"], F.array(join(own)))).otherwise(s["done"])
        other = state(closed, new, x["cost"], F.lit(0), x["run"])
        tail = lambda n: F.slice(own, F.size(own) - n + 1, n)
        total = lambda pieces: F.aggregate(pieces, F.lit(0), lambda a, y: a + y["cost"])
        after = F.transform(F.array(repeated(own, x["run"])), lambda n: state(closed, F.concat(tail(n), new), total(tail(n)) + x["cost"], n, x["run"]))[0]
        full = (F.size(own) > s["old"]) & (s["cost"] + x["cost"] > size)
        return F.when(x["run"] != s["run"], other).when(full, after).otherwise(state(s["done"], F.concat(own, new), s["cost"] + x["cost"], s["old"], s["run"]))

    empty = state(F.array().cast("array<string>"), F.array().cast("array<struct<text:string,cost:int>>"), F.lit(0), F.lit(0), F.lit(-2))
    last = lambda s: F.when(F.size(s["own"]) > 0, F.concat(s["done"], F.array(join(s["own"])))).otherwise(s["done"])
    # the words of two long sentences that follow one another have different runs, and so are never packed together
    return F.aggregate(F.flatten(F.transform(parts, items)), empty, add, last)


class _ChunkPage:
    """Table function: a page's text, a size and an overlap to its chunks, one row for each."""

    def eval(self, text: str, size: int, overlap: float):
        sentences = [x for x in (s.strip() for s in _ENDS.split(text or "")) if x]
        for i, chunk in enumerate(pack_sentences(sentences, size, int(size * overlap))):
            yield i, chunk, token_cost(chunk)


def register_chunk_function(spark: SparkSession, name: str = "chunk_page") -> str:
    """Makes ``name(text, size, overlap)`` usable in SQL after LATERAL; gives ``part``, ``chunk`` and ``token_count``."""
    spark.udtf.register(name, F.udtf(_ChunkPage, returnType="part int, chunk string, token_count int"))
    return name


def chunk_pages(pages: DataFrame, *, size: int = 512, overlap: float = 0.1, whole: bool = False) -> DataFrame:
    """Chunks of pages (doc_id, page_number, text, and tables if there are any), tables first and whole.

    Pages of bounded length are packed in the JVM where they are read (``packed``). With ``whole`` a page may be a text of any
    length and is packed by ``pack_sentences`` in Arrow batches, in time that grows with the text alone. The running number of chunks over a
    document comes from a window. A null text has no chunks of its own.
    """
    carry, none = int(size * overlap), F.array().cast("array<string>")

    def fold(parts: pa.Array) -> pa.Array:
        return pa.array([pack_sentences(p or [], size, carry) for p in parts.to_pylist()], pa.list_(pa.string()))

    sentences = T.sentences(F.col("text"))
    parts = F.arrow_udf(fold, "array<string>")(sentences) if whole else F.coalesce(packed(sentences, size, carry), none)
    tables = F.col("tables") if "tables" in pages.columns else F.lit([]).cast("array<string>")
    cut = pages.select("doc_id", "page_number", tables.alias("tables"), parts.alias("parts"))
    before = F.coalesce(F.sum(F.size("tables") + F.size("parts")).over(Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut.withColumn("offset", before).withColumn("n_tables", F.size("tables"))
    whole = placed.select("*", F.posexplode(F.concat("tables", "parts")).alias("i", "text"))
    index = (F.col("offset") + F.col("i")).cast("int")
    is_table = F.col("i") < F.col("n_tables")
    tail = F.when(is_table, F.concat(F.lit("__table"), F.col("i"))).otherwise(F.concat(F.lit("__c"), index))
    return whole.select(
        F.concat("doc_id", F.lit("__p"), "page_number", tail).alias("chunk_id"), "doc_id", "page_number", index.alias("chunk_index"), "text",
        T.token_estimate(F.col("text")).alias("token_count"), is_table.alias("is_table"),
    )


def parent_groups(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with ``parent_id``, and the parents' texts: each four text chunks of a page that has more than three."""
    page = Window.partitionBy("doc_id", "page_number")
    text = chunks.where("not is_table")
    numbered = text.withColumn("g", F.floor((F.row_number().over(page.orderBy("chunk_index")) - 1) / 4)).withColumn("n", F.count(F.lit(1)).over(page))
    parent = F.when(F.col("n") > 3, F.concat("doc_id", F.lit("__p"), "page_number", F.lit("__parent"), "g"))
    named = numbered.withColumn("parent_id", parent).drop("g", "n")
    texts = named.where("parent_id is not null").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    return named, texts.select("parent_id", F.array_join(F.transform("c", lambda c: c["text"]), " ").alias("parent_text"))


def expand_to_parents(hits: DataFrame, named: DataFrame, parents: DataFrame) -> DataFrame:
    """Ranked hits (query_id, rank, chunk_id, score) with the parent in place of the child; only a parent's first child stays."""
    joined = hits.join(named.select("chunk_id", "parent_id", "text"), "chunk_id", "left").join(parents, "parent_id", "left")
    first = F.row_number().over(Window.partitionBy("query_id", F.coalesce("parent_id", "chunk_id")).orderBy("rank"))
    return joined.withColumn("__n", first).where("__n = 1").select("query_id", "rank", F.coalesce("parent_id", "chunk_id").alias("chunk_id"), F.coalesce("parent_text", "text").alias("text"), "score")
