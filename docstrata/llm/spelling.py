"""Spelling variants: words of a table's vocabulary that differ by one letter, found in bidirectional FM-indexes.

If two words differ by one letter inserted, deleted or replaced, one half of either stands unchanged in the other. So
a word is searched twice: its first half exactly behind a delimiter, then onward over the rest with one error; and its
second half exactly before a delimiter, then backward over the first half with one error. The vocabulary is cut into
ranges of its alphabetical order, and for the second search of the order of the reversed words: the words that begin
(or end) with a half are a run of ranges, so a word goes to those alone, and every range holds about as many letters.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.shared import forget, table

RANGE_LETTERS = 400_000  # of the words that one index holds; a longer word has an index of its own
_QUERIES = 8_192  # searched side by side
_BOUND = 40  # letters of a range's ends that the routing looks at
_LAST = "\U0010ffff"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3, typos: int = 97) -> DataFrame:
    """``word`` and its number of occurrences ``n`` over all whole texts.

    Words are runs of ASCII and Latin-1 letters with A-Z lowered; where ``typos`` divides h, the unsigned CRC-32 of the
    UTF-8 bytes of ``<id>:<word>``, the letter at h modulo the length is left out. Words of fewer than ``least_letters`` letters
    or ``least_count`` occurrences are left out. Null texts count as empty, a null id as an empty string; repeated rows count again;
    an empty table has no words; other columns are not read.
    """
    low = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % typos == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _rotations(codes: np.ndarray, kinds: int) -> np.ndarray:
    """Starts of all rotations of ``codes`` in order, by doubling the length that is compared."""
    n, bits = len(codes), max(1, int(kinds - 1).bit_length())
    wide = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(wide):
        key = (key << bits) | np.roll(codes, -j)
    while True:
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        if new[order[-1]] == n - 1:
            return order
        key = new * n + np.roll(new, -wide)
        wide *= 2


class _Side:
    """A Burrows-Wheeler transform with the number of each letter, and of smaller letters, before any place."""

    def __init__(self, codes: np.ndarray, kinds: int):
        self.bwt = np.roll(codes, 1)[_rotations(codes, kinds)].astype(np.int32)
        self.blocks = len(codes) // 64 + 1
        padded = np.full(self.blocks * 64, kinds, np.int32)
        padded[: len(codes)] = self.bwt
        self.equal, self.less = self._counts(padded, kinds, np.equal), self._counts(padded, kinds, np.less)

    def _counts(self, padded, kinds, compare):
        masks = np.zeros((kinds + 1, self.blocks), np.uint64)  # the last row is of a letter that does not occur
        for c in range(kinds):
            masks[c] = np.packbits(compare(padded, c), bitorder="little").view("<u8")
        held = np.bitwise_count(masks).astype(np.int32)
        before = np.cumsum(held, axis=1, dtype=np.int32) - held
        return masks.ravel(), before.ravel()

    def count(self, of, letters: np.ndarray, places: np.ndarray) -> np.ndarray:
        masks, before = of
        at = letters * self.blocks + (places >> 6)
        inside = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return before[at] + np.bitwise_count(masks[at] & inside)


class TwoWayIndex:
    """A bidirectional FM-index over sorted, distinct words, each between delimiters.

    A pattern is a state of three numbers: where its rotations begin among those of the text, where its reversal's begin
    among those of the reversed text, and how many there are. ``left`` and ``right`` add a letter at either end and keep all three.
    As the delimiter is the smallest letter, the rank of a word between delimiters is the word's place in the list, plus one.
    """

    def __init__(self, words: list[str]):
        self.words = words
        text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
        self.alphabet, codes = np.unique(text, return_inverse=True)
        codes = codes.astype(np.int64)
        self.kinds, self.size = len(self.alphabet), len(codes)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=self.kinds))])
        self.ahead, self.behind = _Side(codes, self.kinds), _Side(codes[::-1].copy(), self.kinds)

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of all texts, each with a delimiter behind it, and where each text begins; unknown letters are ``kinds``."""
        raw = np.frombuffer("".join([t + "\0" for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")
        place = np.minimum(np.searchsorted(self.alphabet, raw), self.kinds - 1)
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
        return np.where(self.alphabet[place] == raw, place, self.kinds).astype(np.int64), starts

    def _extend(self, side: _Side, letters, low, other, size):
        begin = side.count(side.equal, letters, low)
        width = side.count(side.equal, letters, low + size) - begin
        smaller = side.count(side.less, letters, low + size) - side.count(side.less, letters, low)
        return self.first[letters] + begin, other + smaller, width

    def left(self, letters, f, g, size):
        return self._extend(self.ahead, letters, f, g, size)

    def right(self, letters, f, g, size):
        g, f, size = self._extend(self.behind, letters, g, f, size)
        return f, g, size

    def _letters_after(self, rightward: bool, f, g, size):
        """(state, letter) for each letter that can follow in a state: read off short intervals, tried over long ones."""
        side, low = (self.behind, g) if rightward else (self.ahead, f)
        short = np.flatnonzero(size <= self.kinds)
        lengths = size[short]
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        state = np.repeat(short, lengths)
        pairs = np.unique(state * (self.kinds + 1) + side.bwt[low[state] + inside])
        long = np.flatnonzero(size > self.kinds)
        tried = (long[:, None] * (self.kinds + 1) + np.arange(self.kinds)).ravel()
        pairs = np.concatenate([pairs, tried])
        return pairs // (self.kinds + 1), pairs % (self.kinds + 1)

    def near(self, queries: list[str], by_start: bool, known: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) places of all words one letter away whose error lies in the second half (``by_start``) or the first.

        ``known``: the queries are words of this index, so a path that only one word has left is the query's own.
        """
        halves = [(q[: len(q) // 2], q[len(q) // 2 :]) for q in queries]
        exact, starts = self.codes([a[::-1] if by_start else b for a, b in halves])
        rest, begins = self.codes([b if by_start else a[::-1] for a, b in halves])
        ends = np.concatenate([starts[1:], [len(exact)]])
        step, onward = (self.left, self.right) if by_start else (self.right, self.left)
        q = np.arange(len(queries))
        f, g, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.size, np.int64)
        at, done = 0, []
        while len(q):  # the exact half and its delimiter
            more = starts[q] + at < ends[q]
            done.append((q[~more], f[~more], g[~more], size[~more]))
            q, f, g, size = q[more], f[more], g[more], size[more]
            f, g, size = step(exact[starts[q] + at], f, g, size)
            q, f, g, size = (x[size > 0] for x in (q, f, g, size))
            at += 1
        q, f, g, size = (np.concatenate(x) for x in zip(*done))
        pool = tuple(np.zeros(0, np.int64) for _ in range(5))  # with one error: query, place in its rest, state
        found, at = [], 0
        while len(q) or len(pool[0]):
            if known:
                q, f, g, size = (x[size > 1] for x in (q, f, g, size))
            x = rest[begins[q] + at]
            inner = x != 0
            following = rest[np.minimum(begins[q] + at + 1, len(rest) - 1)]
            skip = inner & (x != following)  # one of equal letters is left out once, as the last of them
            state, letter = self._letters_after(by_start, f, g, size)
            other = (letter != 0) & (letter != x[state])
            state, letter = state[other], letter[other]
            ef, eg, esize = onward(letter, f[state], g[state], size[state])
            new = [(q[skip], np.full(skip.sum(), at + 1), f[skip], g[skip], size[skip])]
            for chosen, place in (((esize > 0), at), ((esize > 0) & inner[state], at + 1)):  # inserted before x, or in its place
                new.append((q[state[chosen]], np.full(chosen.sum(), place), ef[chosen], eg[chosen], esize[chosen]))
            pool = tuple(np.concatenate(parts) for parts in zip(pool, *new))
            q, f, g, size, x = (y[inner] for y in (q, f, g, size, x))
            f, g, size = onward(x, f, g, size)
            q, f, g, size = (y[size > 0] for y in (q, f, g, size))
            pq, place, pf, pg, psize = pool
            letter = rest[begins[pq] + place]
            pf, pg, psize = onward(letter, pf, pg, psize)
            whole = (psize > 0) & (letter == 0)
            found.append((pq[whole], pf[whole] - 1))
            on = (psize > 0) & (letter != 0)
            pool = pq[on], place[on] + 1, pf[on], pg[on], psize[on]
            at += 1
        who, word = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not by_start and len(who):  # the error may also count as one of the second half: the other search has these
            mine = np.array([not self.words[w].startswith(halves[i][0]) for i, w in zip(who.tolist(), word.tolist())])
            who, word = who[mine], word[mine]
        return who, word


def _ranges(vocab: DataFrame, by_start: bool, letters: int):
    """The words in ranges of the order of their starts or ends: a table (shard, word, n), its path, and the ends of each range."""
    key = F.col("word") if by_start else F.reverse("word")
    total = vocab.agg(F.sum(F.length("word") + 1).alias("n")).first()["n"] or 0
    cuts = max(1, -(-total // letters))

    def number(batches):
        part, sub, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            shards = []
            for word in batch.column("word").to_pylist():
                if held and held + len(word) + 1 > 2 * letters:
                    sub, held = sub + 1, 0
                held += len(word) + 1
                shards.append(part + sub)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), batch.column("word"), batch.column("n")], names=["shard", "word", "n"])

    dealt, path = table(
        vocab.select("word", "n", key.alias("key")).repartitionByRange(cuts, "key").sortWithinPartitions("key").select("word", "n")
        .mapInArrow(number, "shard long, word string, n long")
    )
    ends = dealt.groupBy("shard").agg(F.substring(F.min(key), 1, _BOUND).alias("low"), F.substring(F.max(key), 1, _BOUND).alias("high")).collect()
    return dealt, path, sorted((r["low"], r["high"] + _LAST, r["shard"]) for r in ends)


def _search(vocab: DataFrame, by_start: bool, letters: int, pairs: bool) -> tuple[DataFrame, str]:
    """One of the two searches for all words; rows as ``near_words`` or, for ``variants``, what each range says of a word."""
    dealt, path, ends = _ranges(vocab, by_start, letters)
    lows, highs, shards = [e[0] for e in ends], [e[1] for e in ends], [e[2] for e in ends]

    def route(batches):
        for batch in batches:
            to, guest, place = [], [], []
            for i, (own, word) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("word").to_pylist())):
                half = word[: len(word) // 2] if by_start else word[len(word) // 2 :][::-1]
                for k in range(bisect.bisect_left(highs, half), bisect.bisect_right(lows, half + _LAST)):
                    to.append(shards[k])
                    guest.append(shards[k] != own)
                    place.append(i)
            rows = batch.take(pa.array(place, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(guest, pa.bool_()), rows.column("word"), rows.column("n")], names=["shard", "guest", "word", "n"])

    def found(index, counts, words, own_n, known):
        """Rows of queries against an index; words of the index answer even if they have no near word."""
        for low in range(0, len(words), _QUERIES):
            part = words[low : low + _QUERIES]
            who, near = index.near(part, by_start, known)
            if pairs:
                yield [part[i] for i in who], [index.words[w] for w in near], counts[near]
                continue
            order = np.lexsort((near, -counts[near], who))  # places are in code-point order
            who, near = who[order], near[order]
            asked, best, n_near = np.unique(who, return_index=True, return_counts=True)
            form = dict(zip(asked.tolist(), zip(n_near.tolist(), near[best].tolist())))
            rows = range(len(part)) if known else asked.tolist()
            hits = [form.get(i, (0, -1)) for i in rows]
            yield (
                [part[i] for i in rows], [own_n[low + i] for i in rows], [h[0] for h in hits],
                [index.words[h[1]] if h[0] else None for h in hits], [int(counts[h[1]]) if h[0] else None for h in hits],
            )

    types = [pa.string(), pa.string(), pa.int64()] if pairs else [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    schema = "word string, near string, near_n long" if pairs else "word string, n long, n_near long, form string, form_n long"
    names = [c.split()[0] for c in schema.split(", ")]

    def walk(batches):
        now, index, counts, held, held_n, asked, asked_n = None, None, None, [], [], [], []

        def answers(last):
            nonlocal index, counts, asked, asked_n
            if index is None and held:
                order = sorted(range(len(held)), key=held.__getitem__)
                words = [held[i] for i in order]
                index, counts = TwoWayIndex(words), np.array([held_n[i] for i in order], np.int64)
                yield from found(index, counts, words, counts.tolist(), True)
            if asked and (last or len(asked) >= _QUERIES):
                yield from found(index, counts, asked, asked_n, False)
                asked, asked_n = [], []

        def batch_of(columns):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for shard, guest, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    yield from map(batch_of, answers(True))
                    now, index, held, held_n = shard, None, [], []
                if guest:
                    asked.append(word)
                    asked_n.append(n)
                    if len(asked) >= _QUERIES:
                        yield from map(batch_of, answers(False))
                else:
                    held.append(word)
                    held_n.append(n)
        yield from map(batch_of, answers(True))

    routed = dealt.mapInArrow(route, "shard long, guest boolean, word string, n long")
    return routed.repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", "guest").mapInArrow(walk, schema), path


def near_words(vocab: DataFrame, *, range_letters: int = RANGE_LETTERS) -> DataFrame:
    """``word``, ``near`` and ``near_n``: each ordered pair of words that differ by exactly one code point inserted, deleted or replaced.

    ``vocab`` has distinct, non-null ``word`` (no NUL letters) and ``n``; words may have any length.
    """
    vocab = vocab.select("word", F.col("n").cast("long").alias("n"))
    return _search(vocab, True, range_letters, True)[0].unionByName(_search(vocab, False, range_letters, True)[0])


def _roots(links: DataFrame) -> tuple[DataFrame, str]:
    """``word`` and ``to``, the last of the forms that follow from it: each round doubles how far ``to`` has gone."""
    spark = links.sparkSession
    now, path = table(links.select("word", F.col("form").alias("to"), F.lit(True).alias("moved")))
    while now.where("moved").limit(1).count():
        ahead = now.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        after, next_path = table(now.join(ahead, "to", "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")))
        forget(spark, path)
        now, path = after, next_path
    return now.select("word", "to"), path


def variants(vocab: DataFrame, *, ratio: int = 2, range_letters: int = RANGE_LETTERS) -> DataFrame:
    """For each word of ``vocab`` (as in ``near_words``): ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``n_near`` counts the words one letter away; ``form`` is the one of largest ``n`` (ties: the smallest by code points)
    if that is at least ``ratio`` (2 or more) times the word's own, else null; ``root`` is the last of the forms that follow from the word, or
    the word. Counts at least double from form to form, so chains end after some 40 steps and are followed by doubling.
    An empty vocabulary gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or chains of forms might not end")
    spark = vocab.sparkSession
    words, path = table(vocab.select("word", F.col("n").cast("long").alias("n")))
    (starts, starts_path), (ends, ends_path) = (_search(words, by_start, range_letters, False) for by_start in (True, False))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))))
    told = starts.unionByName(ends).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed, formed_path = table(
        told.select("word", F.when(enough, F.col("best.form")).alias("form"), "n", "n_near", F.when(enough, -F.col("best.less")).alias("form_n"))
    )
    forget(spark, path, starts_path, ends_path)
    roots, _ = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame) -> DataFrame:
    """The variants of the words of all documents. Cases as in ``vocabulary`` and ``variants``."""
    return variants(vocabulary(docs))
