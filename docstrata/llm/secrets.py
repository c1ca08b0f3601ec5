"""Secrets by a battery of randomness tests.

Candidates are the spans of fixed patterns and long runs of token characters. The smallest encoding that holds a
candidate's characters is inferred, and three statistics say how far it is from chance in that alphabet: uniformity of
its characters (chi-squared), runs of character classes, and serial correlation. What they are in ordinary writing is
counted on the table itself: all text outside candidates, read in each alphabet and cut into windows of each length.
The three empirical p-values are combined by Fisher's rule, the combination is ranked in the same windows (the tests are
not independent), and candidates are accepted by the Benjamini-Hochberg rule, with its own threshold for each class of lengths.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.shared import table

KINDS = ("assign", "access", "hex")
# Fixed: the base patterns, in the order in which kinds are listed. Letters of the words are A-Z and a-z, nothing that folds to them.
_WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = regex.compile(rf"""(?:{_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# their lengths are part of the pattern: a shorter run holds no longer match
_ACCESS = regex.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = regex.compile(r"[0-9a-f]{24,}")
_RUN = regex.compile(r"[A-Za-z0-9+/_=-]{16,}")
# Texts without a word of the first pattern, or without a run, hold no match of it, or of the others: whole texts are looked through for these first.
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_TOKEN_BYTES = bytes(49 if _RUN.fullmatch(chr(i) * 16) else 48 for i in range(256))
_ENCODINGS = (
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper_digits", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("lower_digits", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=-_."),
)
_LENGTHS = (16, 20, 24, 32, 48, 64, 128)
_SHAPE = (24, 12, 8)  # bins of the three statistics
_CELLS = math.prod(_SHAPE)
_PIECE = 1 << 16  # bytes of a long text whose windows are counted by themselves
_AT_ONCE = 1 << 19  # bytes of text whose windows are counted at once
_PRIOR = 1000.0  # windows of assumed ordinary writing, beside those that are counted


def _class(c: str) -> int:
    """Vowel, consonant, upper case, digit, other."""
    return 0 if c in "aeiou" else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4


class _Alphabet:
    def __init__(self, chars: str):
        self.chars, self.k = frozenset(chars), len(chars)
        self.code = np.full(256, 255, np.uint8)  # of bytes of ordinary writing; letters of the other case count if only one is there
        for i, c in enumerate(chars):
            self.code[ord(c)] = i
            if c.swapcase() not in chars:
                self.code[ord(c.swapcase())] = i
        self.table, self.others = self.code.tobytes(), np.flatnonzero(self.code == 255).astype(np.uint8).tobytes()
        self.cls = np.array([_class(c) for c in chars], np.int8)
        self.classes = bytes(self.cls) + bytes(256 - self.k)  # a table of codes
        share = np.bincount(self.cls, minlength=5) / self.k
        self.change = 1 - float((share**2).sum())

    def statistics(self, codes: np.ndarray) -> np.ndarray:
        """Rows of equally long tokens to rows of (chi-squared, runs, serial correlation), standardised: 0 is what chance gives."""
        v, (rows, n) = codes.astype(np.int64), codes.shape
        own = self.cls[codes]
        counts = np.bincount((v + np.arange(rows)[:, None] * self.k).ravel(), minlength=rows * self.k).reshape(rows, self.k)
        squares = (counts**2).sum(1)
        serial = _serial(n, v.sum(1), (v * v).sum(1), (v[:, 1:] * v[:, :-1]).sum(1), v[:, 0] + v[:, -1])
        return np.c_[self.chi(n, squares), self.runs(n, (own[:, 1:] != own[:, :-1]).sum(1)), serial]

    def chi(self, n: int, squares: np.ndarray) -> np.ndarray:
        """Uniformity from the sum of squares of how often each character is there."""
        return (squares * self.k / n - n - (self.k - 1)) / math.sqrt(2 * (self.k - 1))

    def runs(self, n: int, changes: np.ndarray) -> np.ndarray:
        if not self.change:
            return np.zeros(len(changes))
        return np.abs(changes - self.change * (n - 1)) / math.sqrt(self.change * (1 - self.change) * (n - 1))


def _equal_pairs(columns: np.ndarray, halves: np.ndarray | None = None) -> np.ndarray:
    """Pairs of equal characters of each window of at most 256; ``columns`` has a row of bytes for each place in the windows.

    ``halves``: the pairs inside both halves of each window, if they are known; then only pairs across are compared.
    """
    out = np.zeros(columns.shape[1], np.uint16) if halves is None else halves
    half = len(columns) // 2
    for lag in range(1, len(columns)) if halves is None else range(half):
        if halves is None:
            out += (columns[lag:] == columns[:-lag]).view(np.uint8).sum(0, dtype=np.uint8)
        else:
            out += (columns[: half - lag] == columns[half + lag :]).view(np.uint8).sum(0, dtype=np.uint8)
            out += (columns[half - lag : half] == columns[half : half + lag]).view(np.uint8).sum(0, dtype=np.uint8)
    return out


def _serial(n: int, total: np.ndarray, squares: np.ndarray, products: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Serial correlation from sums of codes, of their squares and of products of neighbours; ``ends``: first and last code."""
    total, squares, products = (x.astype(np.float64) for x in (total, squares, products))
    square = total * total
    spread = n * (n * squares - square)
    with_next = n * n * products - n * (2 * square - total * ends) + (n - 1) * square
    return np.where(spread > 0, np.abs(with_next) / np.maximum(spread, 1), 1.0) * math.sqrt(n)


_ALPHABETS = [_Alphabet(chars) for _, chars in _ENCODINGS]
# alphabets that give the same bytes the same codes, and differ in the classes of characters
_STREAMS = [tuple(i for i, b in enumerate(_ALPHABETS) if np.array_equal(a.code, b.code)) for at, a in enumerate(_ALPHABETS) if not any(np.array_equal(a.code, b.code) for b in _ALPHABETS[:at])]


def _cells(stats: np.ndarray) -> np.ndarray:
    """The cell of each row of statistics; lower bins are closer to chance."""
    chi = np.clip(np.floor(stats[:, 0]) + 3, 0, _SHAPE[0] - 1)
    runs, serial = (np.clip(np.floor(stats[:, j] * 2), 0, _SHAPE[j] - 1) for j in (1, 2))
    return ((chi * _SHAPE[1] + runs) * _SHAPE[2] + serial).astype(np.int64)


def battery(token: str) -> tuple[int, int]:
    """Place (length class and inferred encoding) and cell (binned statistics) of a token of 6 characters or more."""
    own = next((i for i, a in enumerate(_ALPHABETS) if a.chars.issuperset(token)), len(_ALPHABETS) - 1)
    codes = np.minimum(_ALPHABETS[own].code[np.frombuffer(token.encode("ascii", "replace"), np.uint8)], _ALPHABETS[own].k - 1)
    length = max(0, int(np.searchsorted(_LENGTHS, len(token), "right")) - 1)
    return length * len(_ENCODINGS) + own, int(_cells(_ALPHABETS[own].statistics(codes[None].astype(np.int64)))[0])


def candidates(text: str | None) -> list[tuple]:
    """(kind, start, end, base, place, cell) of one text's candidates, by start and kind; offsets are code points."""
    text = text or ""
    raw, found = text.encode("utf-8", "surrogatepass"), []
    lower = raw.lower() if b"=" in raw or b":" in raw else b""
    for m in _ASSIGN.finditer(text) if any(n in lower for n in _NAMES) else ():
        if len(m[1]) >= 6:
            found.append(("assign", m.start(), m.end(), True, m[1]))
    runs = b"1" * 16 in raw.translate(_TOKEN_BYTES)
    found += [("access", m.start(), m.end(), True, m[0]) for m in (_ACCESS.finditer(text) if runs else ())]
    found += [("hex", m.start(), m.end(), True, m[0]) for m in (_HEX.finditer(text) if runs else ())]
    base = sorted((s, e) for _, s, e, _, _ in found)
    at = 0
    for m in _RUN.finditer(text) if runs else ():
        while at < len(base) and base[at][1] <= m.start():
            at += 1
        if at == len(base) or base[at][0] >= m.end():
            found.append(("random", m.start(), m.end(), False, m[0]))
    out = [(kind, start, end, is_base, *battery(token)) for kind, start, end, is_base, token in found]
    return sorted(out, key=lambda x: (x[1], (*KINDS, "random").index(x[0])))


def _sums(values: np.ndarray) -> np.ndarray:
    """Running sums from 0. Those that pass 32 bits wrap around, which leaves sums of windows as they are."""
    out = np.zeros(len(values) + 1, np.int32)
    np.cumsum(values, dtype=np.int32, out=out[1:])
    return out


def ordinary(texts: list[tuple[str, list[tuple]]]) -> dict[int, int]:
    """How many windows of the texts, outside their candidates, fall into each cell of each place (place * cells + cell).

    All text is read in each alphabet and in windows of each length, which lie end to end in each text (in pieces of
    ``_PIECE`` bytes of a longer one).
    """
    out = np.zeros(len(_LENGTHS) * len(_ENCODINGS) * _CELLS, np.int64)
    pieces, held = [], 0
    for text, found in texts:
        if found:
            cuts = [0, *itertools.chain.from_iterable((s[1], s[2]) for s in found), len(text)]
            text = " ".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
        raw = text.encode("utf-8", "surrogatepass")
        for at in range(0, len(raw), _PIECE):
            pieces.append(raw[at : at + _PIECE])
            held += len(pieces[-1])
            if held >= _AT_ONCE:
                _count_windows(pieces, out)
                pieces, held = [], 0
    _count_windows(pieces, out)
    return {c: int(out[c]) for c in np.flatnonzero(out).tolist()}


def _count_windows(pieces: list[bytes], out: np.ndarray) -> None:
    """Adds the windows of the pieces, each in all alphabets and lengths, to the counts of cells."""
    for alike in _STREAMS:
        own = _ALPHABETS[alike[0]]
        kept = [p.translate(own.table, own.others) for p in pieces]
        held, joined = np.array([len(p) for p in kept], np.int64), b"".join(kept)
        begins = np.cumsum(held) - held
        code = np.frombuffer(joined, np.uint8)
        if len(code) < _LENGTHS[0]:
            continue
        wide = code.astype(np.int32)
        total, squares, products = _sums(wide), _sums(wide * wide), _sums(wide[1:] * wide[:-1])
        classes = [np.frombuffer(joined.translate(_ALPHABETS[i].classes), np.uint8) for i in alike]
        changes = [_sums(c[1:] != c[:-1]) for c in classes]
        inside: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each length: windows of each piece, and their pairs
        for length, n in enumerate(_LENGTHS):
            windows = held // n
            count = int(windows.sum())
            if not count:
                continue
            first = np.arange(0, n * count, n) + np.repeat(begins - n * (np.cumsum(windows) - windows), windows)
            last = first + (n - 1)
            read = np.frombuffer(b"".join([p[: n * w] for p, w in zip(kept, windows.tolist())]), np.uint8).reshape(count, n)
            halves = None
            if n // 2 in inside:  # a window is two of half its length, those from the beginning of its piece
                had, known = inside[n // 2]
                at = (first - np.repeat(begins, windows)) // (n // 2) + np.repeat(np.cumsum(had) - had, windows)
                halves = known[at] + known[at + 1]
            equal = _equal_pairs(np.ascontiguousarray(read.T), halves)
            inside[n] = windows, equal
            pairs = n + 2.0 * equal
            chi = _ALPHABETS[alike[0]].chi(n, pairs)
            serial = _serial(n, total[last + 1] - total[first], squares[last + 1] - squares[first], products[last] - products[first], wide[first] + wide[last])
            for i, changed in zip(alike, changes):
                cells = _cells(np.c_[chi, _ALPHABETS[i].runs(n, changed[last] - changed[first]), serial])
                low = (length * len(_ENCODINGS) + i) * _CELLS
                out[low : low + _CELLS] += np.bincount(cells, minlength=_CELLS)


_FOUND = "struct<spans:array<struct<kind:string,start:int,end:int,base:boolean,cell:int>>,windows:array<struct<cell:int,n:bigint>>>"


def _scan(texts: pa.Array) -> pa.Array:
    """Candidates of each text; the windows of all texts of a batch stand at its first row."""
    rows = texts.to_pylist()
    known: dict = {}
    for t in rows:
        if t not in known:
            known[t] = candidates(t)
    times = ordinary([(t or "", known[t]) for t in rows])
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("cell", pa.int32())])
    kind = pa.struct([("spans", pa.list_(span)), ("windows", pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64())])))])
    spans = [[{"kind": k, "start": s, "end": e, "base": b, "cell": place * _CELLS + cell} for k, s, e, b, place, cell in known[t]] for t in rows]
    return pa.array([{"spans": x, "windows": [{"cell": c, "n": n} for c, n in sorted(times.items())] if not i else None} for i, x in enumerate(spans)], kind)


def _normal(edges: np.ndarray, mean: float, sd: float) -> np.ndarray:
    """Mass of a normal distribution between the edges, the outer bins with all beyond them."""
    up = np.array([0.5 * math.erfc(-(x - mean) / sd / math.sqrt(2)) for x in edges])
    return np.diff(np.concatenate([[0.0], up, [1.0]]))


def _assumed(place: int) -> np.ndarray:
    """Cells of assumed ordinary writing: prose repeats characters, seldom changes case, and alternates vowels and consonants."""
    alphabet, n = _ALPHABETS[place % len(_ENCODINGS)], _LENGTHS[place // len(_ENCODINGS)]
    shift = n * max(0.75, alphabet.k / 15.0 - 1)  # of chi-squared, which is non-central for uneven letters
    spread = math.sqrt(2 * (alphabet.k - 1))
    chi = _normal(np.arange(-2, _SHAPE[0] - 3, dtype=float), shift / spread, math.sqrt(2 * (alphabet.k - 1 + 2 * shift)) / spread)
    rate = 0.65 if set(alphabet.cls) <= {0, 1} else 0.15
    if alphabet.change:
        z = (rate - alphabet.change) / math.sqrt(alphabet.change * (1 - alphabet.change)) * math.sqrt(n - 1)
        edges = np.arange(1, _SHAPE[1]) / 2
        runs = np.diff(np.concatenate([[0.0], _folded(edges, z, 1.5), [1.0]]))
    else:
        runs = np.eye(_SHAPE[1])[0]
    serial = np.diff(np.concatenate([[0.0], _folded(np.arange(1, _SHAPE[2]) / 2, 0.0, 1.5), [1.0]]))
    return np.einsum("i,j,k->ijk", chi, runs, serial)


def _folded(edges: np.ndarray, mean: float, sd: float) -> np.ndarray:
    below = lambda x: 0.5 * math.erfc(-(x - mean) / sd / math.sqrt(2))
    return np.array([below(x) - below(-x) for x in edges])


def p_values(windows: np.ndarray, place: int) -> np.ndarray:
    """For each cell of a place, the share of ordinary windows whose combined statistic is at least as close to chance."""
    null = windows.reshape(_SHAPE) + _PRIOR * _assumed(place)
    total = null.sum()
    score = np.zeros(_SHAPE)
    for j in range(3):
        below = np.cumsum(null.sum(tuple(x for x in range(3) if x != j))) / total
        score -= np.log(np.maximum(below, 1e-300)).reshape([-1 if x == j else 1 for x in range(3)])
    flat, mass = score.ravel(), null.ravel()
    order = np.argsort(-flat, kind="stable")
    tail = np.cumsum(mass[order]) / total
    last = np.searchsorted(-flat[order], -flat, "right") - 1  # cells of one score stand or fall together
    return np.minimum(tail[last], 1.0)


def accepted(windows: dict[int, int], counts: dict[int, int], rate: float) -> list[int]:
    """Cells whose candidates the Benjamini-Hochberg rule accepts at false-discovery ``rate``, by class of lengths."""
    out = []
    for length in range(len(_LENGTHS)):
        cells, times, ps = [], [], []
        for place in range(length * len(_ENCODINGS), (length + 1) * len(_ENCODINGS)):
            own = {c - place * _CELLS: n for c, n in counts.items() if c // _CELLS == place}
            if own:
                null = np.zeros(_CELLS)
                for c, n in windows.items():
                    if c // _CELLS == place:
                        null[c - place * _CELLS] = n
                p = p_values(null, place)
                cells += [place * _CELLS + c for c in own]
                times += own.values()
                ps += [p[c] for c in own]
        if not cells:
            continue
        order = np.argsort(ps, kind="stable")
        ranked, p = np.cumsum(np.array(times, float)[order]), np.array(ps)[order]
        good = np.flatnonzero(p <= rate * ranked / ranked[-1])
        if len(good):
            out += [cells[i] for i in order if ps[i] <= p[good[-1]]]
    return out


def find(docs: DataFrame, *, text_col: str = "text", spans_col: str = "secret_spans", rate: float = 0.01, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (the columns of ``keep``, else all) with ``spans_col``: structs of kind, start, end, base, by start.

    All spans of the base patterns, and those the battery adds at false-discovery ``rate``; the rule ranks the candidates
    of all documents, against the ordinary writing of all documents. Texts are read once; what was found is a table in
    the shared folder.

    Null texts count as empty and have no spans; offsets are code points, ends exclusive; whole texts of any length.
    An existing column named ``spans_col`` is replaced, other columns stay, repeated rows are each returned (and each
    count), and an empty table gives an empty result. The driver gets counts of cells: a bounded number of rows.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != spans_col]
    marked, _ = table(docs.withColumn(spans_col, F.arrow_udf(_scan, _FOUND)(F.col(text_col).cast("string"))).select(*kept, spans_col))
    windows = marked.select(F.explode(f"{spans_col}.windows").alias("w")).groupBy("w.cell").agg(F.sum("w.n").alias("n")).collect()
    counts = marked.select(F.explode(f"{spans_col}.spans").alias("s")).where("not s.base").groupBy("s.cell").agg(F.count(F.lit(1)).alias("n")).collect()
    good = accepted({r["cell"]: r["n"] for r in windows}, {r["cell"]: r["n"] for r in counts}, rate)
    own = F.filter(f"{spans_col}.spans", lambda s: s["base"] | s["cell"].isin(good) if good else s["base"])
    plain = F.transform(own, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return marked.withColumn(spans_col, plain)


def digest(docs: DataFrame, **options) -> DataFrame:
    """Counts of base spans, their digest, and all spans as text, for each document. Cases as in ``find``."""
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = lambda s: s["base"]
    found = find(docs.select("doc_id", "text"), keep=("doc_id",), **options)
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS),
        F.sha2(F.array_join(F.transform(F.filter("secret_spans", base), named), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("secret_spans", named), ",").alias("spans"),
    )


def _redacted(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(texts, spans):
        if text is None or not len(found):
            out.append(text)
            continue
        kept, at = [], 0
        for s in sorted(found, key=lambda s: s["start"]):
            if s["end"] <= at:
                continue
            kept += [text[at : max(at, s["start"])], "[SECRET]"] if s["start"] >= at else []
            at = s["end"]
        out.append("".join(kept) + text[at:])
    return pd.Series(out, dtype=object)


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with each secret replaced by ``[SECRET]`` and ``length_col`` (if there is one) brought up to date.

    All documents stay; those without secrets, and null texts, are as they were.
    """
    found = find(docs, text_col=text_col, spans_col="__spans", **options)
    has = F.size("__spans") > 0
    changed = F.pandas_udf(_redacted, "string")(F.col(text_col), F.col("__spans"))
    out = found.where(has).withColumn(text_col, changed)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return found.where(~has).select(*docs.columns).unionByName(out.select(*docs.columns))
