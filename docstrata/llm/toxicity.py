"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on the telling parts of toxic text (words with a
stem that is far more common in toxic documents: trained on all of their text the dictionary learns what toxic and
ordinary documents share). A window of words is compressed twice, with the ordinary dictionary and with that dictionary
after the toxic one; it is toxic to the degree that the second makes it shorter. Thresholds are calibrated on labelled
documents which the dictionaries have not seen: each saving in bytes has a log-likelihood ratio, and a logistic model
over a few summaries of a document's windows gives the score.
"""

from __future__ import annotations

import collections
import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LOW, _HIGH = -6, 14  # savings beyond these count as these
_BATCH = 4096  # windows compressed at once
# Both dictionaries end with it and every window starts with it: each window then has a match, so that the fixed cost of
# the first match does not hide the saving of a short one.
_ANCHOR = bytes([1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 14, 15, 16, 17, 18, 19])


@dataclass(frozen=True)
class Bounds:
    """How many labelled documents the fit may gather, how much of their text, and how many windows of the ordinary ones
    train a dictionary: a bound on the driver's memory and time."""

    toxic_train: int = 1300
    ordinary_train: int = 2400
    toxic_check: int = 700
    ordinary_check: int = 1600
    bytes_train: int = 16_000_000
    bytes_check: int = 16_000_000
    windows_train: int = 200_000


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    ratio: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    words: int

    def savings(self, texts: list) -> list[np.ndarray]:
        """For each whole text, how many of its windows the toxic dictionary makes shorter by each number of bytes."""
        plain, marked = _compressors(self.ordinary, self.toxic)
        width = _HIGH - _LOW + 1
        found = np.zeros((len(texts), width), np.int64)
        pending, owner = [], []

        def flush():
            a, b = (np.fromiter(map(len, c.multi_compress_to_buffer(pending, threads=1)), np.int64, len(pending)) for c in (plain, marked))
            np.add.at(found, (np.array(owner), np.clip(a - b, _LOW, _HIGH) - _LOW), 1)
            pending.clear()
            owner.clear()

        for i, text in enumerate(texts):
            for window in _windows(text, self.words):
                pending.append(_ANCHOR + b" " + window)
                owner.append(i)
                if len(pending) == _BATCH:
                    flush()
        if pending:
            flush()
        return list(found)

    def scores(self, texts: list) -> list[float]:
        x = (np.array([_summaries(h, self.ratio) for h in self.savings(texts)]).reshape(-1, len(self.centre)) - self.centre) / self.scale
        return (1 / (1 + np.exp(-np.clip(x @ self.weight[:-1] + self.weight[-1], -30, 30)))).tolist()


@functools.lru_cache(maxsize=2)
def _compressors(ordinary: bytes, toxic: bytes):
    """The toxic part comes first, so that matches in the ordinary part cost the same in both dictionaries."""
    how = zstd.ZstdCompressionParameters(
        write_content_size=0, write_checksum=0, write_dict_id=0, strategy=zstd.STRATEGY_BTOPT, min_match=3, search_log=4, hash_log=15, chain_log=15, window_log=17, target_length=24
    )
    found = []
    for content in (ordinary + _ANCHOR, toxic + ordinary + _ANCHOR):
        dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=how)
        found.append(zstd.ZstdCompressor(compression_params=how, dict_data=dictionary))
    return tuple(found)


def _windows(text: str | None, words: int):
    """Windows (lower case, a fixed number of words each); a text without words is one empty window."""
    all_words = (text or "").lower().split()
    for i in range(0, max(1, len(all_words)), words):
        yield " ".join(all_words[i : i + words]).encode("utf-8", "surrogatepass")


def _summaries(h: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Of a histogram of savings: mean ratio, its positive part, largest savings, shares above thresholds, length."""
    n = max(1, h.sum())
    top = np.repeat(np.arange(len(h))[::-1], h[::-1])[: max(3, n // 20)] if h.sum() else np.array([-_LOW])
    total = float(h @ ratio)
    return np.array(
        [
            total / n, total / np.sqrt(n + 5), float(h @ np.clip(ratio, 0, None)) / n, ratio[top].max(), ratio[top[:3]].mean(), top[0], top[:3].mean(),
            top[: max(1, n // 20)].mean(), h[5 - _LOW :].sum() / n, h[7 - _LOW :].sum() / n, np.log(n),
        ]
    )


def _grams(word: str) -> list[str]:
    word = " " + word
    return [word[i : i + 5] for i in range(len(word) - 4)]


def _dictionaries(toxic: list[str], ordinary: list[str], size: int, words: int, windows: int) -> tuple[bytes, bytes]:
    """Content of the ordinary dictionary, and of one trained on what is far more common in toxic documents."""
    counts = [collections.Counter(), collections.Counter()]
    for k, texts in enumerate((ordinary, toxic)):
        for t in texts:
            counts[k].update({g for w in set(t.lower().split()) for g in _grams(w)})
    n0, n1 = max(1, len(ordinary)), max(1, len(toxic))
    marked = {g for g, c in counts[1].items() if c >= 4 and c / n1 > 12 * (counts[0][g] + 1) / n0}
    telling = [w for t in toxic for w in t.lower().split() if not marked.isdisjoint(_grams(w))]
    plain = itertools.islice((w for t in ordinary for w in _windows(t, 2 * words)), windows)
    samples = ([" ".join(telling[i : i + 4]).encode("utf-8", "surrogatepass") for i in range(0, len(telling), 4)], list(plain))
    return tuple(_trained(s, size)[-size:] for s in reversed(samples))


def _trained(samples: list[bytes], size: int) -> bytes:
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:  # too few samples to train on: the samples themselves serve
        return b" ".join(samples)[-size:] or b" "


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1.0) -> np.ndarray:
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: DataFrame, *, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", bounds: Bounds = Bounds(), dictionary_bytes: int = 8192, words: int = 4) -> Model:
    """Fit on labelled documents (label 0 or 1; others do not count).

    The sample is bounded by ``bounds``: for either label, the documents with the smallest hashes of their ids, up to
    those counts and bytes; dictionaries are trained on the first part, thresholds calibrated on the rest. Repeated texts
    count once; null labels and null texts do not count; repeated ids are documents like others. With no documents of a
    label in the part for thresholds, every score is that of the other one; without any labels every score is near 0.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and text is not null")
    order = F.xxhash64("id", F.lit(2)), F.col("id"), F.xxhash64("text")
    sample = [r for y, n in _wanted(bounds) for r in rows.where(F.col("y") == y).orderBy(*order).limit(n).collect()]  # the smallest of each task, then of all
    parts = {}
    for y, train, check in ((1, bounds.toxic_train, bounds.toxic_check), (0, bounds.ordinary_train, bounds.ordinary_check)):
        got = [r["text"] for r in sample if r["y"] == y][: train + check]
        got = list(dict.fromkeys(got))
        cut = min(train, len(got) * train // (train + check))
        parts[y] = [_within(got[:cut], bounds.bytes_train), _within(got[cut:], bounds.bytes_check)]
    ordinary, toxic = _dictionaries(parts[1][0], parts[0][0], dictionary_bytes, words, bounds.windows_train)
    width = _HIGH - _LOW + 1
    model = Model(ordinary, toxic, np.zeros(width), np.zeros(11), np.ones(11), np.zeros(12), words)
    hists = {y: model.savings(parts[y][1]) for y in (0, 1)}
    if not hists[0] or not hists[1]:
        model.weight[-1] = 30.0 if hists[1] else -30.0
        return model
    sums = {y: np.sum(h, axis=0) + 0.5 for y, h in hists.items()}
    model.ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    x = np.array([_summaries(h, model.ratio) for y in (0, 1) for h in hists[y]])
    y = np.repeat([0.0, 1.0], [len(hists[0]), len(hists[1])])
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weight = _logistic((x - model.centre) / model.scale, y)
    return model


def _wanted(bounds: Bounds):
    return (1, bounds.toxic_train + bounds.toxic_check), (0, bounds.ordinary_train + bounds.ordinary_check)


def _within(texts: list[str], limit: int) -> list[str]:
    found = []
    for t in texts:
        limit -= len(t)
        if limit < 0 and found:
            break
        found.append(t)
    return found


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with ``score_col``, from 0 to 1, for each whole text (an existing column of that name is replaced).

    Null and empty texts are one empty window. Equal texts have equal scores. Other columns stay as they are; an empty
    table gives an empty result.
    """

    def run(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        distinct = list(dict.fromkeys(rows))
        known = dict(zip(distinct, model.scores(distinct)))
        return pa.array([known[t] for t in rows], pa.float64())

    return docs.withColumn(score_col, F.arrow_udf(run, "double")(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id"):
    """Whether a document takes no part in learning: crc32 of its id, as text, is a multiple of 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_on_labels(docs: DataFrame, labels: DataFrame, *, bounds: Bounds = Bounds(), **options) -> Model:
    """Fit on the labelled documents that are not held out.

    The sample is drawn from the labels alone; only its ids (a bounded number) meet the documents, so texts are not
    shuffled.
    """
    rows = labels.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    picked = None
    for y, n in _wanted(bounds):
        part = rows.where(F.col("toxic") == y).distinct().orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    return fit(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), bounds=bounds, **options)


def keep_ordinary(docs: DataFrame, model: Model, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score below ``threshold``, columns as in ``docs``. Empty and null texts stay if they do."""
    return score(docs, model, text_col=text_col, score_col="__toxicity").where(F.col("__toxicity") < threshold).select(*docs.columns)
