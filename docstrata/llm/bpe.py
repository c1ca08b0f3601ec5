"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece of text exactly one token can end its encoding. An automaton over all tokens names those
that end at a place; one of them is the prefix's last token if it is compatible with the last token of the prefix
before it, that is, if no merge across their border would have come before both were complete. Back-pointers then give
the ids.

The automaton is that of Aho and Corasick, not a suffix automaton of the vocabulary: it names the same tokens at each place
and has fewer states for each worker to hold.
"""

from __future__ import annotations

import array
import itertools
import json

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.shared import slices

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
# Fixed: the pieces into which the byte-level pre-tokenizer cuts a text.
_PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_CACHED_PIECES = 250_000  # of at most _CACHED_LENGTH letters, some 50 MB, in each of two generations
_CACHED_PAIRS = 200_000
_CACHED_LENGTH = 32  # letters of a piece that is kept


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = itertools.count(0x100)
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class BytePairs:
    """Vocabulary, merges and special tokens of a ``tokenizers`` file; ``encode`` gives ids, ``decode`` bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = _byte_letters()
        self.to_letters = {b: c for b, c in enumerate(letters)}
        of_letter = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max(itertools.chain(vocab.values(), self.special.values())))
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if token in self.special:
                continue
            self.bytes_of[i] = bytes(of_letter[c] for c in token)
            self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.rank, self.made_of = {}, {}
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocab[left], vocab[right]
            self.rank[pair] = r
            self.made_of.setdefault(vocab[left + right], (*pair, r))
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends: dict[int, list] = {}
        self.begins: dict[int, list] = {}
        self.pairs: dict[int, bool] = {}

    def _border(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens on one border (0 left, 1 right) while ``token`` is built, with the rank of the merge that takes each up."""
        found, until = [], float("inf")
        while True:
            found.append((token, until))
            if token not in self.made_of:
                return found
            until = self.made_of[token][2]
            token = self.made_of[token][side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart: no merge over their border comes while both its sides exist.

        At equal rank the merge further left comes first, so a border merge loses to one inside ``left`` and wins
        against one inside ``right``.
        """
        ends, begins, rank = self.ends.get(left), self.begins.get(right), self.rank
        if ends is None:
            ends = self.ends[left] = self._border(left, 1)
        if begins is None:
            begins = self.begins[right] = self._border(right, 0)
        for x, x_until in ends:
            for y, y_until in begins:
                r = rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece, as bytes of int32."""
        letters = piece.encode("utf-8").decode("latin-1").translate(self.to_letters)
        last = [-1] * (len(letters) + 1)
        back = [0] * (len(letters) + 1)
        pairs = self.pairs
        for at, (token, size) in self.automaton.iter(letters):
            if last[at + 1] >= 0:
                continue
            start = at + 1 - size
            if start:
                pair = last[start] << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= _CACHED_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.compatible(last[start], token)
                if not fits:
                    continue
            last[at + 1], back[at + 1] = token, start
        ids, end = array.array("i"), len(letters)
        while end:
            ids.append(last[end])
            end = back[end]
        ids.reverse()
        return ids.tobytes()

    def _ordinary(self, text: str) -> bytes:
        """Ids of all pieces. Frequent pieces stay known: a full generation becomes the older one, which is still looked up."""
        pieces = _PIECES.findall(text)
        known, older, long = self.pieces, self.older, {}
        for piece in set(pieces).difference(known):
            if len(piece) > _CACHED_LENGTH:
                long[piece] = self._piece(piece)
                continue
            ids = older.get(piece)
            known[piece] = self._piece(piece) if ids is None else ids
        if long:
            found = b"".join([long[p] if p in long else known[p] for p in pieces])
        else:
            found = b"".join(map(known.__getitem__, pieces))
        if len(known) >= _CACHED_PIECES:
            self.pieces, self.older = {}, known
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids as int32; strings of special tokens become their ids."""
        if self.cut is None or not self.cut.search(text):
            return np.frombuffer(self._ordinary(text), np.int32)
        found, at = [], 0
        for m in self.cut.finditer(text):
            found += [self._ordinary(text[at : m.start()]), np.array([self.special[m[0]]], np.int32).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*found, self._ordinary(text[at:])]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The bytes of all tokens, one after another; what is no UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[str, BytePairs] = {}


def load(name: str) -> BytePairs:
    """The tokenizer, kept by the worker process. ``name``: a file of ``public_tokenizers`` or a path all workers have."""
    if name not in _LOADED:
        _LOADED[name] = BytePairs(name if "/" in name else public_tokenizers.path(name))
    return _LOADED[name]


def encode(df: DataFrame, *, text_col: str = "text", ids_col: str = "ids", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``df`` with ``ids_col`` (array<int>) in place of ``text_col``.

    Null texts count as empty, and empty texts have no ids. An existing column named ``ids_col`` is replaced; other
    columns stay as they are. Whole texts of any length; a piece is never cut.
    """

    def run(texts: pa.Array) -> pa.Array:
        encode_one = load(tokenizer).encode
        return _id_lists([encode_one(t or "") for t in texts.to_pylist()])

    return df.withColumn(ids_col, F.arrow_udf(run, "array<int>")(F.col(text_col).cast("string"))).drop(*({text_col} - {ids_col}))


def _id_lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found]), pa.int32()))


def decode(df: DataFrame, *, ids_col: str = "ids", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``df`` with ``text_col`` in place of ``ids_col``; null ids give an empty text, bytes that are no UTF-8 U+FFFD."""

    def run(ids: pa.Array) -> pa.Array:
        decode_one = load(tokenizer).decode
        return pa.array([decode_one(x.values.to_numpy(zero_copy_only=False)) if x.is_valid and len(x) else "" for x in ids], pa.string())

    return df.withColumn(text_col, F.arrow_udf(run, "string")(ids_col)).drop(*({ids_col} - {text_col}))


def round_trip(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``id_col``, ``ids`` of each whole text, and ``decoded``, what those ids decode to, in one pass.

    Null texts count as empty; null and repeated ids are rows like others; an empty table gives an empty result; other
    columns are not read. A task holds the ids of a few megabytes of text at once.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "ids", "decoded"]

    def run(batches):
        for part in slices(batches, "text"):
            own = load(tokenizer)
            found = [own.encode(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), _id_lists(found), pa.array(map(own.decode, found), pa.string())], names=names)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def round_trip_digest(docs: DataFrame, *, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Number and digest of each document's ids, and the digest of what they decode to. Cases as in ``round_trip``."""
    return round_trip(docs, tokenizer=tokenizer).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
