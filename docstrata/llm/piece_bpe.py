"""Byte-level BPE through a sentencepiece model that is made from the vocabulary itself.

A file of ranks becomes a sentencepiece BPE model: each token is a piece, its bytes written as letters that are neither
spaces nor controls, its score the negative rank, and nothing is normalised. The best-scored pair that sentencepiece
joins is then the pair of least rank. A text is cut into pre-tokens first, which are encoded one by one; ids are decoded
by mapping the letters of their pieces back to bytes.
"""

from __future__ import annotations

import base64
import itertools

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from docstrata.llm.shared import slices

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
_KEPT_BYTES = 4 << 20  # of pre-tokens and their ids that a worker keeps
_KEPT_LENGTH = 32  # letters of a pre-token that is kept


def byte_letters() -> list[str]:
    """A letter for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = itertools.count(0x100)
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ``i`` is the token of rank ``i``; ranks must be 0, 1, 2 and so on.

    Scores are 32-bit floats, so at most 2**24 ranks stay apart. The unknown piece that the format asks for comes last;
    it never occurs if all 256 bytes are tokens, which is required.
    """
    if sorted(ranks.values()) != list(range(len(ranks))) or len(ranks) > 1 << 24:
        raise ValueError("ranks must be the numbers from 0 on, at most 2**24 of them")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("each byte must be a token")
    model, letters = sentencepiece_model_pb2.ModelProto(), byte_letters()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = model.pieces.add()
        piece.piece, piece.score = "".join([letters[b] for b in token]), -float(rank)
    unknown = model.pieces.add()
    unknown.piece, unknown.score, unknown.type = "<unk>", 0.0, sentencepiece_model_pb2.ModelProto.SentencePiece.UNKNOWN
    model.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(ranks)
    normal = model.normalizer_spec
    normal.name, normal.add_dummy_prefix, normal.remove_extra_whitespaces, normal.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class PieceBytePairs:
    """The model and its two mappings; ``encode`` gives the ids of texts, ``decode`` the bytes of ids."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(ranks))
        letters = byte_letters()
        self.to_letters = dict(enumerate(letters))
        of_letter = {ord(c): chr(b) for b, c in enumerate(letters)}
        self.bytes_of = [self.model.id_to_piece(i).translate(of_letter).encode("latin-1") for i in range(len(ranks))]
        # a token that merges alone do not reach is the id of a pre-token that equals it
        lone = [i for i, ids in enumerate(self.model.encode([self.model.id_to_piece(i) for i in range(len(ranks))], num_threads=1)) if ids != [i]]
        self.lone = {self.model.id_to_piece(i): i for i in lone}
        # the engine's white space differs from the property by four control characters
        self.cut = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens, as bytes of int32."""
        letters = [p.encode("utf-8").decode("latin-1").translate(self.to_letters) for p in pieces]
        found = self.model.encode(letters, num_threads=1)
        lone = self.lone
        return {p: np.array([lone[s]] if s in lone else ids, np.int32).tobytes() for p, s, ids in zip(pieces, letters, found)}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as int32. Short pre-tokens stay known until they fill their room; then it starts anew."""
        cuts = [self.cut.findall(t) for t in texts]
        fresh = set(itertools.chain.from_iterable(cuts)).difference(self.known)
        kept = [p for p in fresh if len(p) <= _KEPT_LENGTH]
        long = self._learn([p for p in fresh if len(p) > _KEPT_LENGTH])
        if self.held > _KEPT_BYTES:
            self.known, self.held = {}, 0
            kept = list({p for p in itertools.chain.from_iterable(cuts) if len(p) <= _KEPT_LENGTH})
        new = self._learn(kept)
        self.known.update(new)
        self.held += sum(len(p) + len(ids) for p, ids in new.items())
        known = self.known
        of = (lambda p: known.get(p) or long[p]) if long else known.__getitem__
        return [np.frombuffer(b"".join(map(of, pieces)), np.int32) for pieces in cuts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_LOADED: dict[tuple[str, str], PieceBytePairs] = {}


def load(ranks: str, pattern: str = public_tokenizers.PATTERN) -> PieceBytePairs:
    """The model, kept by the worker process. ``ranks``: a file of ``public_tokenizers`` or a path all workers have."""
    if (ranks, pattern) not in _LOADED:
        _LOADED[ranks, pattern] = PieceBytePairs(ranks if "/" in ranks else public_tokenizers.path(ranks), pattern)
    return _LOADED[ranks, pattern]


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found]), pa.int32()))


def round_trip(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """``id_col``, ``ids`` (array<int>) of each whole text, and ``decoded``, the bytes that those ids stand for.

    Null and empty texts have no ids and decode to nothing; null and repeated ids are rows like others; strings that
    look like special tokens are ordinary text; an empty table gives an empty result; columns other than the two named
    are not read, so clashing names do no harm. A text may have any length and is never cut inside a pre-token. A task
    holds the ids of a few megabytes of text (one text at least) and some 4 MB of known pre-tokens.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        own = load(ranks, pattern)
        for part in slices(batches, "text", 2 << 20):
            found = own.encode([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(found), pa.array(map(own.decode, found), pa.binary())], names=["id", "ids", "decoded"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, *, ids_col: str = "ids", bytes_col: str = "decoded", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``df`` with ``bytes_col`` (binary) in place of ``ids_col``; null ids give no bytes. An id outside the vocabulary raises."""

    def run(ids: pa.Array) -> pa.Array:
        own = load(ranks)
        return pa.array([own.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid and len(x) else b"" for x in ids], pa.binary())

    return df.withColumn(bytes_col, F.arrow_udf(run, "binary")(ids_col)).drop(*({ids_col} - {bytes_col}))


def digest(docs: DataFrame) -> DataFrame:
    """Number and digest of each document's ids, and the digest of the bytes they decode to. Cases as in ``round_trip``."""
    return round_trip(docs).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
