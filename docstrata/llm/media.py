"""Audio features of byte payloads.

A payload becomes unsigned 8-bit samples in a WAV file, which is written to a table. Read back, the samples are resampled
by a polyphase filter, cut into overlapped frames, and turned into log-mel filterbank energies, which are kept in an
Arrow stream of tensors of one fixed shape with their time spans; a two-threshold gate on frame energy marks active time
spans. Samples are resampled and transformed block by block: beside file and tensors a long payload needs a few numbers a frame.
"""

from __future__ import annotations

import functools
import hashlib
import io
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.shared import forget, slices, table

UNIT = 64


@dataclass(frozen=True)
class Settings:
    rate: int = 16_000  # of the stored samples
    up: int = 1
    down: int = 2
    taps: int = 16  # on either side, for each phase
    frame: int = 256
    hop: int = 128
    mels: int = 24
    frames: int = 64  # in a tensor
    on_db: float = 3.0  # above the median frame energy
    off_db: float = 1.0
    hold: int = 3  # frames below the lower threshold that end a span


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def to_wav(payload: bytes, rate: int) -> bytes:
    """A RIFF file with one channel of unsigned 8-bit PCM, each payload byte a sample."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and sample bytes of a RIFF file: chunks are followed up to the data."""
    f = io.BytesIO(media)
    kind, _, form = struct.unpack("<4sI4s", f.read(12))
    if (kind, form) != (b"RIFF", b"WAVE"):
        raise ValueError("not a WAVE file")
    rate = 0
    while head := f.read(8):
        name, size = struct.unpack("<4sI", head)
        body = f.read(size + size % 2)[:size]
        if name == b"fmt ":
            rate = struct.unpack("<HHIIHH", body[:16])[2]
        if name == b"data":
            return rate, body
    raise ValueError("no data chunk")


@functools.lru_cache(maxsize=8)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low-pass in ``up`` phases, each a row of ``2 * taps`` weights that sum to 1."""
    n = np.arange(-taps * up, taps * up)
    cutoff = 1.0 / max(up, down)
    h = np.sinc(n * cutoff) * np.hanning(len(n) + 2)[1:-1]
    rows = np.stack([h[p::up][::-1] for p in range(up)])
    return rows / rows.sum(1, keepdims=True)


def resample(x: np.ndarray, up: int, down: int, taps: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Outputs ``lo`` to ``hi`` of a polyphase filter: output m takes the phase ``m * down % up`` at input ``m * down // up``.

    No sample is inserted; unsigned bytes count from -1 to 1 (128 is 0); beyond both ends there is silence.
    """
    rows = _phases(up, down, taps)
    m = np.arange(lo, -(-len(x) * up // down) if hi is None else hi)
    if not len(m):
        return np.zeros(0)
    at, phase = m * down // up, m * down % up
    first, last = int(at[0]) - taps + 1, int(at[-1]) + taps + 1
    part = x[max(0, first) : max(0, last)]
    part = (part.astype(np.float64) - 128) / 128 if x.dtype == np.uint8 else part
    padded = np.concatenate([np.zeros(max(0, -first)), part, np.zeros(max(0, last - max(len(x), max(0, first))))])
    view = np.lib.stride_tricks.sliding_window_view(padded, 2 * taps)
    if up == 1:
        return view[::down][: len(m)] @ rows[0]
    return np.einsum("ij,ij->i", view[at - at[0]], rows[phase])


@functools.lru_cache(maxsize=8)
def _mel_bank(rate: float, frame: int, mels: int) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, bins x mels."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, frame // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    bank = np.clip(np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)), 0, None)
    return bank.astype(np.float32)


def features(samples: bytes, s: Settings):
    """Tensors (blocks x frames x mels, float32, zeros after the last frame), number of frames, active spans in frames."""
    window = np.hanning(s.frame + 2)[1:-1].astype(np.float32)
    bank = _mel_bank(s.rate * s.up / s.down, s.frame, s.mels)
    x = np.frombuffer(samples, np.uint8)
    size = -(-len(x) * s.up // s.down)
    n = 1 + max(0, -(-(size - s.frame) // s.hop))
    blocks, energy = np.zeros((-(-n // s.frames), s.frames, s.mels), np.float32), np.zeros(n)
    for b in range(len(blocks)):
        first, last = b * s.frames, min(n, (b + 1) * s.frames)
        begin, end = first * s.hop, (last - 1) * s.hop + s.frame
        y = resample(x, s.up, s.down, s.taps, begin, min(end, size)).astype(np.float32)
        y = np.concatenate([y, np.zeros(end - begin - len(y), np.float32)])
        frames = np.lib.stride_tricks.sliding_window_view(y, s.frame)[:: s.hop] * window
        power = np.abs(np.fft.rfft(frames, axis=1).astype(np.complex64)) ** 2
        blocks[b, : last - first] = np.log(power @ bank + 1e-6)
        energy[first:last] = 10 * np.log10((frames.astype(np.float64) ** 2).mean(1) + 1e-10)
    return blocks, n, hysteresis(energy, np.median(energy), s)


def hysteresis(energy: np.ndarray, level: float, s: Settings) -> list[tuple[int, int]]:
    """Spans of frames that start above the upper threshold and end after ``hold`` frames below the lower one."""
    spans, start, last = [], -1, -1
    for i, e in enumerate(energy.tolist()):
        if start < 0:
            if e >= level + s.on_db:
                start, last = i, i
        elif e >= level + s.off_db:
            last = i
        elif i - last >= s.hold:
            spans.append((start, last + 1))
            start = -1
    if start >= 0:
        spans.append((start, last + 1))
    return spans


def tensor_batch(blocks: np.ndarray, first_frame: int, s: Settings) -> pa.RecordBatch:
    """Blocks as a fixed-shape Arrow tensor column with the time span of each."""
    kind = pa.fixed_shape_tensor(pa.float32(), (s.frames, s.mels), dim_names=("frame", "mel"))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(blocks.reshape(-1), pa.float32()), s.frames * s.mels)
    step = s.hop * s.down / s.up / s.rate
    start = [(first_frame + i * s.frames) * step for i in range(len(blocks))]
    return pa.RecordBatch.from_arrays(
        [pa.ExtensionArray.from_storage(kind, flat), pa.array(start, pa.float64()), pa.array([t + s.frames * step for t in start], pa.float64())],
        names=["log_mel", "start_s", "end_s"],
    )


def ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


_AUDIO = pa.struct([
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
    ("n_frames", pa.int64()), ("segments", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), ("tensors", pa.binary()),
])
_READ = (
    "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,"
    "n_frames:bigint,segments:array<struct<start_s:double,end_s:double>>,tensors:binary>"
)


def store(docs: DataFrame, *, text_col: str = "text", settings: Settings = Settings(), media_col: str = "media") -> DataFrame:
    """``docs`` with ``media_col``, a WAV file that holds each whole text's bytes; null texts count as empty (64 zeros).

    An existing column named ``media_col`` is replaced; other columns stay; an empty table gives an empty result.
    """

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([to_wav(payload_of(t), settings.rate) for t in texts.to_pylist()], pa.binary())

    return docs.withColumn(media_col, F.arrow_udf(run, "binary")(F.col(text_col).cast("string")))


def _heard(file: bytes | None, settings: Settings) -> dict | None:
    if file is None:
        return None
    _, payload = from_wav(file)
    blocks, n, spans = features(payload, settings)
    step = settings.hop * settings.down / settings.up / settings.rate
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
        "media_bytes": len(file), "media_sha256": hashlib.sha256(file).hexdigest(), "n_frames": n,
        "segments": [{"start_s": a * step, "end_s": b * step} for a, b in spans], "tensors": ipc(tensor_batch(blocks, 0, settings)),
    }


def analyse(media: DataFrame, *, media_col: str = "media", settings: Settings = Settings(), audio_col: str = "audio") -> DataFrame:
    """``media`` with ``audio_col`` in place of ``media_col``: what was read back from the file, its features and time spans.

    ``tensors`` is an Arrow stream of fixed-shape tensors (``log_mel``) with the time span of each (``start_s``, ``end_s``);
    ``segments`` are the active spans. Equal files have equal values whatever batch they are in. A null file gives null;
    an existing column named ``audio_col`` is replaced, others stay; an empty table gives an empty result.
    """
    rows = media.select(*(c for c in media.columns if c not in (media_col, audio_col)), media_col)

    def run(batches):
        for part in slices(batches, media_col):
            heard = pa.array([_heard(x, settings) for x in part.column(part.num_columns - 1).to_pylist()], _AUDIO)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], heard], names=[*part.schema.names[:-1], audio_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"`{audio_col}` {_READ}"])
    return rows.mapInArrow(run, schema)


def _read_tensors(streams: pa.Array) -> pa.Array:
    """Digest of each stream as it is read: shape, values and time span of every tensor."""
    out = []
    for x in streams:
        if not x.is_valid:
            out.append(None)
            continue
        table_ = pa.ipc.open_stream(x.as_buffer()).read_all()
        tensors = table_["log_mel"].combine_chunks()
        own = hashlib.sha256(repr(tensors.type.shape).encode())
        own.update(np.ascontiguousarray(tensors.to_numpy_ndarray()).tobytes())
        for c in ("start_s", "end_s"):
            own.update(table_[c].to_numpy().tobytes())
        out.append(f"{len(tensors)}x{'x'.join(map(str, tensors.type.shape))}:{own.hexdigest()[:32]}")
    return pa.array(out, pa.string())


def digest(docs: DataFrame, **options) -> DataFrame:
    """Sizes and digests of each document's stored form and features. Null texts count as empty; ids may be null or repeat.

    The files are a table, and what is heard in them is another; ``feature`` digests the tensors read back from that one,
    and the active spans.
    """
    files = store(docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))).drop("text")
    stored, path = table(files, compression="zstd")
    heard, _ = table(analyse(stored, **options), compression="zstd")
    forget(docs.sparkSession, path)
    spans = F.crc32(F.concat_ws(",", F.transform("audio.segments", lambda x: F.concat_ws("-", x["start_s"].cast("string"), x["end_s"].cast("string")))).cast("binary"))
    feature = F.concat_ws("/", F.arrow_udf(_read_tensors, "string")("audio.tensors"), F.size("audio.segments").cast("string"), spans.cast("string"))
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    return heard.select("doc_id", "n_bytes", *(F.col(f"audio.{c}").alias(c) for c in names), feature.alias("feature"))
