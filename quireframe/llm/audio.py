"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAVE containers, decoded to PCM and resampled."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.llm.common import Cut

RATE = 8000
UNIT = 576
# WAVE format tags.
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
NAMES = {tag: name for name, tag in TAGS.items()}
# IMA ADPCM step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157,
    173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707,
    1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635,
    13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    step = code >> 4 & 7
    size = ((code & 15) << 4) + 8 + np.where(step > 0, 256, 0) << np.maximum(step - 1, 0)
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": _mulaw(), "alaw": _alaw()}


def _adpcm() -> tuple[np.ndarray, np.ndarray]:
    """By step index and nibble: the change of the predictor and the next step index."""
    step, nibble = STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    change = np.where(nibble & 8, -size, size)
    return change.astype(np.int32).ravel(), np.clip(np.arange(89)[:, None] + INDEX_CHANGE[None, :], 0, 88).astype(np.int32).ravel()


CHANGE, NEXT = _adpcm()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM (blocks, samples) of mono IMA ADPCM blocks (blocks, bytes): all blocks step together.

    A block has a predictor (16 bit), a step index (above 88 counts as 88) and a byte that is ignored; then two
    samples a byte, the low nibble first. The first sample is the predictor.
    """
    n, width = blocks.shape
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(head[:, 2], 88).astype(np.int32)
    codes = np.empty((2 * (width - 4), n), np.uint8)  # a row for each step
    codes[0::2] = (blocks[:, 4:] & 15).T
    codes[1::2] = (blocks[:, 4:] >> 4).T
    out = np.empty((1 + len(codes), n), np.int16)
    out[0] = value
    for k in range(len(codes)):
        at = (index << 4) | codes[k]
        value += CHANGE[at]
        np.clip(value, -32768, 32767, out=value)
        index = NEXT[at]
        out[k + 1] = value
    return out.T


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit PCM at another rate: linear between neighbours in whole numbers (floor), the last sample held."""
    if not len(pcm) or rate == to:
        return pcm
    x = np.append(pcm, pcm[-1]).astype(np.int32)
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[0::2] = pcm
        out[1::2] = x[:-1] + x[1:] >> 1
        return out
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    i, part = at // to, at % to
    return ((x[i] * (to - part) + x[i + 1] * part) // to).astype(np.int16)


def wave(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono WAVE file that holds the payload as it is. The payload of ima_adpcm is whole blocks of UNIT bytes."""
    align, per_block = (UNIT, 2 * (UNIT - 4) + 1) if codec == "ima_adpcm" else (1, 1)
    if len(payload) % align:
        raise ValueError("a part of an ADPCM block")
    form = struct.pack("<HHIIHH", TAGS[codec], 1, rate, rate * align // per_block, align, 4 if codec == "ima_adpcm" else 8)
    form += struct.pack("<HH", 2, per_block) if codec == "ima_adpcm" else struct.pack("<H", 0)
    fact = struct.pack("<I", len(payload) // align * per_block)
    chunks = b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1) for name, x in ((b"fmt ", form), (b"fact", fact), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wave(media: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, block size and payload of a file that wave() made; raises ValueError on any other."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack_from("<I", media, 4)[0] != len(media) - 8:
        raise ValueError("no whole WAVE file")
    at, found = 12, {}
    while at < len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        found[name] = media[at + 8 : at + 8 + n]
        if len(found[name]) != n:
            raise ValueError("a chunk is cut short")
        at += 8 + n + (n & 1)
    tag, channels, rate, _, align = struct.unpack_from("<HHIIH", found[b"fmt "])
    if tag not in NAMES or channels != 1:
        raise ValueError(f"format {tag} with {channels} channels")
    return NAMES[tag], rate, align, found[b"data"]


def decode_all(files: list[bytes], to: int) -> list[tuple[str, bytes, np.ndarray]]:
    """(codec, payload, PCM at rate ``to``) of each file; the ADPCM blocks of all files step together."""
    read = [read_wave(x) for x in files]
    own = [i for i, r in enumerate(read) if r[0] == "ima_adpcm"]
    blocks = {}
    for align in {read[i][2] for i in own}:
        same = [i for i in own if read[i][2] == align]
        joined = np.frombuffer(b"".join(read[i][3] for i in same), np.uint8).reshape(-1, align)
        decoded, at = decode_adpcm(joined), 0
        for i in same:
            n = len(read[i][3]) // align
            blocks[i] = decoded[at : at + n].ravel()
            at += n
    out = []
    for i, (codec, rate, _, payload) in enumerate(read):
        pcm = blocks[i] if i in blocks else TABLES[codec][np.frombuffer(payload, np.uint8)]
        out.append((codec, payload, resample(pcm, rate, to)))
    return out


def codec_of(n_bytes: int) -> str:
    """The codec in which a text of so many bytes is kept: the three take turns."""
    return ("mulaw", "alaw", "ima_adpcm")[n_bytes % 3]


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, n_bytes long, media binary): the UTF-8 bytes of each text, padded with 255 to a positive multiple
    of UNIT, as the samples of a telephony WAVE file.

    Null texts count as empty (UNIT bytes of 255). Null ids stay; repeated rows give repeated files; equal texts give
    equal files. Other columns are left out, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = [(t or "").encode() for t in b.column(1).to_pylist()]
                files = [wave(t.ljust(max(UNIT, -(-len(t) // UNIT) * UNIT), b"\xff"), codec_of(len(t))) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
PCM = f"{DIGEST}, codec string, rate int, pcm binary"
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _files(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows in groups of about so many bytes of media, at least one."""
    rows, held = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                rows.append(row)
                held += len(row[2])
                if held >= most_bytes:
                    yield rows
                    rows, held = [], 0
    if rows:
        yield rows


def decoded(files: DataFrame, to: int = 16000) -> DataFrame:
    """The files of store_texts() read back: sizes and digests of payload and file, and 16-bit little-endian PCM at rate ``to``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _files(batches):
            found = zip(rows, decode_all([r[2] for r in rows], to), strict=True)
            yield _batch([(d, n, len(p), sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), sha256(m).hexdigest(), codec, to, pcm.astype("<i2").tobytes()) for (d, n, m), (codec, p, pcm) in found], PCM)

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, PCM)


def feature(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, peak, mean absolute value, sign changes and CRC-32 of PCM, joined by colons."""
    size = np.abs(pcm.astype(np.int32))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec}:{len(pcm)}:{size.max(initial=0)}:{int(size.sum(dtype=np.int64)) // max(1, len(pcm))}:{crossings}:{zlib.crc32(pcm.astype('<i2').tobytes())}"


def features(sound: DataFrame) -> DataFrame:
    """The rows of decoded(), with a feature() of their PCM in its place."""
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                found = [feature(codec, np.frombuffer(pcm, "<i2")) for codec, pcm in zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(found, pa.string())], names=[*names, "feature"])

    return sound.select(*names, "codec", "pcm").mapInArrow(run, f"{DIGEST}, feature string")


def audio_round_trip(docs: DataFrame, to: int = 16000, passes: int = 4) -> DataFrame:
    """The texts as WAVE files, their PCM at rate ``to``, and what both have: see store_texts(), decoded() and features().

    Files and PCM are written as tables into the shared folder and read back. PCM is four (ADPCM eight) times as large
    as the text, so its table is compressed harder; the files go once their PCM is there, in ``passes`` by a hash of
    the row, so that no more than such a part of the files lies beside it. One value of a column holds less than 2 GB,
    so a text of more than 250 MB raises.
    """
    cut = Cut(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sound = []
    for k in range(passes):
        files = cut(store_texts(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(passes)) == k)), "audio")
        sound.append(cut(decoded(files, to), "pcm", (files,), level=9))
    return features(reduce(DataFrame.unionByName, sound))
