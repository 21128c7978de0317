import hashlib
import zlib

import numpy as np
import pytest

from quireframe.llm import audio
from quireframe.llm.contract import op7_audio


def plain_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(audio.INDEX_CHANGE[code])))
            out.append(value)
    return out


def test_expansion_tables():
    mulaw, alaw = audio.TABLES["mulaw"], audio.TABLES["alaw"]
    assert (mulaw[0x00], mulaw[0x80], mulaw[0xFF], mulaw[0x7F]) == (-32124, 32124, 0, 0)
    assert (alaw[0x2A], alaw[0xAA], alaw[0xD5], alaw[0x55]) == (-32256, 32256, 8, -8)
    assert len(set(alaw.tolist())) == 256 and len(set(mulaw.tolist())) == 255


def test_adpcm_blocks_step_together():
    blocks = np.random.default_rng(3).integers(0, 256, (7, 40), dtype=np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]


def test_resampling():
    pcm = np.array([0, 10, -7, 32767, -32768], np.int16)
    assert audio.resample(pcm, 8000, 16000).tolist() == [0, 5, 10, 1, -7, 16380, 32767, -1, -32768, -32768]
    general = audio.resample(pcm, 8000, 12000)
    assert len(general) == 7 and general[3] == -7
    assert audio.resample(pcm, 8000, 8000) is pcm and len(audio.resample(pcm[:0], 8000, 16000)) == 0


def test_wave_files():
    for codec in audio.TAGS:
        media = audio.wave(b"\x01\x02\x03" * 192, codec)
        assert audio.read_wave(media)[0] == codec and audio.read_wave(media)[3] == b"\x01\x02\x03" * 192
        with pytest.raises(ValueError):
            audio.read_wave(media[:-1])


def check(rows, docs):
    assert len(rows) == len(docs)
    by_text = {}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        media = audio.wave(payload, audio.codec_of(len(raw)))
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        codec = r.feature.split(":")[0]
        if codec == "ima_adpcm":
            pcm = np.array([x for i in range(0, len(payload), 576) for x in plain_adpcm(payload[i : i + 576])], np.int16)
        else:
            pcm = np.array([audio.TABLES[codec][b] for b in payload], np.int16)
        assert r.feature == audio.feature(codec, audio.resample(pcm, 8000, 16000))
        assert by_text.setdefault(raw, r.feature) == r.feature


def test_query(spark, sf):
    check(op7_audio(spark, sf).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


def test_hard_rows(spark):
    docs = {1: None, 2: "", 3: "x" * 576, 4: "é" * 3_000_000, 5: "x" * 577, 6: "x" * 578}
    df = spark.createDataFrame([(d, t, b"m") for d, t in docs.items()], "doc_id long, text string, media binary")
    small = df.where("doc_id <> 4")
    check(audio.audio_round_trip(small).collect(), {d: t for d, t in docs.items() if d != 4})
    assert audio.audio_round_trip(df).where("doc_id = 4").first().n_bytes == 6_000_000
    assert audio.audio_round_trip(df.limit(0)).count() == 0
    assert audio.audio_round_trip(df.union(df)).where("doc_id = 3").count() == 2
    pcm = audio.decoded(audio.store_texts(small)).where("doc_id = 3").first()
    assert pcm.rate == 16000 and len(pcm.pcm) == 2 * 2 * 576


def test_pcm_is_stored(spark, monkeypatch):
    """The features come from a stored table of PCM."""
    kept = []
    plain = audio.Cut.__call__
    monkeypatch.setattr(audio.Cut, "__call__", lambda self, df, name, *a, **k: kept.append((name, plain(self, df, name, *a, **k))) or kept[-1][1])
    df = spark.createDataFrame([(1, "abc"), (2, "x" * 577)], "doc_id long, text string")
    rows = {r.doc_id: r for r in audio.audio_round_trip(df).collect()}
    stored = {r.doc_id: r for name, table in kept if name == "pcm" for r in table.collect()}
    assert set(stored) == {1, 2} and all(rows[d].feature == audio.feature(r.codec, np.frombuffer(r.pcm, "<i2")) for d, r in stored.items())
