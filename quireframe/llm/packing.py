"""Packing documents into training sequences with bounded-space online best fit."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END = (0).to_bytes(4, "little")
#: A space beside other white space: there the tokenizer's splits depend on more than the next chunk.
MIXED_SPACE = re.compile(r" \s|\s ")
# Fixed value: the pattern by which byte-level tokenizers split text.
SPLITS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_ranks(path: str) -> dict[bytes, int] | None:
    """Ranks by bytes of a byte-level BPE file whose merges stand in the order of their ids; None for any other file."""
    with open(path, encoding="utf-8") as f:
        parsed = json.load(f)
    model, before = parsed["model"], parsed.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not parsed.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain:
        return None
    vocabulary = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [vocabulary.get("".join(m)) for m in merges] != list(range(256, 256 + len(merges))):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(merges)}


class TokenIds:
    """The ids of texts as little-endian unsigned 32-bit bytes, by a tokenizers file.

    A byte-level tokenizer never merges across a space that stands alone between two words, so a text is encoded
    chunk by chunk at such spaces and the ids of chunks are kept (at most ``keep`` of them). Where the file is a plain
    byte-level BPE, chunks are encoded by rank, which gives the same ids at a tenth of the time. Texts in which a
    space touches other white space or an added token of the file stands (such as an end-of-text mark, which then is
    its one id), and all texts for any other kind of file, go to the tokenizers library whole.
    """

    def __init__(self, path: str, keep: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([MIXED_SPACE.pattern, "\0", *added]))
        self.known: dict[str, bytes] = {}
        self.keep = keep
        self.ranked = None
        if ranks := _byte_ranks(path):
            import tiktoken

            self.ranked = tiktoken.Encoding("chunks", pat_str=SPLITS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                self.lengths[i] = len(token)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        """Keep the ids of new chunks. Those that begin with a space and end with none are encoded as one text and cut
        where their bytes end; the others, and all if a cut falls inside a token, are encoded one by one."""
        joined = [c for c in new if c[:1] == " " and not c[-1].isspace()]
        ids = np.asarray(self.ranked("".join(joined)), np.int64)
        ends = np.cumsum([len(c.encode()) for c in joined])
        token_ends = np.cumsum(self.lengths[ids])
        cuts = np.searchsorted(token_ends, ends) + 1
        if joined and (cuts[-1] != len(ids) or (token_ends[cuts - 1] != ends).any()):
            joined, cuts = [], []
        raw, at = ids.astype("<u4").tobytes(), 0
        for c, end in zip(joined, (4 * cuts).tolist() if joined else (), strict=True):
            self.known[c] = raw[at:end]
            at = end
        for c in new.difference(joined):
            own = self.ranked(c)
            self.known[c] = struct.pack(f"<{len(own)}I", *own)

    def of(self, texts: list[str]) -> list[bytes]:
        chunks = [None if not self.ranked or self.whole.search(t) else t.replace(" ", "\0 ").split("\0") for t in texts]
        known, new = self.known, set()
        for found in chunks:
            if found:
                new |= set(found).difference(known)
        self._learn(new)
        whole = iter(self._whole([t for t, c in zip(texts, chunks, strict=True) if c is None]))
        out = [next(whole) if c is None else b"".join(map(known.__getitem__, c)) for c in chunks]
        if len(known) > self.keep:
            for c in new:
                del known[c]
        return out


class Packer:
    """Best-fit packing of one partition with a fixed number of open windows.

    A document of more than a window first fills whole windows. What is left goes to the open window with the least
    room that still holds it. When none does, the fullest open window takes as much of it as it has room for and is
    emitted, and the rest is placed again. finish() merges what is left in the open windows into full windows and
    cuts the remainder, shorter than a window, into sequences with powers of two as lengths, which need no padding.
    """

    def __init__(self, size: int, windows: int, first_id: int):
        if size & (size - 1) or size < 1 or windows < 1:
            raise ValueError("size must be a power of two and windows positive")
        self.size, self.windows, self.next_id = size, windows, first_id
        self.open: list[list] = []  # [used, pieces]; a piece is (doc, start, ids, doc_tokens)
        self.rows: list[tuple] = []

    def _emit(self, pieces: Iterable[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        size, total, start = self.size, len(ids) // 4, 0
        while total - start >= size:
            self._emit([(doc, start, ids[4 * start : 4 * (start + size)], total)])
            start += size
        while (rest := total - start) > 0:
            fits = [w for w in self.open if size - w[0] >= rest]
            if fits:
                window = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                window = [0, []]
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
            n = min(rest, size - window[0])
            window[1].append((doc, start, ids[4 * start : 4 * (start + n)], total))
            window[0] += n
            start += n
            if window[0] == size:
                self.open.remove(window)
                self._emit(window[1])

    def finish(self) -> None:
        left = [p for w in self.open for p in w[1]]
        room = sum(w[0] for w in self.open)
        self.open = []
        at = 0  # ids of left[0] that are used
        while room:
            want = self.size if room >= self.size else 1 << (room.bit_length() - 1)
            room -= want
            pieces = []
            while want:
                doc, start, ids, total = left[0]
                n = min(want, len(ids) // 4 - at)
                pieces.append((doc, start + at, ids[4 * at : 4 * (at + n)], total))
                want -= n
                at += n
                if 4 * at == len(ids):
                    left.pop(0)
                    at = 0
            self._emit(pieces)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 7
        self.rows = []
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


_IDS: dict[str, TokenIds] = {}


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, windows: int = 32, batch: int = 64) -> DataFrame:
    """Pack documents (doc_id long, text string) into sequences of at most ``size`` tokens; one row per piece.

    Each document is its token ids followed by id 0; each id lies in exactly one piece. Every input partition is
    packed by itself in its own order, with ``windows`` open windows, so nothing is shuffled and a task holds no more
    than those windows and ``batch`` texts. All sequences but at most log2(size) of a partition are full, and those
    have powers of two as lengths, so none needs padding. sequence_id is unique: partition number times 2^33 plus a
    count.

    Null texts count as empty: one piece with id 0 alone. Null ids stay null. Repeated rows are packed once for each
    row. Long texts are cut into full windows. Columns other than doc_id and text are left out. An empty table gives
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _IDS.get(tokenizer_path) or _IDS.setdefault(tokenizer_path, TokenIds(tokenizer_path))
        packer = Packer(size, windows, TaskContext.get().partitionId() << 33)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc, found in zip(part.column(0).to_pylist(), ids.of(texts), strict=True):
                    packer.add(doc, found + END)
                if len(packer.rows) > 5000:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, PIECES)
