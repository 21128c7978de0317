"""Zstandard-compressed web archives: one frame a record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from datetime import datetime, timezone
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.llm.common import Cut, new_folder, store_of

# Magic numbers of the skippable frame that holds a dictionary, of a frame and of a plain dictionary.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
DICTIONARY = 0xEC30A437
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class BrokenArchive(ValueError):
    """An archive that does not hold what its headers say."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: Names of records come from the archive and the record's place in it, so each has one of its own.
RECORDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:quireframe:records")


def _number(page_id: int | None) -> str:
    return "null" if page_id is None else str(page_id)


def _page(number: str) -> int | None:
    return None if number == "null" else int(number)


def _line(value: str | None) -> str:
    return "".join(c for c in value or "" if c not in "\r\n")


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_to_uri: str | None = None, name: str = "", date: str = "1970-01-01T00:00:00Z",
    http: bytes = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n",
) -> bytes:
    """A WARC/1.1 record: ``name`` makes its record id unique, ``date`` is when the archive was written (UTC).

    A revisit has the page's number, the one it refers to and the length of its payload in extension headers, and no
    payload; what it refers to is named by the response's target and digest.
    """
    revisit = refers_to is not None
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(RECORDS, f'{name} {_number(page_id)}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page", _number(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        headers += [("X-Refers-To-Page", _number(refers_to)), ("WARC-Refers-To-Target-URI", _line(refers_to_uri)), ("WARC-Profile", REVISIT)]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record; raises BrokenArchive where lengths or digests differ."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1" or not gap:
        raise BrokenArchive("no WARC/1.1 record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise BrokenArchive(f"bad header line {line!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest", "x-page"):
        if name not in headers:
            raise BrokenArchive(f"no {name}")
    try:
        datetime.fromisoformat(headers["warc-date"])
    except ValueError as error:
        raise BrokenArchive(f"bad date {headers['warc-date']!r}") from error
    n = headers["content-length"]
    if not n.isdigit() or len(rest) != int(n) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BrokenArchive(f"Content-Length {n} of a record with {len(rest) - 4} bytes")
    block = rest[:-4]
    if headers["warc-block-digest"] != f"sha1:{payload_digest(block)}":
        raise BrokenArchive("the block's digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise BrokenArchive("no HTTP header")
    if headers["warc-type"] == "response":
        if headers["warc-payload-digest"] != f"sha1:{payload_digest(payload)}" or headers.get("x-payload-length") != str(len(payload)):
            raise BrokenArchive("the payload's length or digest differs")
    elif headers["warc-type"] != "revisit" or payload or "x-refers-to-page" not in headers:
        raise BrokenArchive("neither a response nor a revisit")
    return headers, payload


def train_dictionary(samples: list[bytes], most_bytes: int = 32 << 10) -> bytes:
    """A Zstandard dictionary for records like the samples; empty where they are too few or too small to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(most_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(records: Iterable[bytes], out, dictionary: bytes = b"", level: int = 3) -> int:
    """Write records to a binary file: the dictionary (compressed) in a skippable frame, then one frame a record."""
    import zstandard

    if dictionary:
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor = zstandard.ZstdCompressor(level=level, dict_data=own, write_checksum=True, write_content_size=True)
    n = 0
    for data in records:
        out.write(compressor.compress(data))
        n += 1
    return n


def read_archive(source, piece: int = 1 << 20, most_record: int = 1 << 31) -> Iterator[bytes]:
    """The records of an archive, frame by frame; holds one record and about ``piece`` bytes of the file at a time."""
    import zstandard

    held = source.read(8)
    own = None
    if len(held) == 8 and struct.unpack("<I", held[:4])[0] == DICTIONARY_FRAME:
        n = struct.unpack("<I", held[4:])[0]
        packed = source.read(n)
        if len(packed) != n:
            raise BrokenArchive("the dictionary is cut short")
        if packed[:4] == struct.pack("<I", FRAME):
            packed = zstandard.ZstdDecompressor().decompress(packed)
        if packed[:4] != struct.pack("<I", DICTIONARY):
            raise BrokenArchive("no dictionary in the leading frame")
        own = zstandard.ZstdCompressionDict(packed)
        held = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=own)
    while held or (held := source.read(piece)):
        while len(held) < 18 and (more := source.read(piece)):
            held += more
        if held[:4] != struct.pack("<I", FRAME):
            raise BrokenArchive("no frame where one should begin")
        size = zstandard.frame_content_size(held)
        if not 0 <= size <= most_record:
            raise BrokenArchive(f"a frame of {size} bytes")
        frame, parts = decompressor.decompressobj(), []
        try:
            while True:
                parts.append(frame.decompress(held))
                if frame.eof:
                    held = frame.unused_data
                    break
                held = source.read(piece)
                if not held:
                    raise BrokenArchive("a frame is cut short")
        except zstandard.ZstdError as error:
            raise BrokenArchive(str(error)) from error
        data = b"".join(parts)
        if len(data) != size:
            raise BrokenArchive(f"{len(data)} bytes in a frame of {size}")
        yield data


def with_digests(pages: DataFrame) -> DataFrame:
    """(page_id long, url string, html string, payload_digest string, payload_bytes long); null html counts as empty."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.encode() for x in b.column(2).to_pylist()]
            more = [pa.array([payload_digest(x) for x in raw], pa.string()), pa.array([len(x) for x in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "payload_digest", "payload_bytes"])

    return plain.mapInArrow(run, "page_id long, url string, html string, payload_digest string, payload_bytes long")


def refer(pages: DataFrame, cut: Cut, least_bytes: int = 0) -> DataFrame:
    """with_digests(), refers_to (long) and refers_to_uri (that page's url): of pages with equal payloads of at least ``least_bytes``, the largest page_id is the
    response (null), the others refer to it. Smaller payloads are all responses.

    A payload that very many pages share is one row of the aggregate, made before the shuffle; the join reads written
    tables, so that Spark can split a skewed digest. Rows repeated with the largest page_id are responses each.
    """
    digested = cut(with_digests(pages), "pages")
    counted = digested.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("_last"), F.max_by("url", "page_id").alias("_uri"), F.count("*").alias("_n"))
    shared = cut(counted.where("_n > 1 AND _last IS NOT NULL").select(F.col("payload_digest").alias("_digest"), "_last", "_uri"), "shared")
    joined = digested.join(shared, F.col("payload_digest") == F.col("_digest"), "left")
    other = (F.col("page_id") != F.col("_last")) | (F.col("page_id").isNull() & F.col("_last").isNotNull())
    return joined.select(*digested.columns, F.when(other, F.col("_last")).alias("refers_to"), F.when(other, F.col("_uri")).alias("refers_to_uri"))


def write(referred: DataFrame, folder: str, samples: int = 200, sample_bytes: int = 16 << 10) -> DataFrame:
    """Write the rows of refer() as archives, one a partition, and return (path string, records long) of each.

    A file's dictionary is trained on its own first ``samples`` records (their first ``sample_bytes``), so that each
    file reads by itself. A task that runs again writes another file; only files that are returned count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = store_of(folder)
        path, n = f"{at}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst", 0
        date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

        def records() -> Iterator[bytes]:
            own = 0
            for whole in batches:
                for at in range(0, whole.num_rows, 64):
                    part = whole.slice(at, 64)
                    for page_id, url, html, digest, refers_to, uri in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        yield record(page_id, url, html.encode(), digest, refers_to, uri, f"{path} {own}", date)
                        own += 1

        rows = records()
        first = list(islice(rows, samples))
        if first:
            system.create_dir(at, recursive=True)
            with system.open_output_stream(path) as out:
                n = write_archive((x for some in (first, rows) for x in some), out, train_dictionary([x[:sample_bytes] for x in first]))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([n], pa.int64())], names=["path", "records"])

    return referred.select("page_id", "url", "html", "payload_digest", "refers_to", "refers_to_uri").mapInArrow(run, "path string, records long")


def read(files: DataFrame, batch: int = 256) -> DataFrame:
    """The records of archives, given (path string, records long): one row each, with the payload (empty for revisits).

    Every frame, header, length and digest is checked, and the number of records of a file; BrokenArchive ends the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for path, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, at = store_of(path)
                rows, n, held = [], 0, 0
                with system.open_input_stream(at) as source:
                    for data in read_archive(source):
                        h, payload = parse(data)
                        refers = _page(h["x-refers-to-page"]) if h["warc-type"] == "revisit" else None
                        rows.append((_page(h["x-page"]), h.get("warc-target-uri"), h["warc-type"], refers, int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), payload))
                        n += 1
                        held += len(payload)
                        if len(rows) >= batch or held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if n != expected:
                    raise BrokenArchive(f"{n} records in {path}, not {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "records").mapInArrow(run, READ)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write a record per page into archives in the shared folder and read them back; see refer(), write() and read().

    Null html and empty html are payloads of no bytes. Null page_id stays null and is never what others refer to.
    Repeated rows are records each. An empty table gives no rows. Other columns than page_id, url and html are left out.
    """
    cut = Cut(pages.sparkSession)
    folder = new_folder(pages.sparkSession, "warc")
    files = cut(write(refer(pages, cut, least_bytes), folder), "files")
    return read(files.repartition(max(1, files.count()))).drop("payload")  # a task for each archive
