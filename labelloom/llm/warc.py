"""WARC archives compressed record by record with Zstandard.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a Zstandard frame or
bare; after it comes one frame a record, so each can be decoded alone. The reader takes an archive as a stream: it
holds the dictionary and one record, and rejects a broken frame, version, header, length or digest by naming file and
byte. An archive that is written closes at ``ARCHIVE_BYTES`` of payload; its name tells partition and attempt, and only
archives of the attempt that succeeded are in the manifest, so lost executors leave no record twice.

Null html is an empty payload, a null url leaves the header out, line ends in a url are escaped. Rows that repeat
page_id and payload are each a record; where they have the largest page_id, each is a response.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import partitions, shared_dir, written

SKIPPABLE, FRAME, TRAINED = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 20, 16 << 10, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, record_id string, page_id long, warc_type string, target_uri string, refers_to long, refers_to_id string, payload_digest string, payload_bytes long, payload binary"
#: Fields that say how a record is to be read: they may not come twice with different values.
SINGLE = {"warc-type", "warc-record-id", "content-length", "transfer-encoding"}
HASHES = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "md5": hashlib.md5}


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit when it refers to another page: its block is the HTTP head alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe="!#$%&'()*+,/:;=?@[]~")}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary for the samples; where they are too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def dictionary_of(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if raw[:4] == TRAINED else zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: Iterable[bytes]) -> int:
    """Writes records as one archive; the number written. At most ``SAMPLE_BYTES`` are held to train the dictionary."""
    held, size, n = [], 0, 0
    source = iter(records)
    for record in source:
        held.append(record)
        size += len(record)
        if size >= SAMPLE_BYTES:
            break
    raw = train([x[: SAMPLE_BYTES // 8] for x in held])
    frame = zstandard.ZstdCompressor(level=9).compress(raw)
    out.write(SKIPPABLE + len(frame).to_bytes(4, "little") + frame)
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary_of(raw), write_checksum=True)
    for group in (held, source):
        for record in group:
            out.write(packer.compress(record))
            n += 1
    return n


def frames(source, path: str = "") -> Iterator[tuple[int, bytes]]:
    """``(offset, record)`` of each frame of an archive, read as a stream."""
    offset, rest = 0, b""

    def need(n: int) -> bytes:
        nonlocal rest
        while len(rest) < n and (more := source.read(1 << 20)):
            rest += more
        return rest[:n]

    dictionary = None
    if need(4) == SKIPPABLE:
        size = int.from_bytes(need(8)[4:], "little")
        raw = need(8 + size)[8:]
        if len(raw) < size:
            raise ValueError(f"{path}: the dictionary frame is cut off")
        rest, offset = rest[8 + size :], 8 + size
        if raw[:4] == FRAME:
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
        dictionary = dictionary_of(raw)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while need(4):
        if rest[:4] != FRAME:
            raise ValueError(f"{path}: no frame at byte {offset}")
        one, parts, began = reader.decompressobj(), [], offset
        try:
            while not one.eof:
                if not rest and not need(1):
                    raise ValueError(f"{path}: the frame at byte {began} is cut off")
                parts.append(one.decompress(rest))
                offset += len(rest) - len(one.unused_data)
                rest = one.unused_data
        except zstandard.ZstdError as e:
            raise ValueError(f"{path}: the frame at byte {began} is broken: {e}") from None
        yield began, b"".join(parts)


def headers(lines: bytes, where: str) -> dict[str, str]:
    """Fields by lower-case name. A line that begins with a blank goes on with the one before; values of a repeated field are joined by commas."""
    out: dict[str, str] = {}
    name = ""
    for line in lines.split(b"\r\n") if lines else []:
        try:
            text = line.decode("utf-8")
        except UnicodeDecodeError:
            text = line.decode("latin1")
        if text[:1] in (" ", "\t") and name:
            out[name] = f"{out[name]} {text.strip()}".strip()
            continue
        name, colon, value = text.partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon or not name or name in SINGLE and out.get(name, value) != value:
            raise ValueError(f"{where}: header {line[:80]!r}")
        out[name] = value if name in SINGLE or name not in out else f"{out[name]}, {value}"
    return out


def unchunked(body: bytes, where: str) -> bytes:
    """A body whose chunks each follow their length in hexadecimal, up to one of length 0."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            raise ValueError(f"{where}: the chunk at byte {at} of the body is broken")
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def digest_holds(label: str, *payloads: bytes) -> bool:
    """Whether one of the payloads has the labelled digest, in base32 or hexadecimal; a digest of another kind isn't judged."""
    kind, _, value = label.rpartition(":")
    make = HASHES.get(kind.lower().replace("-", "") or "sha1")
    return make is None or any(value.upper().rstrip("=") in (base64.b32encode(d).decode().rstrip("="), d.hex().upper()) for d in (make(x).digest() for x in payloads))


def parse_record(record: bytes, where: str = "") -> dict:
    """The fields of a record of any type, once its version, headers, lengths and digest hold.

    The payload of an HTTP message is its body, with chunks put together, of other blocks the whole. Archives of others
    may repeat header fields, name records by any URI (page_id is then null) and leave out the HTTP length or the digest,
    which is then that of the payload found.
    """
    head, gap, block = record.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"{where}: no WARC record")
    found = headers(lines, where)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in found:
            raise ValueError(f"{where}: {name} is missing")
    if not found["content-length"].isdigit() or len(block) != int(found["content-length"]) + 4 or block[-4:] != b"\r\n\r\n":
        raise ValueError(f"{where}: Content-Length {found['content-length']} for a block of {len(block) - 4} bytes")
    kind, block, size = found["warc-type"], block[:-4], None
    raw = payload = block
    if found.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        http, gap, raw = block.partition(b"\r\n\r\n")
        about = headers(http.partition(b"\r\n")[2], where)
        chunked = "chunked" in about.get("transfer-encoding", "").lower()
        payload = unchunked(raw, where) if chunked and raw else raw
        if not chunked and about.get("content-length", "").isdigit():
            size = int(about["content-length"])
    whole = kind != "revisit" and "warc-truncated" not in found and "warc-segment-number" not in found
    label = found.get("warc-payload-digest")
    if whole and (kind == "response" and size is not None and len(raw) != size or label and not digest_holds(label, payload, raw)):
        raise ValueError(f"{where}: the payload's length or digest is wrong")
    if kind == "revisit" and (payload or not {"warc-refers-to", "warc-refers-to-target-uri", "warc-payload-digest"} & found.keys()):
        raise ValueError(f"{where}: a revisit with a payload or without a target")
    number = lambda x: int(x[10:-1]) if x and x.startswith("<urn:page:") and x[10:-1].lstrip("-").isdigit() else None
    digest = label.removeprefix("sha1:") if label else payload_digest(payload)
    return {
        "record_id": found["warc-record-id"], "page_id": number(found["warc-record-id"]), "warc_type": kind, "target_uri": found.get("warc-target-uri"), "refers_to": number(found.get("warc-refers-to")),
        "refers_to_id": found.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": len(payload) if kind != "revisit" or size is None else size, "payload": payload if kind != "revisit" else None,
    }


def write_warc(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) below the shared folder; the manifest: path, records.

    Of equal payloads of at least ``revisit_from`` bytes the one with the largest page_id is a response, the others
    revisit it; smaller payloads are all responses.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    full = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    full = full.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    best = written(full.filter(F.col("size") >= revisit_from).groupBy("digest", "size").agg(F.max("page_id").alias("best"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "responses")
    rows = full.join(best, ["digest", "size"], "left").select("page_id", "url", "payload", F.when(F.col("best") != F.coalesce("page_id", F.lit(-1 << 63)), F.col("best")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        source = (tuple(x.as_py() for x in row) for b in batches for row in zip(*b.columns, strict=True))
        paths, counts, first = [], [], next(source, None)
        while first is not None:
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(paths):05d}.warc.zst"

            def records() -> Iterator[bytes]:
                nonlocal first
                size = 0
                while first is not None and size < ARCHIVE_BYTES:
                    size += len(first[2])
                    now, first = first, next(source, None)
                    yield record_bytes(*now)

            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                counts.append(write_archive(out, records()))
            paths.append(f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return written(rows.mapInArrow(run, "path string, records long"), "manifest")


def read_warc(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives at ``path``: columns of ``RECORD``; without ``payload`` that column is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)
        rows, size = [], 0
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            fs, local = pafs.FileSystem.from_uri(path)
            with fs.open_input_stream(local, compression=None) as source:
                for offset, record in frames(source, path):
                    row = parse_record(record, f"{path} at byte {offset}") | {"path": path}
                    if not payload:
                        row["payload"] = None
                    rows.append(row)
                    size += len(record)
                    if size > 8 << 20:
                        yield made(rows)
                        rows, size = [], 0
        yield made(rows)

    return manifest.select("path").repartition(partitions(manifest.sparkSession)).mapInArrow(run, RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Writes the pages and reads the archives back: one row a page."""
    back = read_warc(write_warc(pages, revisit_from), payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")
