"""WARC archives in Zstandard, one frame per record.

An archive starts with a skippable frame that holds the dictionary for all its other frames;
every other frame is one record. Spark's text sink writes the archives: a row is a frame,
and the line separator is an empty skippable frame, which decoders pass over. So archives are
written through Spark's own committer into any store it can reach, and a lost executor
costs no more than its task. They are read back as binary files, a task at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE = 48_000_000  # payload bytes aimed at in an archive
LEAST_REVISIT = 1000  # shorter payloads are always stored
RECORD = 600  # bytes that a record counts for besides its payload
SPREAD = 64  # archives that the copies of one payload are dealt to at least
COPIES = 100_000  # copies of one payload in an archive, on the average, that give it more archives
SAMPLE = 400  # pages that the dictionary is trained on
DICTIONARY = 32_768  # bytes
SEPARATOR = "P*M\x18\0\0\0\0"  # an empty skippable frame
# Fixed values of the formats
DICTIONARY_FRAME, SKIPPABLE, FRAME = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _train(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> bytes:
    """A dictionary from at most ``SAMPLE`` pages of the smallest hashes; empty if there is too little text.

    The hashes are ranked alone, so that no task sends more than ``SAMPLE`` numbers.
    """
    import zstandard

    rank = F.xxhash64(id_col, url_col)
    last = pages.select(rank.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    rows = pages.where((rank <= last) & (F.length(body_col) > 0)).select(F.left(body_col, F.lit(20_000)).alias("body")).limit(SAMPLE).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY, [r["body"].encode("utf-8", "replace") for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _b32(hexdigest: str) -> str:
    return base64.b32encode(bytes.fromhex(hexdigest)).decode()


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to, size: int) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only and names the record it refers to."""
    block = HTTP if refers_to is not None else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else "%" + "%".join(f"{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "urn:none"),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{_b32(digest)}",
        f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).hexdigest())}",
        f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write every row of ``pages`` as a record into archives under ``path``.

    Among records of equal payloads of at least ``LEAST_REVISIT`` bytes the one with the largest
    identifier is a response and the others are revisits of it; shorter payloads are always responses. A
    null body is an empty payload. Of repeated rows with the largest identifier the records all are
    responses. A null identifier is written as ``None`` and never referred to. Other columns are ignored.
    """
    dictionary = _train(pages, id_col, url_col, body_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(body_col), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("bigint")})
    groups = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    total, count = pages.agg(F.sum(F.coalesce(F.octet_length(body_col), F.lit(0)) + RECORD), F.count(F.lit(1))).first()
    n = max(1, -(-(total or 0) // ARCHIVE))
    # payloads with very many copies take more salts; at most one row in SPREAD * COPIES names such a payload
    many = {r["digest"]: -(-r["n"] // COPIES) for r in groups.where(F.col("n") > SPREAD * COPIES).select("digest", "n").collect()} if count > SPREAD * COPIES else {}
    salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in many.items() for x in pair]), "digest"), F.lit(SPREAD)) if many else F.lit(SPREAD)
    keepers = groups.where("n > 1 AND keeper IS NOT NULL").select("digest", "keeper", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    # the copies of a payload share a digest; the salt, by row, deals them out to several archives
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), salts).cast("int")).repartition(n, "digest", "salt")
    dealt = rows.join(keepers.repartition(n, "digest", "salt").hint("merge"), ["digest", "salt"], "left")
    refers = F.when((F.col("size") >= LEAST_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    records = dealt.select("page_id", "url", "digest", "size", refers.alias("refers_to"), F.when(refers.isNull(), F.col("payload")).alias("payload"))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        tool = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True, write_content_size=True)
        yield pa.RecordBatch.from_arrays([pa.array([struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary])], names=["frame"])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out.append(tool.compress(_record(r["page_id"], r["url"], r["payload"] or b"", r["digest"], r["refers_to"], r["size"])))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    records.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def read_frames(archive: bytes) -> Iterator[bytes]:
    """The records of one archive: the dictionary from the leading skippable frame, then a frame each.

    A frame's own length comes from decoding it alone; what lies between frames must be skippable.
    """
    import zstandard

    if len(archive) < 8:
        raise ArchiveError("no leading frame")
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_FRAME or 8 + size > len(archive):
        raise ArchiveError("the archive does not start with a dictionary frame")
    dictionary, view = archive[8 : 8 + size], memoryview(archive)
    if dictionary[:4] == struct.pack("<I", FRAME):  # the dictionary itself may be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    at = 8 + size
    while at < len(archive):
        if at + 8 > len(archive):
            raise ArchiveError(f"{len(archive) - at} stray bytes at the end")
        magic, size = struct.unpack_from("<II", archive, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            at += 8 + size
            if at > len(archive):
                raise ArchiveError("a skippable frame is cut off")
            continue
        if magic != FRAME:
            raise ArchiveError(f"no frame at byte {at}")
        one, start, parts = tool.decompressobj(), at, []
        while not one.eof:  # in steps, so that decoding one frame never copies the rest of the archive
            if start >= len(archive):
                raise ArchiveError(f"the frame at byte {at} is cut off")
            step = view[start : start + 65_536]
            try:
                parts.append(one.decompress(step))
            except zstandard.ZstdError as error:
                raise ArchiveError(f"the frame at byte {at} is damaged: {error}") from None
            start += len(step)
        at = start - len(one.unused_data)
        yield b"".join(parts)


def _number(fields: dict[str, str], name: str) -> int | None:
    """The page of a record identifier; null for identifiers of other makers."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", fields[name])
    return int(found[1]) if found else None


def _size(fields: dict[str, str], name: str) -> int:
    if not re.fullmatch("[0-9]{1,18}", fields[name]):
        raise ArchiveError(f"{name} is no length: {fields[name][:80]!r}")
    return int(fields[name])


def _checked(content: bytes, fields: dict[str, str], name: str) -> str:
    """SHA-1 of ``content`` in hex after comparing it with the field, if there is one and it is a SHA-1."""
    digest = hashlib.sha1(content).hexdigest()
    if fields.get(name, "").lower().startswith("sha1:") and fields[name][5:].upper() != _b32(digest) and fields[name][5:].lower() != digest:
        raise ArchiveError(f"the record differs from its {name}")
    return digest


def parse_record(record: bytes) -> dict | None:
    """Fields of a record after validation: version, header lines, lengths and digests.

    Records of other types than response and revisit are validated and give None. The digests and the payload's
    length are optional, as in the format; without them they are those of the content (a revisit's are null).
    """
    head, mark, rest = record.partition(b"\r\n\r\n")
    try:
        lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as error:
        raise ArchiveError(f"the head is no text: {error}") from None
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError("no WARC/1.0 or WARC/1.1 record")
    names = {x.lower(): x for x in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest", "WARC-Block-Digest", "X-Payload-Length", "WARC-Refers-To", "WARC-Target-URI")}
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        name = names.get(name.lower(), name.lower())
        if not colon or not name or name in fields and name in names.values():
            raise ArchiveError(f"bad header line {line[:80]!r}")
        fields[name] = value.strip()
    if missing := [x for x in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length") if x not in fields]:
        raise ArchiveError(f"missing {missing}")
    length = _size(fields, "Content-Length")
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ArchiveError("Content-Length does not fit the record")
    _checked(block, fields, "WARC-Block-Digest")
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    _, mark, payload = block.partition(b"\r\n\r\n")
    size = _size(fields, "X-Payload-Length") if "X-Payload-Length" in fields else None
    if kind == "response":
        if not mark:
            raise ArchiveError("a response without the end of its HTTP head")
        digest = _checked(payload, fields, "WARC-Payload-Digest")
        if size not in (None, len(payload)):
            raise ArchiveError("the payload differs from its length")
        size = len(payload)
    else:
        if "WARC-Refers-To" not in fields:
            raise ArchiveError("a revisit without WARC-Refers-To")
        digest = _hex(fields["WARC-Payload-Digest"]) if "WARC-Payload-Digest" in fields else None
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": _number(fields, "WARC-Record-ID"),
        "url": None if url == "urn:none" else url,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _number(fields, "WARC-Refers-To") if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def _hex(digest: str) -> str:
    """A digest field as hex; SHA-1 in base 32 is turned, others keep their text."""
    kind, _, value = digest.partition(":")
    if kind.lower() != "sha1" or len(value) != 32:
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex()
    except ValueError:
        raise ArchiveError(f"no digest: {digest[:80]!r}") from None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per response and revisit of all archives under ``path``; a damaged archive fails with ``ArchiveError``.

    Records of other types are validated and passed over. ``page_id`` and ``refers_to`` are null where the
    record's identifier is not one that ``write_archives`` gives.
    An empty archive folder gives no rows; an archive without records neither.
    """
    names = [f.split(" ")[0] for f in READ.split(", ")][: None if with_payload else -1]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=False)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in read_frames(content.as_py()):
                    if (row := parse_record(record)) is not None:
                        rows.append(row)
                        size += len(record)
                    if size > 4_000_000:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, READ if with_payload else READ.rpartition(", ")[0])
