"""WARC archives in Zstandard form: one frame for each record, the dictionary in a leading skippable frame.

The writer keeps a payload once: of equal payloads the record with the smallest id is a response, the
others are revisits that refer to it and hold its HTTP header only. Archives are written to a folder
that all machines share, under names that follow from the partition, so a task that runs again writes
the same files again; the reader takes the files that the writer's finished tasks have listed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import deleted, shared_folder

# Fixed values of the formats.
SKIPPABLE, SKIPPABLES = 0x184D2A5D, 0x184D2A50
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
ID = "urn:x-page:"


#: Records that hold what a server sent; those of other types are skipped.
CAPTURES = ("response", "resource", "revisit")


class WarcError(ValueError):
    """An archive or record that breaks the format."""


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        """The header fields and the body of the HTTP message in the block."""
        head, gap, body = self.block.partition(b"\r\n\r\n")
        if not gap or not head.startswith(b"HTTP/"):
            raise WarcError("no HTTP message")
        return _fields(head.split(b"\r\n")[1:]), body

    def content(self) -> tuple[dict[str, str], bytes]:
        """As http(), for records of any protocol; what isn't HTTP has no fields and is a body as a whole."""
        if self.headers.get("content-type", "").lower().startswith("application/http"):
            return self.http()
        return {}, self.block


def _fields(lines: list[bytes]) -> dict[str, str]:
    out, name = {}, None
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:  # goes on from the line before
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"no header field: {line[:80]!r}")
        name = name.strip().decode("utf-8", "replace").lower()
        out[name] = value.strip().decode("utf-8", "replace")
    return out


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    lines += [f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}\r\n\r\n"]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> Record:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC record")
    headers = _fields(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    n = headers["content-length"]
    if not n.isdigit() or len(rest) != int(n) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"{len(rest)} bytes after the header, which says {n} and a line end of 4")
    return Record(headers["warc-type"], headers, rest[:-4])


def archive(records: list[bytes], dictionary_bytes: int = 16384) -> bytes:
    """The records as one archive; the dictionary is trained on starts of up to 128 of them."""
    step = -(-len(records) // 128) or 1
    samples = [r[:4096] for r in records[::step]]
    try:
        trained = zstandard.train_dictionary(dictionary_bytes, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too small; any bytes can be a dictionary
        trained = b"".join(samples)[-dictionary_bytes:] or b"WARC/1.1\r\n"
    squeezed = zstandard.ZstdCompressor(level=9).compress(trained)
    pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(squeezed)), squeezed, *map(pack.compress, records)])


def frames(data: bytes) -> Iterator[bytes]:
    """The content of each frame, after the dictionary frame if there is one; other skippable frames are left out.

    An archive begins with the dictionary frame or, without a dictionary, with the first record.
    """
    if len(data) < 8:
        raise WarcError("no archive")
    magic, n = struct.unpack_from("<II", data)
    engine, at = zstandard.ZstdDecompressor(), 0
    if magic == SKIPPABLE:
        if 8 + n > len(data):
            raise WarcError("the dictionary frame is cut off")
        held = data[8 : 8 + n]
        try:
            if held.startswith(ZSTD_MAGIC):
                held = zstandard.ZstdDecompressor().decompress(held)
            engine, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)), 8 + n
        except zstandard.ZstdError as e:
            raise WarcError(f"the dictionary is broken: {e}") from e
    view = memoryview(data)
    while at < len(data):
        if len(data) - at >= 8 and struct.unpack_from("<I", data, at)[0] & ~0xF == SKIPPABLES:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            if at > len(data):
                raise WarcError("the last frame is cut off")
            continue
        if data[at : at + 4] != ZSTD_MAGIC:
            raise WarcError(f"no frame at {at}")
        one, parts, size = engine.decompressobj(), [], 2048
        while not one.eof:
            if at >= len(data):
                raise WarcError("the last frame is cut off")
            try:
                parts.append(one.decompress(view[at : at + size]))
            except zstandard.ZstdError as e:
                raise WarcError(f"the frame at {at} is broken: {e}") from e
            at, size = min(at + size, len(data)), min(2 * size, 1 << 20)
        at -= len(one.unused_data)
        yield b"".join(parts)


def _page(value: str | None) -> int | None:
    """The page id in a record id that record() wrote; None for any other, which stays as text."""
    inner = (value or "").removeprefix(f"<{ID}").removesuffix(">")
    return int(inner) if re.fullmatch(r"-?[0-9]{1,19}", inner) and value == f"<{ID}{inner}>" else None


def read_archive(data: bytes) -> Iterator[dict]:
    """A row for each capture of an archive; lengths and digests are verified where given, any fault raises WarcError.

    Responses and resources have their payload; a revisit has what its record says of it. record_id and
    refers_to_id are as written; page_id and refers_to are null where they aren't ids of pages.
    """
    for raw in frames(data):
        r = parse_record(raw)
        if r.kind not in CAPTURES:
            continue
        fields, body = r.content()
        length, given = fields.get("content-length", ""), r.headers.get("warc-payload-digest", "")
        sha = given.removeprefix("sha1:") if given.startswith("sha1:") else None
        if length and not length.isdigit():
            raise WarcError(f"no length: {length}")
        if r.kind == "revisit":
            if body:
                raise WarcError("a revisit with a payload")
            n = int(length) if length else None
        else:
            n, own = len(body), digest(body)
            if length and int(length) != n or sha is not None and sha != own:
                raise WarcError("the payload differs from its length or digest")
            sha = own
        refers = r.headers.get("warc-refers-to") if r.kind == "revisit" else None
        ids = {"record_id": r.headers["warc-record-id"], "refers_to_id": refers, "page_id": _page(r.headers["warc-record-id"]), "refers_to": _page(refers)}
        yield ids | {"url": r.headers.get("warc-target-uri"), "payload_bytes": n, "payload_digest": sha, "record_type": r.kind, "payload": None if r.kind == "revisit" else body}


def with_record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, revisit, refers_to: which pages repeat the payload of a smaller page_id.

    Payloads of fewer than least_bytes bytes never refer to another. Two digests of different kinds are
    grouped in narrow rows, combined before the shuffle; payloads are equal if both and the lengths are.
    The join back is by digest, and Spark splits one that many pages share.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.concat(F.unhex(F.sha1("payload")), F.unhex(F.md5("payload")), F.hex(F.length("payload")).cast("binary")))
    firsts = rows.groupBy(F.col("sha").alias("of")).agg(F.min("page_id").alias("first"))
    again = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()) & (F.length("payload") >= least_bytes)
    return rows.join(firsts, F.col("sha") == F.col("of")).select("page_id", "url", "payload", again.alias("revisit"), F.when(again, F.col("first")).alias("refers_to"))


def writer(folder: str, archive_bytes: int):
    """What a task does to write its records (page_id, url, payload, revisit, refers_to) as archives of about archive_bytes.

    Each attempt of a task writes files of its own, under names that no other has, and never renames one. So
    attempts that run twice or at the same time don't meet, whatever the store does to a file that is there.
    """

    def write(batches):
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        attempt, held, size, done = f"{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}", [], 0, []

        def close():
            nonlocal held, size
            data, name = archive(held), f"part-{attempt}-{len(done):05d}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:  # else the name would make it one more frame
                out.write(data)
            done.append((name, len(held), len(data)))
            held, size = [], 0

        for batch in batches:
            for page_id, url, payload, revisit, refers in zip(*batch.columns):
                body = payload.as_py()
                held.append(record(page_id.as_py(), url.as_py(), body, digest(body), refers.as_py(), revisit.as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    close()
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return write


def write_archives(records: DataFrame, folder: str, archive_bytes: int = 24_000_000) -> DataFrame:
    """Writes the rows of with_record_types() as archives; path, records and bytes of each, already written.

    folder is a URI that pyarrow can write from any executor. A new archive begins beyond archive_bytes
    of records, which are in the order of their ids. The list holds the files of the attempts that Spark has
    committed; what others left behind isn't listed, and is removed.
    """
    listed = f"{folder}/listed"
    rows = records.select("page_id", "url", "payload", "revisit", "refers_to").sortWithinPartitions("page_id", "url")
    rows.mapInArrow(writer(folder, archive_bytes), "archive string, records long, bytes long").write.parquet(listed)
    out = records.sparkSession.read.parquet(listed)
    remove_unlisted(folder, out)
    return out


def remove_unlisted(folder: str, listed: DataFrame) -> None:
    """Removes archives in folder that aren't listed: those of attempts that died, or lost to another."""
    there = listed.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"))

    def remove(rows):
        store, base = fs.FileSystem.from_uri(folder)
        for r in rows:
            store.delete_file(f"{base}/{r['archive']}")

    there.join(listed.select("archive"), "archive", "left_anti").foreachPartition(remove)


def read_archives(spark: SparkSession, folder: str, listed: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each capture of the listed archives in folder; with payloads, a revisit gets that of its response.

    Archives of any writer will do: records of other types are skipped, ids of other kinds stay as text.
    They are read by Spark, so they can be in any store. One that breaks the format fails the job.
    """

    def load(batches):
        for batch in batches:
            for content in batch.column(0):
                found = list(read_archive(content.as_py()))
                kinds = {"record_id": pa.string(), "refers_to_id": pa.string(), "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
                kinds |= {"payload": pa.binary()} if payloads else {}
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in kinds.items()], list(kinds))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder)
    named = files.withColumn("archive", F.element_at(F.split("path", "/"), -1)).join(listed.select("archive"), "archive", "left_semi")
    schema = "record_id string, refers_to_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    out = named.select("content").mapInArrow(load, schema + ", payload binary" * payloads)
    if not payloads:
        return out
    own = out.filter("record_type <> 'revisit'").select(F.col("record_id").alias("rid"), F.col("payload_digest").alias("rsha"), F.col("payload").alias("full"))
    one = own.withColumn("nth", F.row_number().over(Window.partitionBy("rid", "rsha").orderBy(F.lit(1)))).filter("nth = 1")
    both = out.join(one, (F.col("refers_to_id") == F.col("rid")) & (F.col("payload_digest") == F.col("rsha")), "left")
    return both.withColumn("payload", F.coalesce("payload", "full")).drop("rid", "rsha", "full", "nth")


def through_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages and reads the archives back, without the payloads.

    Edge cases: null html is an empty payload, a null url gives no target, null page ids are written
    as such and never chosen as the response while a payload has another id. Rows that repeat both id
    and payload have one type; very long payloads are records like others. An empty table gives no
    archives and no rows. Other columns of pages
    aren't looked at.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    listed = write_archives(with_record_types(pages, least_bytes), folder)
    deleted(spark, folder, at_end=True)
    return read_archives(spark, folder, listed).drop("record_id", "refers_to_id")
