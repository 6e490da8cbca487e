"""Legacy archive converter: ARC records (versions 1 and 2) to WARC records, written as gzip members and read back."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import Scratch

#: Payloads shorter than this are never revisits.
LEAST_REVISIT_BYTES = 100
#: Parts that a join on a digest is dealt to, so that a hot payload is no hot task.
SALTS = 16
#: What stands for the address of a record that has none.
NO_URL = "about:blank"
#: An archive file is closed when it has so many bytes (besides one record).
FILE_BYTES = 8_000_000
#: The field names of an ARC header line, by version.
ARC_FIELDS = {1: ["url", "ip", "date", "type", "length"], 2: ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"]}
VERSION_LINE = {1: b"1 0 legacy", 2: b"2 0 legacy"}


def arc_line(version: int, url: str, ip: str, date: str, kind: str, length: int, filename: str = "-", status: int = 200, checksum: str = "-", offset: int = 0) -> bytes:
    """An ARC header line. Blanks inside a url would end the field, so they are percent-encoded."""
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    fields = {"url": safe, "ip": ip, "date": date, "type": kind, "status": str(status), "checksum": checksum, "location": "-", "offset": str(offset), "filename": filename, "length": str(length)}
    return " ".join(fields[x] for x in ARC_FIELDS[version]).encode("utf-8", "surrogatepass") + b"\n"


def arc_file(version: int, records: list[tuple[str, str, str, bytes]], filename: str = "legacy.arc") -> bytes:
    """A version block and (url, date, type, payload) records, each followed by a line end."""
    names = {1: b"URL IP-address Archive-date Content-type Archive-length\n", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"}[version]
    block = VERSION_LINE[version] + b"\n" + names
    out = [arc_line(version, f"filedesc://{filename}", "0.0.0.0", "20000101000000", "text/plain", len(block), filename), block, b"\n"]
    at = sum(map(len, out))
    for url, date, kind, payload in records:
        line = arc_line(version, url, "0.0.0.0", date, kind, len(payload), filename, offset=at)
        out += [line, payload, b"\n"]
        at += len(line) + len(payload) + 1
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of each record, by its declared length; the version block says which fields a line has.

    Lines that do not have the version's number of fields, or lengths that run past the end, raise ValueError: an
    archive is read whole or not at all.
    """
    at, version = 0, 1
    while at < len(data):
        if data[at : at + 1] == b"\n":  # the record's end
            at += 1
            continue
        end = data.index(b"\n", at)
        fields = data[at:end].decode("utf-8", "surrogatepass").split(" ")
        first = fields[0].startswith("filedesc://")
        if first:
            body = data[end + 1 : end + 1 + int(fields[-1])]
            version = int(body.split(b" ", 1)[0])
        names = ARC_FIELDS[version]
        if len(fields) != len(names):
            raise ValueError(f"an ARC header line of version {version} has {len(names)} fields, not {len(fields)}")
        head = dict(zip(names, fields, strict=True))
        n = int(head["length"])
        if n < 0 or end + 1 + n > len(data):
            raise ValueError("a declared length runs past the archive")
        if not first:
            yield head, data[end + 1 : end + 1 + n]
        at = end + 1 + n + 1


def warc_date(arc_date: str) -> str:
    """20010203040506 (or shorter, filled up) -> 2001-02-03T04:05:06Z."""
    full = (arc_date + "00000101000000"[len(arc_date) :])[:14] if arc_date.isdigit() else "19700101000000"
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def http_message(payload: bytes, kind: str) -> bytes:
    """What a crawler would have stored for a page of which only the payload is left."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: {kind}; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(header with its blank line, payload) of an HTTP message; a body without a header is all payload."""
    if body.startswith(b"HTTP/"):
        ends = [(at + len(gap), gap) for gap in (b"\r\n\r\n", b"\n\n") if (at := body.find(gap)) >= 0]
        if ends:
            end = min(ends)[0]
            return body[:end], body[end:]
    return b"", body


def escaped(key: str) -> str:
    """A key as a header value: control characters and % are percent-encoded, so that ``unquote`` gives it back."""
    return re.sub(r"[\x00-\x20\x7f-\x9f%]", lambda m: "".join(f"%{c:02X}" for c in m[0].encode()), key)


def record_id(*parts: str) -> str:
    """A name-based UUID: the same conversion gives the same ids, and the parts hold the place in the archive, so no two records share one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts))}>"


def header(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(filename: str) -> bytes:
    """The record that opens an archive."""
    block = b"software: ARC to WARC conversion\r\nformat: WARC File Format 1.1\r\n"
    return header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", filename)), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Filename", filename), ("Content-Type", "application/warc-fields")], block)


def warc_record(head: dict[str, str], body: bytes, place: str, key: str | None, first: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record for an ARC record (header fields, body): a response, or a revisit of first (key, url, date) with the header alone as its block.

    A body without an HTTP header becomes a resource. place is the record's place in the archive.
    """
    lines, payload = split_http(body)
    digest = hashlib.sha256(payload).hexdigest()
    kind = "resource" if not lines else "revisit" if first else "response"
    target = head["url"] if head["url"] not in ("", "-") else NO_URL
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(place, key or "", target, digest)), ("WARC-Date", warc_date(head["date"])), ("WARC-Target-URI", target)]
    fields += [("WARC-IP-Address", head["ip"])] * (head["ip"] not in ("", "-", "0.0.0.0"))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response" if lines else head["type"] if "/" in head["type"] else "application/octet-stream")]
    fields += [] if key is None else [("X-Key", escaped(key))]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", first[1] or NO_URL), ("WARC-Refers-To-Date", warc_date(first[2])), ("X-Refers-To-Key", escaped(first[0]))]
    return header(fields, lines if kind == "revisit" else body)


def members(blob: bytes) -> Iterator[bytes]:
    """The gzip members of a file one by one, without copying the rest of the file for each."""
    view, at = memoryview(blob), 0
    while at < len(blob):
        member, parts, pos = zlib.decompressobj(31), [], at
        while not member.eof:
            part = view[pos : pos + 65536]
            if not len(part):
                raise ValueError("a cut gzip member")
            parts.append(member.decompress(part))
            pos += len(part)
        at = pos - len(member.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or fields["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError("a WARC block does not match its length or digest")
    return fields, block


def arc_records(spark: SparkSession, folder: str) -> DataFrame:
    """(key, url, ip, date, type, body, digest, bytes) of every record of the .arc and .arc.gz files below folder; digest and bytes are the payload's.

    key is the file's name and the record's number. A file (about 100 MB by convention) is read by one task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, blob in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for k, (head, body) in enumerate(read_arc(b"".join(members(blob)) if path.endswith(".gz") else bytes(blob))):
                    payload = split_http(body)[1]
                    rows.append((f"{path.rpartition('/')[2]}#{k}", head["url"], head["ip"], head["date"], head["type"], body, hashlib.sha256(payload).hexdigest(), len(payload)))
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    names = ["key", "url", "ip", "date", "type", "body", "digest", "bytes"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arc*").option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike(r"\.arc(\.gz)?$"))
    return files.select("path", "content").mapInPandas(run, "key string, url string, ip string, date string, type string, body binary, digest string, bytes long")


def marked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (_id, _url, _date, digest, bytes, ...) with first: a struct (id, url, date) for those that revisit another id's payload.

    Only payloads of LEAST_REVISIT_BYTES bytes take part, and of these only keys and digests: the ids that share a digest
    are found without the payloads, then attached by id and digest, so a hot payload is no hot key. The join that names
    copies is salted, as is that of rows without an id.
    """
    light = rows.where(F.col("bytes") >= LEAST_REVISIT_BYTES).select("_id", "_url", "_date", "digest")
    named = light.where(F.col("_id").isNotNull())
    shared = named.groupBy("digest").agg(F.min(F.struct(F.col("_id").alias("id"), F.col("_url").alias("url"), F.col("_date").alias("date"))).alias("first"), F.max("_id").alias("last"))
    loose = light.where(F.col("_id").isNull()).select("digest").distinct().withColumn("loose", F.lit(True))
    shared = shared.join(loose, "digest", "left").where((F.col("first.id") < F.col("last")) | F.col("loose")).select("digest", "first")
    shared = scratch.keep(shared, "shared").select("*", F.explode(F.expr(f"sequence(0, {SALTS} - 1)")).alias("salt"))
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int").alias("salt")
    copies = named.select("_id", "digest").distinct().select("_id", "digest", salt("_id")).join(shared, ["digest", "salt"]).where(F.col("_id") > F.col("first.id")).select("_id", "digest", "first")
    copies = scratch.keep(copies, "copies")
    own = rows.where(F.col("_id").isNotNull()).join(copies, ["_id", "digest"], "left")
    none = rows.where(F.col("_id").isNull()).withColumn("salt", salt("_url")).join(shared.withColumn("is", F.lit(True)), ["digest", "salt"], "left")
    none = none.withColumn("first", F.when(F.col("bytes") >= LEAST_REVISIT_BYTES, F.col("first")))
    return own.unionByName(none.select(own.columns))


def write_archives(rows: DataFrame, to: str, version: int | None) -> DataFrame:
    """Writes rows (_id, _url, _ip, _date, _type, _body, digest, first) as WARC files below ``to``: (file, records, bytes) of each.

    With a version, _body is a bare payload that becomes an ARC record of that version first, which the converter parses;
    without, _body is that of an ARC record. A file's name holds its partition and number, and a task that runs again
    writes the same bytes under the same name (first to a name of its own, then renamed), so a lost executor leaves no half file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        context, part, held, size, records = TaskContext.get(), 0, [], 0, 0
        store, root = fs.FileSystem.from_uri(to)
        store.create_dir(root, recursive=True)
        name = lambda: f"{context.partitionId():06d}-{part:06d}.warc.gz"

        def add(record: bytes) -> None:
            nonlocal size
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            held.append(packer.compress(record) + packer.flush())
            size += len(held[-1])

        def close() -> pd.DataFrame:
            nonlocal part, held, size, records
            with store.open_output_stream(f"{root}/_own-{context.taskAttemptId()}-{part}", compression=None) as out:
                out.write(b"".join(held))
            store.move(f"{root}/_own-{context.taskAttemptId()}-{part}", f"{root}/{name()}")
            done = pd.DataFrame({"file": [name()], "records": [records], "bytes": [size]})
            part, held, size, records = part + 1, [], 0, 0
            return done

        for batch in batches:
            for key, url, ip, date, kind, body, a, b, c in batch.itertuples(index=False):
                if version is None:
                    found = [({"url": url, "ip": ip, "date": date, "type": kind}, bytes(body))]
                else:
                    found = read_arc(arc_file(version, [(url, date, kind, http_message(bytes(body), kind))]))
                for head, content in found:
                    if not held:
                        add(warcinfo(name()))
                    add(warc_record(head, content, f"{name()}#{records}", None if pd.isna(key) else str(key), None if pd.isna(a) else (a, b, c)))
                    records += 1
                if size >= FILE_BYTES:
                    yield close()
        if held:
            yield close()

    ids = rows.select(F.col("_id").cast("string").alias("_id"), "_url", "_ip", "_date", "_type", "_body", F.col("first.id").cast("string").alias("_a"), F.col("first.url").alias("_b"), F.col("first.date").alias("_c"), "digest")
    # In a fixed order, so that a task that runs again closes the same files at the same records.
    return ids.sortWithinPartitions("_id", "_url", "digest").drop("digest").mapInPandas(run, "file string, records long, bytes long")


def convert(pages: DataFrame, to: str, version: int = 2, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Writes pages as WARC files below the folder ``to`` and returns (file, records, bytes) of each.

    Each page becomes an ARC record with an HTTP message first; the converter parses the ARC header line and declared
    length and makes the WARC record from them. Equal payloads of at least LEAST_REVISIT_BYTES bytes: the smallest id is
    the response, others are revisits of it (rows that repeat that id are responses too). Null payloads count as empty;
    records without a url say NO_URL; null ids never become the response that others refer to, and have no key. Every
    record's id holds its place, so repeated rows have ids of their own. An empty table writes nothing.
    """
    text = F.coalesce(F.col(payload_col), F.lit(""))
    date = F.coalesce(F.col(date_col).cast("string"), F.lit("")) if date_col else F.lit("20000101000000")
    rows = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"), F.lit("0.0.0.0").alias("_ip"), date.alias("_date"), F.lit("text/html").alias("_type"), F.encode(text, "UTF-8").alias("_body"))
    rows = rows.select("*", F.sha2("_body", 256).alias("digest"), F.length("_body").cast("long").alias("bytes"))
    return write_archives(marked(rows, scratch or Scratch(pages.sparkSession, "warc")), to, version)


def convert_archives(spark: SparkSession, folder: str, to: str, scratch: Scratch | None = None) -> DataFrame:
    """Converts existing .arc and .arc.gz files below folder to WARC files below ``to``; keys are those of ``arc_records``.

    Records with an HTTP header become responses, or revisits of the record with the smallest key and the same payload; others resources.
    """
    found = arc_records(spark, folder)
    rows = found.select(F.col("key").alias("_id"), F.col("url").alias("_url"), F.col("ip").alias("_ip"), F.col("date").alias("_date"), F.col("type").alias("_type"), F.col("body").alias("_body"), "digest", "bytes")
    return write_archives(marked(rows, scratch or Scratch(spark, "warc")), to, None)


def read(spark: SparkSession, folder: str, id_col: str = "page_id", kind: str = "string") -> DataFrame:
    """Records of all archives below folder, but for warcinfo: id (of the given type), url, payload_bytes, payload_digest, record_type, refers_to, date, record_id, payload.

    Lengths and digests are checked; payload is null for revisits.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch["content"]:
                rows = []
                for record in members(blob):
                    f, block = parse_record(record)
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    said, payload = f["WARC-Payload-Digest"].removeprefix("sha256:"), None
                    if f["WARC-Type"] != "revisit":
                        payload = split_http(block)[1] if f["Content-Type"].startswith("application/http") else block
                        if hashlib.sha256(payload).hexdigest() != said or len(payload) != int(f["X-Payload-Length"]):
                            raise ValueError("a payload does not match its digest or length")
                    key, first, url = (unquote(f[x]) if x in f else None for x in ("X-Key", "X-Refers-To-Key", "WARC-Target-URI"))
                    rows.append((key, None if url == NO_URL else f["WARC-Target-URI"], int(f["X-Payload-Length"]), said, f["WARC-Type"], first, f["WARC-Date"], f["WARC-Record-ID"], payload))
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    columns = ["_id", "url", "payload_bytes", "payload_digest", "record_type", "_refers", "date", "record_id", "payload"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    out = files.mapInPandas(run, "_id string, url string, payload_bytes long, payload_digest string, record_type string, _refers string, date string, record_id string, payload binary")
    return out.select(F.col("_id").cast(kind).alias(id_col), "url", "payload_bytes", "payload_digest", "record_type", F.col("_refers").cast(kind).alias("refers_to"), "date", "record_id", "payload")


def round_trip(pages: DataFrame, version: int = 2, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", scratch: Scratch | None = None) -> DataFrame:
    """pages written as WARC files in the shared folder and read back: see ``convert`` and ``read``."""
    spark, scratch = pages.sparkSession, scratch or Scratch(pages.sparkSession, "warc")
    scratch.keep(convert(pages, scratch.path("archives"), version, id_col, url_col, payload_col, scratch=scratch), "files")
    scratch.drop("files", "shared", "copies")
    where = spark._jvm.org.apache.hadoop.fs.Path(scratch.path("archives"))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    return read(spark, scratch.path("archives"), id_col, pages.select(id_col).schema[0].dataType.simpleString())


def oracle() -> str:
    """The query's columns as DuckDB SQL."""
    return f"""
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
    f AS (SELECT *, CASE WHEN n >= {LEAST_REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
    SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f"""
