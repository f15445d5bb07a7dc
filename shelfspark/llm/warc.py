"""WARC records in ZIP packages: written as a stream by Spark's text sink, read by ranges through the ZIP directory.

A package holds stored members: WARC files whose records are compressed each by itself, as is usual for archives that are
read by ranges, and indexes with a line per record.  Everything that is written ends in a zero byte, which is the text
sink's record separator, so a package is written row by row and no task holds one: compressed records end in the high
byte of their length, and the last zero is the package's one-character ZIP comment.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship
from .common import table

DATA, INDEX = ("archive/data-", ".warc.gz"), ("indexes/data-", ".cdxj")  # before and after the members' number
PER_MEMBER = 65_536      # records of one WARC member; its index lines are all that a writing task holds
LEAST_BYTES = 100        # shorter payloads are never revisits
PIECE = 1 << 20          # bytes of an index or directory that are read at once
STORED, SENTINEL16, SENTINEL32 = 0, 0xFFFF, 0xFFFFFFFF
END_EXTRA = struct.pack("<HHB", 0x4C46, 1, 0)  # a private extra field whose one byte is the separator
MEMBER_BYTES = 1 << 23  # of a record in one gzip member: below 2^24, so that its length ends in a zero byte
DATE = "2000-01-01T00:00:00Z"  # a fixed date keeps reruns equal


# ------------------------------------------------------------------ records
def uri(url: str) -> bytes:
    """The url with everything that may not stand in a header line percent-encoded."""
    return b"".join(bytes([b]) if 0x21 <= b <= 0x7E else b"%%%02X" % b for b in url.encode("utf-8", "surrogatepass"))


def warc_record(record_id: str, kind: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record: a response with an HTTP head and the payload, or a revisit with the head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:" + record_id.encode() + b">", b"WARC-Date: " + DATE.encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + uri(url))
    lines.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if kind == "revisit":
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:" + refers_to.encode() + b">"]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields (lower-cased names) and the payload after the HTTP head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/1."):
        raise ValueError(f"no WARC record at this place: {first[:40]!r}")
    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines)}
    block = rest[:int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError("WARC record cut short")
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        _, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "payload": payload}


def compressed(record: bytes) -> bytes:
    """The record as gzip members in a row; ends in a zero byte."""
    out = b""
    for at in range(0, len(record), MEMBER_BYTES):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += pack.compress(record[at:at + MEMBER_BYTES]) + pack.flush()
    return out


def page_of(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


# ------------------------------------------------------------------ packages: writing
class Member:
    """Running size and checksum of a stored member, whose local header refers to a data descriptor."""

    def __init__(self, name: str, offset: int):
        self.name, self.offset, self.size, self.crc = name.encode(), offset, 0, 0

    def header(self) -> bytes:
        zip64 = struct.pack("<HHQQ", 1, 16, 0, 0)
        extra = zip64 + END_EXTRA
        return struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, STORED, 0, 0x2821, 0, SENTINEL32, SENTINEL32, len(self.name), len(extra)) + self.name + extra

    def add(self, data: bytes) -> bytes:
        self.size, self.crc = self.size + len(data), zlib.crc32(data, self.crc)
        return data

    def descriptor(self) -> bytes:
        return struct.pack("<IIQQ", 0x08074B50, self.crc, self.size, self.size)

    def entry(self) -> bytes:
        extra = struct.pack("<HHQQQ", 1, 24, self.size, self.size, self.offset)
        return struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, STORED, 0, 0x2821, self.crc, SENTINEL32, SENTINEL32, len(self.name),
                           len(extra), 0, 0, 0, 0, SENTINEL32) + self.name + extra


def package(records: Iterator[tuple[str, bytes]], per_member: int = PER_MEMBER) -> Iterator[bytes]:
    """The bytes of a ZIP64 package of (key, record) pairs, in chunks that all end in a zero byte.

    WARC members of at most `per_member` records alternate with their indexes, so only one index is held at a time.
    """
    done, at, tail = [], 0, b""

    def begin(parts: tuple[str, str]) -> tuple[Member, bytes]:
        """The next member and what stands before its bytes; the last member's descriptor goes first."""
        nonlocal at
        member = Member(f"{parts[0]}{len(done) // 2:05d}{parts[1]}", at + len(tail))
        out = tail + member.header()
        at += len(out)
        return member, out

    def end(member: Member) -> None:
        nonlocal at, tail
        at, tail = at + (member.size if member.name.startswith(DATA[0].encode()) else 0), member.descriptor()
        done.append(member)

    records = iter(records)
    some = list(islice(records, 1))
    while some or not done:
        data, out = begin(DATA)
        yield out
        index = []
        for key, record in chain(some, islice(records, per_member - len(some))):
            raw = compressed(record)
            index.append(json.dumps({"key": key, "offset": data.size, "length": len(raw)}, separators=(",", ":")).encode() + b"\n")
            yield data.add(raw)
        end(data)
        lines, out = begin(INDEX)
        yield out
        held = lines.add(b"".join(index))
        end(lines)
        tail = held + tail  # goes out with the descriptor, whose high bytes are zero
        some = list(islice(records, 1))
    at += len(tail)
    directory = b"".join(m.entry() for m in done)
    end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(done), len(done), len(directory), at)
    locator = struct.pack("<IIQI", 0x07064B50, 0, at + len(directory), 1)
    last = struct.pack("<IHHHHIIH", 0x06054B50, SENTINEL16, SENTINEL16, SENTINEL16, SENTINEL16, SENTINEL32, SENTINEL32, 1)
    yield tail + directory + end64 + locator + last + b"\0"


def write_packages(records: DataFrame, path: str) -> None:
    """records(page_id, url, payload binary, digest, kind, refers_to): one package per partition in folder `path`.

    A null page_id is written as an empty id; a null payload as an empty one.
    """
    ship(records.sparkSession)
    text = lambda v: "" if pd.isna(v) else v

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for page, url, payload, digest, kind, refers in batch.itertuples(index=False, name=None):
                    yield text(page), warc_record(text(page), kind, url, bytes(payload or b""), digest, text(refers))
        held, size = [], 0
        for chunk in package(each()):
            held.append(chunk[:-1])
            size += len(chunk)
            if size > PIECE:
                yield pd.DataFrame({"value": held})
                held, size = [], 0
        yield pd.DataFrame({"value": held})
    rows = records.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", "kind",
                          F.col("refers_to").cast("string").alias("refers_to"))
    rows.mapInPandas(pack, "value binary").select(F.col("value").cast("string").alias("value")).write.text(path, lineSep="\0")


# ------------------------------------------------------------------ packages: reading
def open_file(path: str):
    """A seekable file in any store that pyarrow knows by its URI (local, hdfs, s3, gs)."""
    path = re.sub(r"^file:/+", "file:///", path)
    if "://" in path:
        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


def read_at(file, offset: int, size: int) -> bytes:
    file.seek(offset)
    data = file.read(size)
    if len(data) < size:
        raise ValueError("package cut short")
    return data


def zip_members(file, length: int) -> Iterator[dict]:
    """Members by the central directory: name, method, size, crc and offset of the local header.

    The end record is looked for from the end of the file through the longest comment; where its numbers are
    sentinels, the ZIP64 end record holds them.  The directory is read in pieces.
    """
    tail = read_at(file, max(0, length - 65557), min(length, 65557))
    at = len(tail)
    while True:
        at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP package")
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    entries, size, start = struct.unpack_from("<HII", tail, at + 10)
    where = max(0, length - 65557) + at
    if (entries == SENTINEL16 or size == SENTINEL32 or start == SENTINEL32) and where >= 20:
        sign, _, end64, _ = struct.unpack("<IIQI", read_at(file, where - 20, 20))
        if sign == 0x07064B50:
            fields = struct.unpack("<IQHHIIQQQQ", read_at(file, end64, 56))
            if fields[0] != 0x06064B50:
                raise ValueError("no ZIP64 end of central directory where the locator says")
            entries, size, start = fields[7], fields[8], fields[9]
    data, base = b"", 0
    pos, end = start, start + size
    for _ in range(entries):
        def need(n: int) -> None:
            nonlocal data, base, pos
            if len(data) - base < n:
                more = min(max(PIECE, n), end - pos)
                data, base = data[base:] + read_at(file, pos, more), 0
                pos += more
            if len(data) - base < n:
                raise ValueError("central directory cut short")
        need(46)
        f = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, base)
        if f[0] != 0x02014B50:
            raise ValueError("no central directory entry where one is due")
        need(46 + f[10] + f[11] + f[12])
        name = data[base + 46:base + 46 + f[10]].decode("utf-8", "replace")
        extra = data[base + 46 + f[10]:base + 46 + f[10] + f[11]]
        base += 46 + f[10] + f[11] + f[12]
        wide = {"packed": f[8], "size": f[9], "offset": f[16]}
        x = 0
        while x + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, x)
            if tag == 1:
                y = x + 4
                for key in ("size", "packed", "offset"):
                    if wide[key] == SENTINEL32:
                        wide[key] = struct.unpack_from("<Q", extra, y)[0]
                        y += 8
            x += 4 + n
        yield {"name": name, "method": f[4], "encrypted": bool(f[3] & 1), "crc": f[7], **wide}


def stored_start(file, member: dict) -> int:
    """Where the bytes of a stored member begin; its local header has lengths of its own."""
    head = read_at(file, member["offset"], 30)
    f = struct.unpack("<IHHHHHIIIHH", head)
    if f[0] != 0x04034B50:
        raise ValueError("no local header where the directory says")
    return member["offset"] + 30 + f[9] + f[10]


def list_packages(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files in a folder; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def package_members(packages: DataFrame) -> DataFrame:
    """Stored members of (path, length) packages: path, name, start (of the bytes), size, crc.  Members that are
    compressed or encrypted are not stored and are left out: range reads cannot serve them."""
    ship(packages.sparkSession)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"]):
                with open_file(path) as file:
                    some = [(path, m["name"], stored_start(file, m), m["size"], m["crc"]) for m in zip_members(file, length)
                            if m["method"] == STORED and not m["encrypted"] and not m["name"].endswith("/")]
                yield pd.DataFrame(some, columns=["path", "name", "start", "size", "crc"], dtype=object)
    return packages.repartition("path").mapInPandas(members, "path string, name string, start long, size long, crc long")


def index_entries(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """(path, key, offset in the package, length) of every record by the index members, read in pieces of `piece` bytes.

    A piece owns the lines that begin in it, so a large index is spread over tasks.  Other members are ignored.
    """
    def numbered(parts: tuple[str, str]) -> DataFrame:
        number = F.regexp_extract("name", f"^{re.escape(parts[0])}([0-9]+){re.escape(parts[1])}$", 1)
        return members.withColumn("number", number).filter("number <> ''")
    starts = numbered(DATA).select("path", "number", F.col("start").alias("data_start"))
    pieces = (numbered(INDEX).filter("size > 0").join(starts, ["path", "number"])
              .withColumn("at", F.explode(F.expr(f"sequence(0L, size - 1, {piece}L)"))).select("path", "start", "size", "at", "data_start"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, size, at, data_start in batch.itertuples(index=False, name=None):
                with open_file(path) as file:
                    first = at - 1 if at else 0  # the byte before tells whether a line begins here
                    held = read_at(file, start + first, min(at + piece, size) - first)
                    until = min(at + piece, size)
                    while until < size and not held.endswith(b"\n"):
                        more = read_at(file, start + until, min(4096, size - until))
                        cut = more.find(b"\n")
                        held += more if cut < 0 else more[:cut + 1]
                        until += len(more)
                        if cut >= 0:
                            break
                if at:
                    cut = held.find(b"\n")
                    held = held[cut + 1:] if cut >= 0 else b""
                rows = [json.loads(line) for line in held.split(b"\n") if line]
                yield pd.DataFrame([(path, r["key"], data_start + r["offset"], r["length"]) for r in rows], columns=["path", "key", "offset", "length"], dtype=object)
    return pieces.repartition("path", "start", "at").mapInPandas(read, "path string, key string, offset long, length long")


def read_records(entries: DataFrame, tasks: int | None = None) -> DataFrame:
    """The records at (path, offset, length), each by one range read: page_id, kind, url, digest, refers_to, payload."""
    spark = entries.sparkSession
    ship(spark)
    dealt = entries.repartitionByRange(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "offset").sortWithinPartitions("path", "offset")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, opened = None, None
        for batch in batches:
            rows, size = [], 0
            for path, offset, length in zip(batch["path"], batch["offset"], batch["length"]):
                if path != held:
                    if opened:
                        opened.close()
                    held, opened = path, open_file(path)
                got = parse_record(gzip.decompress(read_at(opened, offset, length)))
                f = got["fields"]
                rows.append((page_of(f.get("warc-record-id")), f["warc-type"], f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha256:"),
                             page_of(f.get("warc-refers-to")), got["payload"]))
                size += length
                if size > PIECE:
                    yield frame(rows)
                    rows, size = [], 0
            yield frame(rows)
        if opened:
            opened.close()

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["page_id", "kind", "url", "digest", "refers_to", "payload"], dtype=object)
    return dealt.mapInPandas(read, "page_id long, kind string, url string, digest string, refers_to long, payload binary")


# ------------------------------------------------------------------ pages
def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages(page_id, url, html) as records: of equal payloads of at least `least_bytes` bytes the smallest page_id is
    the response and the others revisit it; shorter payloads are all responses.  Equal means equal SHA-256.

    A null html is an empty payload.  Repeated rows of the response's page_id are responses as well; a null page_id
    never is the smallest.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter(
        "n > 1 and first is not null").drop("n")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))


def read_back(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes and payload_digest of the full payload, record_type, refers_to.

    A revisit has its payload in the response it refers to; digests are computed from the bytes that were read, and a
    response whose bytes do not have the digest of its header is an error.
    """
    seen = records.select("page_id", "kind", "refers_to", F.length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha"), "digest")
    told = seen.filter("kind = 'response'").select(
        "page_id", F.col("n").alias("payload_bytes"),
        F.when(F.col("sha") == F.col("digest"), F.col("sha")).otherwise(F.raise_error(F.concat(F.lit("payload of page "), F.col("page_id").cast("string"), F.lit(" does not have its digest")))).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    original = told.filter(F.col("page_id").isNotNull()).select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to", "payload_digest"])
    again = seen.filter("kind = 'revisit'").select("page_id", "refers_to", F.col("digest").alias("payload_digest")).join(
        original, ["refers_to", "payload_digest"]).select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return told.unionByName(again)


def op2_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_packages(with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    return read_back(read_records(index_entries(package_members(list_packages(spark, path)))))


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
