"""WARC archives: pages as records, a normaliser of monolithic gzip, and reading by an offset index.

write_archives() makes one gzip stream of each file, as many crawlers do; nothing in it can be read without inflating what is
before.  normalise() has each such stream inflated once, from its beginning to its end, by the task that reads the file (Spark's text
reader hands it on in pieces, so neither the file nor its inflated content is ever held).  It writes every record as a gzip
member of its own, and as sidecar a table of where each member lies.  read_records() seeks and inflates the members of any rows of that table.

A task writes its members to a file whose name no other attempt has, and only files that the finished index names belong to the
archive: a lost executor costs its tasks again, nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, fresh, qualified, removed, scratch, spread

END = "\r\n\r\n"
ID = "urn:x-page:"
#: Profile of a record that repeats a payload (fixed value of WARC 1.1).
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages of a monolithic file at most; a task that inflates one takes it whole.
PAGES = 50_000
#: Rows of the index that a task hands on at a time.
ROWS = 5_000


def base32(hex_: Column) -> Column:
    """Upper-case base32 of 40 hex digits (160 bits: no padding), by 40 bits."""
    parts = (F.lpad(F.conv(F.substring(hex_, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4))
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _shown(x: Column, inside: str = r"[\x00-\x20\x7F]") -> Column:
    """x in a header line: white space and controls are percent-encoded."""
    x = x.cast("string")
    bad = F.regexp_extract_all(x, F.lit(f"({inside})"))
    coded = F.aggregate(F.array_distinct(bad), x, lambda got, c: F.replace(got, c, F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))))
    return F.when(F.size(bad) > 0, coded).otherwise(x)


def decided(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", least: int = 0) -> tuple[DataFrame, str]:
    """pages, and the name of a column more: the id of the record that a row revisits, or null.

    Of rows with equal payloads of at least ``least`` bytes, those with the largest id are responses, the others revisit it.  Payloads
    are told apart by SHA-256.  Only payloads that several rows have are joined; if they are few they are broadcast, else
    pages are shuffled once, and a payload of many pages is dealt over several tasks.
    """
    key, keep, many = fresh(pages, "_payload"), fresh(pages, "_refers_to"), fresh(pages, "_many")
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.withColumn(key, F.when(F.octet_length(body) >= least, F.unhex(F.sha2(body, 256))))
    same = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(id_col).alias(keep), F.count("*").alias(many)).filter(F.col(many) > 1)
    joined = spread(rows, cut(same), [key], many, [id_col], "left").drop(key, many)
    return joined.withColumn(keep, F.when(~F.col(id_col).eqNullSafe(F.col(keep)), F.col(keep))), keep


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = 0) -> DataFrame:
    """(value): a WARC 1.1 record for each page, without the END behind it.

    The payload is the text in UTF-8, of a null the empty one; a revisit has the HTTP header of the full payload, and no payload.
    A null id is written as no id, and a null url as no target.
    """
    rows, keep = decided(pages, id_col, text_col, least)
    body, line = F.coalesce(F.col(text_col), F.lit("")), F.lit("\r\n")
    own = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(_shown(c), F.lit("")), F.lit(">"))
    again = F.col(keep).isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END))
    size = F.octet_length(http) + F.when(again, 0).otherwise(F.octet_length(body))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"), line, F.lit("WARC-Record-ID: "), own(F.col(id_col)), line, F.lit(f"WARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), _shown(F.col(url_col)), line), F.lit("")),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {REVISIT}\r\nWARC-Refers-To: "), own(F.col(keep)), line)).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), base32(F.sha1(body)), line, F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit(END),
    )
    return rows.select(F.concat(header, http, F.when(again, "").otherwise(body)).alias("value"))


def write_archives(pages: DataFrame, path: str, **more) -> None:
    """Records of pages as gzip files at ``path``, each one stream over all of its records."""
    records(pages, **more).write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", PAGES).text(path)


def _split(chunks: Iterator[bytes], name: str) -> Iterator[bytes]:
    """Records (with their END) of an inflated stream that comes in pieces; what is held is one record and one piece."""
    held, at, least = bytearray(), 0, 0
    for chunk in chunks:
        held += chunk
        while len(held) - at > least:
            head = held.find(b"\r\n\r\n", at)
            if head < 0:
                break
            header = bytes(held[at:head])
            if not header.startswith(b"WARC/"):
                raise ValueError(f"{name}: no WARC record where one should begin: {header[:40]!r}")
            least = head + 8 + int(_field(header, b"content-length")) - at
            if len(held) - at < least:
                least -= 1
                break
            yield bytes(held[at : at + least])
            at, least = at + least, 0
        if at:
            del held[:at]
            at = 0
    if held.strip():
        raise ValueError(f"{name}: {len(held)} bytes behind the last whole record")


def _field(header: bytes, name: bytes) -> str | None:
    for line in header.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode()
    return None


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(source, its pieces) of rows (source, line): a file's lines follow each other."""
    state = {"next": None}

    def pieces() -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            code, lines = names.indices.to_numpy(), batch.column(1).to_pylist()
            begin = 0
            for k in range(1, len(lines) + 1):
                if k == len(lines) or code[k] != code[begin]:
                    yield names.dictionary[int(code[begin])].as_py(), b"\n".join([*lines[begin:k], b""])
                    begin = k

    every = pieces()
    state["next"] = next(every, None)

    def one(source: str) -> Iterator[bytes]:
        while state["next"] is not None and state["next"][0] == source:
            yield state["next"][1]
            state["next"] = next(every, None)

    while state["next"] is not None:
        source = state["next"][0]
        rest = one(source)
        yield source, rest
        for _ in rest:
            pass


INDEX = T.StructType([T.StructField(n, T.LongType() if n in ("offset", "length") else T.StringType()) for n in ("archive", "offset", "length", "record_type", "record_id", "target_uri", "refers_to", "payload_digest")])


def _opened(uri: str):
    files, path = pa.fs.FileSystem.from_uri(uri)
    return files, path


def normalise(spark: SparkSession, archives: str, out: str) -> DataFrame:
    """Rewrites the gzip files at ``archives`` to ``out``/members, a member for each record, and returns the offset index, which is at ``out``/index.

    The index has archive, offset, length (of the member, in bytes), record_type, record_id, target_uri, refers_to and payload_digest, null where a record has no such
    field.  Files may hold one gzip stream or many, and any bytes; empty ones give no records.  A file that ends within a record, or holds anything else, raises.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(archives).select(F.col("_metadata.file_path").alias("source"), F.col("value").cast("binary").alias("line"))
    folder = qualified(spark, f"{out}/members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _opened(folder)
        files.create_dir(path, recursive=True)
        for source, pieces in _streams(batches):
            name = f"{source.rstrip('/').rsplit('/', 1)[-1].split('.')[0]}-{uuid.uuid4().hex[:12]}.warc.gz"
            rows, at = [], 0
            with files.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20) as sink:
                for record in _split(pieces, source):
                    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packed.compress(record) + packed.flush()
                    sink.write(member)
                    head = record[: record.find(b"\r\n\r\n")]
                    get = lambda k, head=head: _field(head, k)
                    rows.append((f"{folder}/{name}", at, len(member), get(b"warc-type"), get(b"warc-record-id"), get(b"warc-target-uri"), get(b"warc-refers-to"), get(b"warc-payload-digest")))
                    at += len(member)
                    if len(rows) == ROWS:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    lines.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(f"{out}/index")
    return spark.read.schema(INDEX).parquet(f"{out}/index")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if f.dataType == T.LongType() else pa.string() for f in INDEX]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=INDEX.names)


RECORD = T.StructType([T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType())])


def _read(record: bytes, payload: bool) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    block = block[: int(_field(head, b"content-length"))]
    kind, digest = _field(head, b"warc-type"), (_field(head, b"warc-payload-digest") or "").removeprefix("sha1:") or None
    http, _, body = block.partition(b"\r\n\r\n")
    if kind == "response":
        got = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if digest not in (None, got):
            raise ValueError(f"{_field(head, b'warc-record-id')}: the payload has the digest {got}, the header {digest}")
        digest, size = got, len(body)
    else:
        size, body = _field(http, b"content-length"), None
    return kind, _field(head, b"warc-record-id"), _field(head, b"warc-target-uri"), _field(head, b"warc-refers-to"), digest, None if size is None else int(size), body if payload else None


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """A row of RECORD for each row (archive, offset, length) of an index, whole or filtered; of other records than responses the payload is null.

    Digests of responses are computed anew; one that is not the header's raises.
    """
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    if source:
                        source.close()
                    files, path = _opened(archive)
                    name, source = archive, files.open_input_file(path)
                rows.append(_read(zlib.decompress(source.read_at(length, offset), 31), payload))
                held += len(rows[-1][-1] or b"")
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORD.names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORD.names)
        if source:
            source.close()

    return index.select("archive", "offset", "length").mapInArrow(run, RECORD)


def page_of(record_id: Column, kind: T.DataType) -> Column:
    """The page's id in a record's id; null if it has none."""
    return F.nullif(F.regexp_extract(record_id, f"^<{ID}(.*)>$", 1), F.lit("")).cast(kind)


def archived(pages: DataFrame, out: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0) -> DataFrame:
    """The offset index of normalised archives of pages, at ``out`` (a new folder of the shared one if None); the monolithic ones it is made of are removed."""
    spark = pages.sparkSession
    whole = scratch(spark, "warc-monolithic")
    write_archives(pages, whole, id_col=id_col, url_col=url_col, text_col=text_col, least=least)
    index = normalise(spark, whole, out or scratch(spark, "warc"))
    removed(spark, whole)
    return index


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0) -> DataFrame:
    """One row for each row of pages, read back from its archives: id_col, payload_bytes, payload_digest, record_type, refers_to.

    Of rows with equal payloads of at least ``least`` bytes, the one with the largest id is a response, as are repeated rows of that id; the others
    revisit it.  Null texts are empty payloads, and equal.  A null id revisits another id with its payload, else it is a response.  Urls are not compared.
    Other columns are not read; an empty table gives no rows.
    """
    back = read_records(archived(pages, None, id_col, url_col, text_col, least), payload=False)
    kind = pages.schema[id_col].dataType
    return back.select(page_of(F.col("record_id"), kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to"), kind).alias("refers_to"))
