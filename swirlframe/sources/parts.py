"""Files of fixed layout, read and written by many tasks: a data source of Spark's Python API, and Arrow functions.

Reading: an array in a file is a few numbers (Layout): where its values begin, and how far apart frames, rows and columns lie.  So any range of
grid rows is a range of bytes, and partitions are ranges of rows, however large a file is.

Writing: rows (at, body) are the pieces of a file, in order of ``at``.  A task writes ranges of them as parts and returns their names, and the driver
lists those of the tasks that succeeded in MANIFEST; what other attempts left is deleted.  ``cat path/part-*`` is the file; the readers here take a folder of
parts for the file that it stands for.

Values as text (read_text()) are split at any byte: the values of each range are counted first.

Files are opened through pyarrow, by URI: any store that it reaches.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.checkpoints import qualified

NAME = "swirl_parts"
MANIFEST = "_parts.json"
#: Bytes of a partition that is read, and of a part that is written, about.
BYTES = 32 << 20
#: Bytes of values that a reading task hands on at once.
AT_ONCE = 4 << 20


@dataclass
class Component:
    """An array in a file: the value of (t, i, j) is at begin + t * frame + i * row + j * item; ``missing`` values, and NaN where there is such a list, read as 0."""

    parts: list
    begin: int
    frame: int
    row: int
    item: int
    kind: str
    missing: list | None = None


@dataclass
class Layout:
    name: str
    shape: tuple[int, int, int]
    components: list[Component]


def open_uri(uri: str):
    files, path = pa.fs.FileSystem.from_uri(uri)
    return files, path


def parts_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(uri, place of its first byte, bytes) of the parts of a file; a plain file is one part."""
    uri = qualified(spark, path).rstrip("/")
    files, at = open_uri(uri)
    info = files.get_file_info(at)
    if info.type == pa.fs.FileType.File:
        return [(uri, 0, info.size)]
    with files.open_input_stream(f"{at}/{MANIFEST}") as f:
        listed = json.loads(f.read())
    out, begin = [], 0
    for name, size in listed:
        out.append((f"{uri}/{name}", begin, size))
        begin += size
    return out


def files_of(spark: SparkSession, path: str) -> list[tuple[str, list]]:
    """(path, parts) of the file at path, or of those that it is a pattern or a plain folder of; a folder of parts is one file."""
    out: dict[str, list] = {}
    listed = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()  # a row for each file, none of their bytes
    whole: dict[str, bool] = {}
    for r in listed:
        folder, _, name = r.path.rpartition("/")
        if name.startswith("part-") and folder not in whole:
            files, at = open_uri(folder)
            whole[folder] = files.get_file_info(f"{at}/{MANIFEST}").type == pa.fs.FileType.File
        if not name.startswith("part-") or not whole[folder]:
            out[r.path] = [(r.path, 0, r.length)]
        elif folder not in out:
            out[folder] = parts_of(spark, folder)
    return list(out.items())


def size_of(parts: list) -> int:
    return parts[-1][1] + parts[-1][2] if parts else 0


class Bytes:
    """Random access to a file in parts."""

    def __init__(self, parts: list):
        self.parts, self.open = parts, {}

    def read(self, at: int, n: int) -> bytes:
        out = []
        for k, (uri, begin, size) in enumerate(self.parts):
            a, b = max(at, begin), min(at + n, begin + size)
            if a < b:
                if k not in self.open:
                    files, path = open_uri(uri)
                    self.open[k] = files.open_input_file(path)
                out.append(self.open[k].read_at(b - a, a - begin))
        body = b"".join(out)
        if len(body) != n:
            raise ValueError(f"{self.parts[0][0]}: {len(body)} of {n} bytes at {at}")
        return body

    def close(self) -> None:
        for f in self.open.values():
            f.close()


def header(parts: list, parse, first: int = 1 << 16):
    """parse() of the beginning of a file, of twice as many bytes each time that it raises, until all have been tried."""
    source, size, n = Bytes(parts), size_of(parts), first
    try:
        while True:
            body = source.read(0, min(n, size))
            try:
                return parse(body)
            except Exception:
                if n >= size:
                    raise
                n *= 2
    finally:
        source.close()


@dataclass
class _Range(InputPartition):
    """Grid rows begin to end (numbered through all frames) of a layout."""

    layout: dict
    begin: int
    end: int

    def __init__(self, layout: dict, begin: int, end: int):
        self.layout, self.begin, self.end = layout, begin, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.layouts, self.most = json.loads(options["layouts"]), int(options["bytes"])
        self.frames, self.kind, self.names = json.loads(options["frames"]), options["kind"], json.loads(options["names"])

    def partitions(self) -> list[_Range]:
        out = []
        for lay in self.layouts:
            t, h, w = lay["shape"]
            first, last = self.frames or (0, t)
            begin, end = max(first, 0) * h, min(last, t) * h
            width = max(1, self.most // max(1, sum(w * np.dtype(c["kind"]).itemsize for c in lay["components"])))
            out += [_Range(lay, k, min(k + width, end)) for k in range(begin, end, width)]
        return out or [_Range({}, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.begin >= part.end:
            return
        lay, kind = part.layout, np.dtype(self.kind)
        _, h, w = lay["shape"]
        comps = [Component(**c) for c in lay["components"]]
        sources = [Bytes(c.parts) for c in comps]
        step = max(1, AT_ONCE // max(1, 8 * w * len(comps)))
        names = ["path", "t", "i", *self.names]
        at = part.begin
        while at < part.end:
            t, i = divmod(at, h)
            n = min(step, h - i, part.end - at)
            columns = []
            for c, source in zip(comps, sources, strict=True):
                size = np.dtype(c.kind).itemsize
                body = source.read(c.begin + t * c.frame + i * c.row, (n - 1) * c.row + (w - 1) * c.item + size)
                raw = np.ndarray((n, w), c.kind, body, 0, (c.row, c.item))
                x = raw.astype("f8")
                if c.missing is not None:
                    x = np.where(np.isnan(x) | np.isin(raw, np.array(c.missing, raw.dtype)), 0.0, x)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * w, pa.int32()), pa.array(x.astype(kind).ravel())))
            yield pa.RecordBatch.from_arrays([pa.array([lay["name"]] * n, pa.string()), pa.array(np.full(n, t, np.int32)), pa.array(np.arange(i, i + n, dtype=np.int32)), *columns], names)
            at += n
        for source in sources:
            source.close()


_PARTS = "number long, name string, bytes long, rows long"


def _write(batches: Iterator[pa.RecordBatch], uri: str, width: int) -> Iterator[pa.RecordBatch]:
    """Writes pieces (number of a part, at, body) that come in order, and gives the parts (see _PARTS)."""
    files, path = open_uri(uri)
    files.create_dir(path, recursive=True)
    done, sink = [], None  # done: number, name, bytes, rows
    for batch in batches:
        for number, at, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not done or number != done[-1][0]:
                if sink:
                    sink.close()
                done.append([number, f"part-{number + 1:011d}-{uuid.uuid4().hex[:12]}", 0, 0])
                sink = files.open_output_stream(f"{path}/{done[-1][1]}", compression=None, buffer_size=1 << 20)
            now = done[-1]
            if at != number * width + now[3]:
                raise ValueError(f"{uri}: piece {number * width + now[3]} is not there once")
            sink.write(body)
            now[2] += len(body)
            now[3] += 1
    if sink:
        sink.close()
    columns = list(zip(*done, strict=True)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(columns)], [c.split()[0] for c in _PARTS.split(", ")])


def _commit(parts: list[tuple], rows: int, uri: str, head: bytes, foot: bytes) -> None:
    """Makes parts (see _PARTS) the file at ``uri``, if they have all its pieces."""
    files, path = open_uri(uri)
    files.create_dir(path, recursive=True)
    parts = sorted(parts)
    if [p[0] for p in parts] != list(range(len(parts))) or sum(p[3] for p in parts) != rows:
        raise ValueError(f"{uri}: {sum(p[3] for p in parts)} of {rows} pieces")
    listed = [(p[1], p[2]) for p in parts]
    for name, body, place in (("part-00000000000-head", head, 0), ("part-99999999999-foot", foot, len(listed) + 1)):
        if body:
            with files.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(body)
            listed.insert(place, (name, len(body)))
    with files.open_output_stream(f"{path}/{MANIFEST}.new", compression=None) as f:
        f.write(json.dumps(listed).encode())
    files.move(f"{path}/{MANIFEST}.new", f"{path}/{MANIFEST}")
    keep = {MANIFEST, *(name for name, _ in listed)}
    for info in files.get_file_info(pa.fs.FileSelector(path)):
        if info.base_name.startswith("part-") and info.base_name not in keep:
            files.delete_file(info.path)


class Parts(DataSource):
    """What it needs to know is in options, which read_layouts() gives."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_layouts(spark: SparkSession, layouts: list[Layout], names: list[str], kind: str = "double", frames: tuple[int, int] | None = None, most: int = BYTES) -> DataFrame:
    """(path, t, i, and an array of each component, called ``names``) of files: a row for each grid row of frames first to last - 1 (None: all)."""
    spark.dataSource.register(Parts)
    how = {"double": "f8", "float": "f4"}[kind]
    schema = "path string, t int, i int, " + ", ".join(f"{n} array<{kind}>" for n in names)
    return spark.read.format(NAME).options(schema=schema, layouts=json.dumps([asdict(x) for x in layouts]), frames=json.dumps(frames), bytes=str(most), kind=how, names=json.dumps(names)).load()


def write_pieces(pieces: DataFrame, rows: int, path: str, each: int, head: bytes = b"", foot: bytes = b"", most: int = BYTES) -> None:
    """pieces (at, body), at from 0 to rows - 1 and once each, as the file at ``path``, in parts of about ``most`` bytes; each: about the bytes of a piece.

    A gap, or a piece that is there twice, raises, and the file that was there before stays.  Tasks write it in an Arrow function: to write by a data source
    of the Python API the driver keeps six more Python processes, 200 MB, until it ends.
    """
    uri = qualified(pieces.sparkSession, path)
    width = max(1, most // max(each, 1))
    numbered = pieces.select(F.floor(F.col("at") / width).cast("long").alias("number"), F.col("at").cast("long").alias("at"), "body")
    sorted_ = numbered.repartition("number").sortWithinPartitions("number", "at")
    made = sorted_.mapInArrow(lambda batches: _write(batches, uri, width), _PARTS).collect()  # a row for each part
    _commit([tuple(r) for r in made], rows, uri, head, foot)


def bodies(rows: DataFrame, cols: list[str], make) -> DataFrame:
    """(at, body) of rows (at, cols: arrays of one length): make(values (row, component, column)) gives the bytes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([c.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(b.num_rows, -1) for c in b.columns[1:]], 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(make(x), pa.binary())], ["at", "body"])

    return rows.select("at", *cols).mapInArrow(run, "at long, body binary")


# --- values as text -----------------------------------------------------------------------------------

#: Bytes of text that are split into values at once.
TEXT = 1 << 20
_SPACE = re.compile(rb"\s")


@dataclass
class Text:
    """Numbers apart by white space, from byte begin to byte end of a file: rows of ``width`` of them, ``rows`` in all (None: as many as there are)."""

    name: str
    parts: list
    begin: int
    end: int
    width: int
    rows: int | None = None
    kind: str = "f8"


def ranges(spans: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(number of a span, begin, end): spans of bytes in pieces of ``most``."""
    return [(k, at, min(at + most, end)) for k, (begin, end) in enumerate(spans) for at in range(begin, end, most)]


def by_range(spark: SparkSession, pieces: list, run, schema: str) -> DataFrame:
    """run(piece) gives Arrow batches; a task for each piece.

    The numbers of pieces are an RDD, whose size Spark does not know: it would take what is read for as small as a range of these, and broadcast it in joins.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from run(pieces[k])

    numbers = spark.sparkContext.parallelize([(k,) for k in range(len(pieces))], max(1, len(pieces)))
    return spark.createDataFrame(numbers, "id long").mapInArrow(each, schema)


def _edge(source: Bytes, text: Text, at: int) -> int:
    """``at``, or the end of the value that it is within: a value belongs to the range in which it begins."""
    if at <= text.begin or at >= text.end:
        return min(max(at, text.begin), text.end)
    at -= 1
    while at < text.end:
        body = source.read(at, min(256, text.end - at))
        found = _SPACE.search(body)
        if found:
            return at + found.start()
        at += len(body)
    return text.end


def _words(source: Bytes, text: Text, begin: int, end: int) -> Iterator[list[bytes]]:
    """The values that begin in a range, some at once."""
    at = _edge(source, text, begin)
    while begin < end:
        begin = min(begin + TEXT, end)
        stop = _edge(source, text, begin)
        yield source.read(at, stop - at).split()
        at = stop


def read_text(spark: SparkSession, texts: list[Text], most: int = BYTES) -> DataFrame:
    """(path, at, values array of doubles): the rows of numbers that are text, at counting those of a file.

    Ranges of about ``most`` bytes are counted by a task each, so that the place of each one's first value is known; then a task reads the rows that
    begin in its range.  The driver gets a number a range.
    """
    pieces = ranges([(x.begin, x.end) for x in texts], most)

    def count(piece: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
        k, begin, end = piece
        source = Bytes(texts[k].parts)
        n = sum(map(len, _words(source, texts[k], begin, end)))
        source.close()
        yield pa.RecordBatch.from_pydict({"k": [k], "begin": [begin], "n": [n]}, pa.schema([("k", pa.int64()), ("begin", pa.int64()), ("n", pa.int64())]))

    counted = {(r.k, r.begin): r.n for r in by_range(spark, pieces, count, "k long, begin long, n long").collect()}
    known, total = [], [0] * len(texts)
    for k, begin, end in pieces:
        known.append((k, begin, end, total[k], total[k] + counted[k, begin]))
        total[k] += counted[k, begin]
    for x, n in zip(texts, total, strict=True):
        if n < x.width * (x.rows or 0) or x.rows is None and n % x.width:
            raise ValueError(f"{x.name}: {n} values; the header says {x.width * x.rows if x.rows is not None else f'rows of {x.width}'}")

    def rows(piece: tuple[int, int, int, int, int]) -> Iterator[pa.RecordBatch]:
        k, begin, _, low, high = piece
        text, width = texts[k], texts[k].width
        first, last = -(-low // width), -(-high // width)
        last = last if text.rows is None else min(last, text.rows)
        if first >= last:
            return
        source, held, skip = Bytes(text.parts), np.zeros(0), first * width - low
        for words in _words(source, text, begin, text.end):
            words, skip = words[skip:], max(0, skip - len(words))
            held = np.concatenate([held, np.array(words, "f8").astype(text.kind).astype("f8")])
            n = min(len(held) // width, last - first)
            if n:
                out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(held[: n * width]))
                yield pa.RecordBatch.from_arrays([pa.array([text.name] * n, pa.string()), pa.array(np.arange(first, first + n)), out], ["path", "at", "values"])
                held, first = held[n * width :], first + n
            if first >= last:
                break
        source.close()

    return by_range(spark, known, rows, "path string, at long, values array<double>")


def find_in(spark: SparkSession, parts: list, pattern: bytes, longest: int = 1 << 16, most: int = BYTES) -> list[tuple[int, bytes]]:
    """(place, match) of a pattern of at most ``longest`` bytes that occurs few times in a file: a task looks through a range."""
    size = size_of(parts)

    def look(piece: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
        _, begin, end = piece
        source = Bytes(parts)
        found = [(begin + m.start(), m.group()) for m in re.finditer(pattern, source.read(begin, min(end + longest, size) - begin)) if begin + m.start() < end]
        source.close()
        yield pa.RecordBatch.from_arrays([pa.array([at for at, _ in found], pa.int64()), pa.array([m for _, m in found], pa.binary())], ["at", "found"])

    return sorted((r.at, bytes(r.found)) for r in by_range(spark, ranges([(0, size)], most), look, "at long, found binary").collect())
