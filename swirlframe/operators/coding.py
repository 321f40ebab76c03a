"""Symbol statistics and lossless transforms: entropy, Huffman, runs, differences."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def frequencies(symbols: DataFrame, col: str = "sym") -> DataFrame:
    return symbols.groupBy(F.col(col).alias("sym")).agg(F.count("*").alias("n"))


#: Groups whose counts a task of byte_pairs() holds at once (half a MB each); it hands them on when there are more.
HELD_GROUPS = 128
#: Bytes of texts that are counted at once.
BYTES_AT_ONCE = 1 << 20


def byte_pairs(texts: DataFrame, by: str, text: str) -> DataFrame:
    """(by, before, sym, n): how often each byte of the texts of a group follows each other one; before is -1 at the beginning of a text.

    Tasks count Arrow batches, BYTES_AT_ONCE at once, so at most 257 * 256 rows a group and task are shuffled.  Null and empty texts have no bytes; null is a group of its own.
    """
    kind = texts.schema[by]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict = {}

        def rows():
            for group, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(at), arrow), pa.array((at >> 8).astype(np.int32) - 1), pa.array((at & 255).astype(np.int32)), pa.array(counts[at])], [by, "before", "sym", "n"])
            held.clear()

        for batch in batches:
            arrow = batch.schema.field(0).type
            column = batch.column(1).fill_null("") if batch.column(1).null_count else batch.column(1)
            offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
            if not len(column) or offsets[0] == offsets[-1]:
                continue
            body = np.frombuffer(column.buffers()[2], np.uint8)
            names = batch.column(0).dictionary_encode(null_encoding="encode")
            of, dictionary = names.indices.to_numpy(), names.dictionary.to_pylist()
            for low in range(int(offsets[0]), int(offsets[-1]), BYTES_AT_ONCE):  # any bytes: a text may be longer
                high = min(low + BYTES_AT_ONCE, int(offsets[-1]))
                first, last = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, high, "left")
                begins, ends = np.maximum(offsets[first:last], low), np.minimum(offsets[first + 1 : last + 1], high)
                data = body[low:high].astype(np.int32)
                pair = np.empty_like(data)
                pair[1:] = data[:-1]
                pair[0] = body[low - 1] if low > offsets[0] else 0
                pair = ((pair + 1) << 8) | data
                at = offsets[first:last][(ends > begins) & (offsets[first:last] >= low)] - low
                pair[at] = data[at]  # the beginning of a text
                group = np.repeat(of[first:last], ends - begins)
                order = np.argsort(group, kind="stable")
                some, at = np.unique(group[order], return_index=True)
                for k, found in zip(some, np.split(pair[order], at[1:]), strict=True):
                    name = dictionary[k]
                    if name not in held and len(held) == HELD_GROUPS:
                        yield from rows()
                    if name not in held:
                        held[name] = np.zeros(257 << 8, np.int64)
                    held[name] += np.bincount(found, minlength=257 << 8)
        yield from rows()

    out = T.StructType([kind, T.StructField("before", T.IntegerType()), T.StructField("sym", T.IntegerType()), T.StructField("n", T.LongType())])
    return texts.select(by, text).mapInArrow(run, out).groupBy(by, "before", "sym").agg(F.sum("n").alias("n"))


def pair_statistics(pairs: DataFrame, by: str) -> DataFrame:
    """(by, n_texts, n_bytes, n_runs, n_symbols, entropy_bits, order1_bits, huffman_bits) of byte_pairs().

    n_texts: those that are not empty; n_runs: stretches of one byte repeated; entropy_bits a byte alone, and order1_bits given the byte
    before; huffman_bits: all bytes of a group with one table for it.
    """

    @F.udf("long")
    def size(counts):
        return sum(n * length for n, length in zip(counts, code_lengths(counts), strict=True))

    plogp = lambda n, total: -n * F.log2(n / total)
    before = Window.partitionBy(by, "before")
    given = pairs.withColumn("_bits", plogp(F.col("n"), F.sum("n").over(before)))
    one = given.groupBy(by, "sym").agg(F.sum("n").alias("n"), F.sum("_bits").alias("bits1"), F.coalesce(F.sum(F.when(F.col("before") == -1, F.col("n"))), F.lit(0)).alias("firsts"), F.coalesce(F.sum(F.when(F.col("before") == F.col("sym"), F.col("n"))), F.lit(0)).alias("same"))
    one = one.withColumn("bits0", plogp(F.col("n"), F.sum("n").over(Window.partitionBy(by))))
    whole = one.groupBy(by).agg(*(F.sum(c).alias(c) for c in ("n", "bits0", "bits1", "firsts", "same")), F.count("*").alias("n_symbols"), F.sort_array(F.collect_list("n")).alias("counts"))  # at most 256
    return whole.select(by, F.col("firsts").alias("n_texts"), F.col("n").alias("n_bytes"), (F.col("n") - F.col("same")).alias("n_runs"), "n_symbols", (F.col("bits0") / F.col("n")).alias("entropy_bits"), (F.col("bits1") / F.col("n")).alias("order1_bits"), size("counts").alias("huffman_bits"))


def entropy(freq: DataFrame) -> DataFrame:
    """(bits) a symbol, of a table (sym, n): 0 for an empty one."""
    total = freq.agg(F.sum("n").alias("total"))
    p = F.col("n").cast("double") / F.col("total")
    return freq.crossJoin(F.broadcast(total)).agg(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("bits"))


def six_bins(r: Column) -> Column:
    """The magnitude class of a residual: 0, 1, 2 to 3, 4 to 15, 16 to 255, more."""
    m = F.abs(r)
    return F.when(m == 0, 0).when(m == 1, 1).when(m <= 3, 2).when(m <= 15, 3).when(m <= 255, 4).otherwise(5)


def code_lengths(counts: list[int]) -> list[int]:
    """Huffman code lengths; 0 for the only symbol of a stream."""
    if len(counts) < 2:
        return [0] * len(counts)
    heap = [(n, k, (k,)) for k, n in enumerate(counts)]
    heapq.heapify(heap)
    depth, at = [0] * len(counts), len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for k in (*a[2], *b[2]):
            depth[k] += 1
        heapq.heappush(heap, (a[0] + b[0], at, a[2] + b[2]))
        at += 1
    return depth


def canonical_codes(lengths: list[int]) -> list[int]:
    """Codes of the given lengths, in order of length, then symbol."""
    codes, code, last = [0] * len(lengths), 0, 0
    for k in sorted((k for k, n in enumerate(lengths) if n), key=lambda k: (lengths[k], k)):
        code <<= lengths[k] - last
        last = lengths[k]
        codes[k] = code
        code += 1
    return codes


def huffman_table(freq: DataFrame) -> DataFrame:
    """(sym, n, length, code): quantisation gives at most 2**17 symbols, which is what the driver holds."""
    rows = freq.orderBy("sym").limit((1 << 17) + 1).collect()
    if len(rows) > 1 << 17:
        raise ValueError("more symbols than quantisation can give")
    lengths = code_lengths([r.n for r in rows])
    made = [(r.sym, r.n, n, c) for r, n, c in zip(rows, lengths, canonical_codes(lengths), strict=True)]
    kind = freq.schema["sym"].dataType.simpleString()
    return freq.sparkSession.createDataFrame(made, f"sym {kind}, n long, length int, code long")


def huffman_bits(freq: DataFrame) -> DataFrame:
    """(bits): the size of the whole Huffman-coded stream, without writing it."""
    return huffman_table(freq).agg(F.coalesce(F.sum(F.col("n") * F.col("length")), F.lit(0)).cast("long").alias("bits"))


def _islands(rows: DataFrame, part: list[str], order: str, new: Column) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(order)
    return rows.withColumn("_new", F.coalesce(new.cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def zero_runs(rows: DataFrame, part: list[str], order: str, col: str) -> DataFrame:
    """(part, place, sym): a sequence with each run of zeros replaced by minus its length; place is where the run or value begins (by ``order``)."""
    w = Window.partitionBy(*part).orderBy(order)
    x = F.col(col)
    runs = _islands(rows, part, order, (x != 0) | (F.lag(col).over(w) != 0))
    return runs.groupBy(*part, "_run").agg(F.min(order).alias("place"), F.first(col).alias("x"), F.count("*").alias("n")).select(*part, "place", F.when(F.col("x") == 0, -F.col("n")).otherwise(F.col("x")).cast("long").alias("sym"))


def unzero_runs(runs: DataFrame, part: list[str]) -> DataFrame:
    """(part, place, k, sym): zero_runs() undone, k counting within a run; values that were negative can't be told from runs."""
    many = F.when(F.col("sym") < 0, -F.col("sym")).otherwise(1)
    return runs.select(*part, "place", F.explode(F.sequence(F.lit(0).cast("long"), many.cast("long") - 1)).alias("k"), F.when(F.col("sym") < 0, 0).otherwise(F.col("sym")).alias("sym"))


def tri_runs(rows: DataFrame, part: list[str], order: str, col: str) -> DataFrame:
    """(part, place, kind, value, n): runs of one of -1, 0, 1 (kind "run"), and stretches of other values (kind "literal", value null)."""
    w = Window.partitionBy(*part).orderBy(order)
    few = lambda x: x.between(-1, 1)
    x, before = F.col(col), F.lag(col).over(w)
    runs = _islands(rows, part, order, (few(x) != few(before)) | (few(x) & (x != before)))
    per = runs.groupBy(*part, "_run").agg(F.min(order).alias("place"), F.first(col).alias("x"), F.count("*").alias("n"))
    return per.select(*part, "place", F.when(few(F.col("x")), "run").otherwise("literal").alias("kind"), F.when(few(F.col("x")), F.col("x")).cast("long").alias("value"), "n")


def delta_zigzag(rows: DataFrame, part: list[str], order: str, col: str) -> DataFrame:
    """(part, order, sym): differences to the value before (the first: to 0), as non-negative numbers."""
    from ..functions.scalars import zigzag

    before = F.coalesce(F.lag(col).over(Window.partitionBy(*part).orderBy(order)), F.lit(0))
    return rows.select(*part, order, zigzag(F.col(col) - before).alias("sym"))


def interval_estimate(residuals: DataFrame, col: str, eb: int, share: float = 0.999, most: int = 65536, least: int = 32) -> DataFrame:
    """(intervals): the smallest power of two of quantisation intervals that hold ``share`` of the residuals.

    A residual of magnitude r falls in interval (r div eb + 1) div 2; a histogram and its running sum are all that is needed.
    """
    q = F.call_function("div", F.call_function("div", F.abs(F.col(col)), F.lit(eb).cast("long")) + 1, F.lit(2).cast("long"))
    hist = residuals.groupBy(F.least(q, F.lit(most // 2 - 1).cast("long")).alias("q")).agg(F.count("*").alias("n"))  # at most ``most`` / 2 rows
    total = hist.agg(F.sum("n").alias("total"))
    run = hist.crossJoin(F.broadcast(total)).withColumn("below", F.sum("n").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, 0)))
    enough = run.filter(F.col("below") >= F.col("total") * share).agg(F.min("q").alias("q"))
    need = 2 * (F.col("q") + 1)
    power = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(need - 1)).cast("int"))
    return enough.select(F.greatest(power, F.lit(least).cast("long")).alias("intervals"))


def encode_stream(symbols: list[int], table: dict[int, tuple[int, int]]) -> bytes:
    """Symbols in codes of a table {sym: (length, code)}, highest bit first, padded with zeros; nothing for a table of one symbol."""
    bits, n, out = 0, 0, bytearray()
    for s in symbols:
        length, code = table[s]
        bits, n = bits << length | code, n + length
        while n >= 8:
            n -= 8
            out.append(bits >> n & 0xFF)
        bits &= (1 << n) - 1
    if n:
        out.append(bits << (8 - n) & 0xFF)
    return bytes(out)


def decode_stream(data: bytes, count: int, table: dict[int, tuple[int, int]]) -> list[int]:
    """``count`` symbols of encode_stream()."""
    if len(table) == 1:
        return [next(iter(table))] * count
    by_code = {v: s for s, v in table.items()}
    out: list[int] = []
    length = code = 0
    for byte in data:
        for k in range(7, -1, -1):
            length, code = length + 1, code << 1 | (byte >> k & 1)
            if (length, code) in by_code:
                out.append(by_code[length, code])
                if len(out) == count:
                    return out
                length = code = 0
    if len(out) != count:
        raise ValueError(f"{len(out)} symbols; {count} were said to be there")
    return out


def huffman_encode(symbols: DataFrame, part: str, order: str, col: str) -> DataFrame:
    """(part, n, payload): each part's symbols, in order, in codes of one table for all; a part is held by one task."""
    import pandas as pd

    table = symbols.sparkSession.sparkContext.broadcast({r.sym: (r.length, r.code) for r in huffman_table(frequencies(symbols, col)).collect()})  # at most 2**17 symbols

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order)
        return pd.DataFrame({part: p[part].iloc[:1], "n": [len(p)], "payload": [encode_stream(p[col].tolist(), table.value)]})

    kind = symbols.schema[part].dataType.simpleString()
    return symbols.select(part, order, col).groupBy(part).applyInPandas(run, f"{part} {kind}, n long, payload binary")


def huffman_decode(coded: DataFrame, table: DataFrame, part: str) -> DataFrame:
    """(part, place from 0, sym): what huffman_encode() coded with a table (sym, length, code)."""
    import pandas as pd

    codes = coded.sparkSession.sparkContext.broadcast({r.sym: (r.length, r.code) for r in table.collect()})  # at most 2**17 symbols

    def run(batches):
        for b in batches:
            for p, n, payload in zip(b[part], b["n"], b["payload"], strict=True):
                yield pd.DataFrame({part: p, "place": range(n), "sym": decode_stream(bytes(payload), n, codes.value)})

    kind = coded.schema[part].dataType.simpleString()
    return coded.select(part, "n", "payload").mapInPandas(run, f"{part} {kind}, place long, sym long")


def pack_bits(values: list[int], width: int) -> bytes:
    """Small numbers of ``width`` bits (1, 2, 4), the first in the lowest bits."""
    out = bytearray(-(-len(values) * width // 8))
    for k, v in enumerate(values):
        out[k * width // 8] |= (v & ((1 << width) - 1)) << (k * width % 8)
    return bytes(out)


def unpack_bits(data: bytes, count: int, width: int) -> list[int]:
    return [data[k * width // 8] >> (k * width % 8) & ((1 << width) - 1) for k in range(count)]


def dense_interval(residuals: DataFrame, col: str, width: float) -> DataFrame:
    """(mid, share): the interval of ``width`` that holds the most values, and how many of all."""
    binned = residuals.groupBy(F.floor(F.col(col) / F.lit(float(width))).alias("b")).agg(F.count("*").alias("n"))
    total = binned.agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("m"))
    return total.select(((-F.col("m.b") + 0.5) * width).alias("mid"), (F.col("m.n") / F.col("total")).alias("share"))
