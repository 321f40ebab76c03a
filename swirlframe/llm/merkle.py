"""A Merkle manifest of a dataset, in an external-memory store of nodes.

Leaves are hashed where the texts are read; only (tree, id, digest) goes on.  They are sorted once, by tree (one
for each language) and id, and numbered by the sizes of the sorted runs.  A node has the coordinate (tree, level,
idx).  2**STRIDE consecutive nodes of a level make a block, which a task reads in order, and of which it writes the next STRIDE
levels; these go to Parquet, partitioned by level, and the highest of them is read for the blocks above.  A tree of n leaves
so takes log2(n) / STRIDE passes, each 2**STRIDE times smaller than the one before.  The roots of all trees are the leaves of one more tree.

Proofs come from the same blocks, from the highest to the lowest: a block's nodes are merged with the nodes whose
proofs are wanted, and with the proof of the block itself, which all of them share.

No group is larger than a block, however many rows a language has.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, removed, scratch, written

#: Levels that a task makes of a block (as a power of two, the nodes of a block).
STRIDE = 12
#: The tree over the roots of the others; those have names that begin with "=", or "-" for null.
TOP = "/"
#: A tampered dataset differs in the rows whose checksum this number divides.
TAMPERED = 7


def encoded(*values: Column) -> Column:
    """Values one after the other, each as its number of bytes, ":" and itself in UTF-8, or "-" if it is null: no two lists of values are alike."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def digest_of(text: Column) -> Column:
    """Lowercase hex SHA-256."""
    return F.sha2(text, 256)


def tree_of(lang: Column) -> Column:
    """The name of a language's tree; names sort as languages do, null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))


def leaves(docs: DataFrame, columns: list[str], id_col: str = "doc_id", lang_col: str = "lang", tampered: dict[str, Column] | None = None) -> DataFrame:
    """(tree, id, leaf, changed): a leaf for each row, over ``columns`` in this order.

    ``tampered`` has other values for some columns; ``changed`` is the leaf with them, or null if it is the same leaf.
    """
    leaf = digest_of(encoded(*(F.col(c) for c in columns)))
    rows = docs.select(tree_of(F.col(lang_col)).alias("tree"), F.col(id_col).alias("id"), F.unhex(leaf).alias("leaf"), *([_changed(columns, tampered).alias("changed")] if tampered else []))
    return rows if tampered else rows.withColumn("changed", F.lit(None).cast("binary"))


def _changed(columns: list[str], tampered: dict[str, Column]) -> Column:
    """Only rows with another value are hashed again."""
    other = F.lit(False)
    for c, x in tampered.items():
        other = other | ~F.col(c).eqNullSafe(x)
    return F.when(other, F.unhex(digest_of(encoded(*(tampered.get(c, F.col(c)) for c in columns)))))


def numbered(rows: DataFrame, keep: str) -> DataFrame:
    """rows with ``idx``, their place in their tree: by id (null first), then leaf.  Written at ``keep``.

    Rows are sorted in ranges.  monotonically_increasing_id() counts on within a range, so a row's place is its distance from the
    first row of its tree there, and the rows of that tree in the ranges before (a table of ranges and trees, not of rows).
    """
    spark, at = rows.sparkSession, scratch(rows.sparkSession, "merkle-runs")
    rows.repartitionByRange("tree", "id", "leaf").sortWithinPartitions("tree", "id", "leaf").withColumn("_at", F.monotonically_increasing_id()).withColumn("_run", F.spark_partition_id()).write.option("compression", "zstd").parquet(at)
    runs = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_at", T.LongType()), T.StructField("_run", T.IntegerType())])).parquet(at)
    sizes = cut(runs.groupBy("_run", "tree").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")))
    # a tree lies in ranges that follow each other, so its rows in earlier ranges are a sum over these
    earlier = Window.partitionBy("tree").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_run", "tree", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = runs.join(_small(cut(before)), ["_run", "tree"]).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("idx"))
    placed.write.option("compression", "zstd").parquet(keep)
    removed(spark, at)
    return spark.read.schema(placed.schema).parquet(keep)


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= 100_000 else table


def _parents(nodes: list[str]) -> list[str]:
    """Each node is the hash of two nodes of the level below, the last one perhaps of one."""
    return [hashlib.sha256((nodes[i] + (nodes[i + 1] if i + 1 < len(nodes) else "")).encode()).hexdigest() for i in range(0, len(nodes), 2)]


NODES = T.StructType([T.StructField("tree", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("level", T.IntegerType())])


def _made(level: int, stride: int):
    """Of a block's nodes at a level: the nodes of the next levels, until one is left in the tree."""

    def run(table: pa.Table) -> pa.Table:
        at = np.argsort(table.column("idx").to_numpy())
        first, many = table.column("idx")[int(at[0])].as_py(), table.column("many")[0].as_py()
        nodes = [x.hex() for x in table.column("digest").take(pa.array(at)).to_pylist()]
        out, here = [], many
        for k in range(1, stride + 1):
            if here == 1:  # of the whole tree
                break
            nodes, here = _parents(nodes), -(-here // 2)
            out += [((first >> k) + i, bytes.fromhex(x), level + k) for i, x in enumerate(nodes)]
        idx, digest, levels = zip(*out, strict=True) if out else ((), (), ())
        tree = pa.array([table.column("tree")[0].as_py()] * len(out), pa.string())
        return pa.Table.from_arrays([tree, pa.array(idx, pa.int64()), pa.array(digest, pa.binary()), pa.array(levels, pa.int32())], names=NODES.names)

    return run


@dataclass
class Store:
    """Nodes of all trees: ``path``/level=k has those of level k above the leaves; ``many`` has (tree, many), the number of leaves."""

    spark: SparkSession
    path: str
    leaves: DataFrame
    many: DataFrame
    height: int
    stride: int = STRIDE
    parts: dict[int, str] = field(default_factory=dict)

    def level(self, level: int) -> DataFrame:
        """(tree, idx, digest) of a level, read from the store."""
        return self.levels([level]).drop("level")

    def levels(self, levels: list[int]) -> DataFrame:
        """(tree, idx, digest, level)."""
        made = None
        for at in sorted({(k - 1) // self.stride for k in levels if k > 0}):
            some = [k for k in levels if k > 0 and (k - 1) // self.stride == at]
            if at in self.parts:
                part = self.spark.read.schema(NODES).parquet(self.parts[at]).filter(F.col("level").isin(some)).select(NODES.names)
                made = part if made is None else made.unionByName(part)
        if 0 in levels:
            base = self.leaves.select("tree", "idx", F.col("leaf").alias("digest"), F.lit(0).alias("level"))
            made = base if made is None else base.unionByName(made)
        return self.spark.createDataFrame([], NODES) if made is None else made

    def roots(self) -> DataFrame:
        """(tree, digest): the highest node of each tree."""
        top = _height(F.col("many"))
        tops = self.many.select("tree", top.alias("level"))
        every = self.levels(list(range(self.height + 1))).filter("idx = 0")
        return every.join(_small(tops), ["tree", "level"]).select("tree", "digest")


def _height(many: Column) -> Column:
    """Levels above n leaves: the bits of n - 1."""
    return F.when(many <= 1, F.lit(0)).otherwise(F.length(F.bin(many - 1))).cast("int")


def built(placed: DataFrame, stride: int = STRIDE) -> Store:
    """The nodes above numbered leaves (tree, idx, leaf, ...), in the shared folder."""
    spark = placed.sparkSession
    path = scratch(spark, "merkle-nodes")
    many = cut(placed.groupBy("tree").agg(F.count("*").alias("many")))
    most = many.agg(F.max("many")).first()[0] or 0
    store = Store(spark, path, placed, many, max(most - 1, 0).bit_length(), stride)
    for at in range(-(-store.height // stride)):
        level = at * stride
        here = store.level(level).join(_small(many.select("tree", F.ceil(F.col("many") / F.lit(1 << level)).cast("long").alias("many"))), "tree").filter("many > 1")
        blocks = here.withColumn("_block", F.shiftright("idx", stride)).groupBy("tree", "_block").applyInArrow(_made(level, stride), NODES)
        store.parts[at] = f"{path}/part={at}"
        blocks.write.partitionBy("level").option("compression", "zstd").parquet(store.parts[at])
    return store


STEP = T.StructType([T.StructField("left", T.BooleanType()), T.StructField("digest", T.BinaryType())])
_STEP = pa.struct([("left", pa.bool_()), ("digest", pa.binary())])


def _proved(level: int, stride: int, out: T.StructType, arrow: pa.Schema):
    """Of wanted nodes of a block and its nodes of all its levels: their siblings, and then those of the block."""

    def run(wanted: pa.Table, nodes: pa.Table) -> pa.Table:
        if wanted.num_rows == 0:
            return arrow.empty_table()
        idx = wanted.column("idx").to_numpy()
        levels, places = nodes.column("level").to_numpy(zero_copy_only=False), nodes.column("idx").to_numpy(zero_copy_only=False)
        shared = nodes.column("above").combine_chunks()
        above = next((x for x in shared.filter(pa.array(levels < 0)).to_pylist() if x), [])
        many = wanted.column("many")[0].as_py()
        lefts, takes = [], []
        for k in range(stride):
            if -(-many // (1 << k)) <= 1:  # the root of the tree
                break
            here = np.flatnonzero(levels == level + k)
            here = here[np.argsort(places[here])]
            other = (idx >> k) ^ 1
            at = np.searchsorted(places[here], other)
            there = np.append(places[here], -1)[at] == other
            takes.append(np.where(there, np.append(here, -1)[at], -1))
            lefts.append(((idx >> k) & 1).astype(bool))
        n, own, more = len(idx), len(takes), len(above)
        pool = pa.concat_arrays([nodes.column("digest").combine_chunks(), pa.array([x["digest"] for x in above], pa.binary())])
        at = np.concatenate([np.stack(takes, 1) if own else np.zeros((n, 0), np.int64), np.broadcast_to(nodes.num_rows + np.arange(more), (n, more))], 1).ravel()
        left = np.concatenate([np.stack(lefts, 1) if own else np.zeros((n, 0), bool), np.broadcast_to(np.array([x["left"] for x in above], bool), (n, more))], 1).ravel()
        digest = pool.take(pa.array(at, mask=at < 0))
        steps = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (own + more), pa.int32()), pa.StructArray.from_arrays([pa.array(left), digest], fields=list(_STEP)))
        return pa.Table.from_arrays([*(wanted.column(c) for c in out.names[:-1]), steps], schema=arrow)

    return run


def proofs(store: Store, wanted: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """wanted (tree, idx, ...: leaves by coordinate) with ``siblings``: (left, digest) level by level up to the root of the tree, then
    those that ``above`` (tree, siblings) has.  A level at which a node is alone has a null digest.

    Coordinates that the store does not have give rows whose proofs do not hold.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    tops = -(-store.height // store.stride)
    path = above  # (tree, siblings) of the root, then (tree, idx, siblings) of the blocks
    for at in reversed(range(max(tops, 1))):
        level, stride = at * store.stride, store.stride
        many = store.many.select("tree", F.ceil(F.col("many") / F.lit(1 << level)).cast("long").alias("many"))
        if level:  # proofs of all nodes of this level, for the blocks below
            asked = store.level(level).select("tree", "idx")
        else:
            asked = wanted
        asked = asked.join(_small(many), "tree").withColumn("_block", F.shiftright("idx", stride))
        names = [c for c in asked.columns if c not in ("_block",)]
        out = T.StructType([*(asked.schema[c] for c in names), T.StructField("siblings", T.ArrayType(STEP))])
        nodes = store.levels(list(range(level, level + stride))).select("tree", F.expr(f"shiftright(idx, {stride} - (level - {level}))").alias("_block"), "idx", "digest", "level", F.lit(None).cast(T.ArrayType(STEP)).alias("above"))
        if path is not None:
            block = F.col("idx") if "idx" in path.columns else F.lit(0)
            nodes = nodes.unionByName(path.select("tree", block.cast("long").alias("_block"), F.lit(0).cast("long").alias("idx"), F.lit(None).cast("binary").alias("digest"), F.lit(-1).alias("level"), F.col("siblings").alias("above")))
        nodes = nodes.toDF(*nodes.columns)  # columns of its own, where both sides come from the same leaves
        made = asked.groupBy("tree", "_block").cogroup(nodes.groupBy("tree", "_block")).applyInArrow(_proved(level, stride, out, to_arrow_schema(out)), out).drop("many")
        if level == 0:
            return made
        # trees that end below this level begin with what is above them
        rest = None if above is None else above.join(_small(many.filter("many > 1").select("tree")), "tree", "left_anti").select("tree", F.lit(0).cast("long").alias("idx"), "siblings")
        path = cut(made.select("tree", "idx", "siblings") if rest is None else made.select("tree", "idx", "siblings").join(_small(many.filter("many > 1").select("tree")), "tree", "left_semi").unionByName(rest))
    raise AssertionError("unreachable")


def folded(leaf: Column, siblings: Column) -> Column:
    """The root (hex) that a leaf (hex) and its siblings lead to."""
    other = lambda s: F.lower(F.hex(s["digest"]))
    step = lambda got, s: digest_of(F.when(s["digest"].isNull(), got).when(s["left"], F.concat(other(s), got)).otherwise(F.concat(got, other(s))))
    return F.aggregate(siblings, leaf, step)


@dataclass
class Manifest:
    """The stores of the languages and of their roots, ``tops``: (tree, digest, idx), and ``root`` (hex; the hash of nothing for a table without rows)."""

    store: Store
    upper: Store
    tops: DataFrame
    root: str

    def proofs(self, wanted: DataFrame) -> DataFrame:
        """wanted (tree, idx, ...) with ``siblings`` up to the root of the dataset."""
        up = proofs(self.upper, self.tops.select(F.lit(TOP).alias("tree"), "idx", F.col("tree").alias("of")))
        return proofs(self.store, wanted, cut(up.select(F.col("of").alias("tree"), "siblings")))


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", lang_col: str = "lang", tampered: dict[str, Column] | None = None, stride: int = STRIDE) -> Manifest:
    """The manifest of a table: ``store.leaves`` has (tree, id, leaf, changed, idx), a row for each row of docs.

    Null languages are a tree of their own, the first one.  Null ids come first in their tree, and rows of one id are ordered by
    their leaves, so the order of the input does not matter; equal rows are leaves of their own.  Other columns are not read.
    """
    spark = docs.sparkSession
    hashed = written(leaves(docs, columns, id_col, lang_col, tampered), "merkle-hashed")  # the sort samples what it sorts: texts are read once
    store = built(numbered(hashed, scratch(spark, "merkle-leaves")), stride)
    subroots = cut(store.roots())
    tops = numbered(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("id"), F.col("digest").alias("leaf")), scratch(spark, "merkle-tops"))
    upper = built(tops, stride)
    root = upper.roots().first()
    return Manifest(store, upper, tops.select(F.col("id").alias("tree"), F.col("leaf").alias("digest"), "idx"), root.digest.hex() if root else hashlib.sha256(b"").hexdigest())


def audit(docs: DataFrame, id_col: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), stride: int = STRIDE) -> DataFrame:
    """One row for each row of docs: id_col, leaf, subroot, root, proof_sha256, folded_root, verified.

    The manifest is of docs.  A copy of it in which n_chars is greater by one, in rows where TAMPERED divides the CRC-32 of the id as text, is
    held against it: folded_root is what the copy's leaf and the manifest's proof lead to.  proof_sha256 is the hash of the siblings
    one after the other.  A null id or a null n_chars is not tampered with; other nulls, ties and repeated rows as in manifest().
    An empty table gives no rows.
    """
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % TAMPERED == 0
    made = manifest(docs, list(columns), id_col, "lang", {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, stride)
    rows = made.proofs(made.store.leaves.select("tree", "idx", "id", "leaf", "changed"))
    tops = made.tops.select("tree", F.lower(F.hex("digest")).alias("subroot"))
    hexed = lambda c: F.lower(F.hex(c))
    proof = digest_of(F.array_join(F.transform("siblings", lambda s: hexed(s["digest"])), ""))  # nulls are left out
    out = rows.join(_small(tops), "tree").select(F.col("id").alias(id_col), hexed(F.col("leaf")).alias("leaf"), "subroot", F.lit(made.root).alias("root"), proof.alias("proof_sha256"), folded(hexed(F.coalesce("changed", "leaf")), F.col("siblings")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
