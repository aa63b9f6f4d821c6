"""A Merkle manifest of a table: levels stored at checkpoints, proofs from recomputed subtrees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tapeloom.llm.common import lower_ascii, only, scratch_path

#: Children of a node, and levels from one stored level to the next: an aligned subtree has FAN ** STRIDE nodes at its base.
FAN, STRIDE = 8, 3
BASE = FAN**STRIDE
#: Leaves in one sorted part.
PART_ROWS = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:array<string>,right:array<string>>>"


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def encoded(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*[encoded(c) for c in values]))


def parents(nodes: Column) -> Column:
    """The level above an array of digests that begins at a multiple of FAN."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FAN + 1, FAN), "")))


def width(size: Column, level: int) -> Column:
    """How many nodes a tree of ``size`` nodes has ``level`` levels further up."""
    return F.ceil(size / FAN**level)


def regenerated(blocks: DataFrame) -> DataFrame:
    """Adds level0 .. level<STRIDE>, the digests of each aligned subtree; a tree's last node stays as it is above its height.

    ``blocks`` has ``items``, an array of structs that begin with idx and node, and ``size``, the tree's nodes at this level.
    """
    out = blocks.withColumn("level0", F.transform("items", lambda x: x["node"]))
    for k in range(STRIDE):
        below = F.col(f"level{k}")
        out = out.withColumn(f"level{k + 1}", F.when(width(F.col("size"), k) > 1, parents(below)).otherwise(below))
    return out


def steps(position: Column) -> Column:
    """What lies left and right of a base node's ancestors in their runs, for each level on which the tree still has siblings."""
    found = []
    for k in range(STRIDE):
        at = F.floor(position / FAN**k).cast("int")
        run = at - at % FAN
        level = F.col(f"level{k}")
        step = F.struct(F.slice(level, run + 1, at - run).alias("left"), F.slice(level, at + 2, run + FAN - 1 - at).alias("right"))
        found.append(F.when(width(F.col("size"), k) > 1, F.array(step)).otherwise(F.array().cast(STEP)))
    return F.concat(*found)


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def placed(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """Adds ``idx``, each row's number (from 0) in its ``tree`` by ``order``, and ``size``, the rows of its tree.

    Rows are sorted by ranges over all machines, so a tree that holds most rows spreads over many parts; ``tie`` splits equal
    rows. A row's place in its part comes with the sorted table, its part's begin from counts of one row per part and tree.
    """
    parts = 1 + rows.count() // PART_ROWS
    by = ["tree", *order, "tie"]
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    ordered = stored(ordered.drop("tie"), path).withColumn("part", F.shiftright("at", 33))
    counts = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("tree").orderBy("part"))
    starts = counts.select("tree", "part", (upto - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(W.partitionBy("tree")).alias("size"))
    out = ordered.join(starts, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift"))
    return out.drop("at", "part", "shift")


def blocks_of(nodes: DataFrame, path: str) -> DataFrame:
    """Aligned subtrees' bases: (tree, block, size, items in order) from (tree, idx, size, node, ...)."""
    rest = [c for c in nodes.columns if c not in ("tree", "idx", "size")]
    block = F.floor(F.col("idx") / BASE).alias("block")
    items = F.sort_array(F.collect_list(F.struct("idx", *rest))).alias("items")
    return stored(nodes.groupBy("tree", block).agg(F.first("size").alias("size"), items), path)


def checkpoints(nodes: DataFrame, path: str) -> list[DataFrame]:
    """The stored levels 0, STRIDE, 2 * STRIDE ... of all trees as blocks; the last one holds each tree's root alone, or its base."""
    found = [blocks_of(nodes, f"{path}/level-0")]
    left = found[0].agg(F.max("size")).first()[0] or 0
    while left > BASE:
        up = regenerated(found[-1]).select("tree", F.col("block").alias("idx"), width(F.col("size"), STRIDE).alias("size"), F.col(f"level{STRIDE}")[0].alias("node"))
        found.append(blocks_of(up, f"{path}/level-{STRIDE * len(found)}"))
        left = -(-left // BASE)
    return found


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, node) of each tree, from its last stored block."""
    return regenerated(levels[-1]).select("tree", F.col(f"level{STRIDE}")[0].alias("node"))


def paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Each base node with ``path``, its siblings level by level up to what ``above`` (tree, path, ...) says of its tree.

    From the top down, each aligned subtree's interior nodes are made again from its stored base, the siblings of the base nodes are
    put before the path that all of them share, and the interior nodes are gone again.
    """
    extra = [c for c in above.columns if c != "tree"]
    known = above.select(F.lit(0).cast("long").alias("block"), "tree", *extra)
    for k in reversed(range(len(levels))):
        whole = regenerated(levels[k].join(known, ["tree", "block"]))
        every = F.transform("items", lambda x, i: F.struct(x.alias("item"), F.concat(steps(i), F.col("path")).alias("path")))
        rows = whole.select("tree", *[c for c in extra if c != "path"], F.inline(every))
        known = rows.select("tree", F.col("item.idx").alias("block"), *extra) if k else rows
    return known.select("tree", "item.*", *extra)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, node, lambda acc, s: digest(F.concat(F.array_join(s["left"], ""), acc, F.array_join(s["right"], ""))))


def siblings_digest(path: Column) -> Column:
    return digest(F.array_join(F.flatten(F.transform(path, lambda s: F.concat(s["left"], s["right"]))), ""))


@dataclass
class Manifest:
    """Stored levels of the trees of all languages and of the tree of their roots; ``root`` is None for an empty table."""

    trees: list[DataFrame]
    top: list[DataFrame]
    root: str | None

    def proofs(self) -> DataFrame:
        """Every leaf with subroot and path: tree, doc_id, node, given, subroot, path."""
        spark = self.top[0].sparkSession
        begin = spark.range(1).select(F.lit("").alias("tree"), F.array().cast(STEP).alias("path"))
        tops = paths(self.top, begin).select(F.col("lang_tree").alias("tree"), "path", F.col("node").alias("subroot"))
        return paths(self.trees, tops)


def build(docs: DataFrame, path: str, given: Column | None = None) -> Manifest:
    """The Merkle manifest of ``docs`` (doc_id, source, lang, n_chars, text; other columns are ignored) in tables under ``path``.

    A row's leaf is the digest of its fields, each with its length, null as `-`. The leaves of a language ascend by doc_id
    (null first); rows of one doc_id ascend by leaf, equal ones are leaves of their own. While a level has more than one node, each
    FAN consecutive ones become a parent. The roots of the languages, null first, then bytewise, make one more tree in the same way.
    ``given`` is a second digest (null where it is the leaf) that is kept beside each leaf for later proofs.

    Only every STRIDE-th level is stored, as blocks of aligned subtrees of 512 nodes. Texts are read once and don't leave their task: what is sorted,
    counted and grouped are digests. A text of any length is one digest. An empty table has no root and no proofs.
    """
    fields = only(docs, *FIELDS)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    given = F.lit(None).cast("string") if given is None else given
    rows = fields.select(tree.alias("tree"), "doc_id", leaf([F.col(c) for c in FIELDS]).alias("node"), given.alias("given"), F.monotonically_increasing_id().alias("tie"))
    leaves = stored(rows, f"{path}/leaves")
    trees = checkpoints(placed(leaves, ["doc_id", "node"], f"{path}/sorted"), f"{path}/trees")
    subroots = stored(roots(trees), f"{path}/subroots")
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "node", F.lit(0).alias("tie"))
    top = checkpoints(placed(tops, ["lang_tree"], f"{path}/languages"), f"{path}/top")
    found = roots(top).first()
    return Manifest(trees, top, found and found["node"])


def tampered_leaf() -> Column:
    """The leaf of a row whose text's A-Z became a-z, where 3 divides the crc32 of its doc_id; else null."""
    small = lower_ascii(F.col("text"))
    hit = (F.crc32(F.col("doc_id").cast("string")) % 3 == 0) & (small != F.col("text"))
    return F.when(hit, leaf([small if c == "text" else F.col(c) for c in FIELDS]))


def audited(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The manifest of ``docs`` and a check of every row's tampered form against it: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows without doc_id aren't tampered with, nor does tampering change texts that are null or have no capital letter. An empty table gives no rows.
    """
    spark = docs.sparkSession
    made = build(docs, path or scratch_path(spark, "merkle"), tampered_leaf())
    rows = made.proofs()
    out = rows.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", F.lit(made.root).cast("string").alias("root"), siblings_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("given", "node"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
