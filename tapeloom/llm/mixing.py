"""Mixing of sources to target weights by weighted sampling without replacement, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.common import NOT_SPACE, cut, join_counted, only, words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Bins of quality, for the distribution of a source's keys.
BINS = 16


def text_quality(text: Column) -> Column:
    """0.2 to 1: the share of letters among the characters that aren't ASCII white space."""
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    return F.greatest(F.lit(0.2), F.coalesce(letters / F.nullif(solid, F.lit(0)), F.lit(0.2)))


def _ranked(names: DataFrame) -> DataFrame:
    """The rank of each source by code point, null last, without a sort in one task.

    Range partitions are kept first, so that the counts and the ranks see the same ones.
    """
    n = max(1, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(names.repartitionByRange(n, F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("within", within).join(before, "part").withColumn("rank", F.col("before") + F.col("within")).drop("part", "before", "within")


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, n_docs, source_size -> the same with target.

    Targets are in proportion to the weights and add up to ``share`` of all sizes; a target stops at ``cap`` times its
    source's size and the excess goes to the others by weight, again and again until none is above. Each round is one
    aggregate of two numbers; a round in which no further source is capped ends it.
    """
    ranked = _ranked(sources)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = cut(ranked.select("source", "n_docs", "source_size", w.alias("weight")))
    total = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    limit, rate, capped = F.col("source_size") * cap, 0.0, -1
    while True:
        above = F.col("weight") * F.lit(rate) >= limit
        full, free, n = ranked.agg(
            F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)
        ).first()
        if not free or n == capped:
            break
        rate, capped = max(rate, (total - (full or 0.0)) / free), n
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(rate), limit)).drop("weight")


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    quality: Column | None = None,
    seed: int = 17,
    row: Column | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, row for each row of ``docs``; row is as given, else a hash of doc_id and text.

    size is the number of words; taken is the number of words that the mix takes from the row, repeats counted. A
    source gives floor(target / source_size) complete epochs first. The rest of its target is filled in the order of
    exponential keys -ln(u) / quality, u a hash of doc_id and text, so that better documents tend to come first and
    reruns agree; the last document that is reached gives only the words that are still missing. Thus a source's
    taken words differ from its target by less than one word, and no document exceeds ``cap`` times its size if ``cap`` is whole.

    Null texts have no words; a null source is a source of its own, the last one. Equal rows have equal keys and are
    taken one after the other. An empty table gives an empty result. Other columns are ignored.

    A source may hold a third of all rows: prefix sums go over about sqrt(n) key ranges of about sqrt(n) rows each. The
    ranges are equal shares of the keys' distribution, a sum of exponential ones over the source's bins of quality.
    """
    text = F.coalesce("text", F.lit(""))
    extra = [] if row is None else [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    rows = only(docs, "doc_id", "text", "source", *extra).select(
        "doc_id",
        "source",
        F.size(words(F.col("text"), NOT_SPACE)).cast("long").alias("size"),
        row_hash(seed).alias("h"),
        (text_quality(text) if quality is None else quality).cast("double").alias("quality"),
        (row_hash(seed) if row is None else row).alias("row"),
    )
    u = (F.shiftrightunsigned("h", 11).cast("double") + 0.5) / float(1 << 53)
    named = F.to_json(F.struct("source")).alias("tag")  # null has a name too
    rows = cut(rows.select("doc_id", "source", named, "size", "h", "row", "quality", (-F.log(u) / F.col("quality")).alias("key")))
    bin_of = F.least(F.greatest(F.floor(F.col("quality") * BINS), F.lit(0)), F.lit(BINS - 1))
    bins = [F.struct(F.count_if(bin_of == k).alias("n"), F.avg(F.when(bin_of == k, F.col("quality"))).alias("q")) for k in range(BINS)]
    sources = rows.groupBy("source", "tag").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"), F.array(*bins).alias("bins"))
    sources = cut(sources)
    targets = source_targets(sources.select("source", "n_docs", "source_size"), weights, share, cap).select("source", "target")
    sources = sources.join(targets.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("source", "s2")
    tagged = join_counted(rows.drop("source", "quality"), sources, ["tag"], "n_docs")
    slots = F.ceil(F.sqrt("n_docs"))
    below = F.aggregate("bins", F.lit(0.0), lambda acc, b: acc + F.when(b["n"] > 0, b["n"] * (1 - F.exp(-b["q"] * F.col("key")))).otherwise(0.0))
    tagged = tagged.withColumn("slot", F.least(F.floor(below / F.col("n_docs") * slots), slots - 1)).drop("bins")
    sums = tagged.groupBy("tag", "slot").agg(F.sum("size").alias("slot_size"))
    before = F.sum("slot_size").over(W.partitionBy("tag").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)) - F.col("slot_size")
    sums = sums.select("tag", "slot", before.alias("before"))
    order = W.partitionBy("tag", "slot").orderBy("key", "h").rowsBetween(W.unboundedPreceding, 0)
    within = tagged.withColumn("within", F.sum("size").over(order) - F.col("size"))
    joined = within.join(sums, ["tag", "slot"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least("size", rest - F.col("before") - F.col("within")))
    return joined.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"),
        "row",
    )


def row_hash(seed: int = 17) -> Column:
    return F.xxhash64(F.col("`doc_id`"), F.coalesce(F.col("`text`"), F.lit("")), F.lit(seed))


def repeat_mixed(docs: DataFrame, **mixing) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them: taken words over size, rounded.

    Rows without words, of which nothing can be taken, stay once. Rows are told apart by doc_id and two hashes of all their
    columns; equal rows stand for each other. An empty table stays empty. Columns may have any names.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    other = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    text = F.coalesce(F.col("`text`"), F.lit(""))
    null = F.col("`text`").isNull()
    row = F.struct(F.col("`doc_id`").alias("id"), F.xxhash64(other, text, null).alias("a"), F.xxhash64(null, text, F.lit(3), other).alias("b"))
    row = F.to_json(row)  # a string, so that a null id is equal to a null id
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5))
    plan = mix(docs.select(*[F.col(f"`{c}`") for c in ("doc_id", "text", "source")], row.alias("row_name")), row=F.col("row_name"), **mixing)
    plan = cut(plan.groupBy("row").agg(F.sum(times).cast("int").alias("times"), F.count("*").alias("rows")).where("times > 0"))
    packed = docs.select(row.alias("row"), F.struct(*every).alias("doc"))
    out = packed.join(plan.where("rows = 1"), "row").select("doc", "times")
    if plan.where("rows > 1").limit(1).count():
        twice = packed.join(plan.where("rows > 1"), "row").groupBy("row", "times").agg(F.first("doc").alias("doc"))
        out = out.unionByName(twice.select("doc", "times"))
    return out.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("doc.*")
