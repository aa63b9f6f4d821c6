"""N-gram Jaccard join with PartEnum signatures, and the groups that its links make."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, join_counted, map_arrow, only, release, remove, stored
from tapeloom.llm.set_compare import links_within, parities, refine_task
from tapeloom.llm.shingles import HASH_MASK, U, bounds, chunks, distinct_shingles, mix, set_names

#: Names of sets that one task remembers, to give each set's signatures once; and of groups of equal buckets.
REMEMBERED = 1_000_000
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Bands:
    """Sizes in bands, and PartEnum's parameters for each.

    Two sets of sizes a and b with a similarity of num / den or more differ in at most (a + b) (den - num) / (den + num)
    elements, and their sizes lie in one band or in neighbours. A band's bound k is that for its largest size. The
    domain is split into n1 parts of n2 parts each; of at most k differences some first-level part has k2 or fewer, so
    one of its subsets of n2 - k2 second-level parts is equal in both sets. ``spare`` more first-level parts make sure
    that more such subsets exist than a set has empty ones; only sets with more empty ones sign those too.
    """

    num: int
    den: int
    low: np.ndarray
    n1: np.ndarray
    spare: np.ndarray
    kind: np.ndarray  # index into kinds
    kinds: tuple

    @staticmethod
    def of(num: int, den: int, step: float = 1.25, top: int = 1 << 40) -> Bands:
        low, n1, spare, kind, kinds = [], [], [], [], []
        at = 1
        while at < top:
            high = max(at * den // num, int(at * step))
            k = 2 * high * (den - num) // (den + num)
            if k <= 2:
                shape, groups, extra = ((k + 2, k) if k else (1, 0)), 1, 0
            else:
                shape = (3, 1) if k <= 24 else (2, 1)
                groups = ceil((k + 1) / 2)
                empty = 0.043 * groups
                extra = ceil(empty + 3.5 * sqrt(empty) + 1)
            if shape not in kinds:
                kinds.append(shape)
            low.append(at)
            n1.append(groups + extra)
            spare.append(extra)
            kind.append(kinds.index(shape))
            at = high + 1
        subsets = []
        for n2, k2 in kinds:
            chosen = list(combinations(range(n2), n2 - k2))
            m = np.zeros((n2, len(chosen)), U)
            for c, members in enumerate(chosen):
                m[list(members), c] = 1
            subsets.append((n2, m))
        return Bands(num, den, np.array(low), np.array(n1), np.array(spare), np.array(kind), tuple(subsets))


def signatures(keys: np.ndarray, at: np.ndarray, which: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) for the chosen texts of a chunk, each for its size's band and, near its end, for the next one."""
    size = np.diff(at)[which]
    band = np.searchsorted(bands.low, size, "right") - 1
    more = size * bands.den >= bands.low[band + 1] * bands.num
    text = np.concatenate([which, which[more]])
    band = np.concatenate([band, band[more] + 1])
    found, owners = [], []
    for kind, (n2, subsets) in enumerate(bands.kinds):
        own = np.flatnonzero(bands.kind[band] == kind)
        if not len(own):
            continue
        t, b = text[own], band[own]
        n, first = at[t + 1] - at[t], at[t]
        of = np.repeat(np.arange(len(own)), n)
        x = keys[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)] & HASH_MASK
        cells = bands.n1[b] * n2
        base = np.cumsum(cells) - cells
        # parts are equal ranges of the hash, so a text's sorted hashes come part by part
        cell = base[of] + (((x >> U(22)) * cells[of].astype(U)) >> U(32)).astype(np.int64)
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sums, count = np.zeros(cells.sum(), U), np.zeros(cells.sum(), U)
        sums[cell[begin]] = np.add.reduceat(mix(x + U(0x8CB92BA72F3D8DD7)), begin)
        count[cell[begin]] = np.diff(np.append(begin, len(cell))).astype(U)
        sums, count = sums.reshape(-1, n2) @ subsets, count.reshape(-1, n2) @ subsets
        inst = np.repeat(np.arange(len(own)), bands.n1[b])
        group = np.arange(len(inst)) - np.repeat(np.cumsum(bands.n1[b]) - bands.n1[b], bands.n1[b])
        hollow = np.bincount(inst, weights=(count == 0).any(axis=1), minlength=len(own))
        tag = (b[inst] * 1_000_003 + group).astype(U)[:, None] * U(1009) + np.arange(subsets.shape[1], dtype=U)
        keep = (count > 0) | (hollow > bands.spare[b])[inst][:, None]
        found.append(mix(sums ^ mix(tag + U(0x2545F4914F6CDD1D)))[keep])
        owners.append(np.broadcast_to(t[inst][:, None], keep.shape)[keep])
    if not found:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def _sets_task(width: int, seed: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, offsets, data in chunks(batch.column("text")):
                n = len(offsets) - 1
                keys = distinct_shingles(offsets, data, width)
                at = bounds(keys, n)
                names = [pa.array(set_names(keys, at, s).view(np.int64)) for s in (seed, ~seed)]
                own = batch.slice(begin, n)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("hash"), pa.array(np.diff(at)), *names, parities(keys, at)],
                    ["doc_id", "hash", "n_shingles", "name", "proof", "parity"],
                )

    return task


def _signature_task(width: int, seed: int, bands: Bands, hot: dict[int, int]):
    """Signatures of each set, once per task if remembered. Those of ``hot`` are dealt to so many salts by the set's name."""
    known = np.array(sorted(hot), np.int64)
    salts = np.array([hot[s] for s in sorted(hot)], np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, offsets, data in chunks(batch.column("text")):
                keys = distinct_shingles(offsets, data, width)
                at = bounds(keys, len(offsets) - 1)
                names = set_names(keys, at, seed)
                which = []
                for i, name in enumerate(names.tolist()):
                    if name and name not in seen:
                        which.append(i)
                        seen.add(name)
                if len(seen) > REMEMBERED:
                    seen.clear()
                sig, text = signatures(keys, at, np.array(which, np.int64), bands)
                if not len(sig):
                    continue
                sig, name = sig.view(np.int64), names[text]
                salt = np.zeros(len(sig), np.int64)
                if len(known):
                    k = np.minimum(np.searchsorted(known, sig), len(known) - 1)
                    is_hot = known[k] == sig
                    salt[is_hot] = 1 + (mix(name[is_hot]) % salts[k[is_hot]].astype(U)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(salt), pa.array(name.view(np.int64))], ["sig", "salt", "name"])

    return task


#: Sets of one bucket that meet in one block; larger buckets are dealt into blocks, each two of which meet in a part.
BLOCK = 20_000
#: A signature of more than so many blocks, and of a thousandth of all rows, is salted before it is shuffled.
HOT_BLOCKS = 4


def _bucket_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature, salt and name -> (bucket, block, split, name) of signatures with two sets or more.

    A signature of up to BLOCK sets is a bucket named by its sets, so that equal buckets come once per task if remembered.
    A larger or salted one is named by the signature and leaves in blocks as they fill up, so memory is bounded.
    """
    seen: set[int] = set()
    empty = np.zeros(0, np.int64)
    held = {"sig": empty, "salt": empty, "name": empty}
    blocks = 0  # that have left of the signature at the start of what is held

    def rows(bucket: np.ndarray, block: np.ndarray, split: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(block), pa.array(split), pa.array(name)], ["bucket", "block", "split", "name"])

    def tell(sig: np.ndarray, salt: np.ndarray, name: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.append(True, (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])))
        n = np.diff(np.append(begin, len(sig)))
        content = mix(np.add.reduceat(mix(name.view(U)), begin) + n.astype(U)).view(np.int64)
        split = (salt[begin] > 0) | (n > BLOCK)
        split[0] |= first > 0
        keep = split | (n > 1)
        for k in np.flatnonzero(keep & ~split):
            b = int(content[k])
            keep[k] = b not in seen
            seen.add(b)
        if len(seen) > REMEMBERED:
            seen.clear()
        bucket = np.where(split, mix(sig[begin].view(U) ^ U(0x3C6EF372FE94F82B)).view(np.int64), content)
        number = np.arange(len(sig)) - np.repeat(begin, n)
        block = np.where(np.repeat(split, n), (np.repeat(salt[begin], n) << 32) + number // BLOCK, 0)
        block[: n[0]] += first
        chosen = np.repeat(keep, n)
        if chosen.any():
            yield rows(np.repeat(bucket, n)[chosen], block[chosen], np.repeat(split, n)[chosen], name[chosen])

    for batch in batches:
        if not batch.num_rows:
            continue
        c = {k: np.concatenate([v, batch.column(k).to_numpy()]) for k, v in held.items()}
        new = np.append(True, (c["sig"][1:] != c["sig"][:-1]) | (c["salt"][1:] != c["salt"][:-1]) | (c["name"][1:] != c["name"][:-1]))
        c = {k: v[new] for k, v in c.items()}
        changed = np.flatnonzero((c["sig"] != c["sig"][-1]) | (c["salt"] != c["salt"][-1]))
        last = int(changed[-1]) + 1 if len(changed) else 0
        if last:
            yield from tell(*(v[:last] for v in c.values()), blocks)
            blocks = 0
        held = {k: v[last:] for k, v in c.items()}
        full = (len(held["sig"]) - 1) // BLOCK * BLOCK  # the last row stays, to find its equals
        if full >= HOT_BLOCKS * BLOCK or (blocks and full > 0):
            begun = blocks or 1  # a bucket that left in part is split from its first block on
            yield from tell(*(v[:full] for v in held.values()), begun)
            blocks = begun + full // BLOCK
            held = {k: v[full:] for k, v in held.items()}
    if len(held["sig"]):
        yield from tell(*held.values(), blocks)


def _meetings(rows: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """Adds part and home: rows (key, block, ...) once for each other block of ``blocks`` (key, numbers) of their key.

    Every two blocks of a key share a part, and ``home`` is true in one of a block's parts.
    """
    rows = rows.join(blocks, key).withColumn("place", F.array_position("numbers", F.col("block")) - 1).withColumn("many", F.size("numbers"))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("many").cast("long") - 1), lambda c: (c != F.col("place")) | (F.col("many") == 1))
    rows = rows.withColumn("other", F.explode(other)).withColumn("next", F.pmod(F.col("place") + 1, F.col("many")))
    part = lambda c: F.least("place", c) * F.col("many") + F.greatest("place", c)
    return rows.withColumn("part", part("other")).withColumn("home", part("other") == part("next")).drop("numbers", "place", "many", "other", "next")


def hot_signatures(rows: DataFrame, n_rows: int, width: int, seed: int, bands: Bands, sample: int = 1024) -> dict[int, int]:
    """{signature: salts} of signatures that a hashed sample of rows shows in more than HOT_BLOCKS blocks of sets and a thousandth of all rows.

    It only steers the shuffle; results don't depend on it. There are at most a thousand times a set's signatures of them.
    """
    least = max(HOT_BLOCKS * BLOCK, n_rows // 1000)
    if n_rows <= least:
        return {}
    some = rows.where(F.pmod("hash", F.lit(sample)) == 0).select("text")
    found = map_arrow(some, _signature_task(width, seed, bands, {}), "sig long, salt long, name long").groupBy("sig").agg(F.count("*").alias("n"))
    return {r["sig"]: -(-r["n"] * sample // BLOCK) for r in found.where(F.col("n") * sample > least).collect()}


def refined(buckets: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that join the sets of each bucket which chains of possible links join, as stars.

    Only a parity vector of about a bit per shingle travels with each set of a bucket. It never parts sets that link.
    """
    split = buckets.where("split").groupBy("bucket").agg(F.array_sort(F.collect_set("block")).alias("numbers"))
    split = split.where(F.size("numbers") > 1)
    plain = buckets.where("NOT split").select("bucket", F.lit(0).cast("long").alias("part"), "name")
    dealt = _meetings(buckets.where("split"), "bucket", split).select("bucket", "part", "name")
    alone = buckets.where("split").join(split, "bucket", "left_anti").select("bucket", F.lit(0).cast("long").alias("part"), "name")
    rows = plain.unionByName(dealt).unionByName(alone).join(classes.select("name", "n_shingles", "parity"), "name")
    rows = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "name")  # so that buckets share their least names
    stars = map_arrow(rows.select("bucket", "part", "name", "n_shingles", "parity"), refine_task(num, den), "a long, b long").distinct()
    # a set that several stars hold stays in the first one, whose centre takes the other centres instead; these repeat and collapse
    first = stars.withColumn("first", F.min("a").over(W.partitionBy("b")))
    pairs = F.array(F.struct(F.col("first").alias("a"), "b"), F.struct(F.col("first").alias("a"), F.col("a").alias("b")))
    return first.select(F.inline(pairs)).where("a != b").distinct()


#: Sets, and shingles, of a family that one block holds; two blocks meet in a task.
GROUP_SETS, GROUP_SHINGLES = 16_000, 3_000_000


def comparison_parts(families: DataFrame, classes: DataFrame) -> DataFrame:
    """(family, part, name, block, home): groups in which all pairs are compared so that each pair of a family is.

    A family of no more than GROUP_SETS sets and GROUP_SHINGLES shingles is one block; larger ones are dealt into blocks by a hash.
    """
    rows = families.select("name", F.col("comp").alias("family")).join(classes.select("name", "n_shingles"), "name")
    blocks = rows.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / GROUP_SETS, F.sum("n_shingles") / GROUP_SHINGLES)).alias("blocks"), F.count("*").alias("n"))
    rows = cut(join_counted(rows, blocks, ["family"]).drop("n", "n_shingles"))
    whole = rows.where("blocks = 1").select("family", F.lit(0).cast("long").alias("part"), "name", F.lit(0).cast("long").alias("block"), F.lit(True).alias("home"))
    large = rows.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks"))).drop("blocks")
    numbers = large.groupBy("family").agg(F.array_sort(F.collect_set("block")).alias("numbers"))
    return whole.unionByName(_meetings(large, "family", numbers).select(*whole.columns))


def _compare_task(width: int, num: int, den: int):
    """Rows sorted by family and part -> the links and sums of links_within() of each part, whose sets are held together."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int] = []
        sets: list[np.ndarray] = []
        more: list[tuple] = []
        group = None

        def told() -> list[tuple[int, int | None, int]]:
            if len(sets) < 2:
                return []
            weight, block, home = (np.array(c) for c in zip(*more, strict=True))
            found, sums = links_within(sets, num, den, weight, block, home)
            return [(names[i], names[j], 0) for i, j in found] + [(names[i], None, int(sums[i])) for i in np.flatnonzero(sums)]

        for batch in batches:
            keys_of = list(zip(batch.column("family").to_pylist(), batch.column("part").to_pylist(), strict=True))
            wanted = batch.column("name").to_pylist()
            told_of = list(zip(*(batch.column(c).to_pylist() for c in ("n", "block", "home")), strict=True))
            out: list[tuple[int, int | None, int]] = []
            for begin, offsets, data in chunks(batch.column("text")):
                keys = distinct_shingles(offsets, data, width)
                at = bounds(keys, len(offsets) - 1)
                for i in range(len(offsets) - 1):
                    k = begin + i
                    if keys_of[k] != group:
                        out += told()
                        names, sets, more, group = [], [], [], keys_of[k]
                    more.append(told_of[k])
                    names.append(wanted[k])
                    sets.append((keys[at[i] : at[i + 1]] & HASH_MASK).copy())
            if out:
                yield _edges(out)
        if out := told():
            yield _edges(out)

    return task


def _edges(found: list[tuple[int, int | None, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b", "links"])


def compared(parts: DataFrame, classes: DataFrame, rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b, 0) of names whose sets are similar enough, by their complete texts, of each part a spanning forest; and
    (a, null, links): sums of the rows that have the sets that a links with, to be added up."""
    reps = classes.select("name", "n", "rep.doc_id", "rep.hash", "rep.rows")
    wanted = cut(parts.join(reps, "name"))
    texts = rows.join(wanted.where("rows = 1"), ["doc_id", "hash"])
    if wanted.where("rows > 1").limit(1).count():  # equal rows of one doc_id: one of them is enough
        twice = wanted.where("rows > 1")
        one = rows.join(twice.select("doc_id", "hash").distinct(), ["doc_id", "hash"]).groupBy("doc_id", "hash").agg(F.first("text").alias("text"))
        texts = texts.unionByName(one.join(twice, ["doc_id", "hash"]), allowMissingColumns=True)
    texts = texts.select("family", "part", "name", "n", "block", "home", "text").repartition("family", "part").sortWithinPartitions("family", "part")
    return map_arrow(texts, _compare_task(width, num, den), "a long, b long, links long")


def components(edges: DataFrame) -> DataFrame:
    """(name, comp) of the names that have edges; comp is the smallest name that can be reached.

    Labels move along edges and then jump to their label's label, until none changes. Every step is an aggregate
    with a map-side combine and two joins by counted keys: a name with very many edges (a star's centre) and a label that
    very many names have are broadcast with their one row, so neither meets all its rows in one task.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, edge_path = stored(both, "edges")
    first = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    labels, path = stored(first.select(F.col("a").alias("name"), F.least("a", "m").alias("comp"), "n"), "labels")
    while True:
        near = join_counted(both.withColumnRenamed("b", "name"), labels, ["name"], written=True).groupBy("a").agg(F.min("comp").alias("near"))
        moved = labels.join(near, F.col("name") == F.col("a")).select("name", "n", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        moved, moved_path = stored(moved, "moved")
        held = moved.groupBy("mid").agg(F.count("*").alias("held"))
        jump, jump_path = stored(held.join(labels.select(F.col("name").alias("mid"), F.col("comp").alias("far")), "mid"), "jump")
        told = join_counted(moved, jump, ["mid"], "held", written=True)
        told, new_path = stored(told.select("name", "old", F.least("mid", "far").alias("comp"), "n"), "labels")
        changed = told.where("old != comp").limit(1).count()
        for p in (path, moved_path, jump_path):
            remove(spark, p)
        labels, path = told.select("name", "comp", "n"), new_path
        if not changed:
            remove(spark, edge_path)
            return labels.drop("n")


def _named_sets(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame, int]:
    """The set of each row, the classes of equal sets, and the seed of their names.

    Names have 64 bits and a proof of 64 more. Where two sets share a name but not the proof, all are named anew by another seed.
    """
    for seed in range(8):
        sets = cut(map_arrow(rows, _sets_task(width, seed), "doc_id long, hash long, n_shingles long, name long, proof long, parity binary"))
        each = sets.where("n_shingles > 0").groupBy("name", "doc_id", "hash").agg(
            F.count("*").alias("rows"), F.max("n_shingles").alias("n_shingles"), F.first("parity").alias("parity"), F.min("proof").alias("p"), F.max("proof").alias("q")
        )
        classes = each.groupBy("name").agg(
            F.min(F.struct("doc_id", "hash", "rows")).alias("rep"), F.max("n_shingles").alias("n_shingles"), F.sum("rows").alias("n"),
            F.first("parity").alias("parity"), F.min("p").alias("p"), F.max("q").alias("q"),
        )
        classes = cut(classes)
        if not classes.where("p != q").limit(1).count():
            break
    return sets, classes.drop("p", "q"), seed


def _classified(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash, n_shingles, name) for each row, null doc_ids as LAST; (name, n, keep, n_links) for each set that isn't empty, ``keep``
    being the least doc_id and hash of its component.

    Equal sets become one class first. Classes that share a signature are in one bucket. In each bucket parity vectors
    part the sets that surely don't link; what stays joined, over all buckets, is a family. All sets of a family are
    compared with each other inside tasks of bounded size, each set in one of them unless the family is very large; only
    links that join components leave it and sums of links, never the pairs. So no link is lost.
    """
    spark = docs.sparkSession
    bands = Bands.of(num, den)
    rows = only(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    sets, classes, seed = _named_sets(rows, width)
    hot = hot_signatures(rows, sets.count(), width, seed, bands)
    signed = map_arrow(rows.select("text"), _signature_task(width, seed, bands, hot), "sig long, salt long, name long")
    dealt = signed.repartition("sig", "salt").sortWithinPartitions("sig", "salt", "name")
    buckets = cut(map_arrow(dealt, _bucket_task, "bucket long, block long, split boolean, name long").distinct())
    release(spark)
    families = components(refined(buckets, classes, num, den))
    parts = comparison_parts(families, classes)
    found = cut(compared(parts, classes, rows, width, num, den))
    release(spark)
    comp = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("name")).agg(F.sum("links").alias("links"))
    names = classes.join(comp, "name", "left").join(links, "name", "left").withColumn("comp", F.coalesce("comp", "name"))
    least = names.groupBy("comp").agg(F.min(F.struct("rep.doc_id", "rep.hash")).alias("keep"), F.count("*").alias("n"))
    n_links = F.col("n") - 1 + F.coalesce("links", F.lit(0))
    names = join_counted(names.select("name", "comp", n_links.alias("n_links"), F.col("n").alias("rows")), least, ["comp"])
    return sets.select("doc_id", "hash", "n_shingles", "name"), names.select("name", "keep", "n_links", F.col("rows").alias("n"))


def links_of_similar(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of ``docs``.

    A document's set holds its distinct ``width``-word shingles (words between ASCII white space, A-Z as a-z); with fewer
    words the whole sequence is one shingle; without words, or with a null text, it is empty, linked with nothing and
    its own component. Two documents link when their sets' similarity is at least num / den; component_id is the
    smallest doc_id that links reach, n_links the number of other rows that the row links with. Rows that share a doc_id
    are different documents with one name. Null doc_ids come last; a component of theirs alone has a null id. Other
    columns are ignored.
    """
    sets, names = _classified(docs, width, num, den)
    names = names.select("name", F.col("keep.doc_id").alias("component_id"), "n_links", "n")
    null = lambda c: F.nullif(c, F.lit(LAST))
    filled = join_counted(sets.where("n_shingles > 0"), names, ["name"]).select("doc_id", "n_shingles", "component_id", "n_links")
    empty = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return filled.unionByName(empty).select(null(F.col("doc_id")).alias("doc_id"), "n_shingles", null(F.col("component_id")).alias("component_id"), "n_links")


def groups_of_similar(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of links_of_similar()."""
    return links_of_similar(docs, width, num, den).drop("n_links")


def drop_similar(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, with all their columns, whatever these are called.

    It is the one with the smallest doc_id, null last, and of these the one with the smallest hash of its text; of rows
    that have both in common one stays, the one whose other columns have the smallest hash. Rows without words stay, null
    and empty texts too. An empty table stays empty.
    """
    sets, names = _classified(docs, width, num, den)
    told = join_counted(sets.where("n_shingles > 0"), names, ["name"]).groupBy("doc_id", "hash").agg(F.first("keep").alias("keep"), F.count("*").alias("rows"))
    stays = F.struct("doc_id", "hash") == F.col("keep")
    gone = cut(told.where(~stays | (F.col("rows") > 1)).select(F.col("doc_id").alias("id"), "hash", stays.alias("one")))
    keys = (F.coalesce(F.col("`doc_id`"), F.lit(LAST)).alias("id"), F.xxhash64(F.col("`text`")).alias("hash"))
    packed = docs.select(*keys, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rest = packed.join(gone, ["id", "hash"], "left_anti").select("row")
    once = packed.join(gone.where("one"), ["id", "hash"]).groupBy("id", "hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return rest.unionByName(once.select("row")).select("row.*")
