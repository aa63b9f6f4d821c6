"""Quality rules: fixed base rules and robust multivariate outliers, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, only, words

#: Transformed statistics are whole numbers of 1 / UNIT, so that sums don't depend on their order.
UNIT = 1024
DIMS = ("q0", "q1", "q2", "q3", "q4")
#: Median of chi-square with five degrees of freedom.
CHI2_MEDIAN = 4.3515
#: Floor of a standard deviation, in units; statistics that hardly vary don't reject.
FLOOR = 0.05 * UNIT
CLASSIC, MEDIAN = 0, 1


def statistics(text: Column) -> dict[str, Column]:
    """The words and lines of a text and what is counted in it (see text_statistics)."""
    return {
        "w": words(text),
        "lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long"),
    }


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the kept columns, n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words.

    Repeated words lie in a 3-word window that the text holds twice or more. Windows are hashed and packed with their
    places into one sorted array of numbers per text; neighbours with equal high bits are then compared by their
    full hash, so no rows are exploded and texts of any length take n log n steps.
    """
    rows = only(docs, *dict.fromkeys(("doc_id", "text", *keep)))
    rows = rows.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", *keep, *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    n = F.size("w")
    bits = F.ceil(F.log2(n + 1.0)).cast("int")

    def full(i):
        return F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))

    packed = F.when(
        n >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.call_function("shiftleft", F.call_function("shiftrightunsigned", full(i), F.col("bits")), F.col("bits")).bitwiseOR(i.cast("long")),
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("bits", bits).withColumn("packed", packed)

    def high(x):
        return F.call_function("shiftrightunsigned", x, F.col("bits"))

    def twin(a, x, i, key):
        before, after = F.get(a, i - 1), F.get(a, i + 1)
        return F.coalesce(key(before) == key(x), F.lit(False)) | F.coalesce(key(after) == key(x), F.lit(False))

    near = F.filter("packed", lambda x, i: twin(F.col("packed"), x, i, high))
    rows = rows.withColumn("near", near)
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1).cast("int")
    exact = F.sort_array(F.transform("near", lambda x: F.struct(full(place(x)).alias("h"), place(x).alias("i"))))
    rows = rows.withColumn("near", exact)
    same = F.filter("near", lambda x, i: twin(F.col("near"), x, i, lambda s: s["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(same, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))))
    return rows.select(
        "doc_id",
        *keep,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def _vectors(stats: DataFrame) -> DataFrame:
    n = F.col("n_words")
    shape = [
        F.log((F.col("word_chars") + 100) / (n + 20)),
        F.sqrt(F.col("n_symbols") / (n + 20)),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 2)),
        F.sqrt(F.col("n_repeat_words") / (n + 20)),
        F.sqrt(F.col("n_upper") / (F.col("word_chars") + 100)),
    ]
    return stats.withColumns({d: F.round(c * UNIT).cast("long") for d, c in zip(DIMS, shape, strict=True)})


def _levels(rows: DataFrame) -> DataFrame:
    """Each row three times: in its language and source, in its language, and among all rows. "*" stands for any."""
    tag = lambda c: F.to_json(F.struct(F.col(c).alias("v")))  # noqa: E731  null gets a name that no value has
    rows = rows.withColumns({"own_lang": tag("lang"), "own_source": tag("source")})
    level = lambda a, b: F.struct(a.alias("g_lang"), b.alias("g_source"))
    own, any_ = level(F.col("own_lang"), F.col("own_source")), F.lit("*")
    return rows.select("*", F.inline(F.array(own, level(F.col("own_lang"), any_), level(any_, any_))))


GROUP = ["g_lang", "g_source"]


def _moments() -> list[Column]:
    one = [F.sum(d).alias(f"s_{d}") for d in DIMS]
    two = [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}{b}") for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]
    return [F.count("*").alias("n"), *one, *two]


def _names() -> list[str]:
    return ["n", *[f"s_{d}" for d in DIMS], *[f"s_{a}{b}" for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]]


def _factored(sums: DataFrame, *keep: str) -> DataFrame:
    """Means, the Cholesky factor of the covariance (floor on the diagonal) and half its log determinant, from sums."""
    out = sums.select(
        *keep,
        *[(F.col(f"s_{d}") / F.col("n")).alias(f"m_{d}") for d in DIMS],
        *[(F.col(f"s_{a}{b}") / F.col("n")).alias(f"s_{a}{b}") for i, a in enumerate(DIMS) for b in DIMS[: i + 1]],
    )
    for j, b in enumerate(DIMS):
        cov = lambda a, b: F.col(f"s_{a}{b}") - F.col(f"m_{a}") * F.col(f"m_{b}")
        rest = cov(b, b) + F.lit(FLOOR**2)
        for k in range(j):
            rest = rest - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))))
        below = {}
        for i in range(j + 1, len(DIMS)):
            x = cov(DIMS[i], b)
            for k in range(j):
                x = x - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            below[f"l{i}{j}"] = x / F.col(f"l{j}{j}")
        if below:
            out = out.withColumns(below)
    half = sum((F.log(f"l{j}{j}") for j in range(1, len(DIMS))), F.log("l00"))
    return out.select(*keep, *[f"m_{d}" for d in DIMS], *[f"l{i}{j}" for i in range(len(DIMS)) for j in range(i + 1)], half.alias("half_logdet"))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i, d in enumerate(DIMS):
        z = F.col(d) - F.col(f"m_{d}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(DIMS))), F.col("z0") * F.col("z0")))


def _start(vectors: DataFrame) -> DataFrame:
    """Two starts per group: all rows' moments, and medians with quartile spreads and no correlations."""
    classic = _factored(vectors.groupBy(*GROUP).agg(*_moments()), *GROUP).withColumn("start", F.lit(CLASSIC))
    values = vectors.select(*GROUP, F.inline(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(d).alias("v")) for i, d in enumerate(DIMS)])))
    counts = values.groupBy(*GROUP, "dim", "v").agg(F.count("*").alias("n"))
    order = W.partitionBy(*GROUP, "dim").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    share = counts.select(*GROUP, "dim", "v", (F.sum("n").over(order) / F.sum("n").over(W.partitionBy(*GROUP, "dim"))).alias("upto"))
    cuts = [F.min(F.when((F.col("dim") == i) & (F.col("upto") >= p), F.col("v"))).alias(f"p{i}_{k}") for i in range(len(DIMS)) for k, p in enumerate((0.25, 0.5, 0.75))]
    spread = share.groupBy(*GROUP).agg(*cuts)
    sd = lambda i: F.greatest((F.col(f"p{i}_2") - F.col(f"p{i}_0")) / F.lit(1.349), F.lit(FLOOR))
    median = spread.select(
        *GROUP,
        *[F.col(f"p{i}_1").cast("double").alias(f"m_{d}") for i, d in enumerate(DIMS)],
        *[(sd(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(len(DIMS)) for j in range(i + 1)],
        sum((F.log(sd(i)) for i in range(1, len(DIMS))), F.log(sd(0))).alias("half_logdet"),
        F.lit(MEDIAN).alias("start"),
    )
    return classic.unionByName(median)


def _binned(vectors: DataFrame, fits: DataFrame, *more: Column) -> DataFrame:
    """Counts (and moments) per group, start and bin of the log distance. Bins are an eighth of a doubling wide."""
    d = _distance(vectors.join(fits, GROUP))
    d = d.withColumn("bin", F.floor(8 * F.log2(F.col("d2") + F.lit(1.0 / UNIT))).cast("int"))
    keys = [*GROUP, *(["start"] if "start" in fits.columns else []), "bin"]
    return d.groupBy(*keys).agg(*(more or [F.count("*").alias("n")]))


def _inner(vectors: DataFrame, fits: DataFrame, share: float) -> DataFrame:
    """Moments of the ``share`` of rows with the smallest distances, per group and start; the bin at the edge counts in part."""
    keys = [*GROUP, "start"]
    bins = _binned(vectors, fits, *_moments())
    order = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    before = F.sum("n").over(order) - F.col("n")
    inner = bins.withColumn("before", before).withColumn("all", F.sum("n").over(W.partitionBy(*keys)))
    inner = inner.withColumn("part", F.least(F.lit(1.0), (F.col("all") * share - F.col("before")) / F.col("n"))).where("part > 0")
    return inner.groupBy(*keys).agg(*[F.sum(F.col(c) * F.col("part")).alias(c) for c in _names()])


def robust_moments(vectors: DataFrame, share: float = 0.75, steps: int = 5) -> DataFrame:
    """Per group the moments of the rows that the minimum-covariance-determinant estimate rests on.

    From each start, ``steps`` concentration steps: the rows with the smallest ``share`` of distances give the next
    estimate. The start with the smallest determinant wins. Each step is one aggregation to a few hundred bins of distance
    per group, combined before the shuffle, so a group may hold any share of the rows.
    """
    fits = cut(_start(vectors))
    for _ in range(steps):
        sums = cut(_inner(vectors, fits, share))
        fits = _factored(sums, *GROUP, "start")
    best = fits.groupBy(*GROUP).agg(F.min_by("start", F.struct("half_logdet", "start")).alias("start"))
    return cut(sums.join(best, [*GROUP, "start"]).drop("start"))


def _toward(own: DataFrame, parent: DataFrame, on: list[str], weight: float, cols: list[str]) -> DataFrame:
    """Sums of groups and of ``weight`` rows more that are like their parent's mean row."""
    p = parent.select(*on, *[(F.col(c) / F.col("n")).alias(f"p_{c}") for c in cols])
    joined = own.join(p, on) if on else own.join(F.broadcast(p))  # one row
    return joined.select(*GROUP, *[(F.col(c) + weight * F.col(f"p_{c}")).alias(c) for c in cols])


def robust_fit(vectors: DataFrame, weight: float = 100.0, share: float = 0.75) -> DataFrame:
    """Per language and source (rows of ``vectors`` at three levels, see _levels()): means, factor and scale of distances.

    Each estimate leans on the next wider one, as if ``weight`` rows like that one's were there too: a language and source
    on its language, a language on all rows. So groups of any size have an estimate, large ones their own. Distances are
    scaled to the chi-square median in the same way.
    """
    sums, cols = robust_moments(vectors, share), _names()
    of_all = sums.where("g_lang = '*'").select(*GROUP, *cols)
    of_lang = _toward(sums.where("g_lang != '*' AND g_source = '*'"), of_all, [], weight, cols)
    own = _toward(sums.where("g_source != '*'"), of_lang.drop("g_source"), ["g_lang"], weight, cols)
    fits = cut(_factored(own, *GROUP).drop("half_logdet").unionByName(_factored(of_lang, *GROUP).drop("half_logdet")).unionByName(_factored(of_all, *GROUP).drop("half_logdet")))
    bins = _binned(vectors, fits)
    order = W.partitionBy(*GROUP).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    half = bins.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(W.partitionBy(*GROUP)))
    half = half.where(F.col("upto") * 2 >= F.col("all")).groupBy(*GROUP).agg(F.min("bin").alias("bin"), F.first("all").alias("n"))
    scale = F.greatest(F.pow(F.lit(2.0), (F.col("bin") + 1) / 8) / F.lit(CHI2_MEDIAN), F.lit(1.0))
    half = cut(half.select(*GROUP, "n", (F.col("n") * scale).alias("scale")))
    top = half.where("g_lang = '*'")
    lang = _toward(half.where("g_lang != '*' AND g_source = '*'"), top, [], weight, ["n", "scale"])
    scaled = _toward(half.where("g_source != '*'"), lang.drop("g_source"), ["g_lang"], weight, ["n", "scale"])
    return cut(fits.join(scaled.select(*GROUP, (F.col("scale") / F.col("n")).alias("scale")), GROUP))


def judge(docs: DataFrame, weight: float = 100.0, cutoff: float = 60.0) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, source, the statistics, base_failed, distance (null where base_failed) and kept.

    base_failed: fewer than 50 words, or more than half of the words repeat. The method estimates location and spread
    of five transformed statistics (word length, symbols, duplicate lines, repeated words, capitals) per language and
    source by minimum covariance determinant, and rejects where the squared Mahalanobis distance exceeds ``cutoff``.

    Estimates use all rows that pass the base rules, and every such row has one: that of a small group leans on its
    language's and that of all rows (see robust_fit()). Null texts are empty; null languages and sources are groups of
    their own. Equal rows get equal verdicts. An empty table gives an empty result.
    """
    stats = cut(text_statistics(docs, "lang", "source"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    vectors = _vectors(stats.withColumn("base_failed", failed))
    good = cut(_levels(vectors.where("NOT base_failed")))
    fits = robust_fit(good, weight)
    scored = _distance(good.where("g_source != '*'").join(fits, GROUP)).withColumn("distance", F.col("d2") / F.col("scale"))
    out = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    bad = vectors.where("base_failed").select(*out, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return scored.select(*out, "distance", (F.col("distance") <= cutoff).alias("kept")).unionByName(bad)
