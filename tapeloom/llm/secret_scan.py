"""Secret scanning with corpus-wide ownership frequency, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, join_counted, only, row_key

# Kinds and patterns, in the order in which they are listed.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Kinds of the method's own: other shapes of credentials, and values that only one owner has.
BEARER = r"[bB][eE][aA][rR][eE][rR]\x20+([A-Za-z0-9+/_.=-]+)"
PREFIXED = r"(?:gh[pousr]_|xox[abprs]-|sk_live_|glpat-|AIza)[A-Za-z0-9_-]+"
KINDS = ("assign", "access", "hex", "bearer", "prefixed", "live")
BASE_KINDS = KINDS[:3]

#: Lengths that are summed up in one array.
BLOCK = 256

SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(lengths: Column) -> Column:
    """Sums of all lengths before each one. Arrays only grow within blocks of BLOCK, so the work is linear but for one number a block."""

    def running(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
        firsts = running(sums, F.lit(0))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), firsts.alias("first")), lambda z: running(z["b"], z["first"])))

    number = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    blocks = F.transform(number, lambda k: F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(lengths) > 0, _let(blocks, placed)).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, kind: int, pattern: str, least: int, group: int = 0) -> Column:
    """Leftmost matches that don't overlap, as places in code points; only those whose group is long enough.

    The text between the matches comes from split(), the matches from regexp_extract_all(): both walk the text alike,
    so running sums of the lengths give the places. A text may have any number of matches.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gap = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    length = F.transform(whole, lambda w: F.length(w))
    # split() has one part more than there are matches
    steps = F.filter(F.arrays_zip(gap.alias("gap"), length.alias("length"), value.alias("value")), lambda s: s["length"].isNotNull())

    def found(steps: Column) -> Column:
        def spans(before: Column) -> Column:
            def one(z: Column) -> Column:
                begin = z["before"] + z["s"]["gap"]
                return F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + z["s"]["length"]).alias("end"), z["s"]["value"].alias("value"))

            each = F.arrays_zip(before.alias("before"), steps.alias("s"))
            return F.transform(F.filter(each, lambda z: F.length(z["s"]["value"]) >= least), one)

        return _let(_let(F.transform(steps, lambda s: s["gap"] + s["length"]), _before), spans)

    return _let(steps, found).cast(SPAN)


def candidates(text: Column) -> Column:
    """All candidate spans of one text, base kinds first. Texts without the characters of a kind skip its work."""
    none = F.array().cast(SPAN)

    def of(kind: int, pattern: str, hint: str, least: int, group: int = 0) -> Column:
        return F.when(text.rlike(hint), _spans(text, kind, pattern, least, group)).otherwise(none)

    return F.concat(
        of(0, ASSIGN, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", 12, 2),
        of(1, ACCESS, r"AKIA[A-Z0-9]{14}", 18),
        of(2, HEX, r"[0-9a-f]{16}", 16),
        of(3, BEARER, r"(?i)bearer\x20+[A-Za-z0-9+/_.=-]{16}", 16, 1),
        of(4, PREFIXED, r"(?:gh[pousr]_|xox[abprs]-|sk_live_|glpat-|AIza)[A-Za-z0-9_-]{12}", 16),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def find_secrets(docs: DataFrame, repository: str = "source", owner: str = "lang", copied: int = 2) -> DataFrame:
    """doc_id, spans (array of kind, start, end, value, n_repositories, n_owners, live) for each row of ``docs``.

    A candidate's value is hashed; for each hash the distinct repositories and owners are counted over the whole corpus.
    A value found in fewer than ``copied`` repositories and fewer than ``copied`` owners looks live and specific to its
    owner; one that several have is a copied example. For each live value a further span of kind live is added.

    Null texts count as empty. A null repository or owner is one of its own. Rows that are there twice are counted once
    per repository and owner. Other columns are ignored. An empty table gives an empty result.

    Texts are read once; only candidates are shuffled. Counts are combined before each shuffle, and the join of
    candidates with counts broadcasts values with a large share of all candidates and shuffles the others.
    """
    rows = only(docs, "doc_id", "text", *dict.fromkeys((repository, owner)))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.select(
        "doc_id",
        row_key(F.col("doc_id"), text).alias("row"),
        F.col(repository).alias("repository"),
        F.col(owner).alias("owner"),
        candidates(text).alias("spans"),
    )
    rows = cut(rows)
    some = rows.where(F.size("spans") > 0)
    each = some.select("row", "repository", "owner", F.explode("spans").alias("span")).distinct()
    each = each.select("row", "repository", "owner", "span", F.sha2("span.value", 256).alias("hash"))
    owned = each.groupBy("hash", "repository", "owner").agg(F.lit(1).alias("one"))
    owned = owned.withColumns({c: F.to_json(F.struct(c)) for c in ("repository", "owner")})  # nulls count too
    by_repo = owned.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("n_repositories"))
    by_owner = owned.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("n_owners"))
    counts = by_repo.join(by_owner, "hash").join(each.groupBy("hash").agg(F.count("*").alias("n")), "hash")
    told = join_counted(each, counts, ["hash"]).withColumn("live", (F.col("n_repositories") < copied) & (F.col("n_owners") < copied))
    told = told.groupBy("row").agg(
        F.collect_set(F.struct("span.*", "n_repositories", "n_owners", "live")).alias("told")
    )
    kind = "array<struct<start:int,kind:int,end:int,value:string,n_repositories:bigint,n_owners:bigint,live:boolean>>"

    def flat(s, k):
        return F.struct(s["start"], k.alias("kind"), s["end"], s["value"], s["n_repositories"], s["n_owners"], s["live"])

    extra = F.transform(F.filter("told", lambda s: s["live"]), lambda s: flat(s, F.lit(KINDS.index("live"))))
    every = F.transform("told", lambda s: flat(s, s["kind"]))
    # equal spans are neighbours once sorted; array_distinct() would compare each with all
    once = lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))
    spans = _let(F.array_sort(F.concat(every.cast(kind), extra.cast(kind))), once)
    return rows.select("doc_id", "row").join(told, "row", "left").select(
        "doc_id", F.coalesce(spans, F.array().cast(kind)).alias("spans")
    )


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the counted and joined form of find_secrets()."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))

    def count(k):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
