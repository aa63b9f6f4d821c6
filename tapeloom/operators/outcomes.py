"""Relations over the outcome dataset: labelled records and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAN = ("upper", "lower", "neither")


def location_bins() -> Column:
    """O3: a record may lie in two bins."""
    edge, extreme = F.col("at_value_edge"), F.col("at_structural_extreme")
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    return F.when(~F.col("levels_ready"), lit("not_ready")).when(edge & extreme, lit("value_edge", "structural_extreme")).when(edge, lit("value_edge")).when(extreme, lit("structural_extreme")).otherwise(lit("neither"))


def level_within() -> Column:
    """Whether the level was reached within the horizon; unknown where its passage was censored before the horizon's end."""
    p, end = F.col("level_passage"), F.col("end_ms")
    out = F.when(p.isNull(), F.lit(None)).when(p == "at_decision", "at_decision")
    out = out.when((p == "touched") & (F.col("level_at") < end), "touched").when(p.isin("touched", "not_within"), "not_within")
    return out.when(F.col("level_censor_at") >= end, "not_within").otherwise("unknown")


def extreme_vs_opposite() -> Column:
    """Which came first, the evidence extreme or the barrier on the other side."""
    p, at, cut, race = F.col("extreme_passage"), F.col("extreme_at"), F.col("extreme_censor_at"), F.col("race")
    won, touched, censored = F.col("race_at"), p == "touched", p == "censored"
    own_side = (race == "upper") == (F.col("extreme_price") > F.col("reference"))
    quiet = F.when(touched & (at < F.col("end_ms")), "extreme_first").when(censored & (cut < F.col("end_ms")), "unknown").otherwise("neither")
    stopped = F.when(touched & (at < F.col("censor_at")), "extreme_first").otherwise("unknown")
    own = F.when(touched & ((at < won) | ((at == won) & ~F.col("same_ms"))), "extreme_first").otherwise("undetermined")
    other = F.when(touched & (at < won), "extreme_first").when(touched & (at == won), "undetermined").when(censored & (cut <= won), "unknown").otherwise("opposite_first")
    out = F.when(p.isNull() | (race == "unavailable"), F.lit(None)).when(p == "at_decision", "extreme_first")
    return out.when(race == "neither", quiet).when(race == "censored", stopped).when(own_side, own).otherwise(other)


def labeled(contexts: DataFrame, outcomes: DataFrame, passages: DataFrame, key: list[str]) -> DataFrame:
    """Contexts with their outcomes, and the passages of the level and of the extreme where there are some."""
    j = contexts.join(outcomes, key)
    for t in ("level", "extreme"):
        names = {"price": f"{t}_price", "passage": f"{t}_passage", "passage_at": f"{t}_at", "passage_censor_at": f"{t}_censor_at"}
        j = j.join(passages.where(F.col("target") == t).select(*key, *[F.col(c).alias(n) for c, n in names.items()]), key, "left")
    fair = (F.col("race") != "unavailable") & F.col("censor_reason").isNull()
    offset = (F.col("upper") - F.col("reference")).cast("double")
    return j.select(
        *j.columns,
        F.coalesce("trigger", F.lit("baseline")).alias("group_trigger"), F.coalesce("trigger_family", F.lit("baseline")).alias("group_family"),
        F.coalesce("regime", F.lit("not_ready")).alias("group_regime"), location_bins().alias("location_bins"),
        F.when(fair & (offset != 0), F.col("up").cast("double") / offset).alias("up_x"), F.when(fair & (offset != 0), F.col("down").cast("double") / offset).alias("down_x"),
        F.when(F.col("race").isin("upper", "lower"), F.col("race_at") - F.col("decision_ms")).alias("time_to_event_ms"),
        level_within().alias("level_within"), extreme_vs_opposite().alias("extreme_vs_opposite"),
    )


def five_numbers(c: str, out: str) -> list[Column]:
    """Nearest-rank summary of the values that aren't null, and their count."""
    rank = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})").alias(f"{out}_p{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    return [F.count(c).alias(f"{out}_n"), F.min(c).alias(f"{out}_min"), *rank, F.max(c).alias(f"{out}_max")]


def summary(rows: DataFrame, n_min: int) -> DataFrame:
    """Eight splits by trigger, regime and location (four grouping sets over plain and exploded rows), and families."""
    every = rows.withColumn("location", F.lit("all")).unionByName(rows.withColumn("location", F.explode("location_bins")))
    dims = [F.col(c) for c in ("horizon", "horizon_ms", "group_trigger", "group_family", "group_regime", "location")]
    h, ms, t, f, r, loc = dims
    races = [F.count_if(F.col("race") == x).alias(f"n_{x}") for x in (*RAN, "censored", "unavailable")]
    within = [F.count_if(F.col("level_within") == x).alias(f"level_{x}") for x in ("at_decision", "touched", "not_within", "unknown")]
    versus = [F.count_if(F.col("extreme_vs_opposite") == x).alias(f"versus_{x}") for x in ("extreme_first", "opposite_first", "neither", "undetermined", "unknown")]
    g = every.groupingSets([[h, ms, t, f, r, loc], [h, ms, t, f, loc], [h, ms, r, loc], [h, ms, loc]], *dims).agg(
        F.grouping("group_trigger").alias("gt"), F.grouping("group_regime").alias("gr"), F.count("*").alias("samples"),
        F.count_distinct(F.struct("instrument", "decision_ms", "event_seq")).alias("events"), F.count_if("clear").alias("clear"), *races,
        F.count_if("same_ms").alias("n_same_ms"), *five_numbers("time_to_event_ms", "tte"), *five_numbers("up_x", "up_x"), *five_numbers("down_x", "down_x"), *within, *versus,
    )
    ran = F.nullif(F.col("n_upper") + F.col("n_lower") + F.col("n_neither"), F.lit(0))
    split = F.concat_ws(",", F.when(F.col("gt") == 0, "trigger"), F.when(F.col("gr") == 0, "regime"), F.when(F.col("location") != "all", "location"))
    named = {"trigger": ("gt", "group_trigger"), "family": ("gt", "group_family"), "regime": ("gr", "group_regime")}
    out = g.select(
        "horizon", "horizon_ms", F.when(split == "", "all").otherwise(split).alias("split"),
        *[F.when(F.col(k) == 0, F.col(c)).otherwise("all").alias(n) for n, (k, c) in named.items()], "location",
        *[c for c in g.columns if c not in {"horizon", "horizon_ms", "gt", "gr", "group_trigger", "group_family", "group_regime", "location"}],
        (F.col("clear") >= n_min).alias("meets_min_sample"), *[(F.col(f"n_{x}") / ran).alias(f"share_{x}") for x in RAN],
    )
    fam = rows.where("trigger IS NOT NULL").groupBy("horizon", "horizon_ms", F.col("group_family").alias("family")).agg(
        F.count("*").alias("samples"), F.count_distinct(F.struct("instrument", "decision_ms", "event_seq")).alias("events")
    )
    fam = fam.withColumns({"split": F.lit("family"), "trigger": F.lit("all"), "regime": F.lit("all"), "location": F.lit("all")})
    return out.unionByName(fam, allowMissingColumns=True)
