"""Unified cohorts, feature matrix, pairwise ranker, premiums and forward scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabmill import config
from slabmill.functions import names
from slabmill.functions import scouting as sc
from slabmill.functions.dates import season_end_year
from slabmill.operators.asof import first_by
from slabmill.operators.concordance import concordance_share
from slabmill.operators.ordering import exact_quantiles, spread_row_number, tie_percent_rank
from slabmill.session import stage
from slabmill.sources.cohorts import normalize_frame

# --- Fixed values: column lists ---------------------------------------------------
_D, _S, _I = T.DoubleType(), T.StringType(), T.IntegerType()
UNIFIED = T.StructType(
    [
        T.StructField("br_slug", _S), T.StructField("name", _S), T.StructField("draft_year", _I), T.StructField("draft_pick", _D),
        T.StructField("position", _S), T.StructField("age_at_draft", _D), T.StructField("trb_pct", _D), T.StructField("ast_pct", _D),
        T.StructField("stl_pct", _D), T.StructField("blk_pct", _D), T.StructField("usg_pct", _D), T.StructField("ts_pct", _D),
        T.StructField("sos", _D), T.StructField("recruit_rank_pct", _D), T.StructField("wingspan_in", _D), T.StructField("max_vert_in", _D),
        T.StructField("prospect_origin", _S), T.StructField("years_in_prior_league", _I), T.StructField("prior_league_mle_score", _D),
        T.StructField("prior_league_strength_rank", _I),
    ]
)
NUMERIC = [
    "trb_pct", "ast_pct", "stl_pct", "blk_pct", "usg_pct", "ts_pct", "sos", "recruit_rank_pct", "age_at_draft", "draft_pick",
    "log_draft_pick", "mock_rank", "wingspan_in", "max_vert_in", "years_in_prior_league", "prior_league_mle_score",
    "prior_league_strength_rank",
]
ORIGINS = ["NCAA", "GLEAGUE", "EUROLEAGUE", "LIGA_ACB", "LNB", "LBA", "NBL", "OTHER_INTL"]
COMBINE = ["wingspan_minus_height", "bmi", "standing_reach", "max_vertical", "lane_agility_time", "three_quarter_sprint"]
FEATURES = [*NUMERIC, *[f"pos_{p}" for p in config.POSITIONS], *[f"origin_{o}" for o in ORIGINS]]
COMBINE_FEATURES = [*COMBINE, *[f"combine_{c}_imputed" for c in COMBINE], "has_combine_data"]


def season_filter(cohort: DataFrame, years: Sequence[int]) -> DataFrame:
    """Draft year from the season label, wanted years kept."""
    return cohort.withColumn("draft_year", season_end_year(F.col("season"))).where(F.col("draft_year").isin(*years))


def unified_cohort(ncaa: DataFrame, gleague: DataFrame, euro: DataFrame, years: Sequence[int]) -> DataFrame:
    """College, development-league and overseas prospects as one frame, one row per (slug, class)."""
    college = ncaa.where(F.col("draft_year").isin(*years)).withColumn("prospect_origin", F.lit("NCAA"))
    minor = season_filter(gleague, years).withColumn("prospect_origin", F.lit("GLEAGUE"))
    abroad = season_filter(euro, years).withColumn("prospect_origin", sc.league_origin(F.col("league")))
    parts = []
    for frame in (college, minor, abroad):
        season = F.col("season") if "season" in frame.columns else F.lit(None).cast("string")
        aged = frame.withColumn("age_at_draft", F.col("age").try_cast("double")) if "age" in frame.columns else frame
        parts.append(normalize_frame(aged.withColumn("_season", season), T.StructType([*UNIFIED.fields, T.StructField("_season", _S)])))
    return finish_cohort(collapse_origins(parts[0].unionByName(parts[1]).unionByName(parts[2])))


def collapse_origins(cohort: DataFrame) -> DataFrame:
    """Best-priority row per (slug, class) and how many rows there were; one aggregation."""
    key = ["br_slug", "draft_year"]
    rest = [c for c in cohort.columns if c not in key]
    order = F.struct(sc.origin_priority(F.col("prospect_origin")), F.col("_season"), F.col("name"))
    picked = cohort.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r"), F.count("prospect_origin").cast("int").alias("_n"))
    return picked.select(*key, "_r.*", "_n").withColumn("years_in_prior_league", F.col("_n")).drop("_n", "_season")


def scale_to_college(cohort: DataFrame) -> DataFrame:
    """Multiply rate columns by the league's equivalency; efficiency stays as it is."""
    origin = F.coalesce("prospect_origin", F.lit("NCAA"))
    out = cohort.withColumn("prior_league_mle_score", sc.league_multiplier(origin)).withColumn(
        "prior_league_strength_rank", sc.league_strength(origin)
    )
    return out.withColumns({c: F.col(c) * F.col("prior_league_mle_score") for c in config.SCALED_STATS if c in cohort.columns})


def finish_cohort(cohort: DataFrame) -> DataFrame:
    defaults = {"prospect_origin": "NCAA", "years_in_prior_league": 1, "prior_league_mle_score": 1.0, "prior_league_strength_rank": 3}
    return normalize_frame(scale_to_college(cohort), UNIFIED, defaults)


def cohort_coverage(cohort: DataFrame, needed: int = 5) -> DataFrame:
    out = cohort.groupBy("prospect_origin").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("draft_year").alias("n_classes"))
    return out.withColumn("too_few", F.col("n_classes") < needed)


def combine_features(prospects: DataFrame, combine: DataFrame) -> DataFrame:
    """Measurements joined by slug, gaps filled with the observed median and flagged."""
    one = first_by(combine, ["br_slug"], [c for c in combine.columns if c != "br_slug"])
    height = F.coalesce("height_no_shoes", "height_with_shoes")
    derived = one.select(
        "br_slug",
        (F.col("wingspan") - height).alias("wingspan_minus_height"),
        sc.bmi(F.col("weight"), height).alias("bmi"),
        *[F.col(c).cast("double").alias(c) for c in COMBINE[2:]],
    )
    merged = prospects.join(derived, "br_slug", "left")
    fill = median_fill(merged, COMBINE)
    present = F.coalesce(*[F.col(c) for c in COMBINE]).isNotNull()
    return merged.select(
        *prospects.columns,
        *[F.coalesce(F.col(c), F.try_element_at(fill, F.lit(c)), F.lit(0.0)).alias(c) for c in COMBINE],
        *[F.col(c).isNull().cast("int").alias(f"combine_{c}_imputed") for c in COMBINE],
        present.cast("int").alias("has_combine_data"),
    )


def median_fill(df: DataFrame, columns: Sequence[str]) -> Column:
    """Map of column to observed median as a scalar subquery, all columns in one pass."""
    return F.coalesce(column_medians(df, columns).agg(F.map_from_entries(F.collect_list(F.struct("feature", "med"))).alias("m")).scalar(),
                      F.create_map().cast("map<string,double>"))


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.explode(entries).alias("e")).select("e.*").where(F.col("x").isNotNull())
    return exact_quantiles(long, ["feature"], "x", {"med": 0.5})


def prospect_matrix(prospects: DataFrame, outcomes: DataFrame, combine: DataFrame | None = None) -> DataFrame:
    """Slug, class, target and every numeric feature; prospects without outcome count as 0."""
    first = first_by(outcomes.select("br_slug", "career_bpm_5y"), ["br_slug"], ["career_bpm_5y"])
    merged = prospects.drop("career_bpm_5y").join(first, "br_slug", "left")
    pick = F.coalesce(F.col("draft_pick").cast("double"), F.lit(config.UNDRAFTED_PICK))
    defaults = {"prior_league_mle_score": 1.0, "prior_league_strength_rank": 3, "years_in_prior_league": 1}
    have = set(merged.columns)

    def numeric(c: str) -> Column:
        if c in ("draft_pick", "mock_rank"):
            return pick
        if c == "log_draft_pick":
            return F.log1p(pick)
        if c not in have:
            return F.lit(float(defaults.get(c, 0.0)))
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    pos = sc.position(F.col("position")) if "position" in have else F.lit("")
    origin = F.upper(F.coalesce("prospect_origin", F.lit("NCAA"))) if "prospect_origin" in have else F.lit("NCAA")
    matrix = merged.select(
        "br_slug",
        F.col("draft_year").cast("int").alias("draft_year"),
        F.greatest(F.coalesce(F.col("career_bpm_5y").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("target"),
        *[numeric(c).alias(c) for c in NUMERIC],
        *sc.one_hot(pos, config.POSITIONS, "pos"),
        *sc.one_hot(origin, ORIGINS, "origin"),
    )
    return matrix if combine is None else combine_features(matrix, combine)


# --- pairwise ranker -----------------------------------------------------------------
def pairwise_training_rows(matrix: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows whose weighted least squares equals least squares over all pairs of each class.

    For pairs (i, j) of a class with n rows, fitting sign(y_i - y_j) to w(x_i - x_j)
    needs only sums over rows: features centred on the class mean, weight n, and as
    label the share of the class below minus the share above. No pair is formed.
    """
    ranked = tie_percent_rank(matrix, "target", "_pct", ["draft_year"])
    means = matrix.groupBy("draft_year").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in features])
    joined = ranked.join(means, "draft_year")
    label = 2 * F.col("_pct") - (F.col("_n") + 1) / F.col("_n")
    return joined.select(
        "draft_year", label.alias("label"), F.col("_n").cast("double").alias("weight"),
        *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in features],
    )


def in_years(df: DataFrame, years: tuple[int, int]) -> DataFrame:
    return df.where(F.col("draft_year").between(*years))


def pairwise_rank_fit(matrix: DataFrame, features: Sequence[str] = FEATURES, train: tuple[int, int] = config.TRAIN_YEARS) -> dict[str, float]:
    """Linear scoring weights; falls back to all classes when none lies in the training years."""
    subset = in_years(matrix, train)
    if subset.isEmpty():
        subset = matrix
    rows = stage(pairwise_training_rows(subset, features), "pairwise_rows")
    vector = VectorAssembler(inputCols=list(features), outputCol="x")
    # Small fixed penalty: some one-hot columns are constant within every class.
    fit = LinearRegression(featuresCol="x", labelCol="label", weightCol="weight", fitIntercept=False, regParam=1e-3).fit(vector.transform(rows))
    return dict(zip(features, fit.coefficients.toArray().tolist(), strict=True))


def rank_score(weights: dict[str, float]) -> Column:
    return sum((F.col(c) * F.lit(w) for c, w in weights.items() if w), F.lit(0.0))


def holdout_concordance(matrix: DataFrame, weights: dict[str, float], years: tuple[int, int] = config.HOLDOUT_YEARS) -> DataFrame:
    scored = in_years(matrix, years).withColumn("score", rank_score(weights))
    return concordance_share(scored, "target", "score", ["draft_year"])


def stardom_premium(scored: DataFrame) -> DataFrame:
    """Model percentile minus the percentile implied by the draft slot, within class."""
    top_pick = scored.agg(F.coalesce(F.max(F.col("draft_pick").cast("double")), F.lit(60.0)).alias("p")).scalar()
    filled = scored.select(
        "br_slug", "draft_year", F.coalesce(F.col("draft_pick").cast("double"), top_pick).alias("draft_pick"), "model_score"
    )
    a = tie_percent_rank(filled, "model_score", "percentile_rank", ["draft_year"])
    b = tie_percent_rank(a, "draft_pick", "_pick_pct", ["draft_year"])
    return b.select(
        "br_slug", "draft_year", (F.col("percentile_rank") - (1 - F.col("_pick_pct"))).alias("premium"), "percentile_rank"
    )


def scores_to_store(scores: DataFrame, player: DataFrame, model_version: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows for the score table, one row of skip counts)."""
    mapped = scores.join(player.where(F.col("br_slug").isNotNull()).select("br_slug", "player_id"), "br_slug", "left")
    good = mapped.where(F.col("player_id").isNotNull() & F.col("draft_year").isNotNull()).select(
        "player_id", F.col("draft_year").cast("int").alias("draft_year"), F.lit(model_version).alias("model_version"),
        F.round("premium", 4).alias("premium"), F.round("percentile_rank", 4).alias("percentile_rank"), now.alias("fit_at"),
    )
    counts = mapped.agg(
        F.count_if(F.col("player_id").isNotNull() & F.col("draft_year").isNotNull()).alias("stored"),
        F.count_if(F.col("player_id").isNull()).alias("unmapped"),
        F.count_if(F.col("player_id").isNotNull() & F.col("draft_year").isNull()).alias("bad_year"),
    )
    return good, counts


def consensus_rank(mocks: DataFrame, min_sources: int = config.MIN_MOCK_SOURCES) -> DataFrame:
    """Median rank, votes and spread per player; a player has one row per source."""
    slug = F.nullif("br_slug", F.lit(""))
    key = F.coalesce(slug, names.name_key(F.col("player_name")))
    votes = mocks.select(key.alias("_k"), slug.alias("slug"), "player_name", "source", F.col("mock_rank").cast("double").alias("r"))
    out = votes.groupBy("_k").agg(
        F.coalesce(F.min_by("slug", F.when(F.col("slug").isNotNull(), F.col("source"))), F.lit("")).alias("br_slug"),
        F.min_by("player_name", "source").alias("player_name"),
        F.median("r").alias("consensus_rank"),
        F.count(F.lit(1)).alias("sources_count"),
        F.when(F.count("r") >= 2, F.percentile("r", 0.75) - F.percentile("r", 0.25)).otherwise(0.0).alias("rank_dispersion"),
    )
    return out.where(F.col("sources_count") >= min_sources).drop("_k")


def forward_scores(current: DataFrame, weights: dict[str, float], consensus: DataFrame, draft_year: int, as_of: Column) -> DataFrame:
    """Score an undrafted class and compare it with the mock-draft consensus.

    Every pick is the undrafted sentinel; without a consensus there is no premium.
    """
    cohort = current.where(F.col("draft_year") == draft_year).withColumn("draft_pick", F.lit(config.UNDRAFTED_PICK))
    nothing = cohort.select("br_slug", F.lit(None).cast("double").alias("career_bpm_5y")).limit(0)
    matrix = prospect_matrix(cohort, nothing).select("br_slug", rank_score(weights).alias("pairwise_score"))
    scored = cohort.select("br_slug", "name", "class_year", "n_games_played", "prior_league").join(matrix, "br_slug").join(
        consensus.select("br_slug", "consensus_rank", "sources_count"), "br_slug", "left"
    )
    ranked = tie_percent_rank(tie_percent_rank(scored, "pairwise_score", "pairwise_pct"), "consensus_rank", "consensus_pct")
    return ranked.select(
        "br_slug", "name", F.lit(draft_year).alias("draft_year"), as_of.cast("date").alias("as_of_date"), "pairwise_score",
        "consensus_rank", "sources_count",
        F.col("class_year").isin(*config.UNDERCLASS).alias("is_underclassman"),
        sc.years_until_draft(F.col("class_year")).alias("years_until_draft"),
        F.coalesce("prior_league", F.lit("NCAA")).alias("prior_league"), "n_games_played",
        "pairwise_pct", "consensus_pct", (F.col("pairwise_pct") - (1 - F.col("consensus_pct"))).alias("premium"),
    )


def career_outcomes(rows: DataFrame, seasons: int = 5) -> DataFrame:
    """Sums over each slug's first season rows: (br_slug, row_no, row_class, bpm, ws, vorp).

    Team-split and header rows are dropped.
    """
    whole = rows.where(~F.coalesce(F.col("row_class"), F.lit("")).rlike(r"\b(partial_table|thead|over_header)\b"))
    first = spread_row_number(whole, "_i", "row_no", "row_no", ["br_slug"]).where(F.col("_i") <= seasons)
    sums = {c: F.sum(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))) for c in ("bpm", "ws", "vorp")}
    return first.groupBy("br_slug").agg(*[s.alias(f"career_{c}_5y") for c, s in sums.items()])


def outcome_rows(pages: DataFrame) -> DataFrame:
    """Season rows of exploded player pages keyed by slug (``page_id``)."""
    stat = lambda k: F.try_element_at("stats", F.lit(k)).alias(k)
    body = pages.where((F.col("table_id") == "advanced") & (F.size("stats") > 0) & F.try_element_at("stats", F.lit("bpm")).isNotNull())
    return body.select(F.col("page_id").alias("br_slug"), "row_no", "row_class", stat("bpm"), stat("ws"), stat("vorp"))
