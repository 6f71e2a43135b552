"""Leakage-safe feature matrix, gradient-boosted price model, residuals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabmill.functions import cards, dates
from slabmill.operators.asof import asof_join, asof_slice, latest_by
from slabmill.operators.ordering import exact_quantiles, unit_bucket
from slabmill.plans import catalyst
from slabmill.session import stage

NUMERIC = [
    "log_pop_psa10", "log_pop_psa9_or_better", "parallel_tier", "print_run_log", "slab_grade",
    "player_age_at_sale", "years_since_draft", "draft_pick", "cs_momentum_pct", "log_sales_count_90d",
    "bid_ask_proxy", "stardom_premium", "stardom_premium_x_is_rookie", "catalyst_score", "catalyst_score_30d_change",
]
FLAGS = ["is_rookie", "has_auto", "has_patch", "is_one_of_one", "era_modern", "is_hyped", "has_stardom_score"]
CATEGORIES = ["set_tier", "team_market", "slab_grader", "liquidity_tier"]
# Expected direction of effect per feature
EXPECTED_SIGN = {
    "log_pop_psa10": -1, "log_pop_psa9_or_better": -1, "parallel_tier": 1, "print_run_log": -1,
    "cs_momentum_pct": 1, "stardom_premium": 1, "stardom_premium_x_is_rookie": 1, "is_hyped": 1,
}
MODEL_VERSION = "hedonic_v3"


def graded_scope(tx: DataFrame) -> DataFrame:
    """Sales of the two modelled grades, with log price."""
    scoped = tx.where((F.col("slab_grader") == "PSA") & F.col("slab_grade").isin(9.0, 10.0))
    return scoped.withColumn("log_price", F.log("price_usd"))


def star(tx: DataFrame, card: DataFrame, player: DataFrame) -> DataFrame:
    """Sales with card and player attributes; join strategy is left to size statistics."""
    return tx.join(card, "card_id").join(player.select("player_id", "dob", "draft_year", "draft_pick", "team"), "player_id")


PANEL_COLUMNS = ("cs_momentum_pct", "is_hyped", "sales_count_90d", "bid_ask_proxy", "liquidity_tier")


def populations(pop: DataFrame) -> list[tuple[DataFrame, str, dict[str, str]]]:
    """The two graded populations as right-hand sides of an as-of join by card."""
    graded = pop.where(F.col("grader") == "PSA")
    return [
        (graded.where(F.col("grade") == 10), "snapshot_date", {"pop_psa10": "pop_count"}),
        (graded.where(F.col("grade") == 9), "snapshot_date", {"pop_psa9": "pop_count"}),
    ]


def factor_rows(panel: DataFrame) -> list[tuple[DataFrame, str, dict[str, str]]]:
    """The factor panel as a right-hand side of an as-of join by card."""
    return [(panel.withColumn("_at", F.col("as_of_date").cast("timestamp")), "_at", {c: c for c in PANEL_COLUMNS})]


def with_card_history(sales: DataFrame, histories: list[tuple[DataFrame, str, dict[str, str]]]) -> DataFrame:
    """What was known of the card at each sale, of all ``histories`` in one pass."""
    return asof_join(sales, histories, ["card_id"], "sold_at", ["tx_id"])


def with_player_score(sales: DataFrame, scores: DataFrame) -> DataFrame:
    """Latest player score known at each sale."""
    return asof_join(sales, [(scores, "fit_at", {"stardom_premium": "premium"})], ["player_id"], "sold_at", ["tx_id"])


def modern_rookie_fill(sales: DataFrame) -> Column:
    """Median premium of modern rookies as a scalar subquery (NULL when there is none)."""
    cohort = sales.where((F.col("is_rookie") == 1) & (F.col("era_modern") == 1) & F.col("stardom_premium").isNotNull())
    return exact_quantiles(cohort, [], "stardom_premium", {"fill": 0.5}).scalar()


def with_catalyst(sales: DataFrame, events: DataFrame, payload_weight=catalyst.injury_weight) -> DataFrame:
    """Event score at the sale day and its 30-day change, one computation per player-day."""
    month = F.expr("interval 30 days")
    days = sales.select("player_id", F.date_trunc("day", "sold_at").alias("day")).distinct()
    grid = days.union(days.select("player_id", (F.col("day") - month).alias("day"))).distinct()
    scores = catalyst.catalyst_on_days(events, grid, payload_weight=payload_weight)
    earlier = scores.select("player_id", (F.col("day") + month).alias("day"), F.col("catalyst_score").alias("before"))
    both = days.join(scores, ["player_id", "day"], "left").join(earlier, ["player_id", "day"], "left").select(
        "player_id",
        "day",
        F.coalesce("catalyst_score", F.lit(0.0)).alias("catalyst_score"),
        (F.coalesce("catalyst_score", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))).alias("catalyst_score_30d_change"),
    )
    keyed = sales.withColumn("day", F.date_trunc("day", "sold_at"))
    return keyed.join(both, ["player_id", "day"], "left").drop("day")


def hedonic_features(
    tx: DataFrame,
    card: DataFrame,
    player: DataFrame,
    pop: DataFrame,
    panel: DataFrame,
    scores: DataFrame,
    events: DataFrame,
    payload_weight=catalyst.injury_weight,
) -> DataFrame:
    """One row per scoped sale; every looked-up value was known at the sale."""
    base = star(graded_scope(tx), card, player)
    base = with_card_history(base, populations(pop) + factor_rows(panel))
    base = with_player_score(base, scores)
    both_pops = (F.col("pop_psa10") + F.col("pop_psa9")).cast("double")
    sold = F.col("sold_at")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).cast("int")
    wide = base.select(
        "tx_id", "sold_at", "player_id", "log_price",
        F.log1p(F.col("pop_psa10").cast("double")).alias("log_pop_psa10"),
        F.log1p(both_pops).alias("log_pop_psa9_or_better"),
        cards.parallel_tier(F.col("is_one_of_one"), F.col("print_run"), F.col("parallel")).alias("parallel_tier"),
        F.log1p(F.coalesce(F.col("print_run").cast("double"), both_pops)).alias("print_run_log"),
        "slab_grade",
        dates.age_years(sold, F.col("dob")).alias("player_age_at_sale"),
        dates.years_since(sold, F.col("draft_year")).alias("years_since_draft"),
        F.col("draft_pick").cast("double").alias("draft_pick"),
        "stardom_premium",
        F.coalesce("cs_momentum_pct", F.lit(0.5)).alias("cs_momentum_pct"),
        F.log1p(F.coalesce(F.col("sales_count_90d").cast("double"), F.lit(0.0))).alias("log_sales_count_90d"),
        F.coalesce("bid_ask_proxy", F.lit(0.0)).alias("bid_ask_proxy"),
        flag("is_rookie").alias("is_rookie"), flag("has_auto").alias("has_auto"), flag("has_patch").alias("has_patch"),
        flag("is_one_of_one").alias("is_one_of_one"),
        cards.era_modern(F.col("card_year")).alias("era_modern"),
        flag("is_hyped").alias("is_hyped"),
        F.col("stardom_premium").isNotNull().cast("int").alias("has_stardom_score"),
        cards.set_tier(F.col("set_name")).alias("set_tier"),
        cards.team_market(F.col("team")).alias("team_market"),
        "slab_grader",
        F.coalesce("liquidity_tier", F.lit("D")).alias("liquidity_tier"),
    )
    wide = stage(wide, "hedonic_base")
    fill = F.coalesce(modern_rookie_fill(wide), F.lit(0.0))
    filled = wide.withColumn("stardom_premium", F.coalesce(F.col("stardom_premium"), fill))
    filled = filled.withColumn("stardom_premium_x_is_rookie", F.col("stardom_premium") * F.col("is_rookie"))
    out = with_catalyst(filled, events, payload_weight)
    return out.select("tx_id", "sold_at", "player_id", "log_price", *NUMERIC, *FLAGS, *CATEGORIES)


def regression_metrics(predicted: DataFrame, actual: str = "log_price", guess: str = "prediction") -> DataFrame:
    """MAE and R^2 in one pass over running sums."""
    error = F.col(actual) - F.col(guess)
    mean_sq = F.var_pop(actual) * F.count(actual)
    return predicted.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), (1 - F.sum(error * error) / mean_sq).alias("r2")
    )


@dataclass(frozen=True)
class HedonicFit:
    model: PipelineModel
    cutoff: str
    mae: float
    r2: float
    params: tuple[int, int]


def _model_input(features: DataFrame) -> DataFrame:
    # Trees split a missing value off best as one value below every observed one.
    fills = {c: -1.0 for c in ("log_pop_psa10", "log_pop_psa9_or_better", "print_run_log", "draft_pick", "player_age_at_sale")}
    return features.fillna(fills).fillna(0.0, ["years_since_draft"])


def _pipeline(depth: int, rounds: int) -> Pipeline:
    index = StringIndexer(inputCols=CATEGORIES, outputCols=[f"{c}_ix" for c in CATEGORIES], handleInvalid="keep")
    onehot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"{c}_oh" for c in CATEGORIES], handleInvalid="keep")
    vector = VectorAssembler(inputCols=[*NUMERIC, *FLAGS, *onehot.getOutputCols()], outputCol="features")
    boost = GBTRegressor(labelCol="log_price", featuresCol="features", maxDepth=depth, maxIter=rounds, stepSize=0.2, seed=42)
    return Pipeline(stages=[index, onehot, vector, boost])


def time_cutoff(features: DataFrame, share: float = 0.8) -> DataFrame:
    """Exact time quantile that splits training from holdout (one row)."""
    dated = features.select((F.unix_micros("sold_at") / 86400e6).alias("day"))
    q = exact_quantiles(dated, [], "day", {"day": share}, bucket=unit_bucket(7.0))
    return q.select(F.timestamp_micros((F.col("day") * 86400e6).cast("long")).alias("cutoff"))


def hedonic_fit(features: DataFrame, grid: tuple[tuple[int, int], ...] = ((4, 20), (6, 30))) -> HedonicFit:
    """Pick depth and rounds by holdout error on a time split, then refit on everything."""
    data = stage(_model_input(features), "hedonic_input")
    cutoff = time_cutoff(data).first()["cutoff"]
    train, test = data.where(F.col("sold_at") < F.lit(cutoff)), data.where(F.col("sold_at") >= F.lit(cutoff))
    best = None
    for depth, rounds in grid:
        model = _pipeline(depth, rounds).fit(train)
        score = regression_metrics(model.transform(test)).first()
        if best is None or score["mae"] < best[0]:
            best = (score["mae"], score["r2"], (depth, rounds))
    model = _pipeline(*best[2]).fit(data)
    return HedonicFit(model, str(cutoff), best[0], best[1], best[2])


def hedonic_predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    return model.transform(_model_input(features)).withColumnRenamed("prediction", "predicted_log_price")


def mispricing_residuals(predicted: DataFrame, model_version: str = MODEL_VERSION) -> DataFrame:
    """Predicted minus actual log price: positive means undervalued."""
    return predicted.select(
        "tx_id",
        F.lit(model_version).alias("model_version"),
        F.round(F.col("predicted_log_price") - F.col("log_price"), 6).alias("residual"),
        F.round("predicted_log_price", 6).alias("predicted_log_price"),
    )


def assert_no_lookahead(df: DataFrame, ts: str, as_of: Column) -> DataFrame:
    """Rows pass through; a row at or past ``as_of`` fails the job."""
    ok = F.when(F.col(ts) < as_of, F.col(ts)).otherwise(F.raise_error(F.lit(f"look-ahead in {ts}")).cast("timestamp"))
    return df.withColumn(ts, F.when(F.col(ts).isNotNull(), ok))


def mispricing_by_card(residuals: DataFrame, tx: DataFrame, card: DataFrame, as_of: Column) -> DataFrame:
    """Newest residual per card strictly before ``as_of``, with the scarcity tier."""
    known = asof_slice(tx.select("tx_id", "card_id", "sold_at"), "sold_at", as_of)
    joined = residuals.select("tx_id", "residual").join(known, "tx_id")
    latest = latest_by(joined, ["card_id"], ["sold_at", "tx_id", "residual"])
    tier = cards.parallel_tier(F.col("is_one_of_one"), F.col("print_run"), F.col("parallel"))
    out = latest.join(card, "card_id").select(
        "card_id",
        F.col("residual").alias("mispricing_residual"),
        F.col("sold_at").alias("computed_at"),
        F.lit("NBA").alias("sport"),
        tier.alias("parallel_tier"),
    )
    return assert_no_lookahead(out, "computed_at", as_of)


def monotone_check(predicted: DataFrame) -> DataFrame:
    """Correlation of the prediction with each sign-constrained feature beside its expected sign."""
    row = predicted.agg(*[F.corr(c, "predicted_log_price").alias(c) for c in EXPECTED_SIGN])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(s).alias("expected_sign"), F.col(c).alias("corr")) for c, s in EXPECTED_SIGN.items()])
    return row.select(F.explode(pairs).alias("r")).select("r.*")
