"""Market tables seen through a star schema of orders, parts and events.

Every frame here is a lazy projection or small join over one parquet scan, so
filters and column pruning of the operators reach the files.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slabmill.session import tune


class Bridge:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        tune(spark)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def dealt(self, name: str) -> DataFrame:
        """A table for CPU-heavy text work.

        A file in fewer pieces than there are cores is dealt out first; a table of
        many splits already fills the cores, and then nothing moves.
        """
        df, cores = self.raw(name), self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def player_master(self) -> DataFrame:
        key = F.col("s_suppkey")
        return (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                key.cast("int").alias("player_id"),
                F.col("s_name").alias("name"),
                F.col("n_name").alias("team"),
                (1975 + key % 25).cast("int").alias("draft_year"),
                (1 + key % 60).cast("int").alias("draft_pick"),
                F.make_date((1955 + key % 25).cast("int"), (1 + key % 12).cast("int"), (1 + key % 28).cast("int")).alias("dob"),
            )
        )

    @cached_property
    def card_master(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        return self.raw("part").select(
            key.alias("card_id"),
            (1995 + key % 30).cast("int").alias("card_year"),
            F.col("p_brand").alias("manufacturer"),
            F.col("p_type").alias("set_name"),
            key.cast("string").alias("card_number"),
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("parallel"),
            F.when(size <= 25, size).alias("print_run"),
            (key % 10).cast("int").alias("player_id"),
            (size <= 10).alias("is_rookie"),
            (F.col("p_type") == "PROMO").alias("has_auto"),
            (size % 7 == 0).alias("has_patch"),
            (size == 1).alias("is_one_of_one"),
        )

    @staticmethod
    def sales_from_lines(lines: DataFrame, *more: str) -> DataFrame:
        price = F.col("l_extendedprice") / F.col("l_quantity")
        return lines.select(
            F.concat_ws(
                "-",
                F.col("l_orderkey"),
                F.col("l_linenumber"),
                F.col("l_partkey"),
                F.col("l_suppkey"),
                F.round(F.col("l_extendedprice") * 100).cast("bigint"),
            ).alias("tx_id"),
            F.col("l_partkey").alias("card_id"),
            F.col("l_shipdate").cast("timestamp").alias("sold_at"),
            price.alias("price_usd"),
            F.when(F.col("l_returnflag") == "A", "PSA").when(F.col("l_returnflag") == "R", "BGS").alias("slab_grader"),
            F.when(F.col("l_returnflag") != "N", (6 + F.col("l_linenumber") % 5).cast("double")).alias("slab_grade"),
            F.concat_ws("-", F.col("l_partkey"), F.col("l_suppkey")).alias("cert_number"),
            (F.col("l_extendedprice") * F.col("l_tax") / F.col("l_quantity")).alias("fee_estimate"),
            *more,
        )

    @cached_property
    def tx_clean(self) -> DataFrame:
        return self.sales_from_lines(self.raw("lineitem"))

    @cached_property
    def tx_raw(self) -> DataFrame:
        # Lines meet their cards as they are stored: the texts made of them are several times as long.
        c = self.card_master.select(F.col("card_id").alias("_card"), "card_year", "manufacturer", "parallel", "card_number")
        lines = self.dealt("lineitem").join(c, F.col("l_partkey") == F.col("_card"))
        t = self.sales_from_lines(lines, "card_year", "manufacturer", "parallel", "card_number")
        slab = F.when(
            F.col("slab_grader").isNotNull(),
            F.concat(F.col("slab_grader"), F.lit(" "), F.col("slab_grade").cast("int").cast("string")),
        )
        return t.select(
            F.col("tx_id").alias("raw_id"),
            F.when(F.col("slab_grader").isNull(), "ebay_active").otherwise("ebay").alias("source"),
            F.concat_ws(
                " ",
                F.col("card_year").cast("string"),
                F.lit("Panini"),
                F.lit("Prizm"),
                F.col("parallel"),
                F.concat(F.lit("#"), F.col("card_number")),
                slab,
            ).alias("raw_title"),
            F.col("price_usd").alias("raw_price"),
            "sold_at",
            F.col("tx_id").alias("external_id"),
            F.concat(F.lit('{"search_query":"'), F.col("manufacturer"), F.lit('"}')).alias("raw_json"),
            (F.col("sold_at") + F.expr("interval 1 day")).alias("ingested_at"),
        )

    @cached_property
    def player_events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            "event_id",
            (F.col("user_id") % 10).cast("int").alias("player_id"),
            F.when(kind == "purchase", "mvp")
            .when(kind == "signup", "all_star")
            .when(kind == "view", "playoff_win")
            .when(kind == "click", "signed")
            .otherwise("injury_out")
            .alias("event_type"),
            F.col("ts").cast("timestamp").alias("event_date"),
            F.col("props").alias("event_payload"),
        )

    @cached_property
    def pop_snapshots(self) -> DataFrame:
        monthly = (
            self.tx_clean.where(F.col("slab_grader") == "PSA")
            .groupBy(
                F.date_trunc("month", "sold_at").alias("snapshot_date"),
                "card_id",
                F.col("slab_grader").alias("grader"),
                F.col("slab_grade").alias("grade"),
            )
            .agg(F.count(F.lit(1)).alias("n"))
        )
        # One row per month and key: the window holds a few hundred rows at most.
        running = Window.partitionBy("card_id", "grader", "grade").orderBy("snapshot_date")
        return monthly.select(
            "snapshot_date", "card_id", "grader", "grade", F.sum("n").over(running).cast("bigint").alias("pop_count")
        )

    @cached_property
    def portfolio_holdings(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.raw("orders").select(
            key.alias("holding_id"),
            (key % 200).alias("card_id"),
            F.col("o_orderdate").cast("timestamp").alias("acquired_at"),
            (F.col("o_totalprice") / 10).alias("acquired_cost_usd"),
            F.when(F.col("o_orderstatus") == "F", "sold").otherwise("held").alias("status"),
            (1 + key % 10).cast("int").alias("entry_factor_decile"),
            F.substring(F.lit("ABCD"), (1 + key % 4).cast("int"), F.lit(1)).alias("entry_liquidity_tier"),
        )

    @cached_property
    def prospects(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            F.col("c_name").alias("br_slug"),
            (2010 + key % 15).cast("int").alias("draft_year"),
            F.when(key % 5 != 0, (1 + key % 60).cast("int")).alias("draft_pick"),
            F.when(key % 3 == 0, "NCAA").when(key % 3 == 1, "GLEAGUE").otherwise("EUROLEAGUE").alias("prospect_origin"),
            (F.col("c_acctbal") / 400).alias("usg_pct"),
            (F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 300).alias("career_bpm_5y"),
        )

    @cached_property
    def mock_ranks(self) -> DataFrame:
        key = F.col("c_custkey")
        votes = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(k).alias("k")) for s, k in MOCK_VOTES]))
        return (
            self.raw("customer")
            .select(key, F.col("c_name").alias("br_slug"), votes.alias("s"))
            .where((key + F.col("s.k")) % 4 != 0)
            .select(
                F.col("s.source").alias("source"),
                "br_slug",
                F.lit(2026).alias("draft_year"),
                (1 + (key * F.col("s.k")) % 97).cast("int").alias("mock_rank"),
            )
        )


MOCK_VOTES = (("a", 3), ("b", 5), ("c", 7), ("d", 11))
