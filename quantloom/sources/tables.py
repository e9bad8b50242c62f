"""Market tables derived from the source parquet files, all lazily and over whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.session import materialise


class Tables:
    """Lazy access to the source tables of one folder and to the market tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._returns: DataFrame | None = None

    def staged(self) -> Tables:
        """The same tables over bars and returns that are computed in one pass of the source, written, and read from there."""
        t = Tables(self.spark, self.folder)
        t._returns = materialise(self.returns(), "returns")
        return t

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- bars -----------------------------------------------------------------------------
    def bars(self) -> DataFrame:
        """One OHLCV bar per supplier and week.

        The aggregation is combined map-side, so a hot supplier shrinks to one row per week and
        input split before anything is shuffled.  First and last trade are found by one decimal of 38 digits, the
        day of the week (1), order (19), line (2) and part (16), so any 64-bit order is told apart; lines or parts
        beyond their digits stop the job instead of being folded.  A decimal keeps this a hash
        aggregation; a struct key would force a sort of the whole input.  Rows equal in all four are one item
        of one order, listed twice.
        """
        if self._returns is not None:
            return self._returns.drop("ret")
        day = F.unix_date(F.to_date("l_shipdate")).cast("long")
        line, part, order = F.col("l_linenumber").cast("long"), F.col("l_partkey").cast("long"), F.col("l_orderkey").cast("long")
        fits = (order >= 0) & line.between(0, 99) & part.between(0, 10 ** 16 - 1)
        digits = lambda n: F.lit("1" + "0" * n).cast("decimal(38,0)")
        key = F.pmod(day + 3, F.lit(7)).cast("decimal(1,0)") * digits(37) + order.cast("decimal(19,0)") * digits(18) + (line * 10 ** 16 + part).cast("decimal(18,0)")
        key = F.when(F.coalesce(fits, F.lit(True)), key).otherwise(F.raise_error(F.lit("order, line or part key outside of the digits of the bar key")))
        li = self.read("lineitem").select(
            F.col("l_suppkey").alias("symbol"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("q"), key.alias("k"))
        return li.groupBy("symbol", "date").agg(
            F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", "k").alias("close"), F.sum("q").alias("volume"))

    def closes(self) -> DataFrame:
        return self.bars().select("symbol", "date", "close")

    def returns(self) -> DataFrame:
        if self._returns is not None:
            return self._returns
        w = Window.partitionBy("symbol").orderBy("date")
        return self.bars().withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1)

    def sector(self) -> DataFrame:
        """Supplier to industry (nation) and sector (region); the lookups are fixed small dimensions."""
        n, r = self.read("nation"), self.read("region")
        return (self.read("supplier")
                .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
                .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
                .select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("industry"),
                        F.col("r_name").alias("sector")))

    def market_index(self) -> DataFrame:
        """Equal-weight index level by date (one row per calendar week)."""
        return self.bars().groupBy("date").agg(F.avg("close").alias("mclose"))

    def market_returns(self) -> DataFrame:
        # one row per week of the calendar: bounded by the calendar, not by the data
        w = Window.orderBy("date")
        return self.market_index().withColumn("mret", F.try_divide("mclose", F.lag("mclose").over(w)) - 1)

    def returns_with_market(self) -> DataFrame:
        return self.returns().join(self.market_returns(), "date", "left")

    def industry_panel(self) -> DataFrame:
        """Mean weekly return by industry: at most nations x weeks rows."""
        return (self.returns().where(F.col("ret").isNotNull()).join(self.sector(), "symbol")
                .groupBy("industry", "date").agg(F.avg("ret").alias("ret"), F.avg("close").alias("close"),
                                                 F.sum("volume").alias("volume"))
                .withColumnRenamed("industry", "symbol"))

    def macro(self) -> DataFrame:
        """Macro-shaped weekly series (a stand-in): one row per week of the calendar."""
        d = self.bars().join(self.sector(), "symbol")

        def level(name):
            return F.avg(F.when(F.col("sector") == name, F.col("close"))) / 400
        return d.groupBy("date").agg(
            level("AFRICA").alias("rate3m"), level("AMERICA").alias("rate5y"), level("ASIA").alias("rate10y"), level("EUROPE").alias("rate30y"),
            (F.stddev_samp("close") / 30).alias("vix"), F.avg("open").alias("gold"), F.avg("high").alias("oil"), F.avg("close").alias("equity"),
            F.sum("volume").alias("volume"), F.avg("low").alias("usd"))

    def doc_sentiment(self) -> DataFrame:
        """(doc_id, symbol = source, polarity, subjectivity, ...) of whole document texts."""
        from quantloom.operators.sentiment import LEXICON_WORDS, learn_lexicon, text_polarity
        docs = self.read("documents").select("doc_id", F.col("source").alias("symbol"), "lang", "n_chars", "text")
        words = learn_lexicon(docs, self.read("labels"), "text", words=LEXICON_WORDS)
        return text_polarity(docs, "text", F.broadcast(words)).drop("text")  # at most LEXICON_WORDS rows

    # --- ticks, options, metrics -----------------------------------------------------------
    def ticks(self) -> DataFrame:
        return self.read("events").select(
            F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
            F.col("value").alias("price"),
            F.get_json_object("props", "$.k").cast("long").alias("size"), "event_type", "event_id")

    def metrics(self) -> DataFrame:
        return self.read("events").select(F.col("ts").cast("timestamp").alias("ts"),
                                          F.col("event_type").alias("metric"), "value", "event_id")

    def options(self) -> DataFrame:
        """Option rows: click = call, view = put."""
        return (self.read("events").where(F.col("event_type").isin("click", "view"))
                .select(F.col("user_id").alias("symbol"),
                        F.to_date(F.date_trunc("week", "ts")).alias("expiry"),
                        F.to_date("ts").alias("date"),
                        F.when(F.col("event_type") == "click", "call").otherwise("put").alias("side"),
                        F.get_json_object("props", "$.k").cast("long").alias("volume"),
                        (F.get_json_object("props", "$.k").cast("long") * 10 + 1).alias("open_interest"),
                        (F.col("value") / 100).alias("iv")))

    # --- reports ---------------------------------------------------------------------------
    def reports(self) -> DataFrame:
        """Quarterly statement-shaped rows per nation; balance columns are running sums."""
        li = self.read("lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
        o = self.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        c = self.read("customer").select("c_custkey", "c_nationkey")
        gross = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        oper = gross * (1 - F.col("l_tax"))
        q = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(c, F.col("o_custkey") == F.col("c_custkey"))
             .groupBy(F.col("c_nationkey").cast("long").alias("symbol"),
                      F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("report_date"))
             .agg(F.sum("l_extendedprice").alias("revenue"), F.sum(gross).alias("gross_profit"),
                  F.sum(oper).alias("operating_income"),
                  F.sum(F.when(F.col("o_orderstatus") == "F", oper).otherwise(0.0)).alias("net_income"),
                  F.sum("l_quantity").alias("shares")))
        w = Window.partitionBy("symbol").orderBy("report_date").rowsBetween(Window.unboundedPreceding, 0)
        q = q.withColumns({
            "total_assets": F.sum("revenue").over(w),
            "equity": F.sum("net_income").over(w),
            "current_assets": F.sum("gross_profit").over(w) * 0.5,
            "retained_earnings": F.sum("net_income").over(w) * 0.6,
        })
        return q.withColumns({
            "total_liabilities": F.col("total_assets") - F.col("equity"),
            "current_liabilities": (F.col("total_assets") - F.col("equity")) * 0.4,
            "total_debt": (F.col("total_assets") - F.col("equity")) * 0.5,
            "cash": F.col("current_assets") * 0.2,
            "inventory": F.col("current_assets") * 0.3,
            "receivables": F.col("current_assets") * 0.4,
            "cogs": F.col("revenue") - F.col("gross_profit") + F.col("revenue") * 0.4,
            "interest_expense": (F.col("total_assets") - F.col("equity")) * 0.01,
            "operating_cash_flow": F.col("net_income") * 0.9 + F.col("gross_profit") * 0.05,
            "capex": F.col("revenue") * 0.1,
            "ebitda": F.col("operating_income") * 1.1,
            "dividends": F.col("net_income") * 0.3,
            "price": F.col("revenue") / F.col("shares"),
        })

    # --- portfolios ------------------------------------------------------------------------
    def positions(self) -> DataFrame:
        return (self.read("supplier").join(self.sector(), F.col("s_suppkey") == F.col("symbol"))
                .select(F.col("s_nationkey").cast("long").alias("portfolio"), "symbol",
                        F.col("s_acctbal").alias("market_value"), "sector"))

    def weights(self) -> DataFrame:
        """Absolute-value share of each position in its portfolio."""
        p = self.positions()
        t = p.groupBy("portfolio").agg(F.sum(F.abs("market_value")).alias("_t"))
        return (p.join(t, "portfolio")
                .select("portfolio", "symbol", F.try_divide(F.abs("market_value"), "_t").alias("weight")))

    def trades(self) -> DataFrame:
        """Line items as closed trades; returned goods lose, the rest win."""
        return self.read("lineitem").select(
            F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"),
            F.col("l_quantity").alias("size"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice") * F.col("l_discount"))
            .otherwise(F.col("l_extendedprice") * F.col("l_tax")).alias("pnl"),
            (F.col("l_discount") / 10).alias("slippage"), F.col("l_linenumber").cast("double").alias("latency"))

    # --- altered copies for the quality operators ------------------------------------------
    def dirty_bars(self) -> DataFrame:
        """Bars with holes, broken rows and repeats, placed by integer arithmetic on symbol and day."""
        day = F.datediff("date", F.lit("1970-01-05")) / 7
        k = (F.col("symbol") * 7 + day * 3).cast("long") % 23
        b = self.bars().withColumn("_k", k)
        b = b.select(
            "symbol", "date", "open",
            F.when(F.col("_k") == 1, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low",
            F.when(F.col("_k").isin(2, 3, 5), None).otherwise(F.col("close")).alias("close"),
            F.when(F.col("_k") == 4, 0.0).otherwise(F.col("volume")).alias("volume"), "_k")
        return b.unionByName(b.where(F.col("_k") == 6)).drop("_k")

    def second_source(self) -> DataFrame:
        """A second vendor: prices shifted a little, some dates missing."""
        day = (F.datediff("date", F.lit("1970-01-05")) / 7).cast("long")
        b = self.bars().withColumn("_k", (F.col("symbol") * 5 + day) % 11)
        return b.where(F.col("_k") != 0).select(
            "symbol", "date", *[(F.col(c) * (1 + (F.col("_k") - 5) / 1000)).alias(c)
                                for c in ("open", "high", "low", "close")], "volume")

    def main_listing(self) -> DataFrame:
        """The first vendor of two: whole bars of the symbols that are held long."""
        return self.bars().join(self.positions().where(F.col("market_value") > 0).select("symbol"), "symbol", "left_semi")
