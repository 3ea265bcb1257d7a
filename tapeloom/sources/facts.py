"""Company-facts documents and the choice among alternative tags."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Tags of each concept, the preferred one first.
CONCEPT_TAGS = {
    "Revenues": ("RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomer", "Revenues",
                 "TotalRevenues", "SalesRevenueServices", "SalesRevenueProductsNet"),
    "NetIncomeLoss": ("NetIncomeLoss", "NetIncomeAvailableToCommonStockholders",
                      "NetIncomeLossAvailableToCommonStockholders", "NetIncome"),
    "Assets": ("Assets", "AssetsTotal", "TotalAssets"),
    "Liabilities": ("Liabilities", "LiabilitiesTotal", "TotalLiabilities"),
    "StockholdersEquity": ("StockholdersEquity", "ShareholdersEquity", "TotalEquity", "TotalStockholdersEquity"),
    "AssetsCurrent": ("AssetsCurrent", "CurrentAssets"),
    "LiabilitiesCurrent": ("LiabilitiesCurrent", "CurrentLiabilities"),
}

FACT = "STRUCT<val: DOUBLE, end: STRING, filed: STRING, start: STRING>"
DOCUMENT = f"STRUCT<facts: STRUCT<`us-gaap`: MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<{FACT}>>>>>>"


def flatten_company_facts(documents: DataFrame) -> DataFrame:
    """(ticker, body JSON) -> one row per usable fact, with its tag."""
    parsed = documents.select("ticker", F.from_json("body", DOCUMENT).alias("d"))
    tags = parsed.select("ticker", F.explode("d.facts.`us-gaap`").alias("tag", "t"))
    dollars, pure = F.col("t.units")["USD"], F.col("t.units")["pure"]
    values = F.when(F.size(dollars) > 0, dollars).otherwise(pure)
    facts = tags.select("ticker", "tag", F.explode(values).alias("f"))
    rows = facts.select("ticker", "tag", F.col("f.val").alias("value"), F.to_date("f.start").alias("start_date"),
                        F.to_date("f.end").alias("fiscal_period_end"), F.to_date("f.filed").alias("filed_date"))
    return rows.filter((F.abs("value") >= 1) & F.col("fiscal_period_end").isNotNull() & F.col("filed_date").isNotNull())


def preferred_tags(facts: DataFrame) -> DataFrame:
    """Keep, per ticker and concept, the first tag in order that has any fact.

    The tag list is a fixed table.
    """
    rows = [(concept, tag, rank) for concept, tags in CONCEPT_TAGS.items() for rank, tag in enumerate(tags)]
    order = facts.sparkSession.createDataFrame(rows, "concept string, tag string, _rank int")
    ranked = facts.join(F.broadcast(order), "tag")
    chosen = ranked.groupBy("ticker", "concept").agg(F.min("_rank").alias("_rank"))
    return ranked.join(chosen, ["ticker", "concept", "_rank"], "left_semi").drop("_rank", "tag")
