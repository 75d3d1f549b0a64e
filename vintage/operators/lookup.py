"""Dimension lookups by text: a row of an ordered dimension whose key equals the text or is a part of it.

A dimension of few keys goes to every text as one broadcast row, so that a text
is read once for each key and never moves. With many keys, each key is filed
under one of its own three-letter pieces, the one that fewest keys share; texts
are cut into all their pieces and meet the keys by an equi-join, and each text
gets the keys met this way. Keys shorter than three letters are filed under
themselves. Either way a row compares its text with its keys in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .setups import half_up

#: Letters of a piece.
PIECE = 3
#: Keys that go to every text; with more of them, cutting the text costs less than reading it for each key.
FEW = 256

# Market sizes in crore by industry (niche, whole), companies that belong to one, and words of a sector's name that point to one, in order of precedence.
MARKETS = (
    ("SPECIALTY_FATS_CBE", 25000.0, 120000.0), ("ELECTRONICS_MANUFACTURING_EMS", 150000.0, 800000.0), ("IT_SERVICES_GLOBAL", 500000.0, 12000000.0), ("PHARMACEUTICALS_CRAMS_CDMO", 60000.0, 350000.0),
    ("DEFENSE_AEROSPACE_INDIGENOUS", 45000.0, 180000.0), ("RENEWABLE_SOLAR_COMPONENTS", 80000.0, 400000.0), ("CONSUMER_QUICK_SERVICE_RESTAURANTS", 35000.0, 250000.0), ("AUTO_ANCILLARY_EV_POWERTRAIN", 40000.0, 300000.0),
    ("BANKING_FINANCIAL_SERVICES", 1500000.0, 15000000.0), ("FMCG_CONSUMER_GOODS", 350000.0, 3000000.0), ("CAPITAL_GOODS_INFRASTRUCTURE", 400000.0, 4500000.0), ("METALS_MINING_COMMODITIES", 300000.0, 3500000.0),
    ("SPECIALTY_CHEMICALS", 120000.0, 1200000.0), ("GENERAL_MANUFACTURING", 100000.0, 1000000.0),
)
MARKET_COMPANIES = (
    ("SPECIALTY_FATS_CBE", "MANORAMA MANORAMA.NS"), ("ELECTRONICS_MANUFACTURING_EMS", "DIXON DIXON.NS AMBER KAYNES SYRMA"), ("IT_SERVICES_GLOBAL", "TCS INFY WIPRO HCLTECH TECHM PERSISTENT COFORGE LTTS"),
    ("PHARMACEUTICALS_CRAMS_CDMO", "DIVISLAB SUVENPHAR SYNGENE LAURUSLABS CIPLA SUNPHARMA DRREDDY"), ("DEFENSE_AEROSPACE_INDIGENOUS", "SOLARINDS DATAPATTNS MTARTECH PARAS HAL BEL MAZDOCK COCHINSHIP"),
    ("BANKING_FINANCIAL_SERVICES", "HDFCBANK ICICIBANK SBIN KOTAKBANK AXISBANK BAJFINANCE BAJAJFINSV JIOFIN"), ("FMCG_CONSUMER_GOODS", "HINDUNILVR ITC NESTLEIND BRITANNIA TATACONSUM VBL DABUR MARICO"),
    ("CAPITAL_GOODS_INFRASTRUCTURE", "LT BHEL SIEMENS ABB THERMAX CUMMINSIND"), ("METALS_MINING_COMMODITIES", "TATASTEEL JSWSTEEL HINDALCO VEDL COALINDIA"), ("SPECIALTY_CHEMICALS", "SRF NAVINFLUOR DEEPAKNTR AARTIIND PIIND ATUL"),
    ("AUTO_ANCILLARY_EV_POWERTRAIN", "TATAMOTORS M&M MARUTI BAJAJ-AUTO HEROMOTOCO EICHERMOT SONACOMS"),
)
MARKET_WORDS = (
    ("BANKING_FINANCIAL_SERVICES", ("BANK", "FINANC", "NBFC", "LENDING", "INSURANCE")), ("IT_SERVICES_GLOBAL", ("TECH", "IT", "SOFTWARE", "DIGITAL")), ("PHARMACEUTICALS_CRAMS_CDMO", ("PHARMA", "HEALTH", "DRUG", "BIOTECH")),
    ("ELECTRONICS_MANUFACTURING_EMS", ("ELECTRONIC", "EMS", "SEMICONDUCTOR")), ("DEFENSE_AEROSPACE_INDIGENOUS", ("DEFENSE", "AEROSPACE")), ("FMCG_CONSUMER_GOODS", ("FMCG", "CONSUMER", "FOOD", "BEVERAGE", "RETAIL")),
    ("CAPITAL_GOODS_INFRASTRUCTURE", ("INFRA", "ENGINEERING", "CAPITAL GOODS", "CONSTRUCTION", "POWER")), ("METALS_MINING_COMMODITIES", ("METAL", "STEEL", "MINING", "MINERAL")),
    ("SPECIALTY_CHEMICALS", ("CHEMIC", "POLYMER", "FERTILIZ")), ("AUTO_ANCILLARY_EV_POWERTRAIN", ("AUTO", "VEHICLE", "MOTOR")),
)
OTHER_MARKET = "GENERAL_MANUFACTURING"


def pieces(text: Column, size: int) -> Column:
    """All distinct pieces of ``size`` letters; one pass over the text, however long."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def first_contained(facts: DataFrame, text: str, dimension: DataFrame, key: str, order: str, equal_first: bool = True) -> DataFrame:
    """``facts`` plus the columns of the first dimension row, by ``order``, whose key is a part of the text; null where there is none.

    Case and outer blanks do not count. ``equal_first``: a key that equals the whole text goes before any part. Ties in
    ``order`` are decided by the key. A null or empty key matches nothing, a null text finds nothing.
    """
    found = [c for c in dimension.columns]
    keys = dimension.select(F.upper(F.trim(F.col(key))).alias("_key"), F.col(order).alias("_order"), F.struct(*found).alias("_row")).where("_key <> ''")
    x = facts.withColumn("_text", F.upper(F.trim(F.col(text))))
    entry = F.struct("_order", "_key", "_row")
    if keys.limit(FEW + 1).count() <= FEW:
        x = x.crossJoin(F.broadcast(keys.agg(F.collect_list(entry).alias("_keys"))))
    else:
        x = x.withColumn("_id", F.xxhash64("_text"))
        # A key may come by several texts of one number, which only brings more keys to compare.
        met = _met(x.select("_id", "_text").where("_text IS NOT NULL").distinct(), keys)
        x = x.join(met.groupBy("_id").agg(F.collect_list(entry).alias("_keys")), "_id", "left")
    x = x.withColumn("_held", F.filter("_keys", lambda k: F.contains("_text", k["_key"])))
    ranked = F.transform("_held", lambda k, i: F.struct((F.col("_text") != k["_key"] if equal_first else F.lit(False)).alias("part"), k["_order"].alias("order"), k["_key"].alias("key"), i.alias("at")))
    x = x.withColumn("_row", F.get("_held", F.array_min(ranked)["at"])["_row"])
    return x.select(*facts.columns, *(F.col(f"_row.{c}").alias(c) for c in found if c not in facts.columns))


def _met(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``_id`` and the columns of the keys whose piece a text of that number holds, each once."""
    sizes = sorted(r[0] for r in keys.select(F.least(F.length("_key"), F.lit(PIECE)).alias("size")).distinct().collect())  # three at most
    own = F.coalesce(*(F.when(F.length("_key") >= s, pieces(F.col("_key"), s)) for s in reversed(sizes)))
    filed = keys.withColumn("_piece", F.explode(own))
    shared = filed.groupBy("_piece").agg(F.count_distinct("_key").alias("_n"))
    filed = filed.join(shared, "_piece").groupBy("_key", "_order", "_row").agg(F.min(F.struct("_n", "_piece"))["_piece"].alias("_piece"))
    # Pieces travel with the text's number, not with the text.
    cut = texts.select("_id", F.explode(F.flatten(F.array(*(pieces(F.col("_text"), s) for s in sizes)))).alias("_piece"))
    return cut.join(filed, "_piece").select("_id", "_order", "_key", "_row").distinct()


def markets(facts: DataFrame, symbol: str, sector: str) -> DataFrame:
    """``facts`` plus ``market, niche_tam, macro_tam``: by the company's symbol, else by the first word in order that its sector's name holds."""
    spark = facts.sparkSession
    companies = spark.createDataFrame([(s, m) for m, names in MARKET_COMPANIES for s in names.split()], "_symbol string, _listed string")
    words = spark.createDataFrame([(i, w, m) for i, (m, ws) in enumerate(MARKET_WORDS) for w in ws], "_place int, _word string, _named string")
    sizes = spark.createDataFrame(MARKETS, "market string, niche_tam double, macro_tam double")
    x = facts.withColumn("_symbol", F.upper(F.trim(F.col(symbol)))).join(F.broadcast(companies), "_symbol", "left")
    x = first_contained(x, sector, words, "_word", "_place", equal_first=False)
    x = x.withColumn("market", F.coalesce("_listed", "_named", F.lit(OTHER_MARKET))).join(F.broadcast(sizes), "market")
    return x.select(*facts.columns, "market", "niche_tam", "macro_tam")


def tenfold_hurdle(x: DataFrame, terminal_pe: float = 28.0, margin_pct: float = 12.0) -> DataFrame:
    """What a tenfold market value would take: profit, revenue and market shares, and whether they are plausible; columns ``market_cap, ttm_revenue, niche_tam, macro_tam``."""
    c = F.col
    margin = max(0.02, min(0.35, margin_pct / 100 if margin_pct > 1 else margin_pct))
    x = x.withColumns({"target_cap": half_up(F.greatest(c("market_cap"), F.lit(10.0)) * 10, 2), "niche": F.greatest(c("niche_tam"), F.lit(100.0))})
    x = x.withColumn("needed_pat", half_up(c("target_cap") / max(10.0, terminal_pe), 2)).withColumn("macro", F.greatest(c("niche"), c("macro_tam")))
    x = x.withColumn("needed_revenue", half_up(c("needed_pat") / margin, 2))
    x = x.withColumns({
        "needed_niche_pct": half_up(c("needed_revenue") / c("niche") * 100, 2), "needed_macro_pct": half_up(c("needed_revenue") / c("macro") * 100, 2), "niche_pct": F.coalesce(half_up(c("ttm_revenue") / c("niche") * 100, 2), F.lit(0.0)),
        "sam": half_up(c("niche") * 0.60, 2), "som": half_up(half_up(c("niche") * 0.60, 2) * 0.25, 2),
        "capacity": F.when(c("needed_revenue") <= F.coalesce(c("ttm_revenue"), F.lit(0.0)) * 2.5, "WITHIN_EXISTING_RUNWAY").otherwise("REQUIRES_SUBSTANTIAL_GREENFIELD_CAPEX"),
    })
    feasibility = F.when(c("needed_niche_pct") <= 15, "HIGH_FEASIBILITY_RUNWAY").when(c("needed_niche_pct") <= 35, "STRETCH_TARGET").when(c("needed_macro_pct") <= 15, "REQUIRES_ADJACENT_EXPANSION").otherwise("MATHEMATICALLY_ABSURD")
    return x.withColumn("feasibility", feasibility).withColumn("plausible", c("feasibility") != "MATHEMATICALLY_ABSURD").drop("niche", "macro")
