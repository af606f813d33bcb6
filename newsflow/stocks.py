"""Stock master, alias dictionary and news providers."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Symbol, company name and the texts that identify the stock, in
# rank order. The first symbol with a matching alias owns an article.
STOCKS = (
    ("NVDA", "NVIDIA", ("NVDA", "NVIDIA")),
    ("AAPL", "Apple", ("AAPL", "Apple")),
    ("MSFT", "Microsoft", ("MSFT", "Microsoft")),
    ("AMZN", "Amazon", ("AMZN", "Amazon")),
    ("GOOGL", "Alphabet Class A", ("GOOGL", "GOOG", "Alphabet", "Google")),
    ("GOOG", "Alphabet Class C", ("GOOG", "GOOGL", "Alphabet", "Google")),
    ("META", "Meta Platforms", ("META", "Meta", "Facebook")),
    ("AVGO", "Broadcom", ("AVGO", "Broadcom")),
    ("TSLA", "Tesla", ("TSLA", "Tesla")),
    ("WMT", "Walmart", ("WMT", "Walmart")),
    ("COST", "Costco Wholesale", ("COST", "Costco")),
    ("NFLX", "Netflix", ("NFLX", "Netflix")),
    ("AMD", "Advanced Micro Devices", ("AMD", "Advanced Micro Devices")),
    ("CSCO", "Cisco Systems", ("CSCO", "Cisco")),
    ("ADBE", "Adobe", ("ADBE", "Adobe")),
    ("QCOM", "Qualcomm", ("QCOM", "Qualcomm")),
    ("INTC", "Intel", ("INTC", "Intel")),
    ("AMAT", "Applied Materials", ("AMAT", "Applied Materials")),
    ("INTU", "Intuit", ("INTU", "Intuit")),
    ("TXN", "Texas Instruments", ("TXN", "Texas Instruments")),
)
EXCHANGE = "NASDAQ"

# Providers in fetch order. The order decides which copy of an
# article is kept when several providers deliver it.
ALPHA_VANTAGE = "Alpha Vantage"
FINNHUB = "Finnhub"
MARKETAUX = "Marketaux"
YFINANCE = "yfinance"
PROVIDERS = (ALPHA_VANTAGE, FINNHUB, MARKETAUX, YFINANCE)

# The breaker never switches this provider off, and the look-back window is
# applied to this provider only.
UNLIMITED_PROVIDERS = (YFINANCE,)
WINDOWED_PROVIDERS = (YFINANCE,)

SYMBOLS = tuple(symbol for symbol, _, _ in STOCKS)
ALIASES = {symbol: aliases for symbol, _, aliases in STOCKS}


def _local_table(spark: SparkSession, columns: dict[str, tuple[pa.DataType, list]]) -> DataFrame:
    """A literal table whose exact size the optimizer knows, so joins broadcast it."""
    arrays = {name: pa.array(values, kind) for name, (kind, values) in columns.items()}
    return spark.createDataFrame(pa.table(arrays))


def stock_master(spark: SparkSession) -> DataFrame:
    """The configured stocks, one row each."""
    symbols = (pa.string(), list(SYMBOLS))
    return _local_table(
        spark,
        {
            "symbol_rank": (pa.int32(), list(range(len(STOCKS)))),
            "symbol": symbols,
            "name": (pa.string(), [name for _, name, _ in STOCKS]),
            "exchange": (pa.string(), [EXCHANGE] * len(STOCKS)),
            "news_symbol": symbols,
            "yahoo": symbols,
        },
    )


def alias_table(spark: SparkSession) -> DataFrame:
    """The alias dictionary, one row per (symbol, alias)."""
    rows = [(rank, s, a) for rank, (s, _, aliases) in enumerate(STOCKS) for a in aliases]
    ranks, symbols, aliases = map(list, zip(*rows))
    return _local_table(
        spark,
        {
            "symbol_rank": (pa.int32(), ranks),
            "symbol": (pa.string(), symbols),
            "alias": (pa.string(), aliases),
        },
    )


def provider_table(spark: SparkSession, providers: Sequence[str] = PROVIDERS) -> DataFrame:
    """The providers with their rank."""
    return _local_table(
        spark,
        {
            "provider_rank": (pa.int32(), list(range(len(providers)))),
            "source_api": (pa.string(), list(providers)),
        },
    )
