"""Business rules as column expressions. A null input never raises and never scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions.text import lower_snake

# ---------------------------------------------------------------------------
# Labels, thresholds and names that results have to agree with.
# ---------------------------------------------------------------------------
RISK_ORDER = ("Watch", "High", "Mid", "Low")
SIGNAL_ORDER = ("Strong Growth", "Improving", "Mixed", "Declining", "Unknown")

PEER_INDUSTRY_NAMES = ("Semiconductor", "半導體業", "24")
PEER_INDUSTRY_WORD = "半導體"

STATEMENT_METRICS = {
    "EPS": "earnings_per_share",
    "基本每股盈餘": "earnings_per_share",
    "基本每股盈餘（元）": "earnings_per_share",
    "ROE": "return_on_equity",
    "ROA": "return_on_assets",
    "營業收入": "operating_revenue",
    "收益": "operating_revenue",
    "營業毛利": "gross_profit",
    "營業毛利（毛損）": "gross_profit",
    "營業利益": "operating_income",
    "營業利益（損失）": "operating_income",
    "本期淨利（淨損）": "net_income",
    "本期淨利": "net_income",
    "資產總額": "total_assets",
    "資產總計": "total_assets",
    "負債總額": "total_liabilities",
    "負債總計": "total_liabilities",
    "權益總額": "total_equity",
    "權益總計": "total_equity",
    "流動資產": "current_assets",
    "流動負債": "current_liabilities",
    "營業活動之淨現金流入（流出）": "operating_cash_flow",
}

INDUSTRY_LABELS = {
    "1": "Cement",
    "2": "Food",
    "3": "Plastics",
    "4": "Textiles",
    "5": "Electric Machinery",
    "6": "Electrical and Cable",
    "8": "Glass and Ceramics",
    "9": "Paper and Pulp",
    "10": "Iron and Steel",
    "11": "Rubber",
    "12": "Automobile",
    "14": "Building Material and Construction",
    "15": "Shipping and Transportation",
    "16": "Tourism",
    "17": "Financial and Insurance",
    "18": "Trading and Consumers' Goods",
    "20": "Other",
    "21": "Chemical",
    "22": "Biotechnology and Medical Care",
    "23": "Oil, Gas and Electricity",
    "24": "Semiconductor",
    "25": "Computer and Peripheral Equipment",
    "26": "Optoelectronic",
    "27": "Communications and Internet",
    "28": "Electronic Parts and Components",
    "29": "Electronic Products Distribution",
    "30": "Information Service",
    "31": "Other Electronic",
    "35": "Green Energy and Environmental Services",
    "36": "Digital and Cloud Services",
    "37": "Sports and Leisure",
    "38": "Household",
    "91": "Taiwan Depositary Receipts",
}
# ---------------------------------------------------------------------------


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """Value for the key, null when unknown. The table is a plan constant."""
    entries = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*entries), key)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division with null for a null or zero denominator."""
    return F.try_divide(numerator, denominator)


def change(current: Column, previous: Column) -> Column:
    return ratio(current, previous) - 1


def above(price: Column, average: Column) -> Column:
    """True when the price is above its average; an unknown comparison is False."""
    return F.coalesce(price > average, F.lit(False))


def metric_name(account: Column) -> Column:
    return F.coalesce(_lookup(account, STATEMENT_METRICS), lower_snake(account))


def account_metric(account: str) -> str:
    """What ``metric_name`` gives for the account."""
    return STATEMENT_METRICS.get(account) or account.lower().replace(" ", "_")


def known_number(value: Column) -> Column:
    """Null for not a number, which Spark would take for more than any number."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def growth_signal(mom: Column, yoy: Column) -> Column:
    mom, yoy = known_number(mom), known_number(yoy)
    return (
        F.when(mom.isNull() & yoy.isNull(), "Unknown")
        .when((yoy > 0.2) & (mom > 0), "Strong Growth")
        .when(yoy > 0, "Improving")
        .when((yoy < 0) & (mom < 0), "Declining")
        .otherwise("Mixed")
    )


def health_score(
    yoy: Column, mom: Column, above_ma60: Column, volatility: Column, pe: Column, dividend_yield: Column
) -> Column:
    """0 to 100 around a base of 50; each part contributes 0 when its input is null or not a number."""
    yoy, mom, volatility, pe, dividend_yield = map(known_number, (yoy, mom, volatility, pe, dividend_yield))
    parts = [
        F.when(yoy > 0.20, 20).when(yoy >= 0.05, 10).when(yoy >= 0, 5).when(yoy < 0, -15),
        F.when(mom > 0.05, 5).when(mom < -0.05, -5),
        F.when(above_ma60, 10).when(~above_ma60, -5),
        F.when(volatility > 0.05, -10).when(volatility >= 0.03, -5).when(volatility < 0.03, 5),
        F.when(pe.between(8, 25), 10).when(pe > 40, -10),
        F.when(dividend_yield > 0, 5),
    ]
    total = F.lit(50)
    for part in parts:
        total = total + F.coalesce(part, F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def risk_level(score: Column) -> Column:
    """Threshold label; a null score reads as Watch."""
    return F.when(score >= 85, "Low").when(score >= 75, "Mid").when(score >= 65, "High").otherwise("Watch")


def industry_code(industry: Column) -> Column:
    """Industry text with leading zeros of all-digit codes removed ('01' and '1' are one code)."""
    text = F.trim(industry)
    return F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", "")).otherwise(text)


def industry_label(industry: Column) -> Column:
    code = industry_code(industry)
    return F.coalesce(_lookup(code, INDUSTRY_LABELS), code, F.lit("Unknown"))


def in_peer_industry(
    industry: Column, names: Sequence[str] = PEER_INDUSTRY_NAMES, word: str | None = PEER_INDUSTRY_WORD
) -> Column:
    text = F.trim(industry)
    match = text.isin(*names)
    return match | text.contains(word) if word else match


def label_position(label: Column, order: Sequence[str]) -> Column:
    """Zero-based place of a label in a report order; labels outside it come last (99)."""
    place = F.lit(99)
    for index in reversed(range(len(order))):
        place = F.when(label == order[index], index).otherwise(place)
    return place
