"""ANSI SQL for each registered query, written on its own from the definition of the result.

A query is a chain of named parts over the benchmark tables. ``_with`` puts the needed parts in
front of a final SELECT.
"""

from __future__ import annotations

from marketloom.plans.settings import EARLIEST, END, FOCUS, INDUSTRY, MONTHS, START, TODAY

# Column kinds, labels, metric names and headers that a result must have, written out so that a wrong entry
# in the library shows.
PERCENT_COLUMNS = (
    "revenue_yoy", "revenue_mom", "daily_return", "monthly_return", "volatility_20d", "dividend_yield", "roe", "roa",
    "gross_margin", "operating_margin", "debt_ratio",
)
PRICE_COLUMNS = (
    "close_price", "open_price", "high_price", "low_price", "price_change", "pe_ratio", "eps", "current_ratio",
)
WHOLE_COLUMNS = (
    "revenue", "financial_health_score", "trading_volume", "trading_money", "transaction_count",
)
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
RANK_TABLE_HEADERS = {
    "month": "月份",
    "industry_group": "產業",
    "industry_peer_count": "同業家數",
    "industry_revenue_yoy_rank": "營收 YoY 排名",
    "industry_monthly_return_rank": "月報酬排名",
    "industry_health_score_rank": "健康分數排名",
    "industry_volatility_rank": "波動率排名",
}


def _id(key: str) -> str:
    text = f"CAST({key} AS VARCHAR)"
    return f"CASE WHEN length({text}) < 4 THEN lpad({text}, 4, '0') ELSE {text} END"


def _sum(value: str) -> str:
    return f"CAST(sum({value}) AS DOUBLE)"


PARTS: dict[str, str] = {}

PARTS["li"] = f"""
SELECT {_id('l_suppkey')} AS stock_id, CAST(l_shipdate AS DATE) AS date,
       strftime(l_shipdate, '%Y-%m') AS month, CAST(l_quantity AS BIGINT) AS quantity,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS money, CAST(round(l_discount * 100) AS BIGINT) AS discount,
       CAST(round(l_tax * 100) AS BIGINT) AS tax, l_returnflag AS flag, l_linestatus AS status
FROM lineitem"""

_PRICE_SUMS = f"""
       100 + {_sum('discount')} / count(*) AS open_price,
       100 + CAST(max(discount) AS DOUBLE) AS high_price, 100 + CAST(min(discount) AS DOUBLE) AS low_price,
       100 + {_sum('discount * quantity')} / {_sum('quantity')} AS close_price,
       {_sum('quantity')} AS trading_volume, {_sum('money')} / 100 AS trading_money,
       CAST(count(*) AS DOUBLE) AS transaction_count"""

PARTS["prices"] = f"""
SELECT *, close_price - open_price AS price_change
FROM (SELECT stock_id, date, {_PRICE_SUMS} FROM li GROUP BY stock_id, date)"""

PARTS["feed_prices"] = f"""
SELECT * EXCLUDE (flag), nullif(close_price - open_price, 0) AS price_change
FROM (SELECT stock_id, date, flag, {_PRICE_SUMS} FROM li GROUP BY stock_id, date, flag)
WHERE stock_id <> '0050'
QUALIFY row_number() OVER (
    PARTITION BY stock_id, date ORDER BY CASE flag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) = 1"""

# Later feeds have more faults: what is lost there is taken from an earlier feed.
PARTS["soiled_prices"] = f"""
SELECT * EXCLUDE (flag) REPLACE (CASE WHEN flag = 'R' AND day(date) = 8 THEN NULL ELSE close_price END AS close_price),
       change AS price_change
FROM (SELECT *, nullif(close_price - open_price, 0) AS change
      FROM (SELECT stock_id, date, flag, {_PRICE_SUMS} FROM li GROUP BY stock_id, date, flag))
WHERE stock_id <> '0050' AND NOT (flag = 'R' AND day(date) IN (5, 6, 9)) AND NOT (flag = 'A' AND day(date) IN (6, 9))
QUALIFY row_number() OVER (
    PARTITION BY stock_id, date ORDER BY CASE flag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) = 1"""


def _features(source: str) -> str:
    return f"""
SELECT d.*, m.monthly_return, stddev_samp(d.daily_return) OVER w AS volatility_20d,
       coalesce(d.close_price > d.ma_20, FALSE) AS price_above_ma20_flag,
       coalesce(d.close_price > d.ma_60, FALSE) AS price_above_ma60_flag
FROM (
    SELECT *, strftime(date, '%Y-%m') AS price_month,
           close_price / nullif(lag(close_price) OVER s, 0) - 1 AS daily_return,
           avg(close_price) OVER (PARTITION BY stock_id ORDER BY date ROWS 19 PRECEDING) AS ma_20,
           avg(close_price) OVER (PARTITION BY stock_id ORDER BY date ROWS 59 PRECEDING) AS ma_60
    FROM {source} WINDOW s AS (PARTITION BY stock_id ORDER BY date)
) d
LEFT JOIN (
    SELECT stock_id, price_month,
           last_close / nullif(lag(last_close) OVER (PARTITION BY stock_id ORDER BY price_month), 0) - 1
               AS monthly_return
    FROM (SELECT stock_id, strftime(date, '%Y-%m') AS price_month, arg_max(close_price, date) AS last_close
          FROM {source} GROUP BY 1, 2)
) m USING (stock_id, price_month)
WINDOW w AS (PARTITION BY d.stock_id ORDER BY d.date ROWS 19 PRECEDING)"""


PARTS["px"] = _features("prices")
PARTS["feed_px"] = _features("feed_prices")

PARTS["revenue"] = f"""
SELECT stock_id, month, {_sum('money * (100 - discount)')} / 10000 AS revenue FROM li GROUP BY stock_id, month"""

PARTS["feed_revenue"] = f"""
SELECT stock_id, month, revenue, reported_mom, reported_yoy
FROM (
    SELECT stock_id, month, 0 AS feed,
           CAST(sum(money * (100 - discount)) // 10000000 AS DOUBLE) * 1000 AS revenue,
           ({_sum("CASE WHEN status = 'O' THEN money * discount END")} / {_sum('money')} - 5) / 100 AS reported_mom,
           ({_sum("CASE WHEN status = 'O' THEN money * tax END")} * 5 / {_sum('money')} - 20) / 100 AS reported_yoy
    FROM li WHERE flag = 'N' GROUP BY stock_id, month
    UNION ALL
    SELECT stock_id, month, 1, {_sum('money * (100 - discount)')} / 10000, NULL, NULL
    FROM li WHERE flag IN ('A', 'R') GROUP BY stock_id, month
)
QUALIFY row_number() OVER (
    PARTITION BY stock_id, month
    ORDER BY (reported_mom IS NOT NULL OR reported_yoy IS NOT NULL) DESC, feed DESC) = 1"""

PARTS["soiled_revenue"] = PARTS["feed_revenue"].replace(
    "SELECT stock_id, month, revenue,",
    "SELECT stock_id, month, CASE WHEN feed = 0 OR month NOT LIKE '%-02' THEN revenue END AS revenue,",
).replace(
    "QUALIFY", "WHERE CASE feed WHEN 0 THEN month NOT LIKE '%-05' ELSE right(month, 3) NOT IN ('-03', '-04') END QUALIFY"
)


def _growth(source: str, reported: bool) -> str:
    mom = "coalesce(reported_mom, mom)" if reported else "mom"
    yoy = "coalesce(reported_yoy, yoy)" if reported else "yoy"
    return f"""
SELECT month, stock_id, revenue, revenue_mom, revenue_yoy,
       CASE WHEN revenue_mom IS NULL AND revenue_yoy IS NULL THEN 'Unknown'
            WHEN revenue_yoy > CAST(0.2 AS DOUBLE) AND revenue_mom > 0 THEN 'Strong Growth'
            WHEN revenue_yoy > 0 THEN 'Improving'
            WHEN revenue_yoy < 0 AND revenue_mom < 0 THEN 'Declining'
            ELSE 'Mixed' END AS revenue_growth_signal
FROM (
    SELECT *, {mom} AS revenue_mom, {yoy} AS revenue_yoy
    FROM (
        SELECT *, base / nullif(lag(base) OVER w, 0) - 1 AS mom, base / nullif(lag(base, 12) OVER w, 0) - 1 AS yoy
        FROM (SELECT *, last_value(revenue IGNORE NULLS) OVER (PARTITION BY stock_id ORDER BY month) AS base
              FROM {source})
        WINDOW w AS (PARTITION BY stock_id ORDER BY month)
    )
)"""


PARTS["growth"] = _growth("revenue", False)
PARTS["feed_growth"] = _growth("feed_revenue", True)
PARTS["soiled_growth"] = _growth("soiled_revenue", True)

PARTS["company"] = f"""
SELECT {_id('s_suppkey')} AS stock_id, s_name AS stock_name,
       CASE n_regionkey WHEN 0 THEN '24' WHEN 1 THEN '半導體業' WHEN 2 THEN 'Semiconductor' WHEN 3 THEN '25'
                        WHEN 4 THEN '17' END AS industry_group,
       'Listed' AS market_type, FALSE AS focus_flag
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"""

PARTS["listed"] = PARTS["company"]
PARTS["dim"] = f"""
WITH feed AS (
    SELECT c.stock_id, CASE WHEN s_acctbal < 0 THEN stock_name || ' (restated)' ELSE stock_name END AS stock_name,
           CASE industry_group WHEN '25' THEN '025' ELSE industry_group END AS industry_group
    FROM listed c JOIN supplier ON {_id('s_suppkey')} = c.stock_id),
own AS (SELECT {_id('c_custkey')} AS stock_id, c_name, c_mktsegment = 'BUILDING' AS focus FROM customer)
SELECT feed.stock_id, feed.stock_name, feed.industry_group, CAST(NULL AS VARCHAR) AS market_type,
       coalesce(own.focus, FALSE) AS focus_flag
FROM feed LEFT JOIN own USING (stock_id)
UNION ALL
SELECT stock_id, c_name, 'Financial', 'Listed', focus FROM own WHERE stock_id NOT IN (SELECT stock_id FROM feed)"""

PARTS["valuation"] = f"""
SELECT stock_id, date, {_sum('money')} * 100 / nullif({_sum('money * discount')}, 0) AS pe_ratio,
       coalesce({_sum("CASE WHEN flag = 'R' THEN money * tax END")}
                    / ({_sum("CASE WHEN flag = 'R' THEN money END")} * 100),
                {_sum('money * tax')} / ({_sum('money')} * 100)) AS dividend_yield,
       {_sum('money')} * 100 / nullif({_sum('money * discount')}, 0) / 10 AS price_book_ratio
FROM li GROUP BY stock_id, date"""

PARTS["accounts"] = f"""
SELECT stock_id, CAST(last_day(quarter_start + INTERVAL 2 MONTH) AS VARCHAR) AS date, * EXCLUDE (stock_id, quarter_start)
FROM (
    SELECT stock_id, CAST(date_trunc('quarter', date) AS DATE) AS quarter_start,
           {_sum('money')} / 100 AS "營業收入",
           {_sum('money * (100 - discount)')} / 10000 AS "營業毛利（毛損）",
           {_sum('money * (100 - discount - tax)')} / 10000 AS "營業利益（損失）",
           {_sum("CASE WHEN flag <> 'R' THEN money * (100 - discount) END")} / 10000 AS "本期淨利（淨損）",
           {_sum("CASE WHEN flag <> 'R' THEN money * (100 - discount) END")} / 10000 / {_sum('quantity')}
               AS "基本每股盈餘（元）",
           {_sum('money * 2')} / 100 AS "資產總額",
           {_sum("CASE WHEN status = 'O' THEN money END")} / 100 AS "負債總額",
           {_sum("CASE WHEN status = 'O' THEN money ELSE money * 2 END")} / 100 AS "權益總額",
           {_sum("CASE WHEN flag = 'A' THEN money END")} / 100 AS "流動資產",
           {_sum("CASE WHEN flag = 'N' THEN money END")} / 100 AS "流動負債",
           {_sum('money * (discount - tax)')} / 10000 AS "營業活動之淨現金流入（流出）"
    FROM li GROUP BY 1, 2
)"""

_ACCOUNT_CATEGORY = {
    "營業收入": "income_statement",
    "營業毛利（毛損）": "income_statement",
    "營業利益（損失）": "income_statement",
    "本期淨利（淨損）": "income_statement",
    "基本每股盈餘（元）": "income_statement",
    "資產總額": "balance_sheet",
    "負債總額": "balance_sheet",
    "權益總額": "balance_sheet",
    "流動資產": "balance_sheet",
    "流動負債": "balance_sheet",
    "營業活動之淨現金流入（流出）": "cash_flow_statement",
}
PARTS["statements"] = " UNION ALL ".join(
    f"""
SELECT date, stock_id, '{category}' AS statement_category, '{account}' AS type, "{account}" AS value,
       '{STATEMENT_METRICS[account]}' AS normalized_metric_name FROM accounts"""
    for account, category in _ACCOUNT_CATEGORY.items()
)

PARTS["ratios"] = """
SELECT date, stock_id, net / nullif(equity, 0) AS roe, net / nullif(assets, 0) AS roa,
       gross / nullif(sales, 0) AS gross_margin, operating / nullif(sales, 0) AS operating_margin,
       debt / nullif(assets, 0) AS debt_ratio, current_in / nullif(current_out, 0) AS current_ratio, eps
FROM (
    SELECT date, stock_id,
           max(value) FILTER (normalized_metric_name = 'net_income') AS net,
           max(value) FILTER (normalized_metric_name = 'total_equity') AS equity,
           max(value) FILTER (normalized_metric_name = 'total_assets') AS assets,
           max(value) FILTER (normalized_metric_name = 'gross_profit') AS gross,
           max(value) FILTER (normalized_metric_name = 'operating_revenue') AS sales,
           max(value) FILTER (normalized_metric_name = 'operating_income') AS operating,
           max(value) FILTER (normalized_metric_name = 'total_liabilities') AS debt,
           max(value) FILTER (normalized_metric_name = 'current_assets') AS current_in,
           max(value) FILTER (normalized_metric_name = 'current_liabilities') AS current_out,
           max(value) FILTER (normalized_metric_name = 'earnings_per_share') AS eps
    FROM statements WHERE value IS NOT NULL GROUP BY date, stock_id
)"""


def _last_known(columns: list[str], order: str) -> str:
    return ", ".join(f"arg_max({c}, {order}) FILTER ({c} IS NOT NULL) AS {c}" for c in columns)


_RATIOS = ["roe", "roa", "gross_margin", "operating_margin", "debt_ratio", "current_ratio", "eps"]
_MONTH_PRICE = ["close_price", "monthly_return", "volatility_20d", "price_above_ma20_flag", "price_above_ma60_flag"]
_DAY_PRICE = ["open_price", "high_price", "low_price", "price_change", "trading_volume", "trading_money",
              "transaction_count", "daily_return", "ma_20", "ma_60"]

PARTS["silver_px"] = f"SELECT * FROM px WHERE date >= DATE '{START}'"
PARTS["silver_rev"] = f"SELECT * FROM growth WHERE month >= '{START[:7]}'"

PARTS["month_end"] = f"""
SELECT stock_id, price_month AS month, {', '.join(_MONTH_PRICE)}
FROM silver_px QUALIFY row_number() OVER (PARTITION BY stock_id, price_month ORDER BY date DESC) = 1"""

PARTS["month_val"] = f"""
SELECT stock_id, strftime(date, '%Y-%m') AS month, {_last_known(['pe_ratio', 'dividend_yield', 'price_book_ratio'], 'date')}
FROM valuation GROUP BY 1, 2"""

PARTS["month_ratios"] = f"""
SELECT stock_id, substr(date, 1, 7) AS month, {_last_known(_RATIOS, 'date')} FROM ratios GROUP BY 1, 2"""

PARTS["scored"] = """
SELECT *, CASE WHEN financial_health_score >= 85 THEN 'Low' WHEN financial_health_score >= 75 THEN 'Mid'
               WHEN financial_health_score >= 65 THEN 'High' ELSE 'Watch' END AS risk_level
FROM (
    SELECT r.month, r.stock_id, c.stock_name, c.industry_group, c.market_type, c.focus_flag, p.close_price,
           p.monthly_return, r.revenue, r.revenue_mom, r.revenue_yoy, v.pe_ratio, v.dividend_yield, f.roe, f.roa,
           f.gross_margin, f.operating_margin, f.debt_ratio, f.current_ratio, f.eps, p.volatility_20d,
           p.price_above_ma20_flag, p.price_above_ma60_flag,
           CAST(greatest(0, least(100, 50
               + CASE WHEN r.revenue_yoy IS NULL THEN 0 WHEN r.revenue_yoy > CAST(0.2 AS DOUBLE) THEN 20
                      WHEN r.revenue_yoy >= CAST(0.05 AS DOUBLE) THEN 10 WHEN r.revenue_yoy >= 0 THEN 5 ELSE -15 END
               + CASE WHEN r.revenue_mom > CAST(0.05 AS DOUBLE) THEN 5
                      WHEN r.revenue_mom < CAST(-0.05 AS DOUBLE) THEN -5 ELSE 0 END
               + CASE WHEN p.price_above_ma60_flag IS TRUE THEN 10
                      WHEN p.price_above_ma60_flag IS FALSE THEN -5 ELSE 0 END
               + CASE WHEN p.volatility_20d IS NULL THEN 0 WHEN p.volatility_20d > CAST(0.05 AS DOUBLE) THEN -10
                      WHEN p.volatility_20d >= CAST(0.03 AS DOUBLE) THEN -5 ELSE 5 END
               + CASE WHEN v.pe_ratio BETWEEN 8 AND 25 THEN 10 WHEN v.pe_ratio > 40 THEN -10 ELSE 0 END
               + CASE WHEN v.dividend_yield > 0 THEN 5 ELSE 0 END)) AS INTEGER) AS financial_health_score
    FROM silver_rev r
    LEFT JOIN company c USING (stock_id)
    LEFT JOIN month_end p ON p.stock_id = r.stock_id AND p.month = r.month
    LEFT JOIN month_val v ON v.stock_id = r.stock_id AND v.month = r.month
    LEFT JOIN month_ratios f ON f.stock_id = r.stock_id AND f.month = r.month
)"""

PARTS["dashboard"] = f"""
SELECT s.* REPLACE ({', '.join(f'coalesce(s.{c}, p.{c}) AS {c}' for c in _MONTH_PRICE)},
                    {', '.join(f'coalesce(s.{c}, f.{c}) AS {c}' for c in _RATIOS)}),
       p.date AS latest_price_date, {', '.join('p.' + c for c in _DAY_PRICE)}, f.date AS latest_fundamental_date
FROM scored s
LEFT JOIN (SELECT stock_id, max(date) AS date, {_last_known(_MONTH_PRICE + _DAY_PRICE, 'date')}
           FROM silver_px GROUP BY stock_id) p ON p.stock_id = s.stock_id
LEFT JOIN (SELECT stock_id, {_last_known(_RATIOS, 'date')}, max(date) AS date
           FROM ratios GROUP BY stock_id) f ON f.stock_id = s.stock_id"""

PARTS["growth_gold"] = """
SELECT r.month, r.stock_id, c.stock_name, c.industry_group, r.revenue, r.revenue_mom, r.revenue_yoy,
       r.revenue_growth_signal
FROM silver_rev r LEFT JOIN company c USING (stock_id)"""

PARTS["features_gold"] = """
SELECT p.date, p.stock_id, c.stock_name, c.industry_group, p.close_price, p.open_price, p.high_price, p.low_price,
       p.price_change, p.trading_volume, p.trading_money, p.transaction_count, p.daily_return, p.monthly_return,
       p.ma_20, p.ma_60, p.volatility_20d, p.price_above_ma20_flag, p.price_above_ma60_flag
FROM silver_px p LEFT JOIN company c USING (stock_id)"""


def _rank(value: str, groups: str, direction: str) -> str:
    return (
        f"CASE WHEN {value} IS NOT NULL THEN CAST(rank() OVER (PARTITION BY {groups} "
        f"ORDER BY {value} {direction} NULLS LAST) AS DOUBLE) END"
    )


PARTS["peers"] = f"""
SELECT month, stock_id, stock_name, revenue, revenue_yoy, monthly_return, volatility_20d, pe_ratio,
       financial_health_score, risk_level,
       {_rank('revenue_yoy', 'month', 'DESC')} AS revenue_yoy_rank,
       {_rank('monthly_return', 'month', 'DESC')} AS monthly_return_rank,
       {_rank('financial_health_score', 'month', 'DESC')} AS health_score_rank,
       {_rank('volatility_20d', 'month', 'ASC')} AS volatility_rank
FROM scored WHERE industry_group IN ('Semiconductor', '半導體業', '24') OR industry_group LIKE '%半導體%'"""

PARTS["focus"] = f"""
SELECT s.month, s.stock_id, s.stock_name, s.close_price, s.monthly_return, s.revenue, s.revenue_mom, s.revenue_yoy,
       s.pe_ratio, s.dividend_yield, s.volatility_20d, s.financial_health_score, s.risk_level,
       p.revenue_yoy_rank AS semiconductor_revenue_yoy_rank, p.health_score_rank AS semiconductor_health_score_rank
FROM scored s LEFT JOIN peers p ON p.stock_id = s.stock_id AND p.month = s.month
WHERE s.stock_id = '{FOCUS}'"""

PARTS["ranked"] = f"""
SELECT month, stock_id, stock_name, industry_group, n AS industry_peer_count,
       {_rank('revenue_yoy', 'industry_group, month', 'DESC')} AS industry_revenue_yoy_rank,
       {_rank('monthly_return', 'industry_group, month', 'DESC')} AS industry_monthly_return_rank,
       {_rank('financial_health_score', 'industry_group, month', 'DESC')} AS industry_health_score_rank,
       {_rank('volatility_20d', 'industry_group, month', 'ASC')} AS industry_volatility_rank
FROM dashboard
JOIN (SELECT industry_group, month, count(DISTINCT stock_id) AS n FROM dashboard GROUP BY 1, 2)
     USING (industry_group, month)
WHERE month BETWEEN '{MONTHS[0]}' AND '{MONTHS[1]}'"""

PARTS["latest"] = f"""
SELECT * FROM scored WHERE month BETWEEN '{MONTHS[0]}' AND '{MONTHS[1]}' AND industry_group = '{INDUSTRY}'
QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY month DESC) = 1"""

PARTS["latest_all"] = """
SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY month DESC) = 1"""

PARTS["monitored"] = """
SELECT * EXCLUDE (place, total, watch) REPLACE (
    CASE WHEN place <= watch THEN 'Watch'
         WHEN total > watch AND place <= watch + greatest(1, ceil(total * CAST(0.25 AS DOUBLE))) THEN 'High'
         WHEN financial_health_score >= 85 THEN 'Low' WHEN financial_health_score >= 75 THEN 'Mid'
         WHEN financial_health_score >= 65 THEN 'High' ELSE 'Watch' END AS risk_level)
FROM (
    SELECT *, greatest(1, ceil(total * CAST(0.15 AS DOUBLE))) AS watch
    FROM (SELECT *, row_number() OVER (ORDER BY financial_health_score ASC NULLS LAST, stock_id) AS place,
                 count(*) OVER () AS total FROM latest_all)
)"""

PARTS["latest_growth"] = "SELECT * FROM growth_gold WHERE month = (SELECT max(month) FROM growth_gold)"

_NEEDS = {
    "dim": ["listed"], "prices": ["li"], "feed_prices": ["li"], "px": ["prices"], "feed_px": ["feed_prices"], "revenue": ["li"],
    "soiled_prices": ["li"], "soiled_revenue": ["li"], "soiled_growth": ["soiled_revenue"],
    "feed_revenue": ["li"], "growth": ["revenue"], "feed_growth": ["feed_revenue"], "valuation": ["li"],
    "accounts": ["li"], "statements": ["accounts"], "ratios": ["statements"], "silver_px": ["px"],
    "silver_rev": ["growth"], "month_end": ["silver_px"], "month_val": ["valuation"], "month_ratios": ["ratios"],
    "scored": ["silver_rev", "company", "month_end", "month_val", "month_ratios"],
    "dashboard": ["scored", "silver_px", "ratios"], "growth_gold": ["silver_rev", "company"],
    "features_gold": ["silver_px", "company"], "peers": ["scored"], "focus": ["scored", "peers"],
    "ranked": ["dashboard"], "latest": ["scored"], "latest_all": ["scored"], "monitored": ["latest_all"], "latest_growth": ["growth_gold"],
}


# The silver tables as they are cleaned from raw text, with the part that each is taken from.
_FROM_RAW = {
    "silver_px": ("feed_px", f"SELECT * FROM feed_px WHERE date >= DATE '{START}'"),
    "silver_rev": ("feed_growth", f"SELECT * FROM feed_growth WHERE month >= '{START[:7]}'"),
    "company": ("dim", "SELECT * FROM dim"),
}


def _with(select: str, *parts: str, raw: bool = False) -> str:
    needed: list[str] = []
    swapped = _FROM_RAW if raw else {}

    def add(part: str) -> None:
        for other in [swapped[part][0]] if part in swapped else _NEEDS.get(part, []):
            add(other)
        if part not in needed:
            needed.append(part)

    for part in parts:
        add(part)
    texts = {part: swapped[part][1] if part in swapped else PARTS[part] for part in needed}
    return "WITH " + ", ".join(f"{part} AS ({text})" for part, text in texts.items()) + " " + select


_ROUNDED = {
    "open_price", "high_price", "low_price", "close_price", "price_change", "trading_volume", "trading_money",
    "transaction_count", "daily_return", "monthly_return", "ma_20", "ma_60", "volatility_20d", "revenue",
    "revenue_mom", "revenue_yoy", "pe_ratio", "dividend_yield", "price_book_ratio", "value", *_RATIOS,
}


def _cols(*names: str) -> str:
    """Select list with the doubles rounded to six places."""
    return ", ".join(f"round({name} + 1e-9, 6) AS {name}" if name in _ROUNDED else name for name in names)


def _select(source: str, names: list[str], tail: str = "", raw: bool = False) -> str:
    return _with(f"SELECT {_cols(*names)} FROM {source} {tail}", source, raw=raw)


PRICE_INPUT = ["date", "stock_id", "open_price", "high_price", "low_price", "close_price", "price_change",
               "trading_volume", "trading_money", "transaction_count"]
PRICE = [*PRICE_INPUT, "daily_return", "monthly_return", "ma_20", "ma_60", "volatility_20d",
         "price_above_ma20_flag", "price_above_ma60_flag"]
REVENUE = ["month", "stock_id", "revenue", "revenue_mom", "revenue_yoy", "revenue_growth_signal"]
SNAPSHOT = ["month", "stock_id", "stock_name", "industry_group", "market_type", "focus_flag", "close_price",
            "monthly_return", "revenue", "revenue_mom", "revenue_yoy", "pe_ratio", "dividend_yield", *_RATIOS,
            "volatility_20d", "price_above_ma20_flag", "price_above_ma60_flag", "financial_health_score",
            "risk_level"]
DASHBOARD = [*SNAPSHOT, "latest_price_date", *_DAY_PRICE, "latest_fundamental_date"]
FEATURES = ["date", "stock_id", "stock_name", "industry_group", *PRICE[2:]]
GROWTH = ["month", "stock_id", "stock_name", "industry_group", *REVENUE[2:]]
PEERS = ["month", "stock_id", "stock_name", "revenue", "revenue_yoy", "monthly_return", "volatility_20d", "pe_ratio",
         "financial_health_score", "risk_level", "revenue_yoy_rank", "monthly_return_rank", "health_score_rank",
         "volatility_rank"]
FOCUS_COLUMNS = ["month", "stock_id", "stock_name", "close_price", "monthly_return", "revenue", "revenue_mom",
                 "revenue_yoy", "pe_ratio", "dividend_yield", "volatility_20d", "financial_health_score",
                 "risk_level", "semiconductor_revenue_yoy_rank", "semiconductor_health_score_rank"]
RANKED = ["month", "stock_id", "stock_name", "industry_group", "industry_peer_count", "industry_revenue_yoy_rank",
          "industry_monthly_return_rank", "industry_health_score_rank", "industry_volatility_rank"]
PROFILE = ["month", "latest_price_date", "latest_fundamental_date", "stock_id", "stock_name", "industry_group",
           "market_type", *_DAY_PRICE[:7], "close_price", "daily_return", "monthly_return", "volatility_20d",
           "revenue_yoy", "revenue_mom", *_RATIOS, "risk_level", "financial_health_score"]


def _label(code: str) -> str:
    cases = " ".join(
        "WHEN '{}' THEN '{}'".format(key, name.replace("'", "''")) for key, name in INDUSTRY_LABELS.items()
    )
    text = f"trim({code})"
    plain = f"CASE WHEN regexp_full_match({text}, '[0-9]+') THEN CAST(CAST({text} AS BIGINT) AS VARCHAR) ELSE {text} END"
    return f"coalesce(CASE {plain} {cases} ELSE {plain} END, 'Unknown')"


def _shown(name: str) -> str:
    if name == "industry_group":
        return f"{_label(name)} AS {name}"
    if name in PERCENT_COLUMNS:
        return f"coalesce(format('{{:.2f}}%', CAST({name} AS DOUBLE) * 100), 'N/A') AS {name}"
    if name in PRICE_COLUMNS:
        return f"coalesce(format('{{:,.2f}}', CAST({name} AS DOUBLE)), 'N/A') AS {name}"
    if name in WHOLE_COLUMNS:
        return f"coalesce(format('{{:,.0f}}', CAST({name} AS DOUBLE)), 'N/A') AS {name}"
    return name


def _top(source: str, column: str, direction: str, names: list[str]) -> str:
    return _select(source, names, f"ORDER BY {column} {direction} NULLS LAST, stock_id LIMIT 10")


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["price_features"] = _select("px", PRICE, f"WHERE date >= DATE '{START}' AND date <= DATE '{END}'")
    sql["price_clean"] = _select("feed_prices", PRICE_INPUT)
    sql["price_soiled"] = _select("soiled_prices", PRICE_INPUT)
    sql["revenue_soiled"] = _select("soiled_growth", REVENUE, f"WHERE month >= '{START[:7]}'")
    sql["silver_stock_price"] = _select("feed_px", PRICE, f"WHERE date >= DATE '{START}' AND date <= DATE '{END}'")
    sql["revenue_growth"] = _select("feed_growth", REVENUE, f"WHERE month >= '{START[:7]}'")
    sql["company_dim"] = _with(f"SELECT *, {_label('industry_group')} AS industry_label FROM dim", "dim")
    sql["statement_long"] = _select(
        "statements", ["date", "stock_id", "statement_category", "type", "value", "normalized_metric_name"]
    )
    sql["fundamental_metrics"] = _select("ratios", ["date", "stock_id", *_RATIOS])
    sql["valuation_last"] = _select("valuation", ["date", "stock_id", "pe_ratio", "dividend_yield", "price_book_ratio"])
    sql["valuation_monthly"] = _select(
        "month_val", ["stock_id", "month", "pe_ratio", "dividend_yield", "price_book_ratio"]
    )
    sql["month_end_prices"] = _select("month_end", ["stock_id", "month", *_MONTH_PRICE])
    sql["company_snapshot"] = _select("scored", SNAPSHOT)
    sql["price_features_named"] = _select("features_gold", FEATURES)
    sql["operating_dashboard"] = _select("dashboard", DASHBOARD)
    sql["growth_table"] = _select("growth_gold", GROWTH)
    sql["semiconductor_peers"] = _select("peers", PEERS)
    sql["semiconductor_peers_spread"] = sql["semiconductor_peers"]
    sql["focus_snapshot"] = _select("focus", FOCUS_COLUMNS)
    sql["industry_ranks"] = _select("ranked", RANKED)
    profile_row = f"""
SELECT * FROM dashboard WHERE stock_id = '{FOCUS}' AND month BETWEEN '{MONTHS[0]}' AND '{MONTHS[1]}'
ORDER BY month DESC LIMIT 1"""
    sql["company_profile"] = _with(
        f"SELECT {_cols(*PROFILE)}, {', '.join(RANKED[4:])} FROM ({profile_row}) "
        f"LEFT JOIN (SELECT month, {', '.join(RANKED[4:])} FROM ranked WHERE stock_id = '{FOCUS}') USING (month)",
        "dashboard", "ranked",
    )
    sql["company_report"] = _with(
        f"SELECT {', '.join(_shown(name) for name in PROFILE)} FROM ({profile_row})", "dashboard"
    )
    sql["rank_trend_long"] = _with(
        f"""SELECT stock_id, month, rank_type, rank FROM (
            SELECT stock_id, month, {', '.join(RANKED[5:])} FROM ranked)
        UNPIVOT INCLUDE NULLS (rank FOR rank_type IN ({', '.join(RANKED[5:])}))""",
        "ranked",
    )
    whole = {name: f"CAST({name} AS BIGINT)" for name in RANKED[4:]}
    sql["rank_table"] = _with(
        "SELECT "
        + ", ".join(f'{whole.get(name, name)} AS "{header}"' for name, header in RANK_TABLE_HEADERS.items())
        + f" FROM ranked WHERE stock_id = '{FOCUS}'",
        "ranked",
    )
    sql["last_known_names"] = _with(
        """SELECT stock_id, coalesce(arg_max(stock_name, month) FILTER (stock_name IS NOT NULL), stock_id) AS stock_name,
        arg_max(industry_group, month) FILTER (industry_group IS NOT NULL) AS industry_group
        FROM dashboard GROUP BY stock_id""",
        "dashboard",
    )
    sql["price_revenue_relation"] = _with(
        f"""SELECT {_cols('month', 'close_price', 'revenue_yoy', 'revenue_mom')} FROM dashboard
        WHERE stock_id = '{FOCUS}' AND close_price IS NOT NULL AND month BETWEEN '{MONTHS[0]}' AND '{MONTHS[1]}'""",
        "dashboard",
    )
    sql["trend_series"] = _with(
        f"""SELECT price_month AS month, {_cols('volatility_20d')}, stock_id FROM silver_px
        WHERE volatility_20d IS NOT NULL""",
        "silver_px",
    )
    sql["statement_slice"] = _with(
        f"""SELECT CAST(date AS DATE) AS date, type, normalized_metric_name, {_cols('value')} FROM statements
        WHERE stock_id = '{FOCUS}' AND date = (SELECT max(date) FROM statements WHERE stock_id = '{FOCUS}')""",
        "statements",
    )
    sql["statement_trend"] = _with(
        f"""SELECT substr(date, 1, 7) AS month, {_cols('value')}, normalized_metric_name FROM statements
        WHERE stock_id = '{FOCUS}' AND normalized_metric_name IN ('net_income', 'total_assets') AND value IS NOT NULL""",
        "statements",
    )
    sql["latest_per_stock"] = _select("latest", SNAPSHOT)
    sql["risk_bands"] = _select("monitored", SNAPSHOT)
    sql["alert_companies"] = _select("monitored", SNAPSHOT, "WHERE risk_level IN ('High', 'Watch')")
    sql["weak_trend"] = _select("monitored", SNAPSHOT, "WHERE revenue_yoy < 0 AND price_above_ma60_flag = FALSE")
    sql["risk_counts"] = _with(
        "SELECT risk_level, count(*) AS company_count FROM monitored GROUP BY risk_level", "monitored"
    )
    sql["overview_kpis"] = _with(
        """SELECT round(avg(financial_health_score) + 1e-9, 6) AS avg_health_score,
        CAST(count(*) FILTER (risk_level = 'Low') AS BIGINT) AS low_companies,
        CAST(count(*) FILTER (risk_level = 'Mid') AS BIGINT) AS mid_companies,
        CAST(count(*) FILTER (risk_level = 'High') AS BIGINT) AS high_companies,
        CAST(count(*) FILTER (risk_level = 'Watch') AS BIGINT) AS watch_companies FROM monitored""",
        "monitored",
    )
    sql["latest_price_date"] = _with(
        """SELECT coalesce(CAST(greatest((SELECT max(date) FROM features_gold),
        (SELECT max(latest_price_date) FROM dashboard)) AS VARCHAR), 'N/A') AS latest_price_date""",
        "features_gold", "dashboard",
    )
    sql["signal_summary"] = _with(
        """SELECT revenue_growth_signal, count(DISTINCT stock_id) AS company_count,
        round(avg(revenue_yoy) + 1e-9, 6) AS avg_revenue_yoy, round(median(revenue_yoy) + 1e-9, 6) AS median_revenue_yoy,
        round(avg(revenue_mom) + 1e-9, 6) AS avg_revenue_mom, round(coalesce(sum(revenue), 0), 2) AS total_revenue,
        round(count(DISTINCT stock_id) / CAST((SELECT count(*) FROM latest_growth) AS DOUBLE) + 1e-9, 6) AS company_share
        FROM latest_growth GROUP BY revenue_growth_signal""",
        "latest_growth",
    )
    sql["signal_companies"] = _select("latest_growth", GROWTH, "WHERE revenue_growth_signal = 'Improving'")
    sql["top_growth"] = _top("latest_growth", "revenue_yoy", "DESC", GROWTH)
    sql["bottom_growth"] = _top("latest_growth", "revenue_yoy", "ASC", GROWTH)
    sql["top_health"] = _top("monitored", "financial_health_score", "DESC", SNAPSHOT)
    sql["top_volatility"] = _top("monitored", "volatility_20d", "DESC", SNAPSHOT)
    universe = f"""
SELECT stock_id FROM (
    SELECT stock_id, coalesce(trading_money, 0) AS money FROM dashboard
    QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY latest_price_date DESC NULLS LAST, money DESC) = 1)
ORDER BY money DESC, stock_id LIMIT 20"""
    sql["universe_top20"] = _with(f"({universe}) UNION SELECT '{FOCUS}'", "dashboard")
    sql["universe_qualified"] = _with(
        f"""
, universe AS (({universe}) UNION SELECT '{FOCUS}')
SELECT stock_id, snapshot_months, price_months, growth_months FROM universe
JOIN (SELECT stock_id, count(DISTINCT month) AS snapshot_months FROM scored GROUP BY 1) USING (stock_id)
JOIN (SELECT stock_id, count(DISTINCT strftime(date, '%Y-%m')) AS price_months FROM features_gold GROUP BY 1)
     USING (stock_id)
JOIN (SELECT stock_id, count(DISTINCT month) AS growth_months FROM growth_gold GROUP BY 1) USING (stock_id)
WHERE snapshot_months >= 12 AND price_months >= 12 AND growth_months >= 12""",
        "dashboard", "features_gold", "growth_gold",
    )
    sql["universe_configured"] = f"SELECT DISTINCT {_id('c_custkey')} AS stock_id FROM customer"
    sql["universe_unconfigured"] = f"SELECT stock_id FROM ({sql['universe_qualified']})"
    # The configured securities.
    sql["security_list"] = _with(
        """SELECT stock_id, stock_name, configured_name, CAST(place AS INTEGER) AS place, place IS NOT NULL AS configured FROM company
        LEFT JOIN (VALUES ('2330', '台積電', 0), ('2308', '台達電', 1), ('2454', '聯發科', 2), ('2317', '鴻海', 3),
            ('3711', '日月光投控', 4), ('2383', '台光電', 5), ('3037', '欣興', 6), ('2345', '智邦', 7), ('2881', '富邦金', 8),
            ('2382', '廣達', 9), ('2303', '聯電', 10), ('6669', '緯穎', 11), ('3231', '緯創', 12), ('8299', '群聯', 13),
            ('2344', '華邦電', 14), ('2337', '旺宏', 15)) AS listed(stock_id, configured_name, place) USING (stock_id)""",
        "company",
    )
    sql["missing_tables"] = _with(
        """SELECT unnest(['gold_company_monthly_snapshot', 'gold_stock_price_features', 'gold_operating_dashboard',
            'gold_semiconductor_peer_comparison', 'gold_focus_snapshot']) AS missing_table, stocks
        FROM (SELECT count(DISTINCT stock_id) AS stocks FROM growth_gold)""",
        "growth_gold",
    )
    sql["universe_snapshot"] = _with(
        f", universe AS (({universe}) UNION SELECT '{FOCUS}') SELECT {_cols(*SNAPSHOT)} FROM scored "
        "WHERE stock_id IN (SELECT stock_id FROM universe)",
        "dashboard",
    )
    latest_only = "WHERE month = (SELECT max(month) FROM {0})"
    sql["high_risk_sql"] = _select(
        "scored",
        ["month", "stock_id", "stock_name", "industry_group", "revenue_yoy", "monthly_return", "volatility_20d",
         "financial_health_score", "risk_level"],
        latest_only.format("scored") + " AND risk_level IN ('High Risk', 'Watch')",
    )
    sql["peer_sql"] = _select("peers", [name for name in PEERS if name != "revenue"], latest_only.format("peers"))
    sql["latest_peers"] = _select("peers", PEERS, latest_only.format("peers"))
    sql["growth_sql"] = sql["top_growth"]
    sql["focus_sql"] = _select("focus", FOCUS_COLUMNS, "ORDER BY month DESC LIMIT 24")
    sql["report_table"] = _with(f"SELECT {', '.join(_shown(name) for name in SNAPSHOT)} FROM scored", "scored")
    industry = _label("value")
    sql["value_lists"] = _with(
        f"""
SELECT kind, value, CASE WHEN kind = 'industry_group' THEN {industry} ELSE value END AS label FROM (
    SELECT 'month' AS kind, month AS value FROM dashboard
    UNION SELECT 'month', strftime(date, '%Y-%m') FROM features_gold UNION SELECT 'month', month FROM growth_gold
    UNION SELECT 'stock_id', stock_id FROM dashboard UNION SELECT 'stock_id', stock_id FROM features_gold
    UNION SELECT 'industry_group', industry_group FROM dashboard
    UNION SELECT 'industry_group', industry_group FROM features_gold
) WHERE value IS NOT NULL""",
        "dashboard", "features_gold", "growth_gold",
    )
    sql["month_gap_plan"] = _with(
        f"""
, wanted AS (
    SELECT stock_id, strftime(first_day, '%Y-%m') AS query_month
    FROM (SELECT DISTINCT stock_id FROM li),
         (SELECT unnest(generate_series(DATE '{EARLIEST}', DATE '2001-12-01', INTERVAL 1 MONTH)) AS first_day))
SELECT stock_id, query_month FROM wanted
ANTI JOIN (SELECT stock_id, month AS query_month FROM li WHERE flag = 'A') USING (stock_id, query_month)""",
        "li",
    )
    sql["snapshot_append"] = _with(
        f"""SELECT stock_id, date, round(trading_money + 1e-9, 6) AS trading_money, snapshot_date FROM (
        SELECT stock_id, date, sum(money) / CAST(100 AS DOUBLE) AS trading_money,
               CASE WHEN flag <> 'R' THEN CAST(date AS VARCHAR) ELSE '{TODAY}' END AS snapshot_date
        FROM li GROUP BY stock_id, date, flag
        UNION
        SELECT stock_id, date, sum(money) / CAST(100 AS DOUBLE), '{TODAY}' FROM li WHERE flag = 'R'
        GROUP BY stock_id, date)""",
        "li",
    )
    sql["history_append"] = _with(
        """SELECT stock_id, date, flag, round(sum(money) / CAST(100 AS DOUBLE) + 1e-9, 6) AS trading_money FROM li
        GROUP BY stock_id, date, flag
        QUALIFY row_number() OVER (PARTITION BY stock_id, date
                                   ORDER BY CASE flag WHEN 'R' THEN 2 WHEN 'N' THEN 1 ELSE 0 END DESC) = 1""",
        "li",
    )
    sql["history_merge"] = sql["history_append"]
    sql["payload_rows"] = _with(
        """SELECT stock_id, month AS query_month, CAST(date AS VARCHAR) AS date, CAST(sum(quantity) AS VARCHAR) AS volume
        FROM li WHERE (stock_id, month) IN (SELECT stock_id, month FROM li WHERE status = 'O') GROUP BY 1, 2, 3""",
        "li",
    )
    sql["payload_shapes"] = _with(
        """SELECT stock_id, month AS query_month, CAST(date AS VARCHAR) AS date, CAST(sum(quantity) AS VARCHAR) AS volume
        FROM li WHERE CAST(stock_id AS BIGINT) % 5 < 3 OR CAST(stock_id AS BIGINT) % 5 = 3
            AND (stock_id, month) IN (SELECT stock_id, month FROM li WHERE status = 'O') GROUP BY 1, 2, 3
        UNION ALL SELECT DISTINCT stock_id, month, NULL, NULL FROM li WHERE CAST(stock_id AS BIGINT) % 5 = 4""",
        "li",
    )
    sql["payload_csv_rows"] = _with(
        """SELECT stock_id, month AS query_month, CAST(date AS VARCHAR) AS date, CAST(sum(quantity) AS VARCHAR) AS volume
        FROM li WHERE (stock_id, month) IN (SELECT stock_id, month FROM li WHERE flag = 'R') GROUP BY 1, 2, 3""",
        "li",
    )
    sql["payload_valid"] = _with(
        """SELECT month AS query_month, CAST(count(*) FILTER (returned) AS BIGINT) AS accepted,
        CAST(count(*) FILTER (NOT returned) AS BIGINT) AS rejected
        FROM (SELECT stock_id, month, bool_or(flag = 'R') AS returned FROM li GROUP BY 1, 2) GROUP BY month""",
        "li",
    )
    sql["roundtrip_tables"] = sql["price_clean"]
    sql["landed_files"] = f"""
SELECT CAST(l_shipdate AS DATE) AS date, {_id('l_suppkey')} AS stock_id,
       round(arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) + 1e-9, 6) AS close_price,
       round(arg_max(l_quantity, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) + 1e-9, 6) AS trading_volume
FROM lineitem WHERE {_id('l_suppkey')} <> '0050' GROUP BY 1, 2"""
    sql["statement_files"] = f"SELECT *, statement_category AS template FROM ({sql['statement_long']})"
    sql["catalog_growth"] = _with(
        """SELECT month, revenue_growth_signal, count(*) AS companies, count(DISTINCT industry_group) AS industries
        FROM growth_gold GROUP BY 1, 2""",
        "growth_gold",
    )
    sql["snapshot_bucketed"] = sql["company_snapshot"]
    sql["snapshot_from_raw"] = _select("scored", SNAPSHOT, raw=True)
    sql["dashboard_from_raw"] = _select("dashboard", DASHBOARD, raw=True)
    sql["peers_from_raw"] = _select("peers", PEERS, raw=True)
    sql["latest_friday"] = _with(
        """SELECT DISTINCT date, CAST(date - CAST((isodow(date) + 2) % 7 AS INTEGER) AS DATE) AS latest_friday
        FROM li""",
        "li",
    )
    sql["default_start"] = _with(
        f"""SELECT coalesce(min(month) FILTER (month >= strftime(DATE '{TODAY}' - INTERVAL 5 YEAR, '%Y-%m')), min(month))
        AS default_start_month FROM growth_gold""",
        "growth_gold",
    )
    return sql
