"""The derived views as DuckDB common table expressions."""

VIEWS = {}

VIEWS["stock_days"] = """
SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS code,
  CAST(year(o_orderdate) AS VARCHAR) || CASE WHEN month(o_orderdate) <= 6 THEN 'H1' ELSE 'H2' END AS half,
  CASE WHEN o_custkey % 4 = 0 THEN 'growth' ELSE 'main' END AS board,
  (o_orderkey % 9 + 1) * 100 AS decision_shares, o_orderkey % 9 <> 0 AS formula_input_valid,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 + 1 AS INTEGER) AS next_date,
  known5, known15, known5 AND o_orderkey % 7 <> 0 AS sensitive_known5,
  known15 AND o_orderkey % 7 <> 0 AS sensitive_known15,
  o_orderstatus = 'P' AND o_orderkey % 3 = 0 AS known_unfilled,
  CASE WHEN known5 THEN CAST(o_totalprice > 200000 AS DOUBLE) END AS opportunity5,
  CASE WHEN known15 THEN CAST(o_totalprice > 250000 AS DOUBLE) END AS opportunity15,
  CASE WHEN known5 THEN CAST(o_totalprice > 300000 AS DOUBLE) END AS one_percent5,
  CASE WHEN known15 THEN CAST(o_totalprice > 350000 AS DOUBLE) END AS one_percent15,
  CASE WHEN known5 THEN CAST(o_totalprice > 180000 AS DOUBLE) END AS any_opportunity5,
  CASE WHEN known15 THEN CAST(o_totalprice > 220000 AS DOUBLE) END AS any_opportunity15,
  CASE WHEN known5 AND o_orderkey % 11 <> 0 THEN (o_orderkey % 41 - 18) / 1000 END AS mark_0959_return5,
  CASE WHEN known15 AND o_orderkey % 11 <> 0 THEN (o_orderkey % 41 - 20) / 1000 END AS mark_0959_return15,
  CASE WHEN known5 THEN -(o_orderkey % 53) / 1000 END AS adverse_return5,
  CASE WHEN known15 THEN -(o_orderkey % 53) / 1000 END AS adverse_return15,
  CASE WHEN known5 THEN CASE WHEN o_orderkey % 30 > 1 THEN o_orderkey % 30 - 2 ELSE o_orderkey % 30 - 1 END END AS first_positive_end5,
  CASE WHEN known15 THEN o_orderkey % 30 - 1 END AS first_positive_end15,
  CASE WHEN known5 THEN CAST(floor(o_totalprice) AS BIGINT) % 30 - 1 END AS first_bad35,
  CASE WHEN known15 THEN CAST(floor(o_totalprice) AS BIGINT) % 30 - 1 END AS first_bad315,
  CASE WHEN known5 THEN CAST(o_orderkey % 13 <> 0 AS DOUBLE) END AS risk_observed5,
  CASE WHEN known15 THEN CAST(o_orderkey % 13 <> 0 AS DOUBLE) END AS risk_observed15,
  CAST(floor(o_totalprice / 10000) AS INTEGER) AS score, o_totalprice AS strength,
  o_orderpriority IN ('1-URGENT', '2-HIGH') AS "left", o_orderkey % 2 = 0 AS "right"
FROM (SELECT *, o_orderstatus <> 'P' AS known15,
        o_orderstatus <> 'P' OR o_orderkey % 6 = 1 AS known5 FROM orders) o
"""

_EVENTS = ", ".join(f"""
  CASE WHEN known{b} THEN CAST(first_positive_end{b} >= 0
    AND (first_bad3{b} < 0 OR first_bad3{b} > first_positive_end{b}) AS DOUBLE) END AS positive_before_bad3{b},
  CASE WHEN known{b} THEN CAST(space_end{b} >= 0
    AND (first_bad3{b} < 0 OR first_bad3{b} > space_end{b}) AS DOUBLE) END AS space_before_bad3{b}""" for b in (5, 15))

_SPACE = ", ".join(f"""CASE WHEN one_percent{b} = 1 AND first_positive_end{b} >= 0
  THEN CASE WHEN first_positive_end{b} > 26 THEN 28 ELSE first_positive_end{b} + 2 END ELSE -1 END AS space_end{b}"""
                   for b in (5, 15))

VIEWS["ordered_days"] = f"""
SELECT s.* EXCLUDE (space_end5, space_end15), {_EVENTS}
FROM (SELECT *, {_SPACE} FROM stock_days) s
"""

VIEWS["two_lists"] = """
SELECT * REPLACE ("left" AND decision_shares >= 700 AS "left", "right" AND decision_shares >= 700 AS "right")
FROM ordered_days WHERE decision_shares >= 700 AND ("left" OR "right")
"""

VIEWS["daily"] = """
SELECT date, code, floor(((high + low) / 2) * 100 + 0.5) / 100 AS open, high, low, close, volume,
  CASE WHEN code % 13 = 0 AND day(date) = 7 THEN NULL
       WHEN (code + day(date)) % 29 = 0 THEN lag(close) OVER (PARTITION BY code ORDER BY date) * 0.9::DOUBLE
       ELSE lag(close) OVER (PARTITION BY code ORDER BY date) END AS preclose,
  CASE WHEN (day(date) + code) % 17 = 0 THEN 0 ELSE 1 END AS tradestatus, 3 AS adjustflag
FROM (
  SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS code,
    floor((CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE)
           / CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE)) * 100 + 0.5) / 100 AS close,
    floor(max(l_extendedprice / l_quantity) * 100 + 0.5) / 100 AS high,
    floor(min(l_extendedprice / l_quantity) * 100 + 0.5) / 100 AS low,
    CAST(CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS BIGINT) AS volume
  FROM lineitem GROUP BY ALL)
"""

VIEWS["bars"] = """
SELECT event_type AS code, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS slot,
  arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
  count(*) AS volume, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS amount
FROM events GROUP BY ALL
"""

VIEWS["index_bars"] = """
SELECT date, slot, CAST(sum(CAST(amount AS DECIMAL(20,2))) AS DOUBLE) / sum(volume) AS index_close
FROM bars GROUP BY ALL
"""

VIEWS["shares"] = """
SELECT DISTINCT code, date, CAST(100000 + day(date) * 100 + length(code) * 7 AS DOUBLE) AS float_shares FROM bars
"""

# Day bars with clock picks; 14 is the decision slot.
VIEWS["day_bars"] = """
SELECT *, CASE WHEN q IS NOT NULL THEN dh0 END AS dh, CASE WHEN q IS NOT NULL THEN dl0 END AS dl,
  CASE WHEN q IS NOT NULL THEN dv0 END AS dv, CASE WHEN q IS NOT NULL THEN da0 END AS da
FROM (
  SELECT code, date, arg_min(open, slot) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, slot) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS bars,
    max(close) FILTER (slot = 14) AS q, max(close) FILTER (slot = 11) AS p_mid,
    max(close) FILTER (slot = 12) AS p_short, max(close) FILTER (slot = 9) AS p_long,
    max(high) FILTER (slot <= 14) AS dh0, min(low) FILTER (slot <= 14) AS dl0,
    CAST(sum(volume) FILTER (slot <= 14) AS BIGINT) AS dv0,
    CAST(sum(CAST(amount AS DECIMAL(24,4))) FILTER (slot <= 14) AS DOUBLE) AS da0
  FROM bars GROUP BY code, date)
"""

VIEWS["day_context"] = """
SELECT r.* EXCLUDE (dh0, dl0, dv0, da0), mean_close5, mean_close20, pv5, ph20, pl20,
  100 * pat / dcp1 AS vp20
FROM (
  SELECT *, 
    CASE WHEN count(close) OVER p5 = 5 THEN avg(close) OVER p5 END AS mean_close5,
    CASE WHEN count(close) OVER p20 = 20 THEN avg(close) OVER p20 END AS mean_close20,
    CASE WHEN count(volume) OVER p5 = 5 THEN avg(volume) OVER p5 END AS pv5,
    CASE WHEN count(high) OVER p20 = 20 THEN max(high) OVER p20 END AS ph20,
    CASE WHEN count(low) OVER p20 = 20 THEN min(low) OVER p20 END AS pl20,
    CASE WHEN count(true_range) OVER p20 = 20 THEN avg(true_range) OVER p20 END AS pat
  FROM (
    SELECT *, lag(close, 1) OVER d AS dcp1, lag(close, 2) OVER d AS dcp2, lag(close, 6) OVER d AS dcp6,
      lag(close, 21) OVER d AS dcp21,
      CASE WHEN lag(close) OVER d IS NOT NULL THEN
        greatest(high - low, abs(high - lag(close) OVER d), abs(low - lag(close) OVER d)) END AS true_range
    FROM day_bars WINDOW d AS (PARTITION BY code ORDER BY date))
  WINDOW p5 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
         p20 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) r
"""

VIEWS["day_features"] = """
SELECT *, 100 * (q / official - 1) / vp20 AS "NA01", 100 * (open / official - 1) / vp20 AS "NA02",
  100 * (q / nullif(open, 0) - 1) / vp20 AS "NA03", q AS "A04", 100 * (q / nullif(p_mid, 0) - 1) / vp20 AS "NA05",
  100 * (q / nullif(p_short, 0) - 1) / vp20 AS "NA06", 100 * (p_mid / nullif(p_long, 0) - 1) / vp20 AS "NA07",
  100 * (dcp1 / nullif(dcp6, 0) - 1) / vp20 AS "ND01", 100 * (dcp1 / nullif(dcp21, 0) - 1) / vp20 AS "ND02",
  100 * (q / nullif(mean_close5, 0) - 1) / vp20 AS "ND03", 100 * (q / nullif(mean_close20, 0) - 1) / vp20 AS "ND04",
  100 * (q - dl) / CASE WHEN dh - dl > 0.01 THEN dh - dl ELSE 0.01::DOUBLE END AS "C01",
  100 * (dh - dl) / preclose / vp20 AS "NC02", 100 * (dh - q) / preclose / vp20 AS "NC03",
  100 * (CASE WHEN open < q THEN open ELSE q END - dl) / preclose / vp20 AS "NC04",
  dv / nullif(pv5, 0) AS "C05", da / 1000 AS "C06", 100 * (q / nullif(ph20, 0) - 1) / vp20 AS "NC07",
  100 * (q / nullif(pl20, 0) - 1) / vp20 AS "NC08", vp20 AS "V01"
FROM (SELECT *, nullif(dcp1, 0) AS preclose,
    nullif(CASE WHEN day(date) % 11 = 5 THEN NULL WHEN day(date) % 7 = 3 THEN dcp1 * 0.9::DOUBLE ELSE dcp1 END, 0) AS official
  FROM day_context)
"""

# Row-frame features at the decision slot, computed over the whole sequence of each code.
VIEWS["tail_features"] = """
SELECT code, date,
  v5 / nullif(v5_before, 0) AS "A08", v3 / nullif(v3_before, 0) AS "A09",
  (v2 / 2) / nullif((v5 - v2) / 3, 0) AS "A10",
  100 * (close - l5) / CASE WHEN h5 - l5 > 0.01 THEN h5 - l5 ELSE 0.01::DOUBLE END AS "A11",
  a5 / 1000 AS "A12", 100 * (close / nullif(a5 / v5, 0) - 1) AS "A13", 100 * (close / nullif(a2 / v2, 0) - 1) AS "A14",
  100 * s5 / v5 AS "A15", 100 * u5 / 5 AS "A16", 100 * top5 / v5 AS "A17",
  100 * (close / nullif(h8, 0) - 1) AS "A18", 100 * (h8 - l8) AS noon_range,
  100 * abs(ln(close / back5)) / CASE WHEN g5 > 0.000001 THEN g5 ELSE 0.000001::DOUBLE END AS "A20",
  CAST(v5 AS BIGINT) AS tail_volume
FROM (
  SELECT code, date, slot, close,
    CASE WHEN n >= 5 THEN sum(volume) OVER w5 END AS v5, CASE WHEN n >= 3 THEN sum(volume) OVER w3 END AS v3,
    CASE WHEN n >= 2 THEN sum(volume) OVER w2 END AS v2,
    CASE WHEN n >= 10 THEN sum(volume) OVER b5 END AS v5_before,
    CASE WHEN n >= 6 THEN sum(volume) OVER b3 END AS v3_before,
    CASE WHEN n >= 5 THEN min(low) OVER w5 END AS l5, CASE WHEN n >= 5 THEN max(high) OVER w5 END AS h5,
    CASE WHEN n >= 5 THEN sum(amount) OVER w5 END AS a5, CASE WHEN n >= 2 THEN sum(amount) OVER w2 END AS a2,
    CASE WHEN n >= 6 THEN sum(CASE WHEN close > back1 THEN volume WHEN close < back1 THEN -volume ELSE 0 END) OVER w5 END AS s5,
    CASE WHEN n >= 6 THEN count(*) FILTER (close > back1) OVER w5 END AS u5,
    CASE WHEN n >= 5 THEN max(volume) OVER w5 END AS top5,
    CASE WHEN n >= 8 THEN max(high) OVER w8 END AS h8, CASE WHEN n >= 8 THEN min(low) OVER w8 END AS l8,
    CASE WHEN n >= 6 THEN sum(abs(ln(close / back1))) OVER w5 END AS g5, lag(close, 5) OVER w AS back5
  FROM (SELECT *, row_number() OVER w AS n, lag(close) OVER w AS back1
        FROM bars WINDOW w AS (PARTITION BY code ORDER BY date, slot))
  WINDOW w AS (PARTITION BY code ORDER BY date, slot),
    w2 AS (PARTITION BY code ORDER BY date, slot ROWS BETWEEN 1 PRECEDING AND CURRENT ROW),
    w3 AS (PARTITION BY code ORDER BY date, slot ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
    w5 AS (PARTITION BY code ORDER BY date, slot ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
    w8 AS (PARTITION BY code ORDER BY date, slot ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
    b3 AS (PARTITION BY code ORDER BY date, slot ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING),
    b5 AS (PARTITION BY code ORDER BY date, slot ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING))
WHERE slot = 14
"""

VIEWS["scaled_tail"] = """
SELECT d.*, t.* EXCLUDE (code, date), "A13" / vp20 AS "NA13", "A14" / vp20 AS "NA14", "A18" / vp20 AS "NA18",
  noon_range / official / vp20 AS "NA19"
FROM day_features d JOIN tail_features t USING (code, date)
"""

VIEWS["index_features"] = """
SELECT *, 100 * (icp1 / icp2 - 1) AS "I01", 100 * (icp1 / icp6 - 1) AS "I02", 100 * (icp1 / icp21 - 1) AS "I03",
  100 * (icp1 / im20 - 1) AS "I04", 100 * (ix_decision / icp1 - 1) AS "J01", 100 * (ix_decision / ix_mid - 1) AS "J02",
  100 * (ix_decision / ix_short - 1) AS "J03", 100 * (ix_mid / ix_long - 1) AS "J04"
FROM (
  SELECT d.*, ix_decision, ix_mid, ix_short, ix_long,
    lag(index_day_close, 1) OVER w AS icp1, lag(index_day_close, 2) OVER w AS icp2,
    lag(index_day_close, 6) OVER w AS icp6, lag(index_day_close, 21) OVER w AS icp21,
    CASE WHEN count(index_day_close) OVER p = 20 THEN avg(index_day_close) OVER p END AS im20
  FROM day_features d LEFT JOIN (
    SELECT date, arg_max(index_close, slot) AS index_day_close, max(index_close) FILTER (slot = 13) AS ix_decision,
      max(index_close) FILTER (slot = 11) AS ix_mid, max(index_close) FILTER (slot = 12) AS ix_short,
      max(index_close) FILTER (slot = 9) AS ix_long
    FROM index_bars GROUP BY date) i USING (date)
  WINDOW w AS (PARTITION BY code ORDER BY date),
         p AS (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
"""

VIEWS["relative_features"] = """
SELECT *, (100 * (q / official - 1) - "J01") / "V01" AS "R01", (100 * (q / p_mid - 1) - "J02") / "V01" AS "R02",
  (100 * (q / p_short - 1) - "J03") / "V01" AS "R03", (100 * (p_mid / p_long - 1) - "J04") / "V01" AS "R04"
FROM index_features
"""

VIEWS["turnover"] = """
SELECT code, date, psh, ln(1 + psh * q / 1000) AS "S01", 10000 * dv / psh AS "S02", 10000 * tail_volume / psh AS "S03"
FROM (SELECT d.code, d.date, q, dv, tail_volume, lag(float_shares) OVER (PARTITION BY d.code ORDER BY d.date) AS psh
      FROM day_bars d LEFT JOIN shares USING (code, date)
      LEFT JOIN (SELECT code, date, tail_volume FROM tail_features) t USING (code, date))
"""

VIEWS["morning"] = """
SELECT code, date, morning_high, morning_low, coalesce(ready, false) AS morning_complete FROM (
  SELECT code, date,
    CAST(max(round(high * 100)) FILTER (slot <= 5 AND volume > 0) AS BIGINT) AS morning_high,
    CAST(min(round(low * 100)) FILTER (slot <= 5 AND volume > 0) AS BIGINT) AS morning_low,
    count(*) FILTER (slot = 5) = 1 AND count(*) FILTER (slot <= 5) = 6 AND count(*) FILTER (slot BETWEEN 0 AND 5) = 6
      AND count(*) FILTER (slot <= 5 AND good) = 6 AND sum(volume) FILTER (slot <= 5) > 0
      AND max(round(high * 100)) FILTER (slot <= 5 AND volume > 0) > 0
      AND min(round(low * 100)) FILTER (slot <= 5 AND volume > 0) > 0 AS ready
  FROM good_bars GROUP BY code, date)
"""

_GOOD = """coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0
    AND high + 0.0001 >= greatest(open, close, low) AND low - 0.0001 <= least(open, close)
    AND abs(open * 100 - round(open * 100)) <= 0.01 AND abs(high * 100 - round(high * 100)) <= 0.01
    AND abs(low * 100 - round(low * 100)) <= 0.01 AND abs(close * 100 - round(close * 100)) <= 0.01, false)"""
VIEWS["good_bars"] = f"SELECT *, {_GOOD} AS good FROM bars"
VIEWS["flawed"] = """
SELECT * REPLACE (CASE WHEN (slot + day(date)) % 11 = 0 THEN low / 2 ELSE high END AS high,
  CASE WHEN (slot + day(date)) % 23 = 0 THEN close + 0.003::DOUBLE ELSE close END AS close) FROM bars
"""
VIEWS["flawed_good"] = f"SELECT *, {_GOOD} AS good FROM flawed"

VIEWS["morning_features"] = """
SELECT d.code, d.date, morning_high, morning_low, morning_complete,
  CASE WHEN ok THEN 100 * (round(q * 100) / morning_high - 1) / vp20 END AS "AMHD",
  CASE WHEN ok THEN 100 * (round(q * 100) / morning_low - 1) / vp20 END AS "AMLD"
FROM (SELECT *, coalesce(morning_complete AND round(q * 100) > 0 AND vp20 > 0, false) AS ok
      FROM day_context LEFT JOIN morning USING (code, date)) d
"""

VIEWS["clock_guard"] = """
SELECT *, has_decision AND matched_clocks = 6 AND bars_before = 6 AS clock_ok FROM (
  SELECT code, date, count(*) FILTER (slot IN (8, 9, 10, 11, 12, 13)) AS matched_clocks,
    count(*) FILTER (slot BETWEEN 8 AND 14 AND slot <> 14) AS bars_before, bool_or(slot = 14) AS has_decision
  FROM bars GROUP BY code, date)
"""

VIEWS["entries"] = """
SELECT code, date, decision_price, CAST(decision_shares AS BIGINT) AS decision_shares, entry_volume, entry_bars,
  entry_price, CAST(capacity AS BIGINT) AS capacity, 
  entry_price + CASE WHEN entry_price * (15.0::DOUBLE / 10000) > 0.005 THEN entry_price * (15.0::DOUBLE / 10000)
                     ELSE 0.005::DOUBLE END AS entry_cost,
  coalesce(decision_shares <= capacity, false) AS fits_capacity
FROM (
  SELECT *, floor(20000 / (decision_price * 100)) * 100 AS decision_shares, money / entry_volume AS entry_price,
    floor(entry_volume * 0.1::DOUBLE) AS capacity
  FROM (
    SELECT code, date, max(close) FILTER (slot = 14) AS decision_price,
      CAST(sum(volume) FILTER (slot BETWEEN 15 AND 18) AS BIGINT) AS entry_volume,
      count(*) FILTER (slot BETWEEN 15 AND 18) AS entry_bars,
      CAST(sum(CAST(amount AS DECIMAL(24,4))) FILTER (slot BETWEEN 15 AND 18) AS DOUBLE) AS money
    FROM bars GROUP BY code, date)
  WHERE decision_price IS NOT NULL)
"""

VIEWS["watched_labels"] = """
SELECT date, code, next_date, seen_bars, seen_bars = 12 AS known,
  CASE WHEN seen_bars = 12 THEN pos END AS pos, CASE WHEN seen_bars = 12 THEN space END AS space,
  CASE WHEN seen_bars = 12 THEN bad END AS bad, CASE WHEN seen_bars = 12 THEN any_opportunity END AS any_opportunity,
  CASE WHEN seen_bars = 12 THEN last_close / entry_cost - 1 END AS mark_return,
  CASE WHEN seen_bars = 12 THEN lowest / entry_price - 1 END AS adverse_return
FROM (
  SELECT date, code, next_date, count(*) AS seen_bars, entry_price, entry_cost,
    coalesce(min(k) FILTER (k >= 2 AND p0 AND p1 AND p2 AND n >= 3), -1) AS pos,
    coalesce(min(k) FILTER (k >= 2 AND s0 AND s1 AND s2 AND n >= 3), -1) AS space,
    coalesce(min(k) FILTER (low <= entry_price * 0.97::DOUBLE), -1) AS bad,
    CAST(bool_or(p0) AS INTEGER) AS any_opportunity, arg_max(close, k) AS last_close, min(low) AS lowest
  FROM (
    SELECT *, row_number() OVER o AS n, lag(p0, 1) OVER o AS p1, lag(p0, 2) OVER o AS p2,
      lag(s0, 1) OVER o AS s1, lag(s0, 2) OVER o AS s2
    FROM (
      SELECT e.date, e.code, c.next_date, b.slot - 9 AS k, b.low, b.close, entry_price, entry_cost,
        b.volume > 0 AND b.close > entry_cost AS p0, b.volume > 0 AND b.close > entry_cost * 1.01::DOUBLE AS s0
      FROM entries e
      JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM bars)) c USING (date)
      JOIN bars b ON b.code = e.code AND b.date = c.next_date AND b.slot BETWEEN 9 AND 20
      WHERE entry_price IS NOT NULL)
    WINDOW o AS (PARTITION BY code, date ORDER BY k))
  GROUP BY date, code, next_date, entry_price, entry_cost)
"""

VIEWS["month_bars"] = """
SELECT code, date, slot, arg_max(unit, (day, l_orderkey, l_linenumber)) AS close, min(unit) AS low,
  CAST(sum(q) * 1000 AS BIGINT) AS volume, CAST(sum(CAST(unit * q AS DECIMAL(18,2))) * 1000 AS DOUBLE) AS amount
FROM (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS day, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
        CAST(least((dayofmonth(l_shipdate) - 1) // 5, 5) AS INTEGER) AS slot, l_orderkey, l_linenumber,
        floor(l_extendedprice / l_quantity + 0.5) / 100 AS unit, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
GROUP BY code, date, slot
"""

# The sell side is solved by its two cases: the least amount, or the share of the money.
VIEWS["charged"] = """
SELECT e.*, f.buy_rate, f.minimum AS buy_minimum, g.sell_rate, g.minimum AS sell_minimum,
  CASE WHEN NOT coalesce(price > 0 AND decision_shares > 0, false) THEN 'none'
       WHEN coalesce(decision_shares > capacity, true) THEN 'unfilled' ELSE 'filled' END AS entry_state
FROM (
  SELECT code, date, next_date, CASE WHEN code % 2 = 0 THEN 'sh' ELSE 'sz' END AS market,
    CAST(floor(20000 / (decided * 100)) * 100 AS BIGINT) AS decision_shares, money / bought AS price, CAST(floor(bought * 0.1::DOUBLE) AS BIGINT) AS capacity
  FROM (SELECT code, date, max(close) FILTER (slot = 4) AS decided, sum(volume) FILTER (slot = 5) AS bought, sum(amount) FILTER (slot = 5) AS money
        FROM month_bars GROUP BY code, date)
    JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM month_bars)) USING (date)
  WHERE decided IS NOT NULL AND next_date IS NOT NULL) e
  ASOF LEFT JOIN fees f ON f.market = e.market AND e.date >= f.valid_from
  ASOF LEFT JOIN fees g ON g.market = e.market AND e.next_date >= g.valid_from
"""

VIEWS["charged_levels"] = """
SELECT *, CASE WHEN entry_state = 'filled' THEN greatest((paid + sell_minimum) / decision_shares, paid / (decision_shares * (1 - sell_rate))) END AS needed
FROM (SELECT *, CASE WHEN entry_state = 'filled' THEN money + greatest(buy_rate * money, buy_minimum) END AS paid
      FROM (SELECT *, decision_shares * (price + greatest(price * b / 10000, 0.005)) AS money FROM charged, (VALUES (5::DOUBLE), (15::DOUBLE)) l(b)))
"""

VIEWS["month_labels"] = """
SELECT c.code, c.date, c.next_date, c.market, c.decision_shares, c.entry_state, c.b, c.price, c.even,
  count(k) AS seen, count(*) FILTER (volume > 0) AS traded, count(low) AS lows, min(low) AS lowest, arg_max(close, k) AS last_close,
  coalesce(min(k) FILTER (k >= 2 AND g0 AND g1 AND g2), -1) AS pos, coalesce(min(k) FILTER (k >= 2 AND s0 AND s1 AND s2), -1) AS space,
  coalesce(min(k) FILTER (low <= price * 0.97::DOUBLE), -1) AS bad, coalesce(bool_or(g0), false) AS touched
FROM (
  SELECT *, lag(g0, 1) OVER o AS g1, lag(g0, 2) OVER o AS g2, lag(s0, 1) OVER o AS s1, lag(s0, 2) OVER o AS s2
  FROM (
    SELECT l.*, m.slot AS k, m.low, m.close, m.volume, coalesce(m.volume > 0 AND m.close > even, false) AS g0,
      coalesce(m.volume > 0 AND m.close > even * 1.01::DOUBLE, false) AS s0
    FROM (SELECT *, greatest(needed + 0.005, needed / (1 - b / 10000)) AS even FROM charged_levels) l
      LEFT JOIN month_bars m ON m.code = l.code AND m.date = l.next_date AND m.slot <= 3)
  WINDOW o AS (PARTITION BY code, date, b ORDER BY k)) c
GROUP BY ALL
"""



def outcome_columns(b: int) -> str:
    told = lambda c, name: f"max(CASE WHEN known AND b = {b} THEN CAST({c} AS DOUBLE) END) AS {name}{b}"
    return ", ".join([
        f"bool_or(known AND b = {b}) AS known{b}", f"bool_or(known AND traded = 4 AND b = {b}) AS sensitive_known{b}",
        told("CAST(pos >= 0 AS INTEGER)", "opportunity"), told("CAST(space >= 0 AS INTEGER)", "one_percent"),
        told("CAST(touched AS INTEGER)", "any_opportunity"), told("CAST(lows = 4 AS INTEGER)", "risk_observed"),
        f"CAST(max(CASE WHEN known AND b = {b} THEN pos END) AS INTEGER) AS first_positive_end{b}",
        f"CAST(max(CASE WHEN known AND b = {b} THEN bad END) AS INTEGER) AS first_bad3{b}",
        told("CAST(pos >= 0 AND (bad < 0 OR bad > pos) AS INTEGER)", "positive_before_bad3"),
        told("CAST(space >= 0 AND (bad < 0 OR bad > space) AS INTEGER)", "space_before_bad3"),
        told("last_close / even - 1", "mark_0959_return"), told("lowest / price - 1", "adverse_return")])


VIEWS["month_outcomes"] = f"""
SELECT date, code, next_date, market, decision_shares, any_value(seen) AS seen_bars, entry_state = 'unfilled' AS known_unfilled,
  {outcome_columns(5)}, {outcome_columns(15)}, CAST(year(date) AS VARCHAR) || CASE WHEN month(date) <= 6 THEN 'H1' ELSE 'H2' END AS half
FROM (SELECT *, seen = 4 AND entry_state = 'filled' AND even IS NOT NULL AS known FROM month_labels)
GROUP BY date, code, next_date, market, decision_shares, entry_state
"""

VIEWS["active_days"] = """
SELECT date, code, high, low, close, preclose, row_number() OVER (PARTITION BY code ORDER BY date) AS seat,
  adjustflag IS NOT DISTINCT FROM 3 AND coalesce(volume, 0) > 0
    AND len(list_filter([open, high, low, close], lambda p: p > 0 AND abs(p - round(p, 2)) <= 0.0001)) = 4
    AND coalesce(list_max([open, high, low, close]) <= high + 0.0001, false)
    AND coalesce(list_min([open, high, low, close]) >= low - 0.0001, false) AS sound
FROM daily WHERE tradestatus = 1"""

# Each active day beside the active day in the seat before it.
VIEWS["day_changes"] = """
SELECT d.*, e.close AS prior_close, d.sound AND coalesce(e.sound, false) AND coalesce(d.preclose > 0, false) AS comparable,
  list_max([d.high - d.low, abs(d.high - e.close), abs(e.close - d.low)]) AS span,
  list_max([d.high - d.low, abs(d.high - d.preclose), abs(d.preclose - d.low)]) AS span_official
FROM active_days d LEFT JOIN active_days e ON e.code = d.code AND e.seat = d.seat - 1"""

# Each active day against the days in the 21 seats before it.
VIEWS["states"] = """
SELECT d.date, d.code, any_value(d.close) AS close, any_value(d.preclose) AS preclose, any_value(d.prior_close) AS prior_close,
  any_value(d.comparable) AS reference_good,
  any_value(CASE WHEN d.comparable THEN abs(d.preclose - d.prior_close) > 0.005 END) AS reset,
  count(*) FILTER (near AND h.comparable) AS prior_reference_count,
  CASE WHEN count(*) FILTER (near AND h.comparable) = 20
    THEN count(*) FILTER (near AND h.comparable AND abs(h.preclose - h.prior_close) > 0.005) END AS prior_reset_count,
  CASE WHEN count(h.span) FILTER (near) = 20 THEN sum(h.span) FILTER (near) / 20 END AS atr_raw,
  CASE WHEN count(*) FILTER (near AND h.comparable) = 20 THEN sum(h.span_official) FILTER (near AND h.comparable) / 20 END AS atr_reference,
  count(*) FILTER (h.sound) = 21 AS history_price_good
FROM day_changes d LEFT JOIN (SELECT code, seat, sound, comparable, preclose, prior_close, span, span_official FROM day_changes) h
  ON h.code = d.code AND h.seat BETWEEN d.seat - 21 AND d.seat - 1,
LATERAL (SELECT h.seat >= d.seat - 20 AS near)
GROUP BY d.date, d.code
"""

VIEWS["rebuilt"] = """
SELECT *, coalesce(abs(raw - V01) <= 2e-10, false) AS v01_match,
  CASE WHEN known THEN prior_reset_count > 0 END AS reset_in_prior
FROM (
  SELECT d.date, d.code, (d.code + day(d.date)) % 4 <> 0 AS formula_input_valid,
    100 * atr_raw / nullif(d.preclose, 0) AS raw, 100 * atr_reference / nullif(d.preclose, 0) AS ref,
    100 * atr_raw / nullif(d.preclose, 0) + CASE WHEN (day(d.date) + d.code) % 10 = 0 THEN 0.001::DOUBLE ELSE 0::DOUBLE END AS V01,
    coalesce(history_price_good, false) AND coalesce(prior_reference_count = 20, false) AS known, prior_reset_count
  FROM daily d LEFT JOIN states s ON s.date = d.date AND s.code = d.code
  WHERE (d.code + day(d.date)) % 5 <> 0)
"""

VIEWS["features"] = """
SELECT date, code, CAST(year(date) AS VARCHAR) || CASE WHEN month(date) <= 6 THEN 'H1' ELSE 'H2' END AS half,
  k % 10 <> 0 AS formula_input_valid, f1 AS F1, CASE WHEN k % 10 <> 0 THEN f2 END AS F2, f3 AS F3,
  CASE WHEN k % 10 <> 0 THEN f4 END AS F4, f5 AS F5, CASE WHEN k % 10 <> 0 THEN f6 END AS F6,
  date + CAST(k % 4 + 1 AS INTEGER) AS next_date, k % 11 <> 0 AS known15,
  CASE WHEN k % 11 <> 0 THEN CAST(f1 + f3 > 0 AS DOUBLE) END AS opportunity15
FROM (
  SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS code, CAST(sum(l_orderkey) AS BIGINT) AS k,
    CAST(sum(CAST(l_quantity AS DECIMAL(14,2))) AS DOUBLE) / count(*) / 25 - 1 AS f1,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) / count(*) / 50000 - 1 AS f2,
    CAST(sum(CAST(l_discount AS DECIMAL(14,2))) AS DOUBLE) / count(*) * 20 - 1 AS f3,
    CAST(sum(CAST(l_tax AS DECIMAL(14,2))) AS DOUBLE) / count(*) * 25 - 1 AS f4,
    CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) AS f5,
    CAST(sum(l_linenumber) AS DOUBLE) / count(*) / 4 - 1 AS f6
  FROM lineitem GROUP BY ALL)
"""

VIEWS["encoded"] = """
SELECT date, code, half, formula_input_valid, next_date, known15, opportunity15, """ + ", ".join(
    f"CASE WHEN formula_input_valid THEN CAST(floor(least(greatest(100 * {n} + 10000 + 0.000001::DOUBLE, 0), 999999)) AS INTEGER) END AS {n}"
    for n in ("F1", "F2", "F3", "F4", "F5", "F6")) + " FROM features"

VIEWS["training_rows"] = """
SELECT e.*, t.target, 1.0::DOUBLE / count(*) OVER (PARTITION BY e.date) AS weight
FROM encoded e JOIN (
  SELECT date, code, opportunity15 - avg(opportunity15) OVER (PARTITION BY date) AS target
  FROM features WHERE known15 AND date >= DATE '1996-01-01' AND next_date < DATE '2000-01-01') t USING (date, code)
WHERE formula_input_valid
"""

NEEDS = {
    "ordered_days": ["stock_days"], "two_lists": ["ordered_days"], "index_bars": ["bars"], "shares": ["bars"],
    "day_bars": ["bars"], "day_context": ["day_bars"], "day_features": ["day_context"], "tail_features": ["bars"],
    "scaled_tail": ["day_features", "tail_features"], "index_features": ["day_features", "index_bars"],
    "relative_features": ["index_features"], "turnover": ["day_bars", "shares", "tail_features"],
    "good_bars": ["bars"], "flawed": ["bars"], "flawed_good": ["flawed"], "morning": ["good_bars"], "morning_features": ["day_context", "morning"],
    "clock_guard": ["bars"], "entries": ["bars"], "watched_labels": ["entries"], "active_days": ["daily"], "day_changes": ["active_days"], "states": ["day_changes"],
    "charged": ["month_bars", "fees"], "charged_levels": ["charged"], "month_labels": ["charged_levels"], "month_outcomes": ["month_labels"],
    "rebuilt": ["states"], "encoded": ["features"], "training_rows": ["encoded"],
}


def with_views(names: list[str], body: str) -> str:
    """A query preceded by the views it needs, dependencies first."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    head = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    return f"WITH {head}\n{body.strip()}"
