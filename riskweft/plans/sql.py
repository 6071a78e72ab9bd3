"""SQL of the payment tables and features over the driver's tables, for the side-by-side check."""

from __future__ import annotations


def fixed(x: str, digits: int) -> str:
    """A number as text, half up."""
    return f"printf('%.{digits}f', ({x}) + sign({x}) * 1e-9)"


ENV = """
owner AS (SELECT c_custkey AS account_id, c_custkey // 2 AS user_id, c_nationkey AS nk FROM customer),
users AS (SELECT user_id, n_name AS home_country FROM (SELECT user_id, arg_min(nk, account_id) AS nk FROM owner GROUP BY user_id) LEFT JOIN nation ON nk = n_nationkey),
merchants AS (SELECT s_suppkey AS merchant_id, n_name AS country, CASE WHEN s_acctbal < 1000 THEN 'high' WHEN s_acctbal < 5000 THEN 'medium' ELSE 'low' END AS risk_band FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
locations AS (SELECT n_nationkey::BIGINT AS location_id, n_name AS country, (n_nationkey::BIGINT * 7 % 121 - 60)::DOUBLE AS lat, (n_nationkey::BIGINT * 29 % 341 - 170)::DOUBLE AS lon FROM nation),
tx AS (
  SELECT o_orderkey AS txn_id, o_custkey AS account_id, device_id, merchant_id, s_nationkey::BIGINT AS location_id,
    TIMESTAMP '2024-01-01' + to_seconds(date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 120 + o_orderkey * 7919 % 3600) AS ts,
    floor(o_totalprice) / 100.0::DOUBLE AS amount,
    CASE o_orderpriority WHEN '2-HIGH' THEN 'pos' WHEN '3-MEDIUM' THEN 'atm' WHEN '4-NOT SPECIFIED' THEN 'mobile' ELSE 'online' END AS channel,
    o_orderstatus AS status, (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')::INTEGER AS label_fraud, o_orderpriority AS scenario_tag
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS merchant_id, min(l_partkey) % 200 AS device_id FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
  LEFT JOIN supplier ON s_suppkey = merchant_id),
known AS (SELECT account_id, device_id, min(ts) AS first_used_ts, max(ts) AS last_used_ts FROM tx WHERE txn_id % 3 <> 0 AND device_id IS NOT NULL GROUP BY ALL),
links AS (SELECT *, device_id = min(device_id) OVER (PARTITION BY account_id) AS is_primary FROM known)"""

FEATURES = """,
j AS (
  SELECT tx.*, o.user_id, CASE WHEN o.user_id IS NULL THEN tx.account_id END AS lone, u.home_country, l.country AS tx_country, l.lat, l.lon, m.risk_band, k.first_used_ts, k.is_primary, c.n AS device_accounts
  FROM tx LEFT JOIN owner o USING (account_id) LEFT JOIN users u USING (user_id) LEFT JOIN locations l USING (location_id) LEFT JOIN merchants m USING (merchant_id)
  LEFT JOIN links k ON k.account_id = tx.account_id AND k.device_id = tx.device_id
  LEFT JOIN (SELECT device_id, count(DISTINCT account_id) AS n FROM links GROUP BY device_id) c ON c.device_id = tx.device_id),
h AS (
  SELECT *, (count(*) OVER h)::INTEGER AS prior_tx_count, coalesce((sum(amount::DECIMAL(18,2)) OVER h)::DOUBLE, 0) AS prior_total_amount,
    (sum(amount::DECIMAL(18,2)) OVER h)::DOUBLE / nullif(count(amount) OVER h, 0) AS prior_mean_amount,
    CASE WHEN count(*) OVER h >= 2 THEN stddev_pop(amount) OVER h END AS prior_std_amount,
    (count(DISTINCT merchant_id) OVER h)::INTEGER AS prior_unique_merchants, (count(DISTINCT device_id) OVER h)::INTEGER AS prior_unique_devices,
    (count(DISTINCT location_id) OVER h)::INTEGER AS prior_unique_locations,
    (count(DISTINCT tx_country) OVER (PARTITION BY user_id, lone ORDER BY txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INTEGER AS prior_unique_countries,
    lag(txn_id) OVER a AS prev_id, lag(location_id) OVER a AS prev_location_id, lag(tx_country) OVER a AS prev_country, lag(lat) OVER a AS prev_lat, lag(lon) OVER a AS prev_lon
  FROM j WINDOW h AS (PARTITION BY user_id, lone ORDER BY ts, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY account_id ORDER BY ts, txn_id)),
v AS (
  SELECT x.txn_id, count(y.txn_id) FILTER (x.ts - y.ts < INTERVAL 300 SECOND)::INTEGER AS vel_count_300s, coalesce(sum(y.amount::DECIMAL(18,2)) FILTER (x.ts - y.ts < INTERVAL 300 SECOND), 0)::DOUBLE AS vel_amount_300s,
    count(y.txn_id) FILTER (x.ts - y.ts < INTERVAL 3600 SECOND)::INTEGER AS vel_count_3600s, coalesce(sum(y.amount::DECIMAL(18,2)) FILTER (x.ts - y.ts < INTERVAL 3600 SECOND), 0)::DOUBLE AS vel_amount_3600s,
    count(y.txn_id) FILTER (x.ts - y.ts < INTERVAL 86400 SECOND)::INTEGER AS vel_count_86400s, coalesce(sum(y.amount::DECIMAL(18,2)) FILTER (x.ts - y.ts < INTERVAL 86400 SECOND), 0)::DOUBLE AS vel_amount_86400s,
    CASE WHEN any_value(x.amount) > 1000 THEN count(y.txn_id) FILTER (y.amount > 1000 AND x.ts - y.ts < INTERVAL 3600 SECOND) ELSE 0 END::INTEGER AS vel_high_value_count_3600s
  FROM tx x LEFT JOIN tx y ON x.account_id = y.account_id AND (y.ts < x.ts OR (y.ts = x.ts AND y.txn_id < x.txn_id)) GROUP BY x.txn_id),
z AS (SELECT *, pow(sin((radians(coalesce(lat, 0)) - radians(coalesce(prev_lat, 0))) / 2), 2) + cos(radians(coalesce(prev_lat, 0))) * cos(radians(coalesce(lat, 0))) * pow(sin((radians(coalesce(lon, 0)) - radians(coalesce(prev_lon, 0))) / 2), 2) AS hav FROM h),
f AS (
  SELECT z.*, v.* EXCLUDE (txn_id), ln(1 + amount) AS amount_log, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS day_of_week, (hour(ts) >= 2 AND hour(ts) < 5)::INTEGER AS is_offhours,
    (amount > 1000)::INTEGER AS is_high_value, (channel = 'online')::INTEGER AS is_online, (channel = 'pos')::INTEGER AS is_pos, (channel = 'atm')::INTEGER AS is_atm, (channel = 'mobile')::INTEGER AS is_mobile,
    coalesce(risk_band = 'high', false)::INTEGER AS is_high_risk_merchant, CASE risk_band WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END::INTEGER AS merchant_risk_band_ord,
    CASE WHEN prior_std_amount IS NULL THEN NULL WHEN prior_std_amount = 0 THEN CASE WHEN amount = prior_mean_amount THEN NULL ELSE sign(amount - prior_mean_amount) * 'Infinity'::DOUBLE END ELSE (amount - prior_mean_amount) / prior_std_amount END AS amount_zscore,
    ln(1 + amount) - ln(1 + prior_mean_amount) AS amount_log_ratio, (prior_tx_count < 5)::INTEGER AS is_new_user,
    (first_used_ts IS NULL OR first_used_ts > ts)::INTEGER AS is_new_device, coalesce(device_accounts, 1)::INTEGER AS device_account_count, (coalesce(device_accounts, 1) >= 2)::INTEGER AS device_is_shared, coalesce(is_primary, false)::INTEGER AS is_primary_device_for_account,
    (prev_id IS NOT NULL AND (tx_country IS NULL OR prev_country IS NULL OR tx_country <> prev_country))::INTEGER AS country_switch,
    CASE WHEN prev_id IS NULL THEN 0.0 ELSE 2 * 6371.0::DOUBLE * asin(sqrt(least(greatest(hav, 0), 1))) END AS distance_to_prev_km,
    (home_country IS NOT NULL AND (tx_country IS NULL OR tx_country <> home_country))::INTEGER AS is_unusual_location
  FROM z JOIN v USING (txn_id))"""

RISK = """,
g AS (
  SELECT *, (floor(amount)::BIGINT % 101) / 100.0::DOUBLE AS xgb_score, (txn_id * 37 % 101) / 100.0::DOUBLE AS anomaly_score,
    vel_count_300s >= 5 AS r1, is_new_device = 1 AND amount > 500 AS r2, is_unusual_location = 1 AS r3, coalesce(abs(amount_zscore) > 3, false) AS r4,
    device_is_shared = 1 AS r5, is_offhours = 1 AND amount > 1000 AS r6, vel_count_300s >= 8 AS r7, is_new_device = 1 AS r8,
    CASE WHEN amount_zscore IS NULL OR isinf(amount_zscore) THEN 0 ELSE abs(amount_zscore) END AS za FROM f),
s AS (
  SELECT *, (CASE WHEN r1 THEN 0.5 ELSE 0 END + CASE WHEN r2 THEN 0.75 ELSE 0 END + CASE WHEN r3 THEN 0.5 ELSE 0 END + CASE WHEN r4 THEN 0.75 ELSE 0 END + CASE WHEN r5 THEN 0.5 ELSE 0 END + CASE WHEN r6 THEN 0.75 ELSE 0 END + CASE WHEN r7 THEN 1.0 ELSE 0 END + CASE WHEN r8 THEN 0.25 ELSE 0 END)::DOUBLE / 5 AS rule_score,
    least(CASE WHEN za > 3 THEN 0.4 WHEN za > 2 THEN 0.25 WHEN za > 1 THEN 0.1 ELSE 0 END::DOUBLE + 0.2::DOUBLE * is_new_device + 0.2::DOUBLE * is_unusual_location + 0.15::DOUBLE * is_new_user + 0.15::DOUBLE * country_switch + 0.1::DOUBLE * device_is_shared + 0.05::DOUBLE * is_offhours, 1) AS behavioral_score,
    least(greatest(CASE WHEN device_account_count >= 4 THEN 0.9 WHEN device_account_count >= 3 THEN 0.7 WHEN device_account_count >= 2 THEN 0.5 ELSE 0 END, CASE WHEN vel_count_300s >= 8 THEN 0.85 WHEN vel_count_300s >= 5 THEN 0.6 ELSE 0 END)::DOUBLE + CASE WHEN prior_unique_countries >= 3 THEN 0.15 WHEN prior_unique_countries >= 2 THEN 0.08 ELSE 0 END::DOUBLE, 1) AS graph_score
  FROM g),
risk AS (
  SELECT *, CASE WHEN risk_score > 0.7 THEN 'RED' WHEN risk_score > 0.3 THEN 'YELLOW' ELSE 'GREEN' END AS risk_level,
    CASE WHEN risk_score > 0.7 THEN CASE WHEN amount > 1000 THEN 'BLOCK' ELSE 'INVESTIGATE' END WHEN risk_score > 0.3 THEN 'STEP_UP' ELSE 'APPROVE' END AS decision,
    list_filter(['high_velocity', 'new_device_high_value', 'unusual_location', 'unusual_amount', 'shared_device', 'offhours_high_value', 'burst_velocity', 'new_device'], lambda x, i: [r1, r2, r3, r4, r5, r6, r7, r8][i]) AS triggered_rules
  FROM (SELECT *, least(greatest(0.35::DOUBLE * xgb_score + 0.2::DOUBLE * anomaly_score + 0.15::DOUBLE * behavioral_score + 0.1::DOUBLE * graph_score + 0.2::DOUBLE * rule_score, 0), 1) AS risk_score FROM s)),
ev AS (
  SELECT *, CASE WHEN len(e0) = 0 AND (risk_score > 0.3 OR xgb_score > 0.5 OR anomaly_score > 0.5 OR behavioral_score > 0.3 OR graph_score > 0.3 OR rule_score > 0.2) THEN ['elevated_risk: score=' || """ + fixed("risk_score", 2) + """] ELSE e0 END AS evidence
  FROM (SELECT *, list_filter([
    CASE WHEN vel_count_300s >= 5 THEN 'high_velocity: ' || vel_count_300s || ' txns in 5min' END,
    CASE WHEN vel_count_300s >= 8 THEN 'burst_velocity: ' || vel_count_300s || ' txns in 5min' END,
    CASE WHEN device_is_shared = 1 THEN 'shared_device: ' || device_account_count || ' accounts' END,
    CASE WHEN r2 THEN 'new_device_high_value: amount=' || """ + fixed("amount", 2) + """ WHEN is_new_device = 1 THEN 'new_device' END,
    CASE WHEN is_unusual_location = 1 THEN 'unusual_location: distance=' || """ + fixed("distance_to_prev_km", 1) + """ || 'km' END,
    CASE WHEN country_switch = 1 AND is_unusual_location = 0 THEN 'country_switch' END,
    CASE WHEN abs(amount_zscore) > 2 THEN 'unusual_amount: z=' || """ + fixed("amount_zscore", 1) + """ END,
    CASE WHEN r6 THEN 'offhours_high_value: amount=' || """ + fixed("amount", 2) + """ END,
    CASE WHEN r2 THEN 'rule:new_device_high_value' END,
    CASE WHEN xgb_score > 0.6 THEN 'ml_flagged: fraud_prob=' || """ + fixed("xgb_score", 2) + """ END,
    CASE WHEN anomaly_score > 0.6 THEN 'anomalous_pattern: score=' || """ + fixed("anomaly_score", 2) + """ END,
    CASE WHEN graph_score > 0.5 AND device_is_shared = 0 THEN 'graph_risk: score=' || """ + fixed("graph_score", 2) + """ END,
    CASE WHEN is_new_user = 1 AND is_new_device = 0 THEN 'new_user' END], lambda x: x IS NOT NULL) AS e0 FROM risk)),
tx_text AS (
  SELECT txn_id, list_filter([
    CASE WHEN prior_mean_amount > 0 AND (exp(amount_log) - 1) / prior_mean_amount > 2 THEN 'amount ' || """ + fixed("(exp(amount_log) - 1) / prior_mean_amount", 1) + """ || 'x above user mean' END,
    CASE WHEN isinf(amount_zscore) THEN NULL WHEN amount_zscore > 3 THEN 'amount z-score ' || """ + fixed("amount_zscore", 1) + """ || ' well above user mean' WHEN amount_zscore > 2 THEN 'amount z-score ' || """ + fixed("amount_zscore", 1) + """ || ' above user mean' WHEN amount_zscore < -2 THEN 'amount z-score ' || """ + fixed("amount_zscore", 1) + """ || ' below user mean' END,
    CASE WHEN amount_log_ratio > 1 AND NOT coalesce((exp(amount_log) - 1) / nullif(prior_mean_amount, 0) > 2, false) AND exp(amount_log_ratio) > 2 THEN 'amount ' || """ + fixed("exp(amount_log_ratio)", 1) + """ || 'x above user mean (log ratio ' || """ + fixed("amount_log_ratio", 2) + """ || ')' END,
    CASE WHEN is_new_device = 1 THEN 'new device' END,
    CASE WHEN device_is_shared = 1 THEN 'shared device (used by ' || device_account_count || ' accounts)' END,
    CASE WHEN vel_count_300s >= 3 THEN 'velocity burst: ' || vel_count_300s || ' txns in 5min' END,
    CASE WHEN vel_count_3600s >= 5 THEN CASE WHEN vel_count_300s >= 3 THEN 'also ' ELSE 'high velocity: ' END || vel_count_3600s || ' txns in 1h' END,
    CASE WHEN vel_high_value_count_3600s >= 2 THEN vel_high_value_count_3600s || ' high-value txns in 1h' END,
    CASE WHEN is_unusual_location = 1 THEN 'unusual location (outside home country)' END,
    CASE WHEN country_switch = 1 THEN 'country switch from previous transaction' END,
    CASE WHEN distance_to_prev_km > 200 THEN 'large distance to previous location: ' || """ + fixed("distance_to_prev_km", 0) + """ || ' km' WHEN distance_to_prev_km > 100 THEN 'distance to previous location: ' || """ + fixed("distance_to_prev_km", 0) + """ || ' km' END,
    CASE WHEN is_high_value = 1 THEN 'high-value transaction (amount_log ' || """ + fixed("amount_log", 2) + """ || ')' END,
    CASE WHEN is_new_user = 1 THEN 'new user (few prior transactions)' END,
    CASE WHEN is_offhours = 1 THEN 'off-hours transaction (hour ' || hour || ')' END,
    CASE WHEN is_high_risk_merchant = 1 THEN 'high-risk merchant category' END], lambda x: x IS NOT NULL) AS texts FROM risk)"""

SCORED = """,
sc AS (SELECT txn_id, label_fraud AS label, (floor(amount)::BIGINT % 101) / 100.0::DOUBLE AS score FROM tx),
ps AS (SELECT score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM sc GROUP BY score),
cv AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM ps WINDOW w AS (ORDER BY score DESC)),
rt AS (SELECT score, pos, neg, tp, fp, p, n, fp::DOUBLE / n AS fpr, tp::DOUBLE / p AS tpr, tp::DOUBLE / (tp + fp) AS prec FROM cv)"""


def sql(body: str, *parts: str) -> str:
    """body after the environment and further parts."""
    return f"WITH {ENV}{''.join(parts)}\n{body}"
