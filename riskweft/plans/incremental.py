"""Profiles from merged states, and sketches against exact figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweft.operators import features as X
from riskweft.operators import incremental as I
from riskweft.plans.sql import sql
from riskweft.scratch import kept, scratch_path
from riskweft.sources.adapters import environment as env
from riskweft.sources.adapters import event_transactions as events

QUANTILES = (0.1, 0.5, 0.9)


def _profiles(s, d):
    """Profiles of owned payments: the days come one by one, the second one twice, and the first two become one state."""
    e = env(s, d)
    tx = kept(X.with_owner(e["transactions"], e["accounts"], e["users"]).where("user_id IS NOT NULL"), "payments")
    days = [r["day"] for r in tx.select(F.to_date("ts").alias("day")).distinct().orderBy("day").collect()]
    store = I.ProfileStore(s, f"{scratch_path(s, 'profiles')}/states")
    for i, day in enumerate([*days[:2], *days[1:]]):
        store.add(tx.where(F.to_date("ts") == F.lit(day)))
        if i == 2:
            store.compact(str(days[1]))
    listed = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("")).alias(c)
    rounded = [F.round(c, 6).alias(c) for c in ("mean_amount", "median_amount", "std_amount", "avg_daily_frequency")]
    return store.profiles().select("user_id", "n_transactions", *rounded, *[listed(c) for c in ("hour_histogram", "top_merchants", "known_devices", "known_locations")])


def _sketches(s, d):
    """Sketches of each event type and day, merged over the days, against exact figures."""
    e = events(s, d)
    kept_days = kept(I.daily_sketches(e, ["channel"], "ts", "props", "amount"), "sketches")
    est = I.from_sketches(kept_days, ["channel"], QUANTILES)
    exact = e.groupBy("channel").agg(F.count_distinct("props").alias("distinct_props"))
    ranks = e.join(est.select("channel", "quantiles"), "channel").groupBy("channel").agg(*[F.avg((F.col("amount") <= F.get("quantiles", i)).cast("double")).alias(f"r{i}") for i in range(len(QUANTILES))])
    near = [F.abs(F.col(f"r{i}") - q) <= I.RANK_ERROR for i, q in enumerate(QUANTILES)]
    out = est.join(exact, "channel").join(ranks, "channel")
    right = F.abs(F.col("distinct_estimate") - F.col("distinct_props")) <= I.DISTINCT_ERROR * F.col("distinct_props")
    return out.select("channel", "n", "distinct_props", right.alias("distinct_within_error"), (near[0] & near[1] & near[2]).alias("quantiles_within_error"))


QUERIES = {
    "incremental_profiles": (
        _profiles,
        sql("""SELECT user_id, n_transactions, mean_amount, median_amount, std_amount, avg_daily_frequency, hour_histogram, coalesce(top_merchants, '') AS top_merchants, coalesce(known_devices, '') AS known_devices, coalesce(known_locations, '') AS known_locations FROM
            (SELECT user_id, count(*) AS n_transactions, round(avg(amount), 6) AS mean_amount, round(median(amount), 6) AS median_amount, round(coalesce(stddev_samp(amount), 0), 6) AS std_amount, round(count(*) / (date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1), 6) AS avg_daily_frequency,
                array_to_string(list_transform(range(24), lambda h: len(list_filter(list(hour(ts)), lambda x: x = h))), ',') AS hour_histogram,
                array_to_string(list_sort(list(DISTINCT device_id) FILTER (device_id IS NOT NULL)), ',') AS known_devices, array_to_string(list_sort(list(DISTINCT location_id) FILTER (location_id IS NOT NULL)), ',') AS known_locations
            FROM tx JOIN owner USING (account_id) GROUP BY user_id)
            LEFT JOIN (SELECT user_id, string_agg(merchant_id::VARCHAR, ',' ORDER BY r) AS top_merchants FROM (SELECT user_id, merchant_id, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, merchant_id) AS r FROM tx JOIN owner USING (account_id) WHERE merchant_id IS NOT NULL GROUP BY user_id, merchant_id) WHERE r <= 3 GROUP BY user_id) USING (user_id)"""),
    ),
    "sketches_by_day": (_sketches, "SELECT event_type AS channel, count(*) AS n, count(DISTINCT props) AS distinct_props, true AS distinct_within_error, true AS quantiles_within_error FROM events GROUP BY event_type"),
}
