"""A synthetic payment environment from seeded hashes: the same rows for the same seed, whatever the partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweft.operators.prepare import hash_rank, with_rank
from riskweft.schema import TABLES
from riskweft.scratch import kept

#: Countries, categories, weights of the hours, episodes of each scenario, weight of a high-risk merchant
#: in the background (and its share of the payments in the hard form), channels.
COUNTRIES = ["US", "GB", "DE", "FR", "IN", "BR", "NG", "RU", "JP", "MX"]
CATEGORIES = ["grocery", "fuel", "restaurant", "retail", "travel", "electronics", "pharmacy", "entertainment", "utilities", "cash_advance"]
HOUR_WEIGHTS = [0.4, 0.2, 0.1, 0.05, 0.05, 0.1, 0.3, 0.6, 1.0, 1.2, 1.4, 1.5, 1.6, 1.4, 1.3, 1.4, 1.5, 1.6, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5]
SCENARIOS = {"account_takeover": 30, "unusual_amount_time": 60, "transaction_velocity": 40, "new_device": 80, "unusual_location": 60, "device_sharing": 20, "mule_behavior": 15, "unusual_merchant": 50}
HIGH_RISK_WEIGHT, HARD_HIGH_RISK_SHARE = 0.05, 0.20
CHANNELS = ["online", "pos", "atm", "mobile"]


@dataclass(frozen=True)
class Blend:
    """A form that a hard scenario takes with the given chance: which weak signals come together."""

    chance: float
    mu: float
    sigma: float
    signal: str
    new_device: bool = False
    high_risk: float = 0.0  # chance of a high-risk merchant; any merchant otherwise
    night: float = 0.0
    foreign: float = 0.0


#: The hard scenarios, 20 rows each.
HARD_SCENARIOS = {
    "hard_moderate_amo_dev": [Blend(1, 3.9, 0.6, "moderate_amount+new_device", new_device=True)],
    "hard_normal_amount_new_device_merchant": [Blend(1, 3.5, 0.5, "normal_amount+new_device+merchant", new_device=True, high_risk=0.5)],
    "hard_high_amount_normal_location_velocity": [Blend(1, 5.5, 0.5, "high_amount_only")],
    "hard_normal_amount_normal_device_merchant": [Blend(1, 3.7, 0.7, "weak_signals_only", night=0.3, foreign=0.2)],
    "hard_mixed_signals": [
        Blend(0.25, 4.0, 0.4, "combo_0"),
        Blend(0.25, 3.6, 0.5, "combo_1", foreign=1.0),
        Blend(0.25, 3.5, 0.6, "combo_2", new_device=True, night=1.0),
        Blend(0.25, 3.7, 0.6, "combo_3", high_risk=1.0),
    ],
}
HARD_EPISODES = 20

#: Payments that one set of episodes goes with.
EPISODES_PER = 5000


@dataclass(frozen=True)
class EnvironmentConfig:
    users: int = 200
    accounts: int = 250
    devices: int = 220
    merchants: int = 80
    locations: int = 60
    transactions: int = 5000
    days: int = 30
    start: str = "2026-01-01"
    seed: int = 1729
    scenarios: dict[str, int] = field(default_factory=lambda: dict(SCENARIOS))
    hard: bool = False

    @classmethod
    def dev(cls) -> EnvironmentConfig:
        return cls(2000, 3000, 2500, 500, 400, 50_000, seed=42)

    @classmethod
    def hard_overlap(cls) -> EnvironmentConfig:
        return cls(transactions=9000, scenarios=dict.fromkeys(HARD_SCENARIOS, HARD_EPISODES), hard=True)

    def like(self, env: Mapping[str, DataFrame]) -> EnvironmentConfig:
        """With as many rows of each table as the given ones have, and episodes in proportion to the payments."""
        sizes = {name: max(1, env[name].count()) for name in ("users", "accounts", "devices", "merchants", "locations", "transactions")}
        times = max(1, sizes["transactions"] // EPISODES_PER)
        return replace(self, **sizes | {"locations": max(len(COUNTRIES), sizes["locations"])}, scenarios={k: n * times for k, n in self.scenarios.items()})


class Draws:
    """Uniform, normal and integer draws that are functions of (seed, stream, row)."""

    def __init__(self, seed: int, key: Column | str):
        self.seed, self.key = seed, F.col(key) if isinstance(key, str) else key

    def uniform(self, stream: str) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.lit(stream), self.key), 11).cast("double") + 0.5) / float(2**53)

    def integer(self, stream: str, low: int, high: int) -> Column:
        """low to high, both included."""
        return (F.lit(low) + F.floor(self.uniform(stream) * (high - low + 1))).cast("long")

    def between(self, stream: str, low: float, high: float) -> Column:
        return F.lit(low) + self.uniform(stream) * (high - low)

    def normal(self, stream: str) -> Column:
        return F.sqrt(-2 * F.log(self.uniform(stream))) * F.cos(2 * F.pi() * self.uniform(f"{stream}'"))

    def lognormal(self, stream: str, mu: float, sigma: float) -> Column:
        return F.round(F.exp(mu + sigma * self.normal(stream)), 2)

    def pick(self, stream: str, values: list[str], weights: list[float] | None = None) -> Column:
        w = weights or [1.0] * len(values)
        u, done, out = self.uniform(stream) * sum(w), 0.0, F
        for value, x in zip(values[:-1], w[:-1], strict=True):
            done += x
            out = out.when(u < done, value)
        return out.otherwise(values[-1]) if len(values) > 1 else F.lit(values[0])


def _ids(spark: SparkSession, n: int, name: str) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", name)


def entities(spark: SparkSession, c: EnvironmentConfig) -> dict[str, DataFrame]:
    start = F.lit(c.start).cast("timestamp")
    before = lambda d, s: start - F.make_dt_interval(d.integer(s, 1, 700).cast("int"))
    u, a, v, m, p = Draws(c.seed, "user_id"), Draws(c.seed, "account_id"), Draws(c.seed, "device_id"), Draws(c.seed, "merchant_id"), Draws(c.seed, "location_id")
    users = _ids(spark, c.users, "user_id").select("user_id", before(u, "signup").alias("signup_ts"), u.pick("home", COUNTRIES).alias("home_country"), u.pick("segment", ["standard", "premium", "student"], [0.7, 0.2, 0.1]).alias("risk_segment"))
    owner = F.when(F.col("account_id") <= c.users, F.col("account_id")).otherwise(a.integer("owner", 1, c.users))
    accounts = _ids(spark, c.accounts, "account_id").select("account_id", owner.alias("user_id"), before(a, "opened").alias("opened_ts"), a.pick("kind", ["checking", "savings", "credit"]).alias("account_type"), a.pick("status", ["active", "dormant", "closed"], [0.94, 0.04, 0.02]).alias("status"))
    devices = _ids(spark, c.devices, "device_id").select("device_id", v.pick("kind", ["ios", "android", "web", "pos_terminal", "atm"]).alias("device_type"), F.lower(F.lpad(F.hex(F.xxhash64(F.lit(c.seed), "device_id")), 16, "0")).alias("fingerprint_hash"), before(v, "seen").alias("first_seen_ts"))
    category = m.pick("category", CATEGORIES)
    band = F.when(F.col("category") == "cash_advance", "high").otherwise(m.pick("band", ["low", "medium", "high"], [0.75, 0.2, 0.05]))
    merchants = _ids(spark, c.merchants, "merchant_id").withColumn("category", category).select("merchant_id", F.concat(F.lit("merchant "), "merchant_id").alias("name"), "category", m.integer("mcc", 1000, 9999).cast("int").alias("mcc_code"), m.pick("country", COUNTRIES).alias("country"), band.alias("risk_band"))
    # every country has a location
    country = F.element_at(F.array(*[F.lit(x) for x in COUNTRIES]), ((F.col("location_id") - 1) % len(COUNTRIES) + 1).cast("int"))
    locations = _ids(spark, c.locations, "location_id").select("location_id", F.concat(F.lit("city "), "location_id").alias("city"), country.alias("country"), country.alias("region"), p.between("lat", -60, 70).alias("lat"), p.between("lon", -180, 180).alias("lon"))
    return {"users": users, "accounts": accounts, "devices": devices, "merchants": merchants, "locations": locations}


def links(spark: SparkSession, c: EnvironmentConfig) -> DataFrame:
    """One to three devices of each account; its first is primary."""
    base = _ids(spark, c.accounts, "account_id")
    n = Draws(c.seed, "account_id").integer("devices", 1, 3)
    each = base.select("account_id", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("i"))
    d = Draws(c.seed, F.concat_ws("/", "account_id", "i"))
    start = F.lit(c.start).cast("timestamp")
    return (
        each.withColumn("device_id", d.integer("device", 1, c.devices))
        .groupBy("account_id", "device_id")
        .agg(F.min("i").alias("i"))
        .select("account_id", "device_id", (start - F.make_dt_interval(F.lit(30))).alias("first_used_ts"), (start + F.make_dt_interval(F.lit(c.days))).alias("last_used_ts"), (F.col("i") == 1).alias("is_primary"))
    )


@dataclass(frozen=True)
class Merchants:
    """(__kind, __number, merchant_id): merchants numbered from 1 within the high-risk ones and within the others."""

    numbered: DataFrame
    high: int
    others: int

    @classmethod
    def of(cls, merchants: DataFrame) -> Merchants:
        ranked = hash_rank(merchants.select("merchant_id", F.coalesce(F.col("risk_band") == "high", F.lit(False)).alias("__kind")), "__kind", "merchant_id", 0)
        numbered = kept(ranked.select("__kind", F.col("__place").cast("long").alias("__number"), "merchant_id"), "merchants")
        n = {r["__kind"]: r["count"] for r in numbered.groupBy("__kind").count().collect()}  # two rows
        return cls(numbered, n.get(True, 0), n.get(False, 0))

    def high_share(self, weight: float) -> float:
        """Chance of a high-risk merchant if each of them has the weight and each other one 1."""
        return self.high * weight / max(1e-12, self.high * weight + self.others)

    def pick(self, rows: DataFrame, d: Draws, high_share: Column, stream: str = "merchant") -> DataFrame:
        """Adds merchant_id: a high-risk one with the given chance, and evenly among those of its kind."""
        high = d.uniform(f"{stream} kind") < high_share if self.high and self.others else F.lit(bool(self.high))
        number = F.when(F.col("__high"), d.integer(stream, 1, max(1, self.high))).otherwise(d.integer(stream, 1, max(1, self.others)))
        picked = rows.withColumn("__high", high).withColumn("__n", number)
        return picked.join(self.numbered, (F.col("__high") == F.col("__kind")) & (F.col("__n") == F.col("__number"))).drop("__high", "__n", "__kind", "__number")


def _numbered(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(__number from 1, key) in order of the key, and how many there are."""
    ranked = kept(with_rank(df.select(key), [key], "__number"), "numbered")
    return ranked.withColumn("__number", F.col("__number").cast("long")), ranked.count()


def _chosen(rows: DataFrame, env: Mapping[str, DataFrame], c: EnvironmentConfig) -> DataFrame:
    """Adds a device that the account knows and one that it doesn't, and places: at home, anywhere, and abroad."""
    d = Draws(c.seed, "row")
    owners = env["accounts"].join(env["users"].select("user_id", "home_country"), "user_id").select("account_id", "home_country")
    known = env["account_devices"].groupBy("account_id").agg(F.array_sort(F.collect_list("device_id")).alias("known"))  # three at most
    out = rows.join(owners, "account_id").join(known, "account_id")
    country = F.array_position(F.array(*[F.lit(x) for x in COUNTRIES]), F.col("home_country"))
    place = country + len(COUNTRIES) * d.integer("home place", 0, max(0, c.locations // len(COUNTRIES) - 1))
    used = F.element_at("known", (1 + d.integer("device", 0, 99) % F.size("known")).cast("int"))
    # the n-th device outside the known ones: each of these that is no larger moves it up
    left = F.lit(c.devices) - F.size("known")
    other = F.aggregate("known", F.lit(1).cast("long") + F.floor(d.uniform("other device") * left), lambda n, x: n + (n >= x).cast("long"))
    return out.withColumns(
        {
            "__used": used,
            "__other": F.when(left > 0, other).otherwise(used),
            "__home": place,
            "__any": d.integer("place", 1, c.locations),
            "__away": 1 + (place - 1 + 1 + d.integer("away", 0, len(COUNTRIES) - 2)) % len(COUNTRIES),
        }
    )


def _hour(d: Draws) -> Column:
    return d.pick("hour", [str(h) for h in range(24)], HOUR_WEIGHTS).cast("int")


def _payment(label: Column, tag: str, extra: Column) -> list[Column]:
    return [label.cast("int").alias("label_fraud"), F.lit(tag).alias("scenario_tag"), extra.alias("scenario_extra")]


PAYMENT = ["row", "account_id", "device_id", "merchant_id", "location_id", "second", "amount", "channel"]


def background(spark: SparkSession, c: EnvironmentConfig, env: Mapping[str, DataFrame], merchants: Merchants) -> DataFrame:
    """Payments of active accounts (of all if none is active)."""
    d = Draws(c.seed, "row")
    accounts, n = _numbered(env["accounts"].where("status = 'active'"), "account_id")
    if not n:
        accounts, n = _numbered(env["accounts"], "account_id")
    rows = spark.range(c.transactions).withColumnRenamed("id", "row").withColumn("__number", d.integer("account", 1, max(1, n))).join(accounts, "__number").drop("__number")
    rows = _chosen(rows, env, c)
    rows = merchants.pick(rows, d, F.lit(HARD_HIGH_RISK_SHARE if c.hard else merchants.high_share(HIGH_RISK_WEIGHT)))
    seconds = d.integer("day", 0, c.days - 1) * 86400 + _hour(d) * 3600 + d.integer("second", 0, 3599)
    device = F.when(d.uniform("new device") < 0.1, F.col("__other")).otherwise(F.col("__used")) if c.hard else F.col("__used")
    location = F.when(d.uniform("stay") < (0.7 if c.hard else 0.9), F.col("__home")).otherwise(F.col("__any"))
    rows = rows.withColumns({"device_id": device, "location_id": location, "second": seconds, "amount": d.lognormal("amount", 3.6, 0.95), "channel": d.pick("channel", CHANNELS)})
    return rows.select(*PAYMENT, *_payment(F.lit(0), "background", F.lit("")))


def hard_rows(spark: SparkSession, c: EnvironmentConfig, env: Mapping[str, DataFrame], merchants: Merchants, tag: str, episodes: int, base: int) -> DataFrame:
    """Single payments that blend weak signals; all are labelled."""
    d, blends, done = Draws(c.seed, "row"), HARD_SCENARIOS[tag], 0.0
    rows = spark.range(episodes).select((F.lit(base) + F.col("id")).alias("row")).withColumn("account_id", d.integer("account", 1, c.accounts))
    roll, at = d.uniform("blend"), F
    for i, b in enumerate(blends[:-1]):
        done += b.chance
        at = at.when(roll < done, i)
    rows = _chosen(rows.withColumn("__blend", at.otherwise(len(blends) - 1) if len(blends) > 1 else F.lit(0)), env, c)
    of = lambda name: F.element_at(F.array(*[F.lit(getattr(b, name)) for b in blends]), F.col("__blend") + 1)
    # any merchant, or for sure a high-risk one
    high = of("high_risk") + (1 - of("high_risk")) * F.lit(merchants.high_share(1.0))
    rows = merchants.pick(rows, d, high)
    hour = F.when(d.uniform("night") < of("night"), d.integer("night hour", 2, 4)).otherwise(d.integer("business hour", 9, 18))
    amount = F.round(F.exp(of("mu") + of("sigma") * d.normal("amount")), 2)
    rows = rows.withColumns(
        {
            "device_id": F.when(of("new_device"), F.col("__other")).otherwise(F.col("__used")),
            "location_id": F.when(d.uniform("foreign") < of("foreign"), F.col("__away")).otherwise(F.col("__home")),
            "second": d.integer("day", 0, c.days - 1) * 86400 + hour * 3600 + d.integer("second", 0, 3599),
            "amount": amount,
            "channel": F.lit("online"),
        }
    )
    return rows.select(*PAYMENT, *_payment(F.lit(1), tag, F.to_json(F.struct(of("signal").alias("signal")))))


def scenario_rows(spark: SparkSession, c: EnvironmentConfig, env: Mapping[str, DataFrame], merchants: Merchants) -> DataFrame:
    """Episodes of the labelled scenarios; each is a few rows of one account."""
    parts = []
    for k, (tag, episodes) in enumerate(c.scenarios.items()):
        base = 1_000_000_000_000 * (k + 1)
        if tag in HARD_SCENARIOS:
            parts.append(hard_rows(spark, c, env, merchants, tag, episodes, base))
            continue
        e = Draws(c.seed, F.concat_ws("/", F.lit(tag), "episode"))
        size = {"transaction_velocity": e.integer("n", 8, 12), "mule_behavior": e.integer("n", 5, 9), "account_takeover": e.integer("n", 2, 3)}.get(tag, F.lit(1).cast("long"))
        rows = spark.range(episodes).withColumnRenamed("id", "episode").withColumns({"account_id": e.integer("account", 1, c.accounts), "n": size, "t": e.integer("day", 1, c.days - 2) * 86400 + e.integer("second", 3600, 82000)})
        rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i")).withColumn("row", F.lit(base) + F.col("episode") * 100 + F.col("i"))
        rows = _chosen(rows, env, c)
        d, last = Draws(c.seed, "row"), F.col("i") == F.col("n")
        second, amount, flagged = F.col("t") + F.col("i") * 60, d.lognormal("amount", 3.6, 0.95), last
        device, location = F.col("__used"), F.when(d.uniform("stay") < 0.9, F.col("__home")).otherwise(F.col("__any"))
        if tag == "account_takeover":
            amount = F.when(last, d.lognormal("high", 7.5, 0.4)).otherwise(amount)
        elif tag == "unusual_amount_time":
            second, amount = F.floor(F.col("t") / 86400) * 86400 + d.integer("night", 2 * 3600, 5 * 3600 + 3599), F.round(d.between("high", 800, 4500), 2)
        elif tag == "transaction_velocity":
            second, amount, flagged = F.col("t") + d.integer("burst", 0, 599), F.round(d.between("low", 5, 250), 2), F.lit(True)
        elif tag == "new_device":
            device, amount = F.col("__other"), d.lognormal("high", 5.0, 0.7)
        elif tag == "device_sharing":
            device, amount = d.integer("shared device", 1, c.devices), d.lognormal("high", 6.5, 0.7)
        elif tag == "unusual_location":
            location, amount = F.col("__away"), d.lognormal("high", 5.5, 0.8)
        elif tag == "mule_behavior":
            second = F.when(last, F.col("t")).otherwise(F.col("t") - d.integer("inbound", 1, 3599))
            amount = F.when(last, F.round(d.between("out", 1500, 8000), 2)).otherwise(F.round(d.between("in", 20, 200), 2))
        elif tag == "unusual_merchant":
            amount = F.round(d.between("high", 500, 3500), 2)
        rows = merchants.pick(rows, d, F.lit(1.0 if tag == "unusual_merchant" else merchants.high_share(1.0)))
        rows = rows.withColumns({"device_id": device, "location_id": location, "second": second, "amount": amount, "channel": d.pick("channel", ["online", "pos", "mobile"])})
        parts.append(rows.select(*PAYMENT, *_payment(flagged, tag, F.to_json(F.struct("episode")))))
    return reduce(DataFrame.unionByName, parts)


#: Seconds by which repeated (account, time) rows are moved, the first that is free; the last two in the hard form only.
JITTER, HARD_JITTER = [0, 1, -1, 2, -2], [0, 1, -1, 2, -2, 3, -3]


def spread_collisions(rows: DataFrame, keys: tuple[str, ...], ts: str, order: str, taken: DataFrame | None = None, offsets: Sequence[int] = tuple(JITTER)) -> DataFrame:
    """Moves rows so that keys and time are unique: each row in turn takes the first offset whose time neither a row
    before it nor a taken one has; a row for which all are taken keeps its time.

    Rows of the same keys are cut into chains of times that could meet; a chain is moved by itself, rows alone in theirs
    are not touched. All rows of one (keys, time) are in one chain. taken has the columns of rows; its rows stay.
    """
    reach = 2 * max(map(abs, offsets)) * 1_000_000
    at = F.unix_micros(F.col(ts))
    every = rows.select(*keys, at.alias("__t"), F.col(order).alias("__o"), F.struct(*rows.columns).alias("__row"), F.lit(False).alias("__fixed"))
    if taken is not None:
        none = F.lit(None).cast(every.schema["__row"].dataType)
        every = every.unionByName(taken.select(*keys, at.alias("__t"), F.lit(None).cast(every.schema["__o"].dataType).alias("__o"), none.alias("__row"), F.lit(True).alias("__fixed")))
    over = Window.partitionBy(*keys).orderBy("__t")
    begins = F.coalesce(F.col("__t") - F.lag("__t").over(over) > reach, F.lit(True)).cast("int")
    every = every.withColumn("__begins", begins).withColumn("__chain", F.sum("__begins").over(over.rangeBetween(Window.unboundedPreceding, 0)))
    movable = F.when(~F.col("__fixed"), F.struct("__o", "__t", "__row"))
    chains = every.groupBy(*keys, "__chain").agg(F.array_sort(F.collect_list(movable)).alias("__rows"), F.collect_set(F.when(F.col("__fixed"), F.col("__t"))).alias("__used")).where(F.size("__rows") > 0)
    steps = F.array(*[F.lit(x * 1_000_000).cast("long") for x in offsets])

    def place(state: Column, row: Column) -> Column:
        free = F.filter(F.transform(steps, lambda x: row["__t"] + x), lambda t: ~F.array_contains(state["used"], t))
        to = F.coalesce(F.get(free, 0), row["__t"])
        return F.struct(F.array_union(state["used"], F.array(to)).alias("used"), F.concat(state["to"], F.array(to)).alias("to"))

    start = F.struct(F.col("__used").alias("used"), F.array().cast("array<long>").alias("to"))
    moved = chains.withColumn("__to", F.when(F.size("__rows") + F.size("__used") == 1, F.transform("__rows", lambda r: r["__t"])).otherwise(F.aggregate("__rows", start, place)["to"]))
    each = moved.select(F.explode(F.arrays_zip(F.col("__rows"), F.col("__to"))).alias("x")).select("x.__rows.__row.*", F.col("x.__to").alias("__to"))
    return each.withColumn(ts, F.timestamp_micros("__to")).select(*rows.columns)


def generate(spark: SparkSession, config: EnvironmentConfig = EnvironmentConfig()) -> dict[str, DataFrame]:
    """The seven tables. Transactions are numbered in time order and stay within the period; a scenario row is moved
    where another payment of its account has its time."""
    env = {name: kept(df, name) for name, df in (entities(spark, config) | {"account_devices": links(spark, config)}).items()}

    merchants = Merchants.of(env["merchants"])

    def timed(rows: DataFrame) -> DataFrame:
        second = F.least(F.greatest("second", F.lit(3)), F.lit(config.days * 86400 - 4)).cast("long")  # leaves room to move
        return kept(rows.withColumn("ts", F.timestamp_seconds(F.unix_seconds(F.lit(config.start).cast("timestamp")) + second)).drop("second"), "payments")

    rows = timed(background(spark, config, env, merchants))
    if config.scenarios:
        rows = rows.unionByName(spread_collisions(timed(scenario_rows(spark, config, env, merchants)), ("account_id",), "ts", "row", rows, HARD_JITTER if config.hard else JITTER))
    ranked = with_rank(rows, ["ts", "row"], "txn_id")
    names = TABLES["transactions"].fieldNames()
    env["transactions"] = ranked.withColumns({"currency": F.lit("USD"), "status": F.lit("settled"), "txn_id": F.col("txn_id").cast("long")}).select(*names)
    return env


def flat_table(spark: SparkSession, n: int = 10_000, fraud_ratio: float = 0.0172, seed: int = 42) -> DataFrame:
    """A flat card table: Time, V1..V28, Amount, Class."""
    d = Draws(seed, "id")
    # exactly the wanted number of frauds: those with the smallest hashes
    place = hash_rank(spark.range(n).withColumn("__all", F.lit(1)), "__all", "id", seed)
    fraud = F.col("__place") <= max(2, int(n * fraud_ratio))
    v = [F.when(fraud, 0.2 + 1.2 * d.normal(f"V{i}")).otherwise(d.normal(f"V{i}")).alias(f"V{i}") for i in range(1, 29)]
    amount = F.when(fraud, d.lognormal("a1", 4.0, 1.2)).otherwise(d.lognormal("a0", 3.5, 1.0))
    return place.select(d.between("time", 0, 172_800).alias("Time"), *v, amount.alias("Amount"), fraud.cast("int").alias("Class"))
