"""Automated accounts: bursts, daily volume, window sweeps, user filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.functions.missing import present
from geopanel.ordered import running_totals
from geopanel.skew import join_bounded, materialize

SECOND = 1_000_000
#: Bits of a limb: 2**31 rows can be summed up in a long.
LIMB = 32

# The sweep's windows (seconds) and thresholds, the chosen burst
# rule (posts, seconds) and the daily limit.
WINDOWS = [2, 5, 10, 60]
THRESHOLDS = [2, 5, 10, 50, 100]
BURST_POSTS, BURST_SECONDS = 5, 5
DAY_LIMIT = 40


def limb_scale(df: DataFrame, measure: Column) -> list[int]:
    """Exponents of the limbs that hold every finite value of ``measure`` exactly, the smallest first.

    A double is a whole multiple of the last bit of the smallest value that
    occurs; the limbs reach from that bit to the largest value.
    """
    size = F.abs(measure.cast("double"))
    size = F.when(size < float("inf"), size)
    edge = df.agg(F.min(F.when(size > 0, size)).alias("low"), F.max(size).alias("high")).first()
    if not edge["low"]:
        return [0]
    low = max(math.frexp(edge["low"])[1] - 53, -1074)
    high = math.frexp(edge["high"])[1]
    return list(range(low, max(high, low + 1), LIMB))


def limbs(measure: Column, exponents: list[int]) -> Column:
    """Parts of a double as an array, as ``exponents``: whole numbers below 2**32 in size, times 2**exponent each.

    All parts have the value's sign. Divisions by powers of two and the
    remainders are exact.
    """
    units = F.array(*[F.lit(math.ldexp(1.0, e)) for e in reversed(exponents)])
    value = measure.cast("double")
    zero = F.struct(F.abs(value).alias("rest"), F.array().cast("array<bigint>").alias("parts"))

    def step(s: Column, unit: Column) -> Column:
        part = F.floor(s["rest"] / unit)
        return F.struct((s["rest"] - part * unit).alias("rest"), F.concat(F.array(part.cast("long")), s["parts"]).alias("parts"))

    sign = F.signum(value).cast("long")
    return F.transform(F.aggregate(units, zero, step, lambda s: s["parts"]), lambda part: part * sign)


def limb_value(parts: list[Column], exponents: list[int]) -> Column:
    """A sum of limbs as a double, to its last digit or two: carries go up first, so nothing cancels."""
    carried, carry = [], F.lit(0).cast("long")
    for part in parts[:-1]:
        whole = part + carry
        carry = F.shiftright(whole, LIMB)
        carried.append(whole - F.shiftleft(carry, LIMB))
    carried.append(parts[-1] + carry)
    value = F.lit(0.0)
    for part, e in zip(reversed(carried), reversed(exponents)):
        value = value + part.cast("double") * F.lit(math.ldexp(1.0, e))
    return value


def forward_windows(
    df: DataFrame,
    windows: list[float],
    user: str = "username",
    timestamp: str = "timestamp",
    value: str | None = None,
    slice_seconds: int | None = None,
) -> DataFrame:
    """Count and mean over ``[t, t + w)`` for every (user, distinct instant, window).

    Returns (user, _t in microseconds, window, rows, posts, mean): ``rows`` is
    how many posts share the instant, ``posts`` and ``mean`` describe the
    window (NULL and NaN are skipped by the mean; an infinite value gives NULL
    means from then on). Both come from differences of running totals, one pass
    for all windows, so the cost does not depend on how many posts a window
    holds. The totals run over range partitions of (user, instant) with a carry
    for each partition, so neither a user nor an hour has to fit a task; with
    ``slice_seconds`` over fixed slices of time instead. Sums are kept in whole
    numbers whose scale is measured first: differences lose no digit, whatever
    the values' size.
    """
    measure = present(value).cast("double") if value else F.lit(None).cast("double")
    scale = limb_scale(df, measure) if value else [0]
    finite = F.when(F.abs(measure) < float("inf"), measure)
    at = F.unix_micros(F.col(timestamp))
    parts = ["rows", "seen", "far", *[f"l{k}" for k in range(len(scale))]]
    parted = F.when(finite.isNotNull(), limbs(finite, scale))
    moments = df.select(user, at.alias("_t"), measure.alias("_m"), parted.alias("_l")).groupBy(user, "_t").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("_m").alias("seen"),
        (F.count("_m") - F.count("_l")).alias("far"),
        *[F.coalesce(F.sum(F.get("_l", F.lit(k))), F.lit(0)).alias(f"l{k}") for k in range(len(scale))],
    )
    # marker 0 closes a window and sorts before the posts of its instant
    ends = [
        F.struct(
            (F.col("_t") + F.lit(round(w * SECOND)).cast("long")).alias("_at"),
            F.lit(0).alias("_post"),
            F.lit(i).alias("_w"),
        )
        for i, w in enumerate(windows)
    ]
    here = F.struct(F.col("_t").alias("_at"), F.lit(1).alias("_post"), F.lit(-1).alias("_w"))
    none = F.lit(0).cast("long")
    marks = moments.select(user, "_t", *parts, F.inline(F.array(here, *ends)))
    is_post = F.col("_post") == 1
    slices = None if slice_seconds is None else F.floor(F.col("_at") / F.lit(slice_seconds * SECOND))
    scanned = running_totals(
        marks, [user], ["_at", "_post"], slices, {f"_c_{p}": F.when(is_post, F.col(p)).otherwise(none) for p in parts}
    )
    # totals at each window's end minus the totals before the post itself
    before = [F.sum(F.when(is_post, F.col(f"_c_{p}") - F.col(p))).alias(f"_b_{p}") for p in parts]
    after = [
        F.sum(F.when(F.col("_w") == i, F.col(f"_c_{p}"))).alias(f"_e{i}_{p}")
        for i in range(len(windows))
        for p in parts
    ]
    gathered = scanned.groupBy(user, "_t").agg(F.max("rows").alias("rows"), *before, *after)
    spans = [
        F.struct(
            F.lit(float(w)).alias("window"),
            *[(F.col(f"_e{i}_{p}") - F.col(f"_b_{p}")).alias(f"_{p}") for p in parts],
        )
        for i, w in enumerate(windows)
    ]
    opened = gathered.select(user, "_t", "rows", F.inline(F.array(*spans)))
    total = limb_value([F.col(f"_l{k}") for k in range(len(scale))], scale)
    mean = F.when((F.col("_seen") > 0) & (F.col("_far") == 0), total / F.col("_seen"))
    return opened.select(user, "_t", "window", "rows", F.col("_rows").alias("posts"), mean.alias("mean"))


def forward_window_stats(
    df: DataFrame,
    window_seconds: float,
    user: str = "username",
    timestamp: str = "timestamp",
    value: str = "vader_compound",
    slice_seconds: int | None = None,
) -> DataFrame:
    """Add to every post the number of posts and the mean of ``value`` in ``[t, t + w)``."""
    found = forward_windows(df, [window_seconds], user, timestamp, value, slice_seconds)
    found = found.select(F.col(user).alias("_u"), "_t", "posts", "mean")
    same = F.col(user).eqNullSafe(F.col("_u")) & (F.unix_micros(F.col(timestamp)) == F.col("_t"))
    return df.join(found, same).drop("_u", "_t")


def burst_users(
    df: DataFrame,
    posts: int = BURST_POSTS,
    seconds: float = BURST_SECONDS,
    user: str = "username",
    timestamp: str = "timestamp",
    slice_seconds: int | None = None,
) -> DataFrame:
    """Users with ``posts`` consecutive posts at most ``seconds`` apart.

    A user's posts are numbered by a running count over range partitions (or
    fixed slices of ``slice_seconds``), and each post meets the one that is
    ``posts - 1`` places earlier by its number. So a user's posts spread over
    tasks evenly, also when all of them lie in one second. At most ``posts``
    copies of one instant are kept: more cannot change the answer.
    """
    span = round(seconds * SECOND)
    moments = df.groupBy(user, F.unix_micros(F.col(timestamp)).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    copies = F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(posts).cast("long")).cast("int"))
    placed = moments.select(user, "_t", F.explode(copies).alias("_copy"))
    slices = None if slice_seconds is None else F.floor(F.col("_t") / F.lit(slice_seconds * SECOND))
    numbered = running_totals(placed, [user], ["_t", "_copy"], slices, {"_place": F.lit(1).cast("long")})
    earlier = numbered.select(F.col(user).alias("_u"), (F.col("_place") + posts - 1).alias("_p"), F.col("_t").alias("_from"))
    met = numbered.join(earlier, F.col(user).eqNullSafe(F.col("_u")) & (F.col("_place") == F.col("_p")))
    return met.where(F.col("_t") - F.col("_from") <= F.lit(span)).select(user).distinct()


def high_volume_users(
    df: DataFrame, limit: int = DAY_LIMIT, user: str = "username", timestamp: str = "timestamp"
) -> DataFrame:
    """Users with more than ``limit`` posts on one day."""
    days = df.groupBy(user, F.to_date(timestamp).alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return days.where(F.col("n") > limit).select(user).distinct()


def flagged_users(burst: DataFrame, volume: DataFrame) -> DataFrame:
    """Both user lists in one table (username, rule)."""
    return burst.withColumn("rule", F.lit("burst")).unionByName(volume.withColumn("rule", F.lit("day")))


def _listed(users: DataFrame, user: str) -> DataFrame:
    """The distinct users as a written table: finding them is not repeated by later steps."""
    return materialize(users.select(user).distinct(), "users")


def keep_users(posts: DataFrame, users: DataFrame, user: str = "username", **joining) -> DataFrame:
    """Posts of listed users; NULL matches NULL."""
    return join_bounded(posts, _listed(users, user), [user], "left_semi", null_safe=True, **joining)


def drop_users(posts: DataFrame, users: DataFrame, user: str = "username", **joining) -> DataFrame:
    """Posts of users not listed; NULL matches NULL."""
    return join_bounded(posts, _listed(users, user), [user], "left_anti", null_safe=True, **joining)


def top_value(df: DataFrame, keys: list[str], column: str, weight: str | None = None) -> DataFrame:
    """Most frequent value per key, the alphabetically first on ties.

    Counts and picks are both combinable aggregates: no window, no sort.
    """
    count = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*keys, column).agg(count.alias("_n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias("_b"))
    return best.select(*keys, F.col("_b.v").alias(column))


def bot_sweep(
    df: DataFrame,
    windows: list[float] = WINDOWS,
    thresholds: list[int] = THRESHOLDS,
    user: str = "username",
    timestamp: str = "timestamp",
    value: str = "vader_compound",
    label: str = "label",
    slice_seconds: int | None = None,
) -> DataFrame:
    """For every window and threshold: users with that many posts in that window.

    Returns (time_window, threshold, user_count, mean_sentiment, main_topic).
    The mean is taken per user over its qualifying posts, then over users; the
    topic is the most frequent main topic among qualifying posts' users.
    """
    found = forward_windows(df, windows, user, timestamp, value, slice_seconds)
    found = found.where(F.col("mean").isNotNull())
    limits = F.array(*[F.lit(t).cast("long") for t in thresholds])
    passed = found.select(
        user, "window", "rows", "mean", F.explode(F.filter(limits, lambda t: t <= F.col("posts"))).alias("threshold")
    )
    per_user = passed.groupBy("window", "threshold", user).agg(
        F.sum("rows").alias("_rows"), (F.sum(F.col("mean") * F.col("rows")) / F.sum("rows")).alias("_mean")
    )
    topics = top_value(df, [user], label).select(F.col(user).alias("_u"), label)
    per_user = per_user.join(topics, F.col(user).eqNullSafe(F.col("_u"))).drop("_u")
    rules = ["window", "threshold"]
    sizes = per_user.groupBy(*rules).agg(
        F.count(F.lit(1)).alias("user_count"), F.avg("_mean").alias("mean_sentiment")
    )
    tops = top_value(per_user, rules, label, weight="_rows").withColumnRenamed(label, "main_topic")
    every = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(float(w)) for w in windows])).alias("window"), limits.alias("_limits")
    )
    every = every.select("window", F.explode("_limits").alias("threshold"))
    table = every.join(sizes, rules, "left").join(tops, rules, "left")
    return table.select(
        F.col("window").alias("time_window"),
        "threshold",
        F.coalesce("user_count", F.lit(0).cast("long")).alias("user_count"),
        "mean_sentiment",
        "main_topic",
    )
