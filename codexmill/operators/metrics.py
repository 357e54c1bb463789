"""Evaluation metrics, straight-line capacity models, streaks and schedules, as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET_STEP = 1024
# Weight of a task by its level.
LEVEL_WEIGHT = {1: 1.0, 2: 2.0, 3: 3.0, 4: 2.0}


def summary(attempts: DataFrame, by: list[str], seconds: str, rate: str, failed: Column) -> DataFrame:
    """Per group: attempts, errors, mean and median seconds, median of positive rates; 0 where there is none."""
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return attempts.groupBy(*by).agg(
        F.count("*").alias("attempts"), F.count_if(failed).alias("errors"), zero(F.avg(seconds)).alias("mean_seconds"), zero(F.median(seconds)).alias("median_seconds"), zero(F.median(F.when(F.col(rate) > 0, F.col(rate)))).alias("median_rate")
    )


def fit(samples: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Per group: base and slope of the least-squares line, slope between the two largest x, largest deviation.

    Groups with fewer than two different x, or a slope that isn't positive, have no line and don't come out.
    """
    line = samples.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("base"), F.count("*").alias("n"), F.countDistinct(x).alias("points"), F.max(x).alias("max_x"))
    good = line.where("points >= 2 and slope > 0")
    level = samples.groupBy(by, x).agg(F.avg(y).alias("__y"))
    w = Window.partitionBy(by).orderBy(F.col(x).desc())
    last = level.withColumn("__r", F.row_number().over(w)).where("__r <= 2").groupBy(by).agg(F.max_by("__y", x).alias("y1"), F.min_by("__y", x).alias("y0"), F.max(x).alias("x1"), F.min(x).alias("x0"))
    dev = samples.join(good.select(by, "slope", "base"), by).groupBy(by).agg(F.max(F.abs(F.col(y) - F.col("base") - F.col("slope") * F.col(x))).alias("deviation"))
    out = good.join(last, by).join(dev, by)
    top = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    return out.select(by, "n", F.round("base", 4).alias("base"), F.round("slope", 4).alias("slope"), F.round(top, 4).alias("top_slope"), F.round("deviation", 4).alias("deviation"), "max_x")


def steeper(fits: DataFrame) -> Column:
    """The slope to plan with: the larger of the overall and the last one."""
    return F.greatest("slope", "top_slope")


def linear() -> Column:
    """Whether the last slope is within half of the overall one."""
    ratio = F.col("top_slope") / F.col("slope")
    return (ratio > 1 / 1.5) & (ratio < 1.5)


def capacity(fits: DataFrame, by: str, budget: float, users: list[int], most: int) -> DataFrame:
    """(by, users, window, predicted, note): the largest window per user within a budget, in steps, up to a limit."""
    u = fits.withColumn("users", F.explode(F.array(*[F.lit(n) for n in users])))
    slope = F.greatest("slope", F.coalesce("top_slope", F.col("slope")))
    room = F.floor(F.greatest(F.lit(0.0), (F.lit(budget) - F.col("base")) / (slope * F.col("users"))) / BUDGET_STEP) * BUDGET_STEP
    window = F.least(room, F.lit(most)).cast("long")
    predicted = F.round(F.col("base") + F.col("users") * F.col("window") * slope, 2)
    out = u.withColumn("window", window).withColumn("predicted", predicted)
    note = F.when(F.col("window") >= most, "limit of the model").when(F.col("predicted") > 0.9 * budget, "tight").otherwise("")
    return out.withColumn("note", note).select(by, "users", "window", "predicted", "note")


def pivot_users(caps: DataFrame, by: str, users: list[int]) -> DataFrame:
    """One row a group, one column u<n> for each number of users."""
    return caps.groupBy(by).pivot("users", users).agg(F.first("window")).select(by, *[F.col(str(n)).alias(f"u{n}") for n in users])


def idle_islands(polls: DataFrame, by: str, at: str, free: Column, gap_seconds: int) -> DataFrame:
    """Polls with idle_s, seconds since continuous idling began; a busy poll or a longer gap starts over."""
    w = Window.partitionBy(by).orderBy(at, *[c for c in polls.columns if c not in (by, at)][:1])
    sec = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    p = polls.withColumn("__s", sec).withColumn("__free", free)
    reset = ~F.col("__free") | F.lag("__s").over(w).isNull() | (F.col("__s") - F.lag("__s").over(w) > gap_seconds) | ~F.coalesce(F.lag("__free").over(w), F.lit(False))
    p = p.withColumn("__i", F.sum(reset.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min("__s").over(Window.partitionBy(by, "__i"))
    return p.withColumn("idle_s", F.when(F.col("__free"), F.round(F.col("__s") - first, 3)).otherwise(0.0)).drop("__s", "__free", "__i")


def streaks(rows: DataFrame, by: str, order: list[str], hit: Column, n: int) -> DataFrame:
    """Rows that end a streak of n hits in a row (then the count starts over), with their number within the run."""
    w = Window.partitionBy(by).orderBy(*order)
    r = rows.withColumn("__h", hit).withColumn("__g", F.sum((~F.col("__h")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(by, "__g", "__h").orderBy(*order))
    return r.where("__h").withColumn("run", place).where(F.col("run") % n == 0).drop("__h", "__g")


def first_free(rows: DataFrame, by: str, order: list[str], free: Column, n: int) -> DataFrame:
    """Per group the first row that completes n free polls in a row."""
    s = streaks(rows, by, order, free, n).where(F.col("run") == n)
    w = Window.partitionBy(by).orderBy(*order)
    return s.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def in_windows(rows: DataFrame, at: str, spans: dict[int, list[str]], gap_minutes: int = 0) -> DataFrame:
    """Rows inside a weekly schedule, with the window's begin and deadline (its end less a gap).

    spans: weekday (1 Monday ... 7 Sunday) to `HH:MM-HH:MM`; a span may pass midnight. Windows are half open. The
    schedule is a literal of a few rows; each row looks at the spans of its own day and of the day before.
    """
    table = [(d, *[int(h) * 60 + int(m) for h, m in (x.split(":") for x in s.split("-"))]) for d, ss in spans.items() for s in ss]
    t = F.col(at).cast("timestamp")
    options = []
    for day, a, b in table:
        for back in (0, 1):
            midnight = F.date_trunc("day", t) - F.expr(f"interval {back} days")
            begin = midnight + F.expr(f"interval {a} minutes")
            end = midnight + F.expr(f"interval {b if b > a else b + 1440} minutes")
            ok = (F.weekday(midnight) + 1 == day) & (t >= begin) & (t < end)
            options.append(F.when(ok, F.struct(begin.alias("begin"), (end - F.expr(f"interval {gap_minutes} minutes")).alias("deadline"))))
    got = F.coalesce(*options)
    return rows.withColumn("__w", got).where("__w is not null").withColumns({"window_begin": F.col("__w.begin"), "window_deadline": F.col("__w.deadline")}).drop("__w")


def liveness(beats: DataFrame, by: str, at: str, stale_seconds: int) -> DataFrame:
    """(by, last, beats, alive): alive if the last beat is not older than that before the newest of all."""
    per = beats.groupBy(by).agg(F.max(at).alias("last"), F.count("*").alias("beats"))
    newest = per.agg(F.max("last").alias("newest"))
    age = (F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6
    return per.crossJoin(F.broadcast(newest)).select(by, "last", "beats", (age <= stale_seconds).alias("alive"))


def worklist(tasks: DataFrame, models: DataFrame, repeats: int, done: DataFrame) -> DataFrame:
    """(model, task, repeat) still to do: eligible models x tasks x repeats without what is done."""
    every = models.crossJoin(F.broadcast(tasks)).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return every.join(done.select("model", "task", "repeat").distinct(), ["model", "task", "repeat"], "left_anti")


def users_max(budget: Column, base: Column, slope: Column, window: Column) -> Column:
    """How many users with a window of tokens fit a budget; 0 where nothing is left."""
    each = window * slope
    return F.when((window > 0) & (each > 0) & (budget > base), F.floor((budget - base) / each)).otherwise(F.lit(0)).cast("long")


def users_at_full(samples: DataFrame, fits: DataFrame, by: str, x: str, y: str, budget: float, most: int, verified: int, spilled: Column) -> DataFrame:
    """(by, users, usable, per_token): users with the whole window of the model.

    Where the largest verified window is below the model's and was measured without spilling, that measurement takes
    the place of the budget and of the fitted slope.
    """
    at = samples.where((F.col(x) == verified) & ~spilled).groupBy(by).agg(F.min(y).alias("total"))
    known = fits.join(at, by, "left") if 0 < verified and (most == 0 or verified < most) else fits.withColumn("total", F.lit(None).cast("double"))
    usable = F.coalesce(F.col("total"), F.lit(float(budget)))
    each = F.when(F.col("total").isNotNull(), (F.col("total") - F.col("base")) / F.lit(float(max(verified, 1)))).otherwise(F.greatest("slope", F.coalesce("top_slope", "slope")))
    out = known.withColumn("usable", usable).withColumn("per_token", each)
    return out.select(by, users_max(F.col("usable"), F.col("base"), F.col("per_token"), F.lit(most)).alias("users"), F.round("usable", 4).alias("usable"), F.round("per_token", 6).alias("per_token"))


def sample_points(most: Column, points: Column | None = None) -> Column:
    """Windows to measure at: those given, else an eighth, a quarter and half of the largest; in steps, in order, each once."""
    whole = F.when(most > 0, most).otherwise(F.lit(32768))
    raw = F.transform(F.array(F.lit(8), F.lit(4), F.lit(2)), lambda k: F.floor(whole / k)) if points is None else points
    stepped = F.transform(raw, lambda p: F.greatest(F.floor(p / BUDGET_STEP) * BUDGET_STEP, F.lit(BUDGET_STEP)))
    limit = most if points is not None else whole
    return F.array_distinct(F.transform(stepped, lambda p: F.when(limit > 0, F.least(p, limit)).otherwise(p)))


def usable_budget(total: Column, baseline: Column, override: Column, reserve: Column) -> Column:
    """What a model may take: the override, else what is there less what others hold, both less a reserve; null if unknown."""
    return F.when(override > 0, override - reserve).when(total.isNotNull(), total - baseline - reserve)


def last_of_role(messages: DataFrame, by: str, order: str, role: str) -> DataFrame:
    """(by, last_id): the largest `order` of a row with that role, -1 where there is none."""
    return messages.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("role") == role, F.col(order))), F.lit(-1)).alias("last_id"))


def checklist(hits: DataFrame, by: list[str], weight: str) -> DataFrame:
    """(by, score): the sum of the weights of the items an answer hits, never below 0."""
    return hits.groupBy(*by).agg(F.round(F.greatest(F.coalesce(F.sum(weight), F.lit(0.0)), F.lit(0.0)), 6).alias("score"))
