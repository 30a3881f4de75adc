"""Time-driven operators in batch form: calendar jobs, timers, inactivity, deadlines, once, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cron import matches, matches_day, parse
from ..sources.shared import cut

MICRO = 1_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def cron_jobs(days: DataFrame, specs: dict[str, str]) -> DataFrame:
    """``cron, day, hour, minute`` of every job on the days ``days(day)``.

    Days are matched first and only then opened into hours and minutes, so no grid of
    minutes is joined with anything.
    """
    parsed = {name: parse(entry) for name, entry in specs.items()}
    hits = F.array(*[
        F.when(matches_day(s, F.col("day")), F.struct(F.lit(name).alias("cron"), F.array(*map(F.lit, s.hours)).alias("hours"), F.array(*map(F.lit, s.minutes)).alias("minutes")))
        for name, s in parsed.items()
    ])
    found = days.select("day", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return found.select(F.col("h.cron").alias("cron"), "day", F.explode("h.hours").alias("hour"), F.col("h.minutes").alias("m")).select(
        "cron", "day", "hour", F.explode("m").alias("minute")
    )


def cron_hits(rows: DataFrame, at: Column, specs: dict[str, str]) -> DataFrame:
    """``rows`` with ``cron``, once for each entry on whose minute ``at`` falls: one pass, no join."""
    hits = [F.when(matches(parse(entry), at), F.lit(name)) for name, entry in specs.items()]
    return rows.withColumn("cron", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())))


def apply_schedule(commands: DataFrame) -> DataFrame:
    """The entries that hold after ``cron, seq, action ("schedule" or "cancel"), spec`` commands."""
    last = commands.groupBy("cron").agg(F.max(F.struct("seq", "action", "spec")).alias("c"))
    return last.where("c.action = 'schedule'").select("cron", "c.spec")


def timer_ticks(timers: DataFrame, horizon_us: Column) -> DataFrame:
    """``timer, n, at_us``: the first trigger and then every interval, up to the horizon.

    ``timers`` has ``timer, first_us, interval_us`` (null: once).
    """
    last = F.when(F.col("interval_us").isNull(), F.lit(0)).otherwise(F.floor((horizon_us - F.col("first_us")) / F.col("interval_us")))
    due = timers.where(F.col("first_us") <= horizon_us).withColumn("n", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    return due.select("timer", "n", (F.col("first_us") + F.col("n") * F.coalesce("interval_us", F.lit(0))).alias("at_us"))


def watchdog_expiries(events: DataFrame, key: str, at_us: Column, timeout_us: int, horizon_us: Column | None = None) -> DataFrame:
    """``key, last_us, expired_us``: where no event of the key follows within the timeout.

    An event exactly at the end resets.  Keys are split into stretches of time as long as the
    timeout; an event can only be followed in its stretch or the next, so a hot key is spread
    over tasks by time.
    """
    if timeout_us <= 0:
        raise ValueError("timeout must be positive")
    rows = events.select(F.col(key).alias("key"), at_us.alias("at")).where("key is not null and at is not null").distinct()
    rows = rows.withColumn("span", F.floor(F.col("at") / timeout_us))
    w = Window.partitionBy("key", "span").orderBy("at")
    following = rows.withColumn("next", F.lead("at").over(w))
    heads = rows.groupBy("key", "span").agg(F.min("at").alias("head")).select("key", (F.col("span") - 1).alias("span"), "head")
    both = following.join(heads, ["key", "span"], "left")
    after = F.coalesce("next", "head")
    end = F.col("at") + timeout_us
    out = both.where(after.isNull() | (after > end)).select(F.col("key").alias(key), F.col("at").alias("last_us"), end.alias("expired_us"))
    return out if horizon_us is None else out.where(F.col("expired_us") <= horizon_us)


def exchange(requests: DataFrame, responses: DataFrame, timeout_us: int = 30 * MICRO) -> tuple[DataFrame, DataFrame]:
    """(answers, dead letters): each request with its first response in time, else status 504.

    ``requests`` has ``request, req_us``; ``responses`` has ``request, resp_us, status, body``.
    Dead letters are responses that are late, early, repeated or to no request.
    """
    tried = responses.join(requests, "request", "left").withColumn(
        "in_time", F.coalesce(F.col("resp_us").between(F.col("req_us"), F.col("req_us") + timeout_us), F.lit(False))
    )
    first = tried.where("in_time").groupBy("request").agg(F.min(F.struct("resp_us", "status", "body")).alias("r"))
    answers = requests.join(first, "request", "left").select(
        "request", "req_us", F.coalesce("r.status", F.lit(504)).alias("status"), F.coalesce("r.body", F.lit("Response action not invoked.")).alias("body")
    )
    order = Window.partitionBy("request").orderBy("resp_us", "status", "body")
    late = tried.where(~F.col("in_time")).select("request", "resp_us", F.when(F.col("req_us").isNull(), "unknown").otherwise("late").alias("why"))
    again = tried.where("in_time").withColumn("n", F.row_number().over(order)).where("n > 1").select("request", "resp_us", F.lit("repeated").alias("why"))
    return answers, late.unionByName(again)


def once(events: DataFrame, key: str, order: list[str], is_reset: Column, is_fire: Column) -> DataFrame:
    """The first firing of each key, and the first after each reset.

    Counted by epochs: an event's epoch is the number of its key's resets before it.  Events
    are dealt to ranges of (key, order) and counted inside each range, on top of the counts
    of the ranges before it, so a key with very many events is spread over tasks.
    """
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(key, *order, is_reset.cast("int").alias("_reset"), is_fire.alias("_fire"))
    ranged = cut(rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()), "epochs")
    inside = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # a row for each range and key in it
    sums = ranged.groupBy("_part", key).agg(F.sum("_reset").alias("n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    here = ranged.withColumn("_epoch", F.sum("_reset").over(inside))
    found = here.where("_fire").join(offsets.withColumnRenamed(key, "_key"), (F.col("_key").eqNullSafe(F.col(key))) & (here["_part"] == offsets["_part"]))
    first = found.groupBy(key, (F.col("_epoch") + F.col("_before")).alias("epoch")).agg(F.min(F.struct(*order)).alias("f"))
    return first.select(key, F.col("epoch").cast("bigint").alias("epoch"), *[F.col(f"f.{c}").alias(c) for c in order])


def reboots(schedule: DataFrame, at_us: int) -> DataFrame:
    """``cron, at_us``: the jobs that a start at ``at_us`` gives the schedules with "@reboot"."""
    return schedule.where("spec = '@reboot'").select("cron", F.lit(at_us).cast("bigint").alias("at_us"))


def echo(calls: DataFrame, action: str) -> DataFrame:
    """Calls of an action that does nothing, answered with their own parameters."""
    return calls.where(F.col("action") == action)


def dead_letters(calls: DataFrame, concepts: DataFrame, actions: DataFrame, rules: DataFrame) -> DataFrame:
    """``calls`` that reach no rule, with ``category``.

    ``calls`` has ``concept, action, error``; ``concepts(concept)``, ``actions(concept, action, kind)``
    with kind "action" or "event", and ``rules(concept, action)`` are the registry.
    """
    c = concepts.select("concept", F.lit(True).alias("has_concept")).distinct()
    a = actions.select("concept", "action", "kind").distinct()
    r = rules.select("concept", "action", F.lit(True).alias("has_rule")).distinct()
    seen = calls.join(c, "concept", "left").join(a, ["concept", "action"], "left").join(r, ["concept", "action"], "left")
    category = (
        F.when(F.col("error").isNotNull(), "uncaught").when(F.col("has_concept").isNull(), "concept").when(F.col("kind").isNull(), "no_action")
        .when(F.col("kind") == "event", "event_invoked").when(F.col("has_rule").isNull(), "ignored")
    )
    return seen.withColumn("category", category).where("category is not null").drop("has_concept", "has_rule", "kind")


def invocations(calls: DataFrame) -> DataFrame:
    """Every call as a row that rules can match, whatever it invokes."""
    return calls.select("action", "params", "flow")
