"""Goal-conditioned transition data: rewards, targets, relabelling, replay, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from treecorpus.functions.hashing import md5_fraction
from treecorpus.operators.positions import grouped_position

KNOWN_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD"]


def episodes(events: DataFrame, episode: str, order: list[str], state: str, bucket: Column) -> DataFrame:
    """Number the steps of each episode and attach the next state.

    Steps are numbered bucket by bucket, and the next state comes from an equi-join on the step
    number, so that an episode holding a third of all events is never one task's work.
    """
    steps = grouped_position(events, [episode], order, bucket).withColumnRenamed("pos", "step")
    after = steps.select(episode, (F.col("step") - 1).alias("step"), F.col(state).alias("next_state"))
    return steps.join(after, [episode, "step"], "left")


def reward_from_status(step: Column, max_steps: int, method: Column, reached: Column, status: Column) -> Column:
    """``struct(reward, terminated, truncated)`` of one transition."""
    cut = step >= max_steps
    known = method.isin(KNOWN_METHODS)
    reward = (
        F.when(cut, -1.0).when(~known, -0.1).when(reached, 1.0).when(status.between(200, 300), 0.1)
        .when(status == 500, -0.5).otherwise(-0.2))
    ended = ~cut & known & (reached | (status == 500))
    return F.struct(reward.alias("reward"), ended.alias("terminated"), cut.alias("truncated"))


def td_target(actions: DataFrame, keys: list[str], gamma: float) -> DataFrame:
    """``reward + gamma * (1 - done) * max q`` over legal actions ``(keys…, reward, done, q, legal)``.

    A transition without a legal next action counts as done.
    """
    best = F.max(F.when(F.col("legal"), F.col("q")))
    rows = actions.groupBy(*keys).agg(F.first("reward").alias("reward"), F.first("done").alias("done"), best.alias("best"))
    return rows.select(*keys, (F.col("reward") + gamma * (1 - F.col("done")) * F.coalesce("best", F.lit(0.0)))
                       .alias("target"))


def her_relabel(steps: DataFrame, episode: str, k: int, seed: int) -> DataFrame:
    """For each step ``k`` future goals: ``(episode, step, draw, goal, reward, done)``.

    A draw is a hashed index between the step and the episode's end; the goal is the next state at
    that index, met by equality on (episode, index).
    """
    ends = steps.groupBy(episode).agg(F.max("step").alias("last"))
    drawn = steps.join(ends, episode).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(k)))) if k > 0 else (
        steps.join(ends, episode).withColumn("draw", F.lit(0)).limit(0))
    key = F.concat_ws(":", F.lit(str(seed)), F.col(episode).cast("string"), F.col("step").cast("string"),
                      F.col("draw").cast("string"))
    at = F.col("step") + F.floor(md5_fraction(key) * (F.col("last") - F.col("step") + 1))
    asked = drawn.select(episode, "step", "draw", "next_state", at.cast("long").alias("at"))
    goals = steps.select(episode, F.col("step").alias("at"), F.col("next_state").alias("goal"))
    met = F.coalesce((F.col("next_state") == F.col("goal")).cast("double"), F.lit(0.0))
    return asked.join(goals, [episode, "at"]).select(
        episode, "step", "draw", "at", "goal", met.alias("reward"), met.alias("done"))


def replay_last_n(transitions: DataFrame, buffer: str, order: list[str], n: int) -> DataFrame:
    """The most recent ``n`` rows per buffer; map tasks keep at most ``n`` rows of a buffer before the shuffle."""
    newest = Window.partitionBy(buffer).orderBy(*[F.desc(c) for c in order])
    return transitions.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= n)


def episode_returns(steps: DataFrame, episode: str) -> DataFrame:
    return steps.groupBy(episode).agg(
        F.sum("reward").alias("total"), F.count_if("reached").alias("n_reached"), F.count("*").alias("n_steps"))


def select_categorical(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per slot the choice with the best score, the first on a tie: ``(keys…, choice)``."""
    return scores.groupBy(*keys).agg(
        F.max_by("choice", F.struct("score", (-F.col("index")).alias("i"))).alias("choice"))


def assemble_arguments(slots: DataFrame, chosen: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """``(arguments, violations)``: a map of given values per row, and required slots without a value."""
    joined = slots.join(chosen.select(row, "slot", "choice"), [row, "slot"], "left")
    missing = joined.filter(F.col("choice").isNull() & F.col("required")).select(row, "slot")
    given = joined.filter(F.col("choice").isNotNull()).groupBy(row).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "choice")))).alias("arguments"))
    return given.join(missing.select(row).distinct(), row, "left_anti"), missing
