"""Iteration ledgers: running best, acceptance, stop rule, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running


def completed(df: DataFrame, objective: str = "objective", status: str = "status") -> DataFrame:
    return df.filter((F.col(status) == "completed") & F.col(objective).isNotNull())


def running_best(
    df: DataFrame,
    objective: str = "objective",
    order: str = "iteration",
    by: Sequence[str] = (),
    status: str = "status",
    min_improvement: float = 0.0,
    acceptance: str = "best",
    digits: int = 6,
) -> DataFrame:
    """Best before and including each record, with improved / is-best / accepted flags.

    Failed records keep null flags and never count as a best. A record is the
    best when strictly lower than every earlier one, and improved only when
    lower by more than the threshold.
    """
    done = (F.col(status) == "completed") & F.col(objective).isNotNull()
    out = running(
        df, by, [order], {"previous_best": ("min", F.when(done, F.col(objective)))}, inclusive=False
    )
    prev, obj = F.col("previous_best"), F.col(objective)
    best_so_far = F.least(prev, F.when(done, obj))
    is_best = F.when(done, prev.isNull() | (obj < prev))
    accepted = F.when(done, F.lit(True)) if acceptance == "latest" else is_best
    return out.select(
        "*",
        best_so_far.alias("best_so_far"),
        F.when(done, prev.isNull() | (obj < prev - min_improvement)).alias("improved"),
        is_best.alias("is_best"),
        accepted.alias("accepted"),
        F.when(done, F.round(obj - prev, digits)).alias("delta_vs_best"),
    )


def best_record(df: DataFrame, objective: str = "objective", order: str = "iteration", by: Sequence[str] = ()) -> DataFrame:
    """The completed record of lowest objective; the earliest wins a tie."""
    rest = [c for c in df.columns if c not in by]
    best = completed(df, objective).groupBy(*by).agg(
        F.min_by(F.struct(*rest), F.struct(objective, order)).alias("_b")
    )
    return best.filter("_b IS NOT NULL").select(*by, "_b.*")


def next_id(df: DataFrame, order: str = "iteration", by: Sequence[str] = ()) -> DataFrame:
    """The next sequence number: largest + 1, or 0 for an empty ledger."""
    return df.groupBy(*by).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next_id"))


def stop_status(
    df: DataFrame,
    objective: str = "objective",
    order: str = "iteration",
    by: Sequence[str] = (),
    max_iterations: int | None = None,
    target: float | None = None,
    patience: int | None = None,
) -> DataFrame:
    """Whether the stopping rules are met: count, best, records since the best, reasons."""
    done = (F.col("status") == "completed") & F.col(objective).isNotNull()
    best = df.groupBy(*by).agg(
        F.count_if(done).alias("n_completed"),
        F.min(F.when(done, F.struct(F.col(objective).alias("o"), F.col(order).alias("i")))).alias("_b"),
    )
    # Counting the later records needs no ordering: it is one more aggregate.
    later = F.count_if(done & (F.col(order) > F.col("_b.i"))).alias("since_improvement")
    if by:
        out = best.join(df.join(best, list(by)).groupBy(*by).agg(later), list(by))
    else:
        out = best.crossJoin(df.crossJoin(F.broadcast(best)).agg(later))  # one row each

    def rule(active: bool, test, text):
        return F.when(test, text) if active else F.lit(None).cast("string")

    reasons = F.concat_ws(
        "; ",
        rule(bool(max_iterations), F.col("n_completed") >= (max_iterations or 0), F.lit("iteration limit reached")),
        rule(target is not None, F.col("_b.o") <= (target if target is not None else 0.0), F.lit("target reached")),
        rule(bool(patience), F.col("since_improvement") >= (patience or 0), F.lit("patience exhausted")),
    )
    return out.select(
        *by, "n_completed", F.col("_b.o").alias("best_objective"), F.col("_b.i").alias("best_iteration"),
        "since_improvement", (reasons != "").alias("stop"),
        F.when(F.col("n_completed") == 0, "no completed iterations yet")
        .when(reasons != "", reasons).otherwise("criteria not met").alias("reason"),
    )


def history(df: DataFrame, changed: str = "parameters_changed", **options) -> DataFrame:
    """Readable ledger: objective or FAILED, delta, improved mark, changed names, is-best."""
    best = running_best(df, **options)
    objective = options.get("objective", "objective")
    order, status = options.get("order", "iteration"), options.get("status", "status")
    names = F.array_join(F.array_sort(F.map_keys(changed)), ", ")
    return best.select(
        *options.get("by", ()), order,
        F.when(F.col(status) == "completed", F.format_string("%.4f", objective)).otherwise("FAILED").alias("objective_text"),
        F.col("delta_vs_best"),
        F.when(F.col("improved"), "+").otherwise(" ").alias("mark"),
        F.when(F.coalesce(F.size(changed), F.lit(0)) > 0, names).otherwise("baseline").alias("changed"),
        F.coalesce(F.col("is_best"), F.lit(False)).alias("is_best"),
        "best_so_far",
    )
