"""Staged classification: a question per level, each asked only where the answers before it were right."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A backend answers a level: (turn, key, truth) -> the predicted label.
Backend = Callable[[int, Column, Column], Column]
BACKENDS: dict[str, Callable[..., Backend]] = {}


def register(name: str):
    def add(f):
        BACKENDS[name] = f
        return f

    return add


@register("mock")
def mock(accuracy: tuple[float, ...] = (0.9, 0.8, 0.7), seed: str = "42") -> Backend:
    """The truth with the given share by level, else 'unknown': decided by md5 of seed, turn and key, so in any order alike."""

    def answer(turn: int, key: Column, truth: Column) -> Column:
        share = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(str(turn)), key.cast("string"))), 1, 4)
        return F.when(share < f"{round(accuracy[turn - 1] * 65536):04x}", truth).otherwise("unknown")

    return answer


def cascade(df: DataFrame, key: str, levels: list[str], backend: Backend) -> DataFrame:
    """df with pred_1.. and tier_1..: a level behind a wrong first answer is 'cascade_error' with tier 0; an unknown answer has tier 3.

    A null truth is never right. All levels are columns of one projection: no stage is written or joined back.
    """
    right = F.coalesce(backend(1, F.col(key), F.col(levels[0])) == F.col(levels[0]), F.lit(False))
    out = {}
    for turn, level in enumerate(levels, 1):
        said = backend(turn, F.col(key), F.col(level))
        asked = F.lit(True) if turn == 1 else right
        out[f"pred_{turn}"] = F.when(asked, said).otherwise("cascade_error")
        out[f"tier_{turn}"] = F.when(~asked, 0).when(said == "unknown", 3).otherwise(1)
    return df.withColumns(out)
