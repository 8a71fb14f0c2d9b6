"""Chains of resolvers: each is fed what the ones before it have left.

A member is a function from rows that have an `id` to answers with that `id`.
Members name the languages that they are for. One that fails is counted and
left out, and the next one is asked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Store


@dataclass(frozen=True)
class Member:
    name: str
    resolve: Callable[[DataFrame], DataFrame]
    #: Languages that it is asked about; none: all of them.
    languages: tuple[str, ...] = ()


@dataclass
class Outcome:
    """`answers`: the members' columns, and `member`, which says whose answer a row is. `left`: rows that nobody answered. `failed`: the members that failed, with why."""

    answers: DataFrame
    left: DataFrame
    failed: list[tuple[str, str]] = field(default_factory=list)


def run(rows: DataFrame, members: Sequence[Member], answer: str, store: Store | None = None) -> Outcome:
    """Asks `members` in order about `rows` (id, language, and others); `answer` is the schema of what they give.

    Of several answers of a member to one row all are kept, answers to ids
    that were not asked about are not. Each member's answers are written before the
    next one is asked, so a failure in a task counts as one of its member.
    """
    store = store or Store(rows.sparkSession, "chain")
    left = store.keep(rows, "asked")
    answers = rows.sparkSession.createDataFrame([], f"{answer}, member string")
    failed: list[tuple[str, str]] = []
    for n, m in enumerate(members):
        asked = left.filter(F.col("language").isin(*m.languages)) if m.languages else left
        try:
            found = store.keep(m.resolve(asked).join(asked.select("id").distinct(), "id", "left_semi").withColumn("member", F.lit(m.name)).select(*answers.columns), f"found{n}")
        except Exception as e:  # a member is someone else's code, and its failure is not that of the chain
            failed.append((m.name, type(e).__name__))
            continue
        answers = answers.unionByName(found)
        left = store.keep(left.join(found.select("id").distinct(), "id", "left_anti"), f"left{n}")
    return Outcome(answers, left, failed)
