"""The session's phases as a state machine over its ten actions, folded in batch or kept in a stream.

The state is the phase and whether a profile is held: ten states, so an action is a table of ten entries. Tables compose, and
composition is associative: a long session is folded in pieces, each a table again, and only the
pieces are put in order. No session, however long, is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PHASES = ("idle", "extracting", "reviewing", "committing", "viewing")
#: ``review-empty`` is ``review-ready`` of a batch that extracted nothing.
ACTIONS = ("profile-loaded", "extract-started", "extract-progressed", "review-ready", "review-empty", "review-updated", "commit-started", "commit-succeeded", "cancelled", "cleared", "failed")
STATES = list(product(PHASES, (False, True)))
START = STATES.index(("idle", False))
PIECE = 1024


def step(phase: str, held: bool, action: str) -> tuple[str, bool]:
    """The next state. Actions that belong to another phase change nothing; five are heard in every phase."""
    rest = "viewing" if held else "idle"
    if action == "profile-loaded":
        return ("viewing" if phase == "idle" else phase), True
    if action == "extract-started":
        return "extracting", held
    if action in ("cancelled", "failed"):
        return rest, held
    if action == "cleared":
        return "idle", False
    if phase == "extracting" and action in ("review-ready", "review-empty"):
        return ("reviewing" if action == "review-ready" else rest), held
    if phase == "reviewing" and action == "commit-started":
        return "committing", held
    if phase == "committing" and action == "commit-succeeded":
        return "viewing", True
    return phase, held


#: For each action the number of the state that every state goes to.
TABLES = {a: [STATES.index(step(*s, a)) for s in STATES] for a in ACTIONS}


def _composed(tables: Column, kind: str) -> Column:
    """Tables applied one after the other; ``kind`` is the array's element type."""
    start = F.array(*map(F.lit, range(len(STATES)))).cast(kind)
    return F.aggregate(tables, start, lambda done, t: F.transform(done, lambda s: F.get(t, s)))


def fold(actions: DataFrame, session: str = "session", order: str = "place") -> DataFrame:
    """(session, phase, held, n_actions): the state each session ends in; ``actions`` (session, place, action), unknown actions are ignored."""
    lookup = F.from_json(F.lit(str(TABLES).replace("'", '"')), "map<string,array<int>>")
    known = actions.withColumn("_t", F.element_at(lookup, F.col("action"))).where(F.col("_t").isNotNull())
    piece = F.floor((F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1) / PIECE)
    ordered = lambda c, by: F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c])
    pieces = known.withColumn("_p", piece).groupBy(session, "_p").agg(_composed(ordered("_t", order), "array<int>").alias("_t"), F.count(F.lit(1)).alias("n"))
    whole = pieces.groupBy(session).agg(_composed(ordered("_t", "_p"), "array<int>")[START].alias("s"), F.sum("n").alias("n_actions"))
    names, held = F.array(*[F.lit(p) for p, _ in STATES]), F.array(*[F.lit(h) for _, h in STATES])
    return whole.select(session, F.get(names, F.col("s")).alias("phase"), F.get(held, F.col("s")).alias("held"), "n_actions")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, n = state.get if state.exists else (START, 0)
    for pdf in batches:
        for action in pdf.sort_values("place")["action"]:
            if action in TABLES:
                at, n = TABLES[action][at], n + 1
    state.update((at, n))
    yield pd.DataFrame({"session": [key[0]], "phase": [STATES[at][0]], "held": [STATES[at][1]], "n_actions": [n]})


def follow(actions: DataFrame) -> DataFrame:
    """The same over a stream of (session, place, action): a row per session touched. Actions of one trigger are put in order."""
    return actions.groupBy("session").applyInPandasWithState(
        _advance, "session long, phase string, held boolean, n_actions long", "at int, n long", "update", GroupStateTimeout.NoTimeout)
