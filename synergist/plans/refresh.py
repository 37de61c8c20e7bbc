"""The refresh chain: what follows from events of some periods.

Facts of touched periods feed the six aggregate tables of these periods; where one of
them is in the current window, the aggregates of the window's periods feed its scores
and reports. Every table is replaced in one step, and the label that readers follow
changes last, so the scores of before can be read meanwhile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import periods as P
from ..sources import tables
from ..sources.readers import scan_facts
from ..sources.scratch import checkpointed
from ..sources.sinks import replace_all, replace_window
from . import aggregates, reports, scores

AGGREGATES = ("individual", "matchup", "duo", "trio", "duo_duration", "trio_duration")
#: Tables of a window label, each with the tables that it is computed from.
SCORES: dict[str, tuple[str, ...]] = {
    "score_duo": ("duo", "individual", "duo_duration"),
    "score_trio": ("trio", "individual", "trio_duration", "score_duo"),
    "score_matchup": ("matchup", "individual"),
    "resilience": ("roles", "sides"),
    "flex": ("individual", "roles"),
}
CURRENT = "current_window"


def stored_window(spark: SparkSession, root: str) -> DataFrame:
    """The window of the newest periods that have aggregates, from the manifest."""
    return checkpointed(P.make_window(tables.entries(spark, f"{root}/individual").where("_rows > 0")))


def score_window(spark: SparkSession, root: str, roles: DataFrame, sides: DataFrame, window: DataFrame, names: tuple[str, ...] = tuple(SCORES)) -> str:
    """Replace the scores and reports of a window's label; returns the label."""
    rows = window.orderBy("depth").collect()  # at most three rows
    label, periods = rows[0].label, [r.period for r in rows]
    inputs: dict[str, DataFrame] = {"roles": roles, "sides": sides}
    inputs |= {n: scan_facts(spark, f"{root}/{n}", periods) for n in AGGREGATES if tables.layout(spark, f"{root}/{n}")}
    build: dict[str, Callable[..., DataFrame]] = {
        "score_duo": lambda duo, one, time: scores.score_duo(duo, one, time, window),
        "score_trio": lambda trio, one, time, duo: scores.score_trio(trio, one, time, duo, window),
        "score_matchup": lambda match, one: scores.score_matchup(match, one, window),
        "resilience": lambda p, t: reports.resilience(p, t),
        "flex": lambda one, p: reports.flex(one, p),
    }
    for name, needs in SCORES.items():
        if name not in names:
            continue
        got = build[name](*(inputs[n] for n in needs)).withColumn("label", F.lit(label))
        replace_window(got, f"{root}/{name}", [label])
        inputs[name] = tables.read(spark, f"{root}/{name}", [label])
    replace_all(window.select("label", "period", "depth", "weight"), f"{root}/{CURRENT}")
    return label


def refresh(root: str, touched: list[str], events_of: Callable[[list[str]], dict[str, DataFrame]], names: tuple[str, ...] = tuple(SCORES)) -> str | None:
    """Rebuild what depends on the ``touched`` periods. ``events_of`` gives the facts m, p
    and t of some periods, and the whole side rows ``sides`` where the source has them in one
    place. Returns the label whose scores were replaced, None if no
    touched period is in the current window."""
    f = events_of(touched)
    spark = f["m"].sparkSession
    if "sides" in f:
        aggregates.refresh_from_sides(f["sides"], touched, root, AGGREGATES)
    else:
        aggregates.refresh(f["m"], f["p"], f["t"], f["p"], touched, root, AGGREGATES)
    window = stored_window(spark, root)
    periods = [r.period for r in window.select("period").collect()]  # at most three
    if not set(periods) & set(touched):
        return None
    now = events_of(periods)
    return score_window(spark, root, now["p"], now["t"], window, names)


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of table ``name`` for the label that readers follow."""
    label = tables.read(spark, f"{root}/{CURRENT}").select("label").first()[0]
    return tables.read(spark, f"{root}/{name}", [label])
