"""Search by part of an actor's name through a stored table of distinct actors.

A substring cannot be pushed into the scan of the scored days. The table of actors is small beside
them: it is searched first, and the names it finds reach the scan as a list of equalities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitus.config import DEFAULTS, Settings
from habitus.operators.serving import matching_threats

#: A search that finds more actors goes to the scored days directly.
MOST_ACTORS = 1000


def distinct_actors(scores: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(actor, days) of the scored table, to be stored beside it."""
    return scores.where(F.col(settings.actor).isNotNull()).groupBy(settings.actor).agg(F.count(F.lit(1)).alias("days"))


def found_actors(
    actors: DataFrame, user: str, regex: bool = False, most: int = MOST_ACTORS, settings: Settings = DEFAULTS
) -> list[str] | None:
    """The actors whose name holds ``user`` (as in ``matching_threats``), or None if more than ``most``."""
    actor = F.col(settings.actor)
    hit = actor.rlike(f"(?i){user}") if regex else F.lower(actor).contains(user.lower())
    rows = actors.where(hit).select(actor).limit(most + 1).collect()
    return None if len(rows) > most else sorted(r[0] for r in rows)


def search_threats(
    scores: DataFrame, actors: DataFrame, user: str, regex: bool = False, most: int = MOST_ACTORS,
    settings: Settings = DEFAULTS, **filters,
) -> DataFrame:
    """The rows of ``matching_threats`` for this ``user``, found through the stored ``actors``.

    Beyond ``most`` actors the scan itself compares the names, with the same rows as result.
    """
    names = found_actors(actors, user, regex, most, settings)
    if names is None:
        return matching_threats(scores, user=user, regex=regex, settings=settings, **filters)
    return matching_threats(scores.where(F.col(settings.actor).isin(names)), settings=settings, **filters)
