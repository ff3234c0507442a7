"""Attributes as known at event time: the latest version valid and recorded by then.

A version counts from the later of two instants on: the start of the day after its validity
date and the moment it was recorded. Among the versions in effect at an event the one with the
latest (validity date, recording, id) wins, which is a running maximum along the effect time.
It is computed as a merge of versions and events, sharded along time for entities of many rows
(``shards``), so no task holds more than about ``shard_rows`` rows of an entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallygrid.operators.shards import SHARD_ROWS, latest_versions


def as_known_at(
    events: DataFrame,
    versions: DataFrame,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Join each event to the version of its entity that was known at the event's time.

    ``events``: ``event_id``, ``entity``, ``at`` (timestamp). ``versions``: ``entity``,
    ``valid_on`` (date), ``recorded_at`` (timestamp), ``version_id`` and any payload columns,
    which come out under their own names (``event_id`` and ``at`` with ``_version`` appended).
    Other columns of ``events`` are ignored. Returns ``event_id, entity, at, valid_on,
    recorded_at, version_id, <payload>``, one row per event row that has a version.

    A version is usable when ``valid_on`` is an earlier calendar day than ``at`` and
    ``recorded_at`` isn't after ``at``. Ties on all of (valid_on, recorded_at, version_id)
    are copies of one row; any of them gives the same result. Events with a null entity or
    time, and versions with a null entity, date, recording or id, take no part. Repeated
    events are answered each; empty tables give an empty result.
    """
    payload = [c for c in versions.columns if c not in ("entity", "valid_on", "recorded_at", "version_id")]
    ev = events.filter("entity is not null and at is not null").select(
        "entity",
        F.col("at").cast("timestamp").alias("t"),
        F.lit(1).alias("kind"),
        F.struct(F.col("event_id").alias("event_id")).alias("event"),
    )
    body = F.struct("valid_on", "recorded_at", "version_id", *[F.col(f"`{c}`") for c in payload])
    ve = versions.filter(
        "entity is not null and valid_on is not null and recorded_at is not null and version_id is not null"
    ).select(
        "entity",
        F.greatest(F.col("recorded_at").cast("timestamp"), F.date_add("valid_on", 1).cast("timestamp")).alias("t"),
        F.lit(0).alias("kind"),
        body.alias("version"),
    )
    rows = ev.unionByName(ve, allowMissingColumns=True)

    rank = "version" if not payload else "struct(version.valid_on, version.recorded_at, version.version_id)"
    known = latest_versions(rows, rank, shard_rows).filter("known is not null")
    return known.select(
        F.col("event.event_id").alias("event_id"),
        "entity",
        F.col("t").alias("at"),
        *[F.col(f"known.`{c}`").alias(c) for c in ("valid_on", "recorded_at", "version_id")],
        *[F.col(f"known.`{c}`").alias(f"{c}_version" if c.lower() in ("event_id", "at") else c) for c in payload],
    )
