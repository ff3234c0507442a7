"""Deeply nested records as flat tables that keep their parent-child links.

Every payload is walked depth first. Each node gets a pre-order and a post-order number within
its payload; node *a* contains node *b* exactly when ``a.pre < b.pre`` and ``a.post > b.post``.
Node tables of different types are linked by that containment alone: nodes of one type that
can't hold each other are disjoint intervals, so the only possible container of a node is the
nearest one that starts before it, found in one sorted pass per payload instead of a join over
pairs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that may wrap the list of a payload.
ENVELOPES = ("matches", "data", "fixtures", "results")

NODE_SCHEMA = (
    "payload_id long, pre int, post int, depth int, path string, kind string, at int, value string"
)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def read_body(body: str | None) -> list | None:
    """The list in a payload: bare, in an envelope, or encoded once more as a JSON string.

    None for null, unreadable or differently shaped bodies."""
    value: object = body
    for _ in range(4):
        if isinstance(value, str):
            try:
                value = json.loads(value.lstrip("﻿"), parse_constant=_no_constant, parse_float=_exact)
            except (ValueError, RecursionError):
                return None
        elif isinstance(value, dict):
            inner = [value[k] for k in ENVELOPES if isinstance(value.get(k), (list, str, dict))]
            if not inner:
                return None
            value = inner[0]
        else:
            break
    return value if isinstance(value, list) else None


class _exact(float):
    """A float that prints as it was written."""

    def __new__(cls, text: str) -> "_exact":
        made = super().__new__(cls, text)
        made.text = text
        return made


def walk(payload_id: int, root: list) -> list[tuple]:
    """Nodes of one payload in pre-order: containers, then what they hold.

    ``path`` joins the keys from the root, ``[]`` standing for a list element; ``at`` counts
    elements from 1 (null elements included). Iterative, so depth is bounded by memory only."""
    out: list[list] = []
    post = 0
    stack: list[tuple] = [("enter", "", 0, None, root)]
    while stack:
        step, path, depth, at, value = stack.pop()
        if step == "leave":
            out[value][2] = post
            post += 1
            continue
        kind, text = "object", None
        if isinstance(value, list):
            kind = "array"
        elif value is None:
            kind = "null"
        elif not isinstance(value, dict):
            kind = "string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "number"
            text = value if isinstance(value, str) else value.text if isinstance(value, _exact) else json.dumps(value)
        out.append([payload_id, len(out), 0, depth, path, kind, at, text])
        stack.append(("leave", path, depth, at, len(out) - 1))
        if kind == "array":
            stack.extend(("enter", path + "[]", depth + 1, i, v) for i, v in reversed(list(enumerate(value, 1))))
        elif kind == "object":
            stack.extend(
                ("enter", f"{path}.{k}" if path else k, depth + 1, None, v) for k, v in reversed(list(value.items()))
            )
    return [tuple(x) for x in out]


def _walk_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    for frame in frames:
        rows: list[tuple] = []
        for payload_id, body in zip(frame["payload_id"], frame["body"]):
            root = read_body(body)
            if root is not None and payload_id == payload_id and payload_id is not None:
                rows.extend(walk(int(payload_id), root))
            if len(rows) > 50_000:
                yield pd.DataFrame(rows, columns=names).astype({"at": "Int32"})
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"at": "Int32"})


def interval_nodes(df: DataFrame, id_col: str, body: Column) -> DataFrame:
    """All nodes of all payloads (``NODE_SCHEMA``); ``body`` is JSON text.

    Null and unreadable bodies and null ids give nothing; an empty list gives its root only.
    Payload ids must be unique for the links to hold; repeated ids are the caller's error."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("payload_id"), body.alias("body")).filter(
        "payload_id is not null and body is not null"
    ).mapInPandas(_walk_all, NODE_SCHEMA)


def link_to_container(nodes: DataFrame, container_path: str, child: Column, keep: str = "at") -> DataFrame:
    """Children (rows of ``nodes`` where ``child`` holds) with the container of the given path:
    ``parent_pre`` and ``parent_{keep}``. Children outside any such container are left out."""
    is_parent = F.col("path") == container_path
    seen = Window.partitionBy("payload_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(is_parent, F.struct("pre", "post", keep)), ignorenulls=True).over(seen)
    return (
        nodes.filter(is_parent | child)
        .withColumn("parent", last)
        .filter(child & (F.col("parent.post") > F.col("post")))
        .withColumn("parent_pre", F.col("parent.pre"))
        .withColumn(f"parent_{keep}", F.col(f"parent.{keep}"))
        .drop("parent")
    )


def typed_table(nodes: DataFrame, path: str, fields: dict[str, str]) -> DataFrame:
    """One row per object node at ``path``: its labels, ``match_pos`` of the fixture that holds
    it, and its scalar ``fields`` (name -> key below ``path``), linked by interval containment.

    Fields are text, null where absent or null; a field written as an object is looked up by
    the dotted key."""
    keys = {f"{path}.{k}": name for name, k in fields.items()}
    wanted = nodes.filter(F.col("path").isin("[]", path, *keys))
    order = Window.partitionBy("payload_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.last(F.when(F.col("path") == "[]", F.struct("pre", "post", "at")), ignorenulls=True).over(order)
    own = F.last(F.when((F.col("path") == path) & (F.col("kind") == "object"), F.struct("pre", "post")), ignorenulls=True).over(order)
    linked = wanted.withColumn("m", at).withColumn("o", own).filter(
        (F.col("o.pre") <= F.col("pre")) & (F.col("o.post") >= F.col("post"))
    )
    return linked.groupBy("payload_id", F.col("m.at").alias("match_pos"), F.col("o.pre").alias("pre"), F.col("o.post").alias("post")).agg(
        *[F.max(F.when(F.col("path") == p, F.col("value"))).alias(name) for p, name in keys.items()]
    )
