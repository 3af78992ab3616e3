"""Job settings from YAML or JSON text: weights and thresholds, as plain dictionaries for job parameters."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def parse(text: str) -> dict:
    """JSON, or YAML of nested ``key: value`` lines and ``- item`` lists (what the settings use)."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    root: dict = {}
    stack: list[tuple[int, object, object]] = [(-1, root, None)]
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while stack[-1][0] >= indent and not (body.startswith("- ") and stack[-1][0] == indent and isinstance(stack[-1][1], list)):
            stack.pop()
        if body.startswith("- "):
            _, holder, owner = stack[-1]
            if not isinstance(holder, list):
                parent, key = owner  # an empty mapping turns out to be a list
                holder = parent[key] = []
                stack[-1] = (indent, holder, None)
            holder.append(_scalar(body[2:]))
            continue
        key, _, value = body.partition(":")
        holder = stack[-1][1]
        if value.strip():
            holder[key.strip()] = _scalar(value.strip())
        else:
            holder[key.strip()] = child = {}
            stack.append((indent, child, (holder, key.strip())))
    return root


def _scalar(text: str):
    text = text.strip().strip("\"'")
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None}.get(text.lower(), text)


def load(spark: SparkSession, path: str) -> dict:
    return parse(spark.read.text(path, wholetext=True).first()[0])
