"""Saving and loading the learned models of this folder: JSON lines below a path that Spark can write and read."""

from __future__ import annotations

import base64
import dataclasses
import json

import numpy as np
from pyspark.sql import SparkSession

from .language_id import LanguageFilter
from .license_scan import LicenceModel
from .quality_rules import Condition, DecisionList
from .url_filter import Node, UrlModel

KINDS = {c.__name__: c for c in (LanguageFilter, LicenceModel, Condition, DecisionList, Node, UrlModel)}
#: Characters in a line.
LINE = 1 << 20


def _plain(x):
    if dataclasses.is_dataclass(x):
        return {"kind": type(x).__name__, "fields": {f.name: _plain(getattr(x, f.name)) for f in dataclasses.fields(x)}}
    if isinstance(x, np.ndarray):
        return {"kind": "array", "type": x.dtype.str, "shape": x.shape, "bytes": base64.b64encode(np.ascontiguousarray(x).tobytes()).decode()}
    if isinstance(x, dict):
        return {"kind": "dict", "items": [[_plain(k), _plain(v)] for k, v in x.items()]}
    if isinstance(x, tuple):
        return {"kind": "tuple", "items": [_plain(v) for v in x]}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return x.item() if isinstance(x, np.generic) else x


def _made(x):
    if isinstance(x, list):
        return [_made(v) for v in x]
    if not isinstance(x, dict):
        return x
    if x["kind"] == "array":
        return np.frombuffer(base64.b64decode(x["bytes"]), x["type"]).reshape(x["shape"]).copy()
    if x["kind"] == "dict":
        return {_made(k): _made(v) for k, v in x["items"]}
    if x["kind"] == "tuple":
        return tuple(_made(v) for v in x["items"])
    return KINDS[x["kind"]](**{k: _made(v) for k, v in x["fields"].items()})


def save(spark: SparkSession, model, path: str) -> None:
    """Writes a model below path, replacing what is there."""
    text = json.dumps(_plain(model))
    lines = [(i, text[at : at + LINE]) for i, at in enumerate(range(0, len(text), LINE))]
    spark.createDataFrame(lines, "no int, part string").coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str):
    """The model that save() wrote."""
    rows = spark.read.schema("no int, part string").json(path).collect()
    return _made(json.loads("".join(r["part"] for r in sorted(rows, key=lambda r: r["no"]))))
