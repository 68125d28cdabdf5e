"""An entry's identity: the first 16 hex digits of the SHA-256 of a JSON list of at, topic, text, sorted slots and target."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType



def identity(at: str | None, topic: str | None, text: str | None, slots: dict[str, str] | None, target: str | None) -> str:
    payload = json.dumps([at, topic, text, sorted((slots or {}).items()), target])
    return hashlib.sha256(payload.encode()).hexdigest()[:16]


@F.pandas_udf(StringType())
def _identity_udf(at: pd.Series, topic: pd.Series, text: pd.Series, names: pd.Series, values: pd.Series, target: pd.Series) -> pd.Series:
    none = lambda x: None if x is None or x != x else x
    rows = zip(at, topic, text, names, values, target)
    return pd.Series([identity(none(a), none(o), none(x), dict(zip(n, v)) if n is not None else None, none(t)) for a, o, x, n, v, t in rows])


def identity_column(at: str = "at", topic: str = "topic", text: str = "text", slots: str = "slots", target: str = "target") -> Column:
    """The identity as a column. The payload's JSON escapes all non-ASCII characters, which no built-in function does: an Arrow UDF.
    Null fields are JSON nulls; null slots are no slots."""
    return _identity_udf(F.col(at), F.col(topic), F.col(text), F.map_keys(slots), F.map_values(slots), F.col(target))
