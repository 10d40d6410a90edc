"""Canonical JSON: keys in order of code points, one form for every number, NaN and infinity refused."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of the compact form, and of the one with a space behind commas and colons.
COMPACT, SPACED = (",", ":"), (", ", ": ")
#: What a payload is refused for.
NOT_JSON, NOT_FINITE = "not JSON", "NaN or infinity"


def dumps(value, ascii: bool = False, separators: tuple[str, str] = COMPACT) -> str:
    """Canonical text of a parsed value; raises ValueError for NaN and infinity."""
    return json.dumps(value, sort_keys=True, separators=separators, ensure_ascii=ascii, allow_nan=False)


def canonical(text: Column, ascii: bool = False) -> Column:
    """struct<json, reason>: the canonical form of a JSON text at any depth, or why there is none.

    Of equal keys of one object the last holds. Null stays null without a reason. Numbers with a
    point or exponent are doubles, others are whole numbers of any length. ``ascii`` escapes
    everything else as \\u. VARIANT is not used here: it writes 1.0 as 1 and infinity as a string, and
    orders keys by UTF-16 units, so that hashes of other writers would not agree.
    """

    @F.pandas_udf("json string, reason string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            try:
                out.append((None if x is None else dumps(json.loads(x), ascii), None))
            except (json.JSONDecodeError, RecursionError):
                out.append((None, NOT_JSON))
            except ValueError:
                out.append((None, NOT_FINITE))
        return pd.DataFrame(out, columns=["json", "reason"], dtype=object)

    return run(text.cast("string"))
