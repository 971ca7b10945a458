"""Extraction of structured values from texts, with an outcome per row."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.text import valid_json


def extract_between(
    df: DataFrame, col: str, open_mark: str, close_mark: str, schema: str | None = None
) -> DataFrame:
    """Text between the first open mark and the first close mark behind it.

    Adds ``outcome`` (``missing_open``, ``unterminated``, ``bad_json``, ``ok``),
    ``n_bytes`` (size of the whole text, for ``missing_open``), ``body``, and
    with a ``schema`` the parsed ``data``.
    """
    c = F.col(col)
    at = F.instr(c, open_mark)
    rest = F.substring(c, at + len(open_mark), F.length(c))
    end = F.instr(F.col("_rest"), close_mark)
    out = df.withColumn("_rest", F.when(at > 0, rest)).withColumn(
        "body", F.when(end > 0, F.substring(F.col("_rest"), F.lit(1), end - 1))
    )
    outcome = F.when(F.col("_rest").isNull(), "missing_open").when(
        F.col("body").isNull(), "unterminated"
    )
    if schema is None:
        return out.withColumns(
            {
                "outcome": outcome.otherwise("ok"),
                "n_bytes": F.when(F.col("_rest").isNull(), F.octet_length(c).cast("bigint")),
            }
        ).drop("_rest")
    data = F.when(valid_json("body"), F.from_json("body", schema))
    out = out.withColumn("data", data)
    return out.withColumns(
        {
            "outcome": outcome.when(F.col("data").isNull(), "bad_json").otherwise("ok"),
            "n_bytes": F.when(F.col("_rest").isNull(), F.octet_length(c).cast("bigint")),
        }
    ).drop("_rest")


def extract_exactly_one(
    df: DataFrame,
    col: str,
    anchor: str,
    attrs: Sequence[str],
    optional: dict[str, str] | None = None,
) -> DataFrame:
    """Quoted attribute values (``name = "value"`` at line start) behind an anchor word.

    Each of ``attrs`` must occur exactly once behind the first anchor.
    ``optional`` maps an attribute to the one it falls back to; its first match
    counts.  ``outcome`` is ``ok``, ``no_anchor``, ``no <attr>`` or
    ``<attr> matches <n> times``; the first failing attribute is named.
    """
    c = F.col(col)
    at = F.instr(c, anchor)
    region = F.when(at > 0, F.substring(c, at, F.length(c)))

    def pattern(attr: str) -> str:
        return rf'(?m)^\s*{re.escape(attr)}\s*=\s*"([^"]+)"'

    def found(attr: str):
        return F.regexp_extract_all(F.col("_region"), F.lit(pattern(attr)), F.lit(1))

    out = df.withColumn("_region", region)
    out = out.withColumns({f"_m_{a}": found(a) for a in [*attrs, *(optional or {})]})
    outcome = F.when(F.col("_region").isNull(), F.lit("no_anchor"))
    for a in attrs:
        n = F.size(f"_m_{a}")
        outcome = outcome.when(n == 0, F.lit(f"no {a}")).when(
            n > 1, F.concat(F.lit(f"{a} matches "), n, F.lit(" times"))
        )
    values = {a: F.get(F.col(f"_m_{a}"), F.lit(0)) for a in attrs}
    for a, fallback in (optional or {}).items():
        values[a] = F.coalesce(
            F.get(F.col(f"_m_{a}"), F.lit(0)), F.get(F.col(f"_m_{fallback}"), F.lit(0))
        )
    out = out.withColumns({**values, "outcome": outcome.otherwise(F.lit("ok"))})
    return out.drop("_region", *[f"_m_{a}" for a in [*attrs, *(optional or {})]])


def extract_got_hash(df: DataFrame, col: str = "text", out: str = "got_hash") -> DataFrame:
    """First actual hash reported by a hash mismatch in a log; null if there is none."""
    found = F.regexp_extract(col, r"got:\s+(sha256-[A-Za-z0-9+/=]+)", 1)
    return df.withColumn(out, F.nullif(found, F.lit("")))
