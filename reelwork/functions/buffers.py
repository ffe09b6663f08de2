"""User code over rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def map_buffers(df: DataFrame, fn: Callable[[dict], dict], schema: str, on_error: str = "quarantine") -> DataFrame:
    """Calls ``fn`` on each row as a dict. A row that fails gets its message in column error (and
    nulls elsewhere), or is left out with on_error='drop'; the others go on."""
    if on_error not in ("quarantine", "drop"):
        raise ValueError("on_error must be 'quarantine' or 'drop'")
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append({**fn(row), "error": None})
                except Exception as e:  # noqa: BLE001  whatever user code raises is data here
                    if on_error == "quarantine":
                        out.append({"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[*names, "error"]).astype({"error": object})

    return df.mapInPandas(run, f"{schema}, error string")
