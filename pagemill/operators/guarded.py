"""Row functions that may fail, without failing the run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_with_errors(
    df: DataFrame, function: Callable[[dict], object], result_type: T.DataType | str = "string"
) -> DataFrame:
    """Call ``function(row)`` for every row: its result and, where it fails, the error's text.

    For code that only exists in Python; built-in ``try_*`` functions do without it.
    """
    if isinstance(result_type, str):
        result_type = T._parse_datatype_string(result_type)
    schema = T.StructType(
        [*df.schema.fields, T.StructField("result", result_type), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results, errors = [], []
            for row in batch.to_dict("records"):
                try:
                    results.append(function(row))
                    errors.append(None)
                except Exception as e:
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch.assign(
                result=pd.Series(results, index=batch.index, dtype=object),
                error=pd.Series(errors, index=batch.index, dtype=object),
            )

    return df.mapInPandas(run, schema)


def skip_bad_rows(mapped: DataFrame) -> DataFrame:
    """The rows of ``map_with_errors`` that went well."""
    return mapped.where("error is null").drop("error")
