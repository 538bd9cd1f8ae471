"""The library's front door.

    from lodestrata.api import scan_repos, diff_repos, history_of, rules_df, register_functions
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import json5
from .functions.content import byte_entropy, max_line_length
from .functions.signals import raw_signals
from .plans.history import ChangeResult
from .plans.history import diff_repositories as diff_repos
from .plans.history import scan_history as history_of
from .plans.scan import ScanResult
from .plans.scan import scan_repositories as scan_repos
from .rules import rules_df

__all__ = ["ChangeResult", "ScanResult", "diff_repos", "history_of", "register_functions", "rules_df", "scan_repos", "with_raw_signals"]


def with_raw_signals(texts: DataFrame, text_col: str = "text", name: str = "raw_signals") -> DataFrame:
    """texts with the array of content signals of a text column; null texts have none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.encode(text, "UTF-8")
    return texts.withColumn(name, raw_signals(text, max_line_length(content), F.octet_length(content), byte_entropy(content)))


@F.pandas_udf(StringType())
def json5_parse(text: pd.Series) -> pd.Series:
    """JSON5 as strict JSON with sorted keys; null for what doesn't parse and for numbers that JSON lacks."""

    def parse(value: object) -> str | None:
        if not isinstance(value, str):
            return None
        try:
            return json.dumps(json5.loads(value), ensure_ascii=False, allow_nan=False)
        except ValueError:
            return None

    return text.map(parse)


def register_functions(spark: SparkSession) -> None:
    """SQL functions for this session: byte_entropy(binary), json5_parse(text), longest_run(text, pattern), line_count(text)."""
    spark.udf.register("byte_entropy", byte_entropy)
    spark.udf.register("json5_parse", json5_parse)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION longest_run(t STRING, p STRING) RETURNS INT RETURN coalesce(array_max(transform(regexp_extract_all(t, p, 0), x -> length(x))), 0)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION line_count(t STRING) RETURNS INT RETURN CASE WHEN t = '' THEN 0 ELSE size(split(t, '\\n')) - if(endswith(t, '\\n'), 1, 0) END")
