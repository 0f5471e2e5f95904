"""Numbers about a run, collected while it writes."""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from answergrid.functions.documents import configure
from answergrid.operators.ingest import Header


class Run:
    """Counts the rows of a DataFrame while another action runs over it.

    ``run.watch(df)`` returns the DataFrame to write.  After the write,
    ``run.report()`` has the rows, the empty texts per watched column, the texts
    that are not JSON per document column and the duration, without a second pass.
    """

    def __init__(self, name: str = "run") -> None:
        self.observation = Observation(name)
        self.started = time.monotonic()

    def watch(
        self, df: DataFrame, empty_in: Sequence[str] = (), json_in: Sequence[str] = ()
    ) -> DataFrame:
        """Counts the rows, the empty texts and the texts that are not JSON; NULL is neither.

        Documents in ``json_in`` are parsed for it once more.
        """
        configure(df.sparkSession)
        counts = [F.count_if(F.col(c) == "").alias(f"empty_{c}") for c in empty_in]
        for c in json_in:
            broken = F.col(c).isNotNull() & F.try_parse_json(c).isNull()
            counts.append(F.count_if(broken).alias(f"not_json_{c}"))
        return df.observe(self.observation, F.count(F.lit(1)).alias("rows"), *counts)

    def report(self, header: Header | None = None) -> dict[str, Any]:
        numbers = dict(self.observation.get)
        if header is not None:
            numbers["missing_fields"] = list(header.missing)
        numbers["duration_ms"] = int((time.monotonic() - self.started) * 1000)
        return numbers
