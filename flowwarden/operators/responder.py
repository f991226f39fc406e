"""User-supplied response function over prompt batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.functions.responses import decision_from_response


def ask(prompts: DataFrame, answer: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Raw answers per event id. `answer` maps a batch with system_prompt and user_prompt to texts.

    When the call for a batch fails it is made prompt by prompt; a prompt that still fails gets null,
    which parses to the isolation fail-safe, and the job goes on.
    """
    def call(batch: pd.DataFrame) -> list | None:
        try:
            raw = list(answer(batch))
        except Exception:
            return None
        return raw if len(raw) == len(batch) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = call(batch)
            if raw is None:
                raw = [(call(batch.iloc[[i]]) or [None])[0] for i in range(len(batch))]
            yield pd.DataFrame({"event_id": batch["event_id"], "raw": pd.Series(raw, dtype=object, index=batch.index)})

    return prompts.select("event_id", "system_prompt", "user_prompt").mapInPandas(run, "event_id long, raw string")


def respond(prompts: DataFrame, answer: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """event_id and parsed `answer`, ready for `with_responses`."""
    return ask(prompts, answer).select("event_id", decision_from_response(F.col("raw")).alias("answer"))
