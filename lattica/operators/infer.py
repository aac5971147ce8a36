"""The seam for models: batched prediction with resume, and the arithmetic of candidate scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import candidate_score
from ..functions.text import strip_image_token, type_prompts, verdict_prompt
from ..types import TYPE_ORDER
from .align import pending

# What a prediction says of how it was scored.
SCORE_METHODS = {
    "full": "length_normalized_sequence_likelihood",
    "binary": "binary_only_length_normalized_sequence_likelihood",
    "generated": "generated_json_discrete_fallback",
}

#: Given prompts, a model's answers.
Predict = Callable[[list[str]], list[str]]
#: Candidates that are weighed against each other, the negative one first: of the verdict, and of each type.
VERDICTS, ANSWERS = ("pristine", "manipulated"), ("no", "yes")


class ScoringModel(Protocol):
    """A model that also says how likely it finds a candidate after a prompt."""

    def __call__(self, prompts: list[str]) -> list[str]: ...

    def mean_logprobs(self, prompts: list[str], candidate: str) -> list[float]:
        """The mean log-probability of the candidate's tokens after each prompt."""


def mean_logprobs(tokens: DataFrame) -> DataFrame:
    """(id, candidate, logprob) by token to the mean by candidate."""
    return tokens.groupBy("id", "candidate").agg(F.avg("logprob").alias("mean_logprob"))


def candidate_scores(tokens: DataFrame, negative: str, positive: str) -> DataFrame:
    """Softmax of the positive candidate's mean log-probability against the negative's."""
    pick = lambda c: F.avg(F.when(F.col("candidate") == c, F.col("logprob")))
    sums = tokens.groupBy("id").agg(pick(negative).alias("_n"), pick(positive).alias("_p"))
    return sums.select("id", candidate_score(F.col("_n"), F.col("_p")).alias("score"))


def prompts(rows: DataFrame) -> DataFrame:
    """Prompts of each row: to generate, to judge, and one for each type."""
    caption = F.col("meta.normalized_text")
    opening = strip_image_token(F.get("conversations", F.lit(0))["value"])
    return rows.select("id", "images", opening.alias("prompt"), verdict_prompt(caption).alias("verdict_prompt"), type_prompts(caption).alias("type_prompts"))


def _softmax(model: ScoringModel, asked: list[str], candidates: tuple[str, str]) -> np.ndarray:
    """How likely the second candidate is against the first, after each prompt."""
    negative, positive = (np.asarray(model.mean_logprobs(asked, c), float) for c in candidates)
    top = np.maximum(negative, positive)
    return np.exp(positive - top) / (np.exp(negative - top) + np.exp(positive - top))


def predict(rows: DataFrame, make_model: Callable[[], Predict | ScoringModel], *, batch: int = 16, mode: str = "generated", model: str = "", adapter: str | None = None, done: DataFrame | None = None) -> DataFrame:
    """id, response, manipulated_score, type_scores, score_method, model, adapter of rows that ``done`` doesn't have.

    Mode ``generated`` needs ``prompt`` and gives no scores; ``binary`` also weighs the verdicts
    after ``verdict_prompt``; ``full`` also weighs yes and no after each of ``type_prompts``.
    ``prompts`` makes these columns; the two modes need a ScoringModel. ``make_model`` runs once
    in each task; a retried task predicts its rows again.
    """
    if batch < 1:
        raise ValueError("the batch must be positive")
    if mode not in SCORE_METHODS:
        raise ValueError(f"mode must be one of {sorted(SCORE_METHODS)}")
    asked = ["prompt"] + ["verdict_prompt"] * (mode != "generated") + ["type_prompts"] * (mode == "full")
    if lacking := [c for c in asked if c not in rows.columns]:
        raise ValueError(f"mode {mode} needs columns {lacking}")
    todo = (rows if done is None else pending(rows, done)).select(F.col("id").cast("string").alias("id"), *asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer: Any = make_model()
        for b in batches:
            said: list[str] = []
            binary, typed = np.full(len(b), np.nan), np.full((len(b), len(TYPE_ORDER)), np.nan)
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                said += [s.strip() for s in answer(part["prompt"].tolist())]
                if mode != "generated":
                    binary[at : at + batch] = _softmax(answer, part["verdict_prompt"].tolist(), VERDICTS)
                if mode == "full":
                    for i in range(len(TYPE_ORDER)):
                        typed[at : at + batch, i] = _softmax(answer, [p[i]["prompt"] for p in part["type_prompts"]], ANSWERS)
            yield pd.DataFrame({"id": b["id"], "response": said, "_binary": binary, "_types": list(typed)})

    out = todo.mapInPandas(run, T.StructType([T.StructField("id", T.StringType()), T.StructField("response", T.StringType()), T.StructField("_binary", T.DoubleType()), T.StructField("_types", T.ArrayType(T.DoubleType()))]))
    scores = F.map_from_arrays(F.array(*map(F.lit, TYPE_ORDER)), F.col("_types"))
    return out.select(
        "id", "response", (F.col("_binary") if mode != "generated" else F.lit(None).cast("double")).alias("manipulated_score"), (scores if mode == "full" else F.lit(None).cast("map<string,double>")).alias("type_scores"),
        F.lit(SCORE_METHODS[mode]).alias("score_method"), F.lit(model).alias("model"), F.lit(adapter).cast("string").alias("adapter"),
    )
