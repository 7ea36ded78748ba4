"""Labels from a pluggable model: prompt, reply, parse; failures become undecided with the reason kept."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.functions import exprs as X

Labeler = Callable[[str], str]
MAX_CHARS, ATTEMPTS = 3000, 8


@dataclass(frozen=True)
class KeyWords:
    """Offline stand-in for a model: the reply is the word of the first phrase the prompt contains."""

    phrases: tuple[tuple[str, str], ...] = (("our members", "org"), ("speaking for my family", "citizen"), ("our engineers", "expert"), ("on behalf of clients", "lobbyist"))

    def __call__(self, prompt: str) -> str:
        low = prompt.lower()
        return next((reply for phrase, reply in self.phrases if phrase in low), "undecided")


@dataclass(frozen=True)
class StructuredKeyWords(KeyWords):
    """As KeyWords, with replies in JSON; where no phrase occurs the reply is a sentence, and lobbyists get a category that doesn't exist."""

    confidence: float = 0.9

    def __call__(self, prompt: str) -> str:
        reply = super().__call__(prompt)
        if reply == "undecided":
            return "I can't tell."
        names = {"citizen": X.CITIZEN, "org": X.WRITTEN_ORGANIZATION, "expert": X.EXPERT}
        return json.dumps({"category": names.get(reply, "unheard of"), "confidence": self.confidence})


def with_retries(labeler: Labeler, prompt: str, attempts: int = ATTEMPTS, base: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The labeler's reply; waits 2 to 60 seconds, doubled and jittered, between failures; at last an error text."""
    for attempt in range(attempts):
        try:
            return labeler(prompt) or "EMPTY_RESPONSE"
        except Exception:  # noqa: BLE001 - any failure of a remote model is retried
            if attempt + 1 < attempts:
                sleep(min(most, base * 2**attempt) * (1 + random.random() / 10))
    return "ERROR: retries_exhausted"


def label(comments: DataFrame, labeler: Labeler, model: str = "offline") -> DataFrame:
    """(comment_id, category, model_response, prompt_used, model) for comments that have text; replies are parsed natively."""
    prompt = F.substring(X.combined_text("comment_text", "attachment_text"), 1, MAX_CHARS)
    asked = comments.where(X.has_text("comment_text", "attachment_text")).select("comment_id", prompt.alias("prompt_used"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(model_response=[with_retries(labeler, p) for p in batch["prompt_used"]])

    replied = asked.mapInPandas(ask, "comment_id string, prompt_used string, model_response string")
    failed = F.col("model_response").startswith("ERROR:") | (F.col("model_response") == "EMPTY_RESPONSE")
    category = F.when(failed, X.UNDECIDED).otherwise(X.reply_label("model_response"))
    return replied.select("comment_id", category.alias("category"), "model_response", "prompt_used", F.lit(model).alias("model"))


def label_structured(comments: DataFrame, labeler: Labeler, model: str = "offline") -> DataFrame:
    """As ``label``, for replies in JSON {category, confidence}; an invalid reply or category is undecided with confidence 0."""
    replied = label(comments, labeler, model)
    parsed = F.from_json("model_response", "category string, confidence double")
    named = X.known_category(parsed["category"])
    return replied.select("comment_id", F.coalesce(named, F.lit(X.UNDECIDED)).alias("category"), F.when(named.isNotNull(), F.coalesce(parsed["confidence"], F.lit(0.0))).otherwise(0.0).alias("confidence"), F.when(named.isNull(), "invalid reply").alias("error"))
