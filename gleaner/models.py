"""The boundary to external models: protocols, batched maps, and deterministic stand-ins for use offline."""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.storage import bound_batches


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class JsonModel(Protocol):
    def call(self, system: str, user: str) -> dict: ...


class HashingEmbedder:
    """Signed hashes of lower-case words, normalized: equal texts have equal vectors anywhere."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)


def embed_column(embedder: Embedder, batch: int = 1024):
    """A pandas function from texts to vectors, in batches; ``storage.bound_batches`` bounds what a task holds at once."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            vectors: list[np.ndarray] = []
            for k in range(0, len(texts), batch):
                vectors.extend(embedder.embed(texts.iloc[k : k + batch].fillna("").tolist()).astype(np.float32))
            yield pd.Series(vectors, dtype=object)

    return run


def call_with_retries(model: JsonModel, system: str, user: str, attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A model's answer; transport errors are tried again with doubling waits, unreadable answers aren't."""
    for k in range(attempts):
        try:
            return model.call(system, user)
        except ValueError:
            raise
        except Exception:
            if k + 1 == attempts:
                raise
            sleep(wait * 2**k)
    raise ValueError("no attempts")


_STARTED: dict[str, float] = {}
_LOCK = threading.Lock()


def throttle(name: str, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
    """Waits until ``interval`` seconds after the last start under this name in this process, whoever made it."""
    with _LOCK:
        rest = _STARTED.get(name, -interval - 1) + interval - clock()
        if interval > 0 and rest > 0:
            sleep(rest)
        _STARTED[name] = clock()


def fetch_limited(fetch: Callable[[], tuple[int, dict]], attempts: int = 3, wait: float = 4.0, sleep: Callable[[float], None] = time.sleep) -> dict | None:
    """What a fetch of (status, body) brings: a status of 429 is tried again with doubling waits; other errors, and the last
    429, give none at once."""
    for k in range(attempts):
        try:
            status, body = fetch()
        except Exception:
            return None
        if status != 429:
            return body if status < 400 else None
        sleep(wait * 2**k)
    return None


def map_batches(df: DataFrame, rows: Callable[[list[dict]], list[dict]], schema: str, batch: int) -> DataFrame:
    """Rows through a function of batches; errors are the function's to turn into rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                out = rows(pdf.iloc[k : k + batch].to_dict("records"))
                if out:
                    yield pd.DataFrame(out)

    bound_batches(df.sparkSession)
    return df.mapInPandas(run, schema)


def extract_insights(df: DataFrame, extract: Callable[[str], list[dict]]) -> DataFrame:
    """source, source_id, insights and error of each raw row; a failure is a row with its error."""
    schema = "source string, source_id string, insights array<struct<text:string,strength:double,anchor_entity:string>>, error string"

    def rows(batch: list[dict]) -> list[dict]:
        out = []
        for r in batch:
            try:
                found, error = extract(r["text"] or ""), None
            except Exception as e:
                found, error = [], f"{type(e).__name__}: {e}"
            out.append({"source": r["source"], "source_id": r["source_id"], "insights": found, "error": error})
        return out

    return map_batches(df.select("source", "source_id", "text"), rows, schema, 80)


def first_sentences(text: str) -> list[dict]:
    """A stand-in extractor: up to three sentences of at least four words."""
    parts = [s.strip() for s in text.replace("\n", " ").split(".")]
    return [{"text": s, "strength": 0.5, "anchor_entity": None} for s in parts if len(s.split()) >= 4][:3]


def name_clusters(clusters: DataFrame, insights: DataFrame) -> DataFrame:
    """A stand-in for naming: a cluster is named by the text nearest to its centre."""
    centre = clusters.select("cluster_id", F.get("centroid_text_indices", F.lit(0)).alias("flat_idx"))
    return centre.join(insights.select("flat_idx", F.col("text").alias("name")), "flat_idx", "left").select("cluster_id", "name", F.lit("neutral").alias("polarity"), F.lit(0.0).alias("name_confidence"))


def score_clusters(clusters: DataFrame, named: Column, actionable: Column, failed: Column | None = None, on_error: str = "C") -> DataFrame:
    """Specificity and tier from two scores of 1 to 5 (0 or none: 3); failed batches get the tier for errors."""
    from gleaner.functions.scores import quality_tier

    a, b = (F.coalesce(F.nullif(c, F.lit(0)), F.lit(3)) for c in (named, actionable))
    tier = quality_tier(a, b, F.col("size"))
    tier = tier if failed is None else F.when(failed, F.lit(on_error)).otherwise(tier)
    return clusters.withColumns({"named_entity_score": a, "actionability_score": b, "specificity": F.greatest(a, b), "quality_tier": tier})


def rule_tag(text: Column) -> Column:
    """A stand-in tagger by words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bad, good = low.rlike(r"\b(avoid|scam|rude|bad|dirty)\b"), low.rlike(r"\b(great|love|best|amazing)\b")
    sentiment = F.when(bad & good, "mixed").when(bad, "negative").when(good, "positive").otherwise("neutral")
    intent = F.when(bad, "warning").when(low.rlike(r"\b(should|must|recommend)\b"), "recommendation").otherwise("description")
    return F.struct(sentiment.alias("insight_sentiment"), intent.alias("intent_tag"), F.regexp_extract_all(low, F.lit(r"\d+(?:[.,]\d+)?\s*\w+"), F.lit(0)).alias("numeric_anchors"), F.lit(None).cast("string").alias("sub_attraction"), F.lit(None).cast("string").alias("visit_date_mentioned"))
