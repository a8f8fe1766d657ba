"""Model profiles, their resolution, and embedding providers."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from ..functions.text import hash_embedding


@dataclass(frozen=True)
class ModelProfile:
    """Limits of an embedding model; the truncation and chunk limits follow from its context."""

    model_id: str
    dimension: int
    context: int
    source: str = "registry"
    protected_dim: int | None = None
    query_prefix: str | None = None
    document_prefix: str | None = None
    truncation: int = field(init=False)
    chunk: int = field(init=False)

    def __post_init__(self):
        for name in ("dimension", "context"):
            v = getattr(self, name)
            if not isinstance(v, int) or isinstance(v, bool) or v <= 0:
                raise ValueError(f"{name} must be a positive integer")
        if not self.model_id.strip():
            raise ValueError("a model needs an id")
        object.__setattr__(self, "truncation", policy.truncation_tokens(self.context))
        object.__setattr__(self, "chunk", policy.chunk_limit(self.truncation))


class ProfileResolver:
    """Registered models by id (letter case ignored); metadata of a call goes before the registry."""

    def __init__(self):
        self._known: dict[str, dict] = {}

    def register(self, model_id: str, dimension: int, context: int, **rest) -> None:
        ModelProfile(model_id, dimension, context, **rest)  # validates
        self._known[model_id.strip().lower()] = {"dimension": dimension, "context": context, **rest}

    def resolve(self, model_id: str, dimension: int | None = None, context: int | None = None) -> ModelProfile:
        known = self._known.get(model_id.strip().lower(), {})
        dim, ctx = dimension or known.get("dimension"), context or known.get("context")
        if not dim or not ctx:
            raise KeyError(f"dimension or context of {model_id} is not known")
        given = [dimension is not None, context is not None]
        source = "metadata" if all(given) else "mixed" if any(given) else "registry"
        rest = {k: v for k, v in known.items() if k in ("protected_dim", "query_prefix", "document_prefix")}
        return ModelProfile(model_id, dim, ctx, source, **rest)


def builtin() -> ProfileResolver:
    """The registry with the one model that ships: 768 dimensions, 512 tokens, 128 protected."""
    r = ProfileResolver()
    r.register("builtin-768", 768, 512, protected_dim=128)
    return r


def resolve_profiles(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """The same as data: (model_id, dimension, context) against the registry, first known value of each."""
    reg = registry.select(F.lower("model_id").alias("_key"), F.col("dimension").alias("_d"), F.col("context").alias("_c"))
    own = wanted.join(F.broadcast(reg), F.lower("model_id") == F.col("_key"), "left")  # a registry is a few rows
    rest = [c for c in wanted.columns if c not in ("model_id", "dimension", "context")]
    return own.select("model_id", F.coalesce("dimension", "_d").alias("dimension"), F.coalesce("context", "_c").alias("context"), *rest)


def routing_policy(resolver: ProfileResolver, model_id: str, dimension: int | None = None, context: int | None = None, **overrides) -> tuple[ModelProfile, dict]:
    """A model's profile and the routing dimensions that follow from it; ``overrides`` go to the routing rule."""
    profile = resolver.resolve(model_id, dimension, context)
    return profile, policy.routing_policy(profile.dimension, **overrides)


Embedder = Callable[[Column], Column]


class Providers:
    """Embedding providers by name: each gives a column of vectors from a column of texts."""

    #: Order of preference where nothing is measured.
    ORDER = ("arrow-onnx", "hash")

    def __init__(self, dim: int = 64):
        self._all: dict[str, tuple[Callable[[], bool], Embedder]] = {"hash": (lambda: True, lambda c: hash_embedding(c, dim))}

    def add(self, name: str, embed: Embedder, supported: Callable[[], bool] = lambda: True) -> None:
        self._all[name] = (supported, embed)

    def resolve(self, forced: str | None = None, measure: Callable[[Embedder], None] | None = None, runs: int = 3) -> tuple[str, Embedder]:
        """A forced provider, the fastest of ``runs`` timed calls after a warm-up, or the first supported one."""
        if forced is not None:
            if forced not in self._all or not self._all[forced][0]():
                raise ValueError(f"provider {forced} is not available")
            return forced, self._all[forced][1]
        names = [n for n in (*self.ORDER, *self._all) if n in self._all and self._all[n][0]()]
        names = list(dict.fromkeys(names))
        if not names:
            raise ValueError("no provider is available")
        if measure is None:
            return names[0], self._all[names[0]][1]
        best, least = names[0], math.inf
        for n in names:
            try:
                measure(self._all[n][1])
                began = time.perf_counter()
                for _ in range(runs):
                    measure(self._all[n][1])
                took = (time.perf_counter() - began) / runs
            except Exception:  # a provider that fails its trial is passed over
                continue
            if took < least:
                best, least = n, took
        return best, self._all[best][1]


def onnx_embedder(path: str, encode: Callable, dim: int, prefix: str = "") -> Embedder:
    """Mean-pooled, normalised sentence vectors of an ONNX model, cut to ``dim``; the session is one per worker.

    ``encode`` maps texts to the model's inputs (name to array, with attention_mask). No model ships with the library.
    """
    import pandas as pd

    held: dict = {}

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import numpy as np
        import onnxruntime

        if "s" not in held:
            held["s"] = onnxruntime.InferenceSession(path)
        inputs = encode([prefix + (t or "") for t in texts])
        out = held["s"].run(None, inputs)[0]
        mask = inputs["attention_mask"][:, :, None]
        mean = (out * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)
        mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
        return pd.Series(list(mean[:, :dim].astype("float32")))

    return embed
