"""Settings from the environment, and logging."""

from __future__ import annotations

import functools
import logging
import os
import time
from dataclasses import dataclass, field


@dataclass(frozen=True)
class StoreConfig:
    path: str = "quern-store"
    collection: str = "wiki"
    #: Vector sizes of the two collections; a vector of another size is refused.  None: any size.
    text_dim: int | None = None
    image_dim: int | None = None


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 10
    generated_queries: int = 4
    fusion_k: int = 60
    text_boost: float = 1.5


@dataclass(frozen=True)
class ChunkConfig:
    buffer: int = 1
    percentile: float = 0.70


@dataclass(frozen=True)
class Config:
    store: StoreConfig = field(default_factory=StoreConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    token_price: float = 0.00002
    api_url: str | None = None


def load_env(*keys: str, env: dict[str, str] | None = None) -> dict[str, str | None]:
    """The named settings; a missing one is None."""
    env = os.environ if env is None else env
    return {k: env.get(k) for k in keys}


def load_config(env: dict[str, str] | None = None) -> Config:
    got = load_env("QUERN_STORE", "QUERN_COLLECTION", "QUERN_TOP_K", "QUERN_API_URL", "QUERN_TEXT_DIM", "QUERN_IMAGE_DIM", env=env)
    size = lambda key: int(got[key]) if got[key] else None
    store = StoreConfig(path=got["QUERN_STORE"] or "quern-store", collection=got["QUERN_COLLECTION"] or "wiki", text_dim=size("QUERN_TEXT_DIM"), image_dim=size("QUERN_IMAGE_DIM"))
    return Config(store=store, retrieval=RetrievalConfig(top_k=int(got["QUERN_TOP_K"] or 10)), api_url=got["QUERN_API_URL"])


def set_up_logging(path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """Driver log to the console and, if a path is given, to a file."""
    log = logging.getLogger("quern")
    log.setLevel(level)
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
    if path and not any(isinstance(h, logging.FileHandler) for h in log.handlers):
        log.addHandler(logging.FileHandler(path))
    return log


def timed(f):
    """Log how long a driver-side call takes."""

    @functools.wraps(f)
    def call(*args, **kwargs):
        began = time.perf_counter()
        try:
            return f(*args, **kwargs)
        finally:
            logging.getLogger("quern").info("%s took %.3f s", f.__name__, time.perf_counter() - began)

    return call
