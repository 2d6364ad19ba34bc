"""Codecs of vectors and small values: little-endian blobs, half precision, base64, tokens, environment."""

from __future__ import annotations

import base64
import json
import os
import secrets
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_blob(vector: Sequence[float], half: bool = False) -> bytes:
    """A vector as little-endian 32-bit floats, or 16-bit ones."""
    return np.asarray(vector, dtype="<f2" if half else "<f4").tobytes()


def from_blob(blob: bytes, half: bool = False) -> list[float]:
    return np.frombuffer(blob, dtype="<f2" if half else "<f4").astype(np.float64).tolist()


def to_blob_column(vector: Column, half: bool = False) -> Column:
    """`to_blob` of an array column; null for null."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else to_blob(v, half) for v in column.to_pylist()], type=pa.binary())

    return F.arrow_udf(run, returnType="binary")(vector)


def from_blob_column(blob: Column, half: bool = False) -> Column:
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if b is None else from_blob(b, half) for b in column.to_pylist()], type=pa.list_(pa.float64()))

    return F.arrow_udf(run, returnType="array<double>")(blob)


def mean_pool(tokens: Sequence[Sequence[float]]) -> list[float]:
    """Mean of token vectors, padding included, brought to length 1 (a zero mean stays zero)."""
    mean = np.asarray(tokens, dtype=np.float64).mean(axis=0)
    size = float(np.linalg.norm(mean))
    return (mean / size if size else mean).tolist()


def random_base64(n: int = 32) -> str:
    """n random bytes in base64."""
    return base64.b64encode(secrets.token_bytes(n)).decode()


def generate_token(n: int = 32) -> str:
    """A random token of n letters and digits that may stand in an address."""
    return secrets.token_urlsafe(n)[:n]


def encode(value: Any) -> str:
    """A value's JSON in base64; `decode` reads it."""
    return base64.b64encode(json.dumps(value, ensure_ascii=False).encode()).decode()


def decode(text: str) -> Any:
    return json.loads(base64.b64decode(text))


def env_or(name: str, other: str | None = None) -> str | None:
    return os.environ.get(name, other)
