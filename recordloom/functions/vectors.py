"""Hashing embeddings and similarity, as Arrow functions over whole batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

MEMO = 200_000  # distinct trigrams remembered per worker


def _bucket(tri: str, dim: int, family: str) -> int:
    if family == "blake2b":
        return int.from_bytes(hashlib.blake2b(tri.encode("utf-8"), digest_size=8).digest(), "little") % dim
    return int(hashlib.md5(tri.encode("utf-8")).hexdigest()[:8], 16) % dim


def hash_embed(text: Column, dim: int = 256, family: str = "blake2b") -> Column:
    """L2-normalised counts of hashed character trigrams; texts under three letters are padded."""
    if family not in ("blake2b", "md5"):
        raise ValueError("family is blake2b or md5")

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        memo: dict[str, int] = {}

        def one(t):
            t = (t or "").lower()
            if len(t) < 3:
                t += "   "
            slots = []
            for i in range(len(t) - 2):
                tri = t[i:i + 3]
                slot = memo.get(tri)
                if slot is None:
                    slot = _bucket(tri, dim, family)
                    if len(memo) < MEMO:
                        memo[tri] = slot
                slots.append(slot)
            v = np.bincount(slots, minlength=dim).astype(np.float64)
            return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)
        return texts.map(one)
    return embed(text)


def embed_udf(fn, dim: int):
    """Wrap any text -> vector function; a vector of another length is an error."""
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t):
            v = np.asarray(fn(t or ""), dtype=np.float32)
            if v.shape != (dim,):
                raise ValueError(f"embedder gave shape {v.shape}, expected ({dim},)")
            return v
        return texts.map(one)
    return embed


def embedder_id(name: str, dim: int, variant: str = "", chunking: str = "p3500") -> str:
    """Identity of a vector space; stores with another identity must be rebuilt."""
    return f"{name}:{dim}:{variant}:{chunking}"


@F.pandas_udf(T.DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    if len(a) == 0:
        return pd.Series([], dtype="float64")
    x, y = np.stack(a.to_numpy()).astype(np.float64), np.stack(b.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    return pd.Series(np.einsum("ij,ij->i", x, y) / np.where(norms == 0, 1.0, norms))
