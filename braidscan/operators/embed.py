"""Function embeddings by message passing over basic blocks (structure2vec)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from braidscan.functions.hashes import normals

#: Rounds of messages, width of the embedding.
ROUNDS, WIDTH = 5, 64


def weights(features: int) -> tuple[np.ndarray, ...]:
    """Input, two inner and output matrices from integer arithmetic."""
    m = lambda seed, rows: np.array(normals(seed, rows, WIDTH)) / np.sqrt(rows)
    return m(41, features), m(42, WIDTH), m(43, WIDTH), m(44, WIDTH)


def embed(x: np.ndarray, a: np.ndarray, b: np.ndarray, w: tuple[np.ndarray, ...]) -> np.ndarray:
    """mu <- tanh(x W1 + relu(relu(N mu P1) P2)), ROUNDS times from zero; the blocks' sum times W2.

    N joins the blocks a[i] and b[i] both ways; its sums are taken edge by edge.
    """
    w1, p1, p2, w2 = w
    mu = np.zeros((len(x), WIDTH))
    for _ in range(ROUNDS):
        near = np.zeros_like(mu)
        np.add.at(near, a, mu[b])
        np.add.at(near, b, mu[a])
        mu = np.tanh(x @ w1 + np.maximum(np.maximum(near @ p1, 0) @ p2, 0))
    return mu.sum(0) @ w2


def embed_functions(blocks: DataFrame) -> DataFrame:
    """blocks (func, block, x, before: the preceding block or null) -> (func, n_blocks, v). A function's blocks fit one task."""
    import pandas as pd

    def run(key, pdf):
        x = np.nan_to_num(np.array(pdf["x"].tolist(), float))
        at = {b: i for i, b in enumerate(pdf["block"])}
        ends = sorted({(at[a], at[b]) for b, a in zip(pdf["block"], pdf["before"]) if pd.notna(a) and int(a) in at})
        a, b = np.array(ends, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"func": [key[0]], "n_blocks": [len(x)], "v": [np.round(embed(x, a, b, weights(x.shape[1])), 6).tolist()]})

    return blocks.groupBy("func").applyInPandas(run, "func long, n_blocks long, v array<double>")
