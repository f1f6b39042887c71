"""Topics of token sequences: a coarse quantiser over latent-semantic vectors, which brings lexically close documents together.

Token ids are dealt to ``BUCKETS`` buckets.  The square roots of a document's counts by bucket, weighted by the buckets' inverse document
frequencies, are projected on the sample's leading singular vectors, and its topic is the centre with the greatest
cosine.  Topics are numbered along a chain of nearest centres, so that neighbouring numbers are close as well.

The quantiser is fitted on a sample of ``SAMPLE`` documents on average; every document gets a topic.  Defined cases: a sample of fewer
than two documents gives one topic; a document with no weight has topic 0.
"""

from __future__ import annotations

import numpy as np

SAMPLE, BUCKETS, DIMENSIONS, TOPICS = 2048, 4096, 48, 128
ROUNDS, SEED = 8, 20_011


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that hold ids, and the square roots of how many."""
    counts = np.bincount((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at]).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class Topics:
    def __init__(self, sample: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """sample: counted() of each sampled document."""
        self.centres = np.zeros((1, 1), np.float32)
        self.projection = np.zeros((BUCKETS, 1), np.float32)
        if len(sample) < 2:
            return
        rng = np.random.default_rng(SEED)
        held = np.zeros((len(sample), BUCKETS), np.float32)
        for i, (at, root) in enumerate(sample):
            held[i, at] = root
        idf = np.log1p(len(sample) / np.maximum((held > 0).sum(axis=0), 1)).astype(np.float32)
        rows = _unit(held * idf)
        width = min(DIMENSIONS, len(sample))
        span = rows @ rng.standard_normal((BUCKETS, min(width + 16, len(sample)))).astype(np.float32)
        for _ in range(3):  # subspace iteration towards the leading singular vectors
            span, _ = np.linalg.qr(rows @ (rows.T @ span))
        right = np.linalg.svd(span.T @ rows, full_matrices=False)[2][:width]
        self.projection = (right.T * idf[:, None]).astype(np.float32)
        vectors = _unit(held @ self.projection)
        centres = vectors[rng.choice(len(sample), min(TOPICS, len(sample)), replace=False)]
        for _ in range(ROUNDS):
            nearest = (vectors @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, vectors)
            centres = np.where(np.bincount(nearest, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
        chain, left = [0], set(range(1, len(centres)))
        while left:
            rest = np.array(sorted(left))
            chain.append(int(rest[(centres[rest] @ centres[chain[-1]]).argmax()]))
            left.remove(chain[-1])
        self.centres = centres[chain].astype(np.float32)

    def of(self, ids: np.ndarray) -> int:
        at, root = counted(ids)
        return int((self.centres @ (root @ self.projection[at])).argmax())
