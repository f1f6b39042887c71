"""Words of texts, cut and told apart by Arrow's kernels: runs of letters, lower-cased."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Cut:
    """Texts as places in a list of distinct words; text i has places[bounds[i]:bounds[i + 1]]."""

    words: list[str]
    places: np.ndarray
    bounds: np.ndarray


def cut_words(texts: list[str | None]) -> Cut:
    """A null text and one without letters have no word."""
    column = pc.fill_null(pa.array(texts, pa.large_string()), "")
    spaced = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(column), pattern=r"[^\pL]+", replacement=" "), " ")
    lists = pc.split_pattern(spaced, " ")
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    words, places = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    if "" in words:  # what an empty text is split into
        keep = places != words.index("")
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        places = places[keep]
    return Cut(words, places, bounds)


def in_parts(texts: list[str | None], most_chars: int = 1_000_000) -> Iterator[list[str | None]]:
    """The texts in runs of about so many characters; a longer text is a run of its own."""
    part: list[str | None] = []
    held = 0
    for text in texts:
        part.append(text)
        held += len(text or "")
        if held >= most_chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def sums_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]
