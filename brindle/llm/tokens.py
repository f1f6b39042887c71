"""Token ids of a public tokenizer file, by the tokenizers library, with a cache in front of it.

The vocabulary lower-cases, drops white space and cuts a text at letters, digits and other
signs before any merge is made, so a run of letters or of signs has the same ids wherever it stands.
Runs are looked up in a bounded cache; the library encodes the unknown ones of many texts together.
Texts with characters beyond Latin-1, apostrophes or special tokens go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 2
#: Entries of a cache's generation; bounds a Python worker's memory.
CACHE_ENTRIES = 400_000
LONGEST_KEPT = 40
#: Texts of these characters alone have no composing or case rule that looks beyond one character.
_PLAIN = re.compile(r"[ -~À-ÿ\n\t\r]+").fullmatch
_LETTERS = "a-zß-öø-ÿ"
_SIGNS = rf"([^{_LETTERS}0-9\s]+)"
_DIGIT = re.compile(r"[0-9]").search


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class CachedEncoder:
    """The cache has two generations: words met again move to the young one, the old one is dropped whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words that are cut and lower-cased already: only bytes are mapped and merges made.
        bare = json.loads(self.tokenizer.to_str())
        bare["normalizer"] = None
        bare["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _asked(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        """Ids of unknown words.  Runs of one kind of sign are asked for together: each ends in a token that closes a word."""
        runs = [w for w in words if not _DIGIT(w)]
        rest = [w for w in words if _DIGIT(w)]
        if runs:
            ids = np.asarray(self.bare.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(runs):
                raw, last = ids.tobytes(), 0
                for word, cut in zip(runs, (cuts * 4).tolist(), strict=True):
                    self.young[word] = raw[last:cut]
                    last = cut
            else:
                rest += runs
        for word in rest:
            self.young[word] = self._asked(word).tobytes()

    def _plain_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts, words being cut and told apart by Arrow's kernels."""
        if len(self.young) >= CACHE_ENTRIES:
            self.young, self.old = {"": b""}, self.young
        parted = pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.large_string())), pattern=_SIGNS, replacement=r" \1 ")
        lists = pc.utf8_split_whitespace(parted)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = list(map(self.young.get, words))
        unknown = []
        for i, found in enumerate(ids):
            if found is None:
                found = self.old.get(words[i])
                if found is None:
                    unknown.append(words[i])
                else:
                    self.young[words[i]] = ids[i] = found
        if unknown:
            self._learn(unknown)
            ids = [self.young[w] if x is None else x for w, x in zip(words, ids, strict=True)]
            for word in unknown:
                if len(word) > LONGEST_KEPT:
                    del self.young[word]
        pool = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        sizes = size[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        gathered = pool[np.repeat(first[at] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [gathered[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """All ids of whole texts, as unsigned 32-bit integers; a null text has none."""
        plain = [i for i, t in enumerate(texts) if t and "'" not in t and "<|" not in t and _PLAIN(t)]
        out = [np.empty(0, "<u4") for _ in texts]
        for i, ids in zip(plain, self._plain_batch([texts[i] for i in plain]) if plain else [], strict=True):
            out[i] = ids
        for i in set(range(len(texts))).difference(plain):
            if texts[i]:
                out[i] = self._asked(texts[i])
        return out

    def encode_documents(self, texts: list[str | None], step: int = 1000, most_chars: int = 4_000_000) -> Iterator[np.ndarray]:
        """Ids of each text and the end id."""
        part: list[str | None] = []
        held = 0
        for i, text in enumerate(texts):
            part.append(text)
            held += len(text or "")
            if len(part) == step or held >= most_chars or i == len(texts) - 1:
                for ids in self.encode_batch(part):
                    yield np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False)
                part, held = [], 0


@lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    """One encoder in each Python worker."""
    return CachedEncoder(path)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
