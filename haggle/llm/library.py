"""The installed tokenizer library inside tasks, with a bounded memory of pre-tokens it has encoded."""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa

#: Pre-tokens that a worker remembers; beyond it the memory starts anew. Only speed depends on it.
MEMORY = 1 << 19


@functools.cache
def tokenizer(path: str):
    """The tokenizer of a .json file, without truncation or padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@functools.cache
def special_strings(path: str) -> tuple[str, ...]:
    """Strings that the library takes out of a text before it splits it. Raises
    ValueError for a tokenizer whose pre-tokens are not those of the byte-level pattern."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
        raise ValueError(f"{path}: only byte-level tokenizers without a normaliser or prefix space are split here")
    added = spec.get("added_tokens", [])
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
        raise ValueError(f"{path}: added tokens that reach into their neighbours are not split here")
    return tuple(sorted((x["content"] for x in added), key=len, reverse=True))


def vocabulary_size(path: str) -> int:
    return tokenizer(path).get_vocab_size(with_added_tokens=True)


_known: dict[str, dict[bytes, bytes]] = {}


def encode_distinct(path: str, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct pre-tokens by the library: all ids in a row, and how many each pre-token has."""
    known = _known.setdefault(path, {})
    words = tokens.to_pylist()
    new = [w for w in words if w not in known]
    if len(known) + len(new) > MEMORY:
        known.clear()
        new = words
    if new:
        encoded = tokenizer(path).encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        known.update((w, np.asarray(e.ids, dtype="<u4").tobytes()) for w, e in zip(new, encoded))
    parts = [known[w] for w in words]
    return np.frombuffer(b"".join(parts), dtype="<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
