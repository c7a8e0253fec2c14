"""Words of whole texts as numbers: batches are split and dictionary-encoded by Arrow, distinct words hashed once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are handled in runs of about so many bytes.
RUN_BYTES = 2_000_000
PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


try:
    _malloc_trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _malloc_trim = None


def give_back() -> None:
    """Return freed memory to the system: Python workers stay alive between tasks, beside the executor's own heap."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def plain_word(word: str) -> str:
    """Lower case without punctuation at its ends; a word of punctuation alone stays."""
    return word.strip(PUNCTUATION).lower() or word


def hash_word(word: str) -> int:
    """64-bit hash of a plain word."""
    return xxhash.xxh64_intdigest(plain_word(word).encode())


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word numbers one text after the other, bounds of the texts, distinct words): blanks are the ASCII ones."""
    for blank in ("\n", "\t", "\r", "\x0b", "\x0c"):
        texts = pc.replace_substring(texts, blank, " ")
    words = pc.split_pattern(texts, " ")
    bounds = np.asarray(words.offsets.to_numpy(zero_copy_only=False), np.int64)
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    at = np.asarray(coded.indices.to_numpy(zero_copy_only=False), np.int64)
    bounds = bounds - bounds[0]
    if "" in distinct:
        real = at != distinct.index("")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        at = at[real]
    return at, bounds, distinct


def runs(texts: pa.Array | pa.ChunkedArray, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of stretches of bounded size; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), np.int64)
    begin = 0
    while begin < len(texts):
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin : begin + 4096]), run_bytes, "right")))
        yield begin, texts.slice(begin, end - begin)
        begin = end
    give_back()


def hashed_runs(texts: pa.Array, hasher: Callable[[str], int] = hash_word) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of words one text after the other, bounds of the texts) of each stretch."""
    for begin, part in runs(texts):
        at, bounds, distinct = split_words(part)
        yield begin, np.fromiter(map(hasher, distinct), np.uint64, len(distinct))[at], bounds


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def content_codes(words: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a word sequence."""
    place = np.arange(1, len(words) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        a = mix(words ^ mix(place)).sum(dtype=np.uint64)
        b = mix(words + place * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))
