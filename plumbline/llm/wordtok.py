"""Tokenising whole texts with the public `tokenizers` library at memory speed.

The vocabulary used here drops white space before its byte-pair merges, so no token ever crosses a blank: the ids of a
text are the ids of its blank-separated chunks, one after the other. Each distinct chunk is therefore encoded once by the
library and remembered; a batch of texts is split, dictionary-encoded and gathered with Arrow and NumPy.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.wordsplit import give_back

#: Chunks remembered by one Python worker: those met in a second run while there is room. The others are encoded in
#: each run anew (a speed matter only, never a result).
MEMO_ENTRIES = 300_000
#: Marks of chunks met before, by hash.
MET_MARKS = 1 << 22
#: Texts are handled in runs of about so many bytes, so that memory does not follow the size of an Arrow batch.
RUN_BYTES = 4_000_000

#: Chunks given to the library at once: its encodings are much larger than their ids.
LIBRARY_BATCH = 4_096

_LOADED: dict[tuple[str, bool], "ChunkTokenizer"] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str, plain: bool = False) -> "ChunkTokenizer":
    """The tokenizer of a path, loaded once per Python worker; plain: special tokens' strings in a text are ordinary text."""
    if (path, plain) not in _LOADED:
        _LOADED[path, plain] = ChunkTokenizer(path, plain)
    return _LOADED[path, plain]


class ChunkTokenizer:
    """`encode(texts)` gives (flat uint32 ids, int64 offsets); nulls and empty texts have no ids."""

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.known = pa.array([], pa.large_string())  # chunks in memory; Arrow looks a whole run's chunks up at once
        self.ids = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.int64)
        self.met = np.zeros(MET_MARKS, bool)

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct chunks and their numbers."""
        ids, lengths = [], []
        for at in range(0, len(chunks), LIBRARY_BATCH):
            found = [x.ids for x in self.library.encode_batch_fast(chunks[at : at + LIBRARY_BATCH], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(lengths[-1].sum())))
        if not chunks:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(lengths)

    def _lookup(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, start in it, number) of distinct chunks."""
        rows = np.asarray(pc.fill_null(pc.index_in(chunks, value_set=self.known), -1).to_numpy(zero_copy_only=False), np.int64).copy()
        new = np.flatnonzero(rows < 0)
        fresh = chunks.take(pa.array(new)).to_pylist()
        own, sizes = self._encode_chunks(fresh)
        rows[new] = len(self.lengths) + np.arange(len(new))
        pool, lengths = np.concatenate([self.ids, own]), np.concatenate([self.lengths, sizes])
        starts = np.cumsum(lengths) - lengths
        room = MEMO_ENTRIES - len(self.known)
        if room > 0 and len(new):
            marks = np.fromiter(map(hash, fresh), np.int64, len(fresh)) & (len(self.met) - 1)
            again = np.flatnonzero(self.met[marks])[:room]
            self.met[marks] = True
            ends = np.cumsum(sizes)
            parts = [own[ends[k] - sizes[k] : ends[k]] for k in again]
            self.known = pa.concat_arrays([self.known, pa.array([fresh[k] for k in again], pa.large_string())])
            self.ids, self.lengths = np.concatenate([self.ids, *parts]), np.concatenate([self.lengths, sizes[again]])
        return pool, starts[rows], lengths[rows]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin (one more entry than texts)."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), np.int64)
        parts, counts = [], []
        begin = 0
        while begin < len(texts):
            reach = np.cumsum(sizes[begin : begin + 4096])
            end = begin + max(1, int(np.searchsorted(reach, RUN_BYTES, "right")))
            ids, n = self._encode_run(texts.slice(begin, end - begin))
            parts.append(ids)
            counts.append(n)
            begin = end
        give_back()
        offsets = np.zeros(len(texts) + 1, np.int64)
        if counts:
            np.cumsum(np.concatenate(counts), out=offsets[1:])
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), offsets

    def _encode_run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        blank = pc.replace_substring(texts, "\n", " ")  # also lays a slice out anew: ascii_lower misreads slices
        if not pc.any(pc.match_substring(blank, "<|")).as_py():  # where no special token can arise from it
            blank = pc.ascii_lower(blank)
        words = pc.split_pattern(blank, " ")
        bounds = np.asarray(words.offsets.to_numpy(zero_copy_only=False), np.int64)
        coded = words.flatten().dictionary_encode()
        at = np.asarray(coded.indices.to_numpy(zero_copy_only=False), np.int64)
        pool, starts, lengths = self._lookup(coded.dictionary)
        n = lengths[at]
        ends = np.cumsum(n)
        where = np.repeat(starts[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return pool[where], np.diff(np.concatenate([[0], ends])[bounds - bounds[0]])
