"""Token ids of whole texts, with a memory of the words seen before.

Texts are cut where a vocabulary breaks them whatever stands around, and the
ids of a text are those of its pieces, one after another.  Cutting, counting of
equal pieces and gathering of ids are Arrow and numpy work on whole slices of
texts; only pieces that the worker does not remember go to the tokenizers
library.  The places:

- A vocabulary that keeps blanks breaks between a character that is no white
  space and a blank or line feed that follows it.
- One that drops blanks is cut at blanks and line feeds, which are no tokens.
- Both break between an ASCII letter or digit and a full stop or comma that
  follows it; this is used at the end of a piece.  Other letters do not count: normalisation may end them with a
  mark (``\\u09df``, ``\\u0130``), and marks join the full stop.

Lower case is taken ahead of the library, so that more pieces are equal, only
for ASCII pieces that hold no special token.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered by a worker (about 80 MB): half of them anew, the other half from before, of which those met again move over.
MEMORY = 400_000
#: Pieces that go to the library in one string.
RUN = 500
#: Longer pieces are encoded but not remembered.
LONGEST = 48

#: White space of any script before a blank or line feed: a run of it may be one token, so it is cut at its start only.
_RUNS = r"[\s\v\x1c-\x1f\x{85}\x{180e}\pZ][ \n]"
_RUN_START = re.compile("(?<=[^\\s᠎])(?=[ \n])")


class WordMemory(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, keeps_space: bool):
        """A vocabulary with at least one special token; ``keeps_space``: blanks belong to the piece after them."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.unnormalized = self.tokenizer
        if not keeps_space:
            # composing and lower case, all that a normaliser here does to a piece, leave Latin-1 text in lower case as it is
            self.unnormalized = Tokenizer.from_file(path)
            self.unnormalized.normalizer = None
        self.keeps_space = keeps_space
        self.before: dict[str, bytes] = {}
        self.mark_id, self.mark = next((i, str(t)) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)

    def cut(self, texts: pa.Array) -> pa.Array:
        """The pieces of each text, still with their full stops and commas."""
        if not self.keeps_space:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        free = chain([0], range(0xE000, 0xF900), range(0xF0000, 0x110000))
        gap = next(c for c in map(chr, free) if not pc.any(pc.match_substring(texts, c)).as_py())
        marked = pc.replace_substring(pc.replace_substring(texts, " ", gap + " "), "\n", gap + "\n")
        runs = pc.match_substring_regex(texts, _RUNS)
        if pc.any(runs).as_py():
            again = [_RUN_START.sub(gap, t) for t in texts.filter(runs).to_pylist()]
            marked = pc.replace_with_mask(marked, runs, pa.array(again, marked.type))
        return pc.split_pattern(marked, gap)

    def folded(self, pieces: pa.Array) -> pa.Array:
        if self.keeps_space:
            return pieces
        plain = pc.and_not(pc.string_is_ascii(pieces), pc.match_substring(pieces, "|>"))
        return pc.if_else(plain, pc.ascii_lower(pieces), pieces)

    def from_library(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of single pieces: strings of many, parted by a special token, on either side of which the library works apart."""
        groups: dict[str, list[str]] = {"whole": [], "lower": [], "alone": []}
        for piece in pieces:
            simple = not self.keeps_space and (piece.isascii() or max(piece) < "\u0100") and "|>" not in piece
            groups["alone" if self.mark in piece else "lower" if simple else "whole"].append(piece)
        for name, tokenizer in (("whole", self.tokenizer), ("lower", self.unnormalized)):
            runs = [groups[name][at : at + RUN] for at in range(0, len(groups[name]), RUN)]
            joined = (self.mark.join(run) for run in runs)
            found = tokenizer.encode_batch_fast([x.lower() if name == "lower" else x for x in joined], add_special_tokens=False)
            for run, one in zip(runs, found, strict=True):
                ids = np.array(one.ids, "<u4")
                ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
                raw, start = ids.tobytes(), 0
                for piece, end in zip(run, ends, strict=True):
                    yield piece, raw[4 * start : 4 * end]
                    start = end + 1
        for piece, one in zip(groups["alone"], self.tokenizer.encode_batch_fast(groups["alone"], add_special_tokens=False), strict=True):
            yield piece, np.array(one.ids, "<u4").tobytes()

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece."""
        if len(self) > MEMORY // 2:
            self.before = dict(self)
            self.clear()
        found = list(map(self.get, pieces))
        open_ = [i for i, ids in enumerate(found) if ids is None]
        before = self.before
        fresh = {}
        for i in open_:
            piece = pieces[i]
            if piece in before:
                found[i] = self[piece] = before[piece]
            else:
                fresh[piece] = None
        if fresh:
            for piece, ids in self.from_library(list(fresh)):
                fresh[piece] = ids
            for i in open_:
                if found[i] is None:
                    found[i] = fresh[pieces[i]]
            self.update((p, ids) for p, ids in fresh.items() if len(p) <= LONGEST)
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none of them null) one after another, each text closed by ``end_id``; and where each ends."""
        cut = self.cut(texts)
        pieces = cut.flatten().dictionary_encode()
        kinds = self.folded(pieces.dictionary)
        # a full stop or comma at the end of a piece is a piece of its own
        marked = pc.match_substring_regex(kinds, "[A-Za-z0-9][.,]$")
        bare = pc.if_else(marked, pc.utf8_slice_codeunits(kinds, 0, -1), kinds).dictionary_encode()
        table = self.of_pieces([*bare.dictionary.to_numpy(zero_copy_only=False).tolist(), ".", ","])
        table.append(np.array([end_id], "<u4").tobytes())
        point, comma, end = range(len(table) - 3, len(table))
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        first = np.cumsum(size) - size

        of_kind = bare.indices.to_numpy().astype(np.int64)
        tail = np.where(marked.to_numpy(zero_copy_only=False), np.where(pc.ends_with(kinds, ".").to_numpy(zero_copy_only=False), point, comma), -1)
        order = pieces.indices.to_numpy().astype(np.int64)
        closes = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64))
        steps = np.ones(len(order), np.int64)
        steps += tail[order] >= 0
        last = np.zeros(len(order), bool)
        last[closes - 1] = True  # a text has one piece at least
        steps += last
        places = np.cumsum(steps)
        parts = np.repeat(of_kind[order], steps)
        parts[places[last] - 1] = end
        with_tail = tail[order] >= 0
        parts[(places - 1 - last)[with_tail]] = tail[order[with_tail]]
        each = size[parts]
        ends = np.cumsum(each)
        where = np.repeat(first[parts] - (ends - each), each)
        where += np.arange(len(where))
        return np.frombuffer(b"".join(table), "<u4")[where], ends[places[last] - 1]


_memories: dict[str, WordMemory] = {}


def memory(path: str) -> WordMemory:
    """The worker's memory for the vocabulary file at ``path``; it outlives tasks where workers are reused."""
    if path not in _memories:
        import json

        with open(path, encoding="utf-8") as file:
            normalizer = json.load(file)["normalizer"]
        _memories[path] = WordMemory(path, keeps_space=normalizer is None)
    return _memories[path]


def encoded(words: WordMemory, ids: pa.Array, texts: pa.Array, end_id: int, chars: int = 1_000_000) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(row ids, token ids, ends) of runs of rows with about ``chars`` bytes of text, so that few pieces exist at a time."""
    texts = texts.cast(pa.large_string())
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(size, (size[start - 1] if start else 0) + chars, "left")) + 1
        part = slice(start, min(stop, len(texts)))
        yield ids[part].to_pylist(), *words.encode(texts[part], end_id)
        start = stop
