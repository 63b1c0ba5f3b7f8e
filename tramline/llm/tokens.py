"""Word-cached use of the public tokenizers, shared by packing and token output.

Byte-pair encoders split a text into pre-tokens before they merge anything, so
a text may be cut at any place where every pre-tokenizer in use cuts too and
the parts encoded one by one.  :data:`UNITS` cuts only

* before a space or newline that follows a character which is not white space,
* after a run of Latin letters that is followed by ASCII punctuation, a space,
  a newline or the end.

Both are pre-token borders of every tokenizer named in ``NAMES``; normalisers
(NFC, lower case, white space) never reach across them.  Texts with any other
white space or control separators are encoded whole.

A batch of texts is cut at single spaces and dictionary-encoded by Arrow, and
each distinct chunk is looked up once.  A chunk not seen before is a Latin
word with or without ASCII punctuation behind it, or is cut into units.  Latin
words are one pre-token each: the model alone, without normaliser and
pre-tokenizer, encodes many in one call.  Chunks and units that are kept are
bounded in number; the first ones seen, which hold the frequent ones, stay.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tramline.llm.common import trim

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
UNITS = re.compile(rf"[ \n]*[{LATIN}]++(?=[ \n!-/:-@\[-^`{{-~]|\Z)|[ \n]*[^ \n]+|[ \n]+\Z")
#: A Latin word (the one letter whose lower case is no letter alone is left out), and ASCII punctuation at the end, for Arrow.
WORD = "^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+$"
PUNCTUATION = r"[!-/:-@\[-^`{-~]+$"
FIRST = re.compile(r"[^ \n]*")
#: White space beside space and newline, and separators that engines class differently.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f-\u2060\u3000\ufeff<]")
#: Entries per worker: chunks in Arrow columns, units in a dictionary.
CACHE_ENTRIES, UNIT_ENTRIES = 500_000, 100_000
#: Places for kept chunks, by hash; a chunk whose place is taken is not kept.
SLOT_BITS = 22
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Longer parts are not kept.
LONG = 64
#: Words joined to one text for the model, and texts encoded in one call.
CALL, CALLS = 256, 32
#: Bytes of text, and texts, cut and dictionary-encoded at a time.
SLICE_BYTES, SLICE_TEXTS = 8 << 20, 4096
PROBE = ["word", "Word", "ÄRGER", "élève", "ɏx", "ŁÓDŹ", "a", "Internationalisation", "qzxwv", "ßtraße", "Ǆ"]


def gather(pool: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of pool that begin at offset, one after the other."""
    upto = np.cumsum(size)
    total = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    at = np.repeat((offset - (upto - size)).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return pool[at]


def slots_of(chunks: pa.Array) -> np.ndarray:
    """A number below 2**SLOT_BITS for each chunk, by its length and its first sixteen and last eight bytes."""
    if not len(chunks):
        return np.zeros(0, np.int64)
    _, offsets, data = chunks.buffers()
    ends = np.frombuffer(offsets, np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
    raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    start, size = ends[:-1] - ends[0], np.diff(ends)
    word = lambda at, n: windows[at].view("<u8").ravel() & LOW_BYTES[np.clip(n, 0, 8)]
    h = word(start, size) * MIX[0]
    h ^= h >> np.uint64(29)
    h += word(start + np.minimum(size, 8), size - 8) * MIX[1]
    h ^= h >> np.uint64(32)
    h += word(start + np.maximum(size - 8, 0), size) * MIX[2] + size.astype(np.uint64)
    return ((h ^ h >> np.uint64(31)) * MIX[0] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _ids(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, all ids) of parts' ids."""
    return np.fromiter(map(len, parts), np.int64, len(parts)) >> 2, np.frombuffer(b"".join(parts), "<u4")


class WordCachedTokenizer:
    """The ids of ``Tokenizer.encode(text, add_special_tokens=False)``, for many texts at a time."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.lower = self._whole("ABC") == self._whole("abc")
        self.before = "" if self._whole(" a") == self._whole("a") else " "
        self.units: dict[str, bytes] = {}
        self.chunks, self.sizes, self.ids = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.model = Tokenizer(self.tokenizer.model)  # the vocabulary is held once
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.comma = self.tokenizer.encode(",", add_special_tokens=False).ids[0]
        sizes, ids = self._words(pa.array([w.lower() if self.lower else w for w in PROBE]), self.before)
        if [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] != [self._whole(" " + w) for w in PROBE]:
            self.model = None  # another kind of tokenizer: every unit is encoded in full
        trim()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, words: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of Latin words with before in front; a comma, always a pre-token of its own, stands between them."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        cuts = pa.array([*range(0, len(words), CALL), len(words)], pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(cuts, words), f"\n,\n{before}").to_pylist()
        parts = []
        for a in range(0, len(joined), CALLS):  # an encoding holds far more than its ids
            encoded = self.model.encode_batch_fast([f"{before}{x}\n," for x in joined[a : a + CALLS]], add_special_tokens=False)
            parts += [np.array(e.ids, dtype="<u4") for e in encoded]
        got = np.concatenate(parts)
        at = np.flatnonzero(got == self.comma)
        if len(at) != len(words):
            raise RuntimeError("the tokenizer split a word at a comma")
        return np.diff(at, prepend=-1) - 1, got[got != self.comma]

    def _unit(self, part: str) -> bytes:
        found = self.units.get(part)
        if found is None:
            found = self._whole(part)
            if len(part) <= LONG and len(self.units) < UNIT_ENTRIES:
                self.units[part] = found
        return found

    def _text(self, text: str) -> bytes:
        """One text, by its units."""
        return self._whole(text) if OTHER_SPACE.search(text) else b"".join(map(self._unit, UNITS.findall(text)))

    def _new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of chunks not seen before, each with the space before it, or the newline that it begins with."""
        lines = pc.starts_with(chunks, "\n").to_numpy(zero_copy_only=False)
        if not lines.any():
            return self._after(chunks, " ")
        plain_sizes, plain_ids = self._after(chunks.filter(pa.array(~lines)), " ")
        line_sizes, line_ids = self._after(pc.utf8_slice_codeunits(chunks.filter(pa.array(lines)), 1), "")
        newline = np.frombuffer(self._unit("\n"), "<u4")
        sizes, offsets = np.zeros((len(chunks), 2), np.int64), np.zeros((len(chunks), 2), np.int64)
        sizes[lines, 0], sizes[lines, 1], sizes[~lines, 1] = len(newline), line_sizes, plain_sizes
        offsets[lines, 1] = np.cumsum(line_sizes) - line_sizes + len(newline)
        offsets[~lines, 1] = np.cumsum(plain_sizes) - plain_sizes + len(newline) + len(line_ids)
        return sizes.sum(1), gather(np.concatenate([newline, line_ids, plain_ids]), offsets.ravel(), sizes.ravel())

    def _after(self, chunks: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of chunks without white space, before in front of each."""
        stem = pc.replace_substring_regex(chunks, PUNCTUATION, "")
        short = pc.less_equal(pc.binary_length(chunks), LONG).to_numpy(zero_copy_only=False)
        by_word = pc.match_substring_regex(stem, WORD).to_numpy(zero_copy_only=False) & short & (self.model is not None)
        words = stem.filter(pa.array(by_word))
        words = (pc.utf8_lower(words) if self.lower else words).dictionary_encode()
        word_sizes, word_ids = self._words(words.dictionary, before and self.before)
        tails = pc.replace_substring_regex(chunks.filter(pa.array(by_word)), WORD[:-1], "").dictionary_encode()
        tail_sizes, tail_ids = _ids([self._unit(t) if t else b"" for t in tails.dictionary.to_pylist()])
        rest_sizes, rest_ids = _ids([self._text(before + c) for c in chunks.filter(pa.array(~by_word)).to_pylist()])
        # two runs a chunk: word or rest, and punctuation
        sizes, offsets = np.zeros((len(chunks), 2), np.int64), np.zeros((len(chunks), 2), np.int64)
        w, t = words.indices.to_numpy(), tails.indices.to_numpy()
        sizes[by_word, 0], offsets[by_word, 0] = word_sizes[w], (np.cumsum(word_sizes) - word_sizes)[w]
        sizes[by_word, 1], offsets[by_word, 1] = tail_sizes[t], (np.cumsum(tail_sizes) - tail_sizes)[t] + len(word_ids)
        sizes[~by_word, 0], offsets[~by_word, 0] = rest_sizes, np.cumsum(rest_sizes) - rest_sizes + len(word_ids) + len(tail_ids)
        return sizes.sum(1), gather(np.concatenate([word_ids, tail_ids, rest_ids]), offsets.ravel(), sizes.ravel())

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, offsets, pool of ids) of distinct chunks."""
        slots = slots_of(chunks)
        at = self.slots[slots].astype(np.int64)
        held = np.flatnonzero(at >= 0)  # chunks that share a place are told apart in full
        same = pc.equal(chunks.take(pa.array(held)), self.chunks.take(pa.array(at[held]))).to_numpy(zero_copy_only=False)
        at[held[~same]] = -1
        missing = at < 0
        new = chunks.filter(pa.array(missing))
        new_sizes, new_ids = self._new(new)
        at[missing] = np.arange(len(new)) + len(self.chunks)
        pool, all_sizes = np.concatenate([self.ids, new_ids]), np.concatenate([self.sizes, new_sizes])
        offsets = np.cumsum(all_sizes) - all_sizes
        if room := CACHE_ENTRIES - len(self.chunks):
            place = slots[missing]
            keep = ((pc.binary_length(new).to_numpy(zero_copy_only=False) <= LONG) & (self.slots[place] < 0)).nonzero()[0]
            keep = np.sort(keep[np.unique(place[keep], return_index=True)[1]])[:room]
            self.slots[place[keep]] = np.arange(len(keep)) + len(self.chunks)
            self.chunks = pa.concat_arrays([self.chunks, new.take(pa.array(keep))])
            self.ids = np.concatenate([self.ids, gather(new_ids, (np.cumsum(new_sizes) - new_sizes)[keep], new_sizes[keep])])
            self.sizes = np.concatenate([self.sizes, new_sizes[keep]])
        return all_sizes[at], offsets[at], pool

    def encode(self, texts: pa.Array, end_id: int | None = None, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends) of consecutive runs of texts, of slice_bytes or one text at most: all ids of a run, each text's followed by end_id if given, and where each text's end; null counts as empty."""
        texts = texts.cast(pa.string())
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(texts):
            before = int(sizes[a - 1]) if a else 0
            b = max(a + 1, min(a + SLICE_TEXTS, int(np.searchsorted(sizes, before + slice_bytes, "right"))))
            ids, ends = self._run(texts.slice(a, b - a))
            trim()
            yield (ids, ends) if end_id is None else (np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1))
            a = b

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = texts.to_pylist()
        apart = {i: self._text(t) for i, t in enumerate(plain) if t and (OTHER_SPACE.search(t) or "  " in t or " \n" in t or "\n\n" in t or t[-1] == " ")}
        if apart or texts.null_count:
            texts = pa.array(["" if t is None or i in apart else t for i, t in enumerate(plain)], pa.string())
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")  # a chunk that begins with a newline had no space before it
        codes = cut.flatten().dictionary_encode()
        ends = cut.offsets.to_numpy()[1:].astype(np.int64) - int(cut.offsets[0].as_py())
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        sizes, offsets, pool = self._chunks(codes.dictionary)
        code = codes.indices.to_numpy().astype(np.int64)
        # a text's first chunk has no space before it
        firsts = [FIRST.match(t)[0] if t and i not in apart else "" for i, t in enumerate(plain)]
        code[starts] = np.arange(len(firsts)) + len(sizes)
        first_sizes, first_ids = _ids([apart[i] if i in apart else self._text(t) for i, t in enumerate(firsts)])
        sizes, offsets = np.concatenate([sizes, first_sizes]), np.concatenate([offsets, np.cumsum(first_sizes) - first_sizes + len(pool)])
        each = sizes[code]
        return gather(np.concatenate([pool, first_ids]), offsets[code], each), np.cumsum(each)[ends - 1]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; null counts as empty."""
        out = []
        for ids, ends in self.encode(pa.array(texts, pa.string())):
            raw, start = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[4 * start : 4 * end])
                start = end
        return out


_OPEN: dict[str, WordCachedTokenizer] = {}


def tokenizer_at(path: str) -> WordCachedTokenizer:
    """The worker's tokenizer for that file; loaded once, its cache lasts over tasks."""
    if path not in _OPEN:
        _OPEN[path] = WordCachedTokenizer(path)
    return _OPEN[path]


def public_path(name: str) -> str:
    """Where the public vocabulary file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
