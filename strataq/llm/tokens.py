"""Token ids of whole texts with a public tokenizer, as little-endian unsigned 32-bit bytes.

A byte-level BPE never joins characters across a space that stands between two other characters, so a text is encoded
piece by piece, and pieces seen before come from a table. A line feed between two other characters is an id of its own
and parts pieces likewise. A text in which white space meets a space is encoded as a whole, as there the split could
differ; so is a text that holds the string of an added token, which is one id.

The table is one array: a piece of up to KEY bytes has the row that its hash names, with its bytes and up to WIDE ids, and
another piece may take that row from it. All pieces of a slice are looked up by a few array operations, none as a Python
object, and memory stays as it is however many pieces come. The few pieces that fit no row are encoded anew in each slice.

New words of letters are what takes the time. The library's splitter would leave them as they are, and part them from a
run of marks behind them, so they go to its model in byte-level form, parted by a character, without the splitter's
regular expression.
"""

from __future__ import annotations

import codecs
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

VOCABULARY = "byte_bpe_50k.json"
ID_BYTES = 4
JOINED = 256
#: Stands for a line feed between two other characters, and parts words in byte-level form.
LINE, LINES = "\0", re.compile(r"\n(?<=\S\n)(?=\S)")
SPLITTER = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
#: Rows of the table, a power of two; bytes and ids of a piece that fits one. With its number of ids a row has 64 bytes.
MOST, KEY, WIDE = 1 << 20, 24, 8
#: Pieces that are looked up at once.
STEP = 1 << 17
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Marks a row that was found since a new piece asked for it last; the next one that asks does not get it.
USED = 1 << 8
#: Keeps the first 0 to 8 bytes of a little-endian word.
HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], "<u8")
#: Marks that are no letters, digits, white space or apostrophes.
PLAIN = ".,;:!?&%$#*|"


def byte_level() -> str:
    """The characters that stand for bytes in a byte-level vocabulary; 0 stays, as it parts words."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    table = [chr(b if b in plain else next(others)) for b in range(256)]
    return LINE + "".join(table[1:])


def letters() -> re.Pattern:
    """Runs of what has been a letter since Unicode 3.2, so that the library's tables say so too."""
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    found = [c for c in map(chr, range(0x80, 0xD800)) if new(c)[0] == old(c)[0] == "L"]
    return re.compile(f"[A-Za-z{LINE} \n{re.escape(PLAIN)}{''.join(found)}]*")


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """texts -> bytes of ids as the library gives them with add_special_tokens=False. One per worker: use `encoder(path)`."""

    def __init__(self, path: str, most: int = MOST):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.bits = max(most.bit_length() - 1, 1)
        self.rows = np.zeros((1 << self.bits, KEY // 8 + 1 + WIDE // 2), "<u8")  # bytes, number of ids, ids
        self.bare, self.table, self.letters = None, byte_level(), letters()
        if self.tok.normalizer is None and repr(self.tok.pre_tokenizer) == SPLITTER:
            self.bare = Tokenizer(self.tok.model)  # the same model
            self.bare.pre_tokenizer = CharDelimiterSplit(LINE)
        vocabulary = self.tok.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space, and that of a line feed
        self.opens[[i for t, i in vocabulary.items() if t[0] == self.table[32] or t == self.table[10]]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = [array("I", e.ids) for e in (self.tok.encode_batch_fast(texts, add_special_tokens=False) if texts else ())]
        if sys.byteorder == "big":
            for x in found:
                x.byteswap()
        return [x.tobytes() for x in found]

    def _joined(self, pieces: list[str], lead: str, words: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each) of pieces without line feeds, each with its lead, a space or a line feed: encoded by
        the hundred, and split where an id begins with a lead. words: they are letters, and marks after LINE."""
        for k in range(0, len(pieces), JOINED):
            part = pieces[k : k + JOINED]
            if words and self._plain(part):
                lead_in = lead if lead == " " else lead + LINE  # the splitter leaves a line feed alone
                (e,) = self.bare.encode_batch_fast([codecs.charmap_decode((lead_in + (LINE + lead_in).join(part)).encode(), "strict", self.table)[0]], add_special_tokens=False)
            else:
                (e,) = self.tok.encode_batch_fast([(lead + lead.join(part)).replace(LINE, "")], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            yield ids, np.diff(np.flatnonzero(self.opens.take(ids)), append=len(ids))

    def _plain(self, words: list[str]) -> bool:
        text = "".join(words)
        return self.bare is not None and (text.isascii() or self.letters.fullmatch(text) is not None)

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, number) of new pieces. A run of PLAIN marks after a word of letters stands for itself. A piece that
        only its text can settle, as white space is at its ends, has no ids."""
        groups: dict[tuple, tuple[list[int], list[str]]] = {(lead, how): ([], []) for lead in " \n" for how in ("words", "others", "lined")}
        for i, p in enumerate(new):
            lead = " "
            if p[:1] == LINE:
                lead, p = "\n", p[1:]
            how = "words"
            if not p.isalpha():
                word = p.rstrip(PLAIN)
                if word.isalpha():
                    p = f"{word}{LINE}{p[len(word) :]}"
                elif not p or p[0].isspace() or p[-1].isspace():
                    continue
                else:
                    how = "lined" if "\n" in p else "others"
            where, pieces = groups[lead, how]
            where.append(i)
            pieces.append(p)
        ids, numbers, at = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], []
        for (lead, how), (where, pieces) in groups.items():
            found = [np.frombuffer(x, "<u4") for x in self._whole([lead + p for p in pieces])] if how == "lined" else []
            for some, n in ((x, [len(x)]) for x in found) if how == "lined" else self._joined(pieces, lead, how == "words"):
                ids.append(some)
                numbers.append(n)
            at += where
        n = np.concatenate(numbers)
        first, number = np.zeros((2, len(new)), np.int64)
        first[at], number[at] = np.cumsum(n) - n, n
        return np.concatenate(ids), first, number

    def _keys(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(the bytes of each piece as words of 8, its row). data goes on for KEY bytes after the last piece."""
        words = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))  # from each byte on
        keys = [words[np.minimum(begin + k, len(words) - 1)] & HEADS.take(np.clip(size - k, 0, 8)) for k in range(0, KEY, 8)]
        h = sum(k * np.uint64(m) for k, m in zip(keys, HASHES, strict=True))
        h ^= h >> np.uint64(32)
        h *= np.uint64(HASHES[0])
        return keys, (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ids(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids of each); 0 for what only a text can settle. A piece goes from
        a cut to the space before the next one."""
        width, begin, size = KEY // 8, cuts[:-1], np.diff(cuts) - 1
        keys, row = self._keys(data, begin, size)
        found = self.rows.take(row, axis=0)
        number = found[:, width].astype(np.int64)
        known = (number > 0) & (size <= KEY)
        for k, key in enumerate(keys):
            known &= found[:, k] == key
        self.rows[row[known & (number <= WIDE)], width] |= np.uint64(USED)
        number &= USED - 1
        ids = found[:, width + 1 :].view("<u4")
        new = np.flatnonzero(~known)
        if not len(new):
            return ids[np.arange(WIDE) < number[:, None]], number
        # the new ones, each once
        pieces = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(cuts), pa.py_buffer(data)).take(pa.array(new)).dictionary_encode()
        of = pieces.indices.to_numpy()
        learnt, first, n = self._learn([p[:-1] for p in pieces.dictionary.to_numpy(zero_copy_only=False)])
        learnt = np.append(learnt, np.zeros(WIDE, "<u4"))
        short = np.where(np.arange(WIDE) < n[:, None], learnt[first[:, None] + np.arange(WIDE)], 0).astype("<u4")
        ids[new], number[new] = short[of], n[of]
        # a row for each that fits one; of several for the same row, any
        some = np.zeros(len(n), np.int64)
        some[of] = new
        some = some[(n > 0) & (n <= WIDE)]
        some = some[size[some] <= KEY]
        kept = (self.rows[row[some], width] & np.uint64(USED)) > 0
        self.rows[row[some[kept]], width] &= np.uint64(USED - 1)
        some = some[~kept]
        _, one = np.unique(row[some], return_index=True)
        some = some[one]
        self.rows[row[some]] = np.column_stack([*(k[some] for k in keys), number[some].astype("<u8"), np.ascontiguousarray(ids[some]).view("<u8")])
        if n.max(initial=0) <= WIDE:
            return ids[np.arange(WIDE) < number[:, None]], number
        out, wide = np.zeros(number.sum(), "<u4"), number > WIDE
        rest = np.repeat(wide, number)
        out[~rest] = ids[(np.arange(WIDE) < number[:, None]) & ~wide[:, None]]
        by = of[wide[new]]
        out[rest] = np.concatenate([learnt[a:b] for a, b in zip(first[by].tolist(), (first + n)[by].tolist(), strict=True)])
        return out, number

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """A null text counts as empty."""
        out, hard, rows = [b""] * len(texts), [], []
        for i, t in enumerate(texts):
            if t:
                (hard if LINE in t or any(a in t for a in self.added) else rows).append(i)
        if rows:
            # as if a line feed stood before each
            parts = [(LINE + LINES.sub(f" {LINE}", texts[i])).encode() for i in rows]
            ends = np.cumsum([len(p) + 1 for p in parts])  # after the space that follows each
            data = np.frombuffer(b" ".join([*parts, bytes(KEY)]), np.uint8)
            begin = np.append(0, np.flatnonzero(data == 32) + 1)
            found = [self._ids(data, begin[k : k + STEP + 1]) for k in range(0, len(begin) - 1, STEP)]
            ids, number = map(np.concatenate, zip(*found, strict=True))
            last = np.searchsorted(begin, ends)  # pieces up to each text's end
            unsafe = np.diff(np.searchsorted(np.flatnonzero(number == 0), last), prepend=0) > 0  # texts with a piece that only they can settle
            cuts = np.concatenate([[0], np.cumsum(number)])[np.concatenate([[0], last])] * ID_BYTES
            view = memoryview(ids.tobytes())
            for i, a, b, alone in zip(rows, cuts[:-1].tolist(), cuts[1:].tolist(), unsafe.tolist(), strict=True):
                if alone:
                    hard.append(i)
                else:
                    out[i] = bytes(view[a + ID_BYTES : b])
        for i, found in zip(hard, self._whole([texts[i] for i in hard]), strict=True):
            out[i] = found
        return out


def encoder(path: str, most: int = MOST) -> Encoder:
    """The worker's encoder for a vocabulary file, kept between tasks; it holds the ids of at most `most` pieces."""
    return kept(("tokens", path, most), lambda: Encoder(path, most))


def in_slices(column, size: int = 1 << 20):
    """(start, texts) of an Arrow string column, so that few whole texts are held as Python objects at once: `size` bytes
    of them, or one text."""
    before = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    k = 0
    while k < len(column):
        end = max(k + 1, int(np.searchsorted(before, (before[k - 1] if k else 0) + size, "right")))
        yield k, column.slice(k, end - k).to_pylist()
        pa.default_memory_pool().release_unused()
        k = end
