"""Tokenizing whole texts with the tokenizers library, a vocabulary's pieces cached.

Both vocabularies cut a text into pieces by a pattern before merging, and a piece between white space is the same in
every text. So the distinct words of many texts are cut into pieces together, and only pieces not met before go through
the library's merges. A word of Latin-1 letters with signs behind them is two pieces in both patterns, which are told
apart in Arrow's memory; other words are cut one by one by the vocabulary's own pattern. Where the vocabulary normalizes,
this holds for Latin-1 (composed, and lowered letter by letter); words beyond it, and texts with white space other than
single spaces and line ends, take the library's whole path. The cache is bounded and lives as long as a Python worker.
Special tokens' strings in a text are ordinary text.

Cases: null and empty texts have no ids; equal texts have equal ids; very long texts are encoded whole (callers give
at most C.BATCH_BYTES of text at once, or one text); texts with any white space or letters give what the library alone gives.
"""

from __future__ import annotations

import gc
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept in a worker's cache, which is emptied when full. About 200 bytes an entry.
CACHE_PIECES = 600_000

#: Before the first word of a text; a text that holds it is encoded directly.
FIRST = "\x00"
#: The letters and the signs of words that need no pattern: an apostrophe can begin a piece of its own.
LETTERS = "".join(chr(i) for i in range(256) if chr(i).isalpha())
SIGNS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'")
#: Byte-level vocabularies write a byte that is no visible Latin-1 character as the next free one from U+0100.
BYTES = dict(zip((b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255 and b != 173)), map(chr, range(256, 512))))

_loaded: dict[str, PieceCache] = {}


def cached(path: str) -> PieceCache:
    if path not in _loaded:
        _loaded[path] = PieceCache(path)
    return _loaded[path]


class PieceCache:
    """`encode_many(texts) -> (flat, ends)` of ids, two bytes each if the vocabulary allows it, four otherwise."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.normal = spec["normalizer"] is not None
        own = [x["pattern"]["Regex"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.cut = regex.compile(own[0] if own else public_tokenizers.PATTERN).findall
        self.merges = self.tok.model.tokenize  # one piece, its bytes written as characters
        self.pieces: dict[str, dict[str, bytes]] = {"": {}, " ": {}}  # by what stands before a piece
        self.code = "H" if self.dtype.itemsize == 2 else "I"  # machine order, which is little-endian wherever Spark's Arrow runs
        # white space is dropped by some vocabularies and part of the next word in others
        self.drops = not self.tok.encode("a b", add_special_tokens=False).ids[1:] or self.tok.encode(" b", add_special_tokens=False).ids == self.tok.encode("b", add_special_tokens=False).ids

    def _direct(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _merged(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            shown = piece
        else:
            shown = piece.encode().decode("latin-1").translate(BYTES)
        return array(self.code, [t.id for t in self.merges(shown)]).tobytes()

    def _slow(self, word: str) -> bytes:
        """Ids of a word that is not letters and signs behind them."""
        if self.normal:
            if max(word) > "\xff":
                return self._direct(word)
            own = self.cut(word.lower())
        else:
            own = self.cut(word[1:] if word[:1] == FIRST else word if word[:1] == "\n" else " " + word)
        return b"".join(self._of_pieces(own))

    def _of_pieces(self, names: list[str], lead: str = "") -> list[bytes]:
        """Ids of each piece with `lead` before it."""
        known = self.pieces[lead]
        ids = [*map(known.get, names)]
        if None in ids:
            if len(known) > CACHE_PIECES:
                known.clear()
            merges, code, shown_lead, merged = self.merges, self.code, lead.translate(BYTES), self._merged
            gc.disable()  # else each pass over the garbage walks the cache
            for i, x in enumerate(ids):
                if x is None:
                    p = names[i]
                    if p.isascii() and p.isalpha():
                        ids[i] = known[p] = array(code, [t.id for t in merges(shown_lead + p)]).tobytes()
                    else:
                        ids[i] = known[p] = merged(lead + p) if p else b""
            gc.enable()
        return ids

    def _stems(self, stems: pa.Array, lead: str) -> pa.Array:
        kinds = stems.dictionary_encode()
        return pa.array(self._of_pieces(kinds.dictionary.to_numpy(zero_copy_only=False).tolist(), lead), pa.large_binary()).take(kinds.indices)

    def _of_words(self, words: pa.Array) -> pa.Array:
        """Ids of each distinct word, as binary."""
        if self.normal:
            first = line = None
            t = pc.utf8_lower(words)
        else:  # what has no space before it is after a mark or a line end
            first, line = pc.starts_with(words, FIRST), pc.starts_with(words, "\n")
            t = pc.if_else(pc.or_(first, line), pc.utf8_slice_codeunits(words, 1), words)
        # letters are looked for in the word as it is: a letter beyond Latin-1 can have a lower case within it
        tail, stem = pc.utf8_ltrim(words if self.normal else t, LETTERS), pc.utf8_rtrim(t, SIGNS)
        plain = pc.equal(pc.utf8_rtrim(tail, SIGNS), "")
        if self.normal:
            ids = self._stems(stem, "")
        else:
            bare = pc.or_(first, line)
            plain = pc.and_(plain, pc.not_equal(stem, ""))
            ids = pc.if_else(bare, self._stems(pc.if_else(bare, stem, ""), ""), self._stems(pc.if_else(bare, "", stem), " "))
            ids = pc.if_else(line, pc.binary_join_element_wise(pa.scalar(self._of_pieces(["\n"])[0], ids.type), ids, pa.scalar(b"", ids.type)), ids)
        out = pc.binary_join_element_wise(ids, self._stems(tail, ""), pa.scalar(b"", ids.type))
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if len(odd):
            out = pc.replace_with_mask(out, pc.invert(plain), pa.array([self._slow(w) if w else b"" for w in words.take(pa.array(odd)).to_pylist()], out.type))
        return out

    def encode_many(self, texts: pa.Array | list) -> list[bytes]:
        """Ids of each text (null: none). Words are told apart once for all texts given, in Arrow's memory."""
        col = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        odd: dict[int, str] = {}
        if self.drops:
            lists = pc.split_pattern(pc.replace_substring(col, "\n", " "), " ")
        else:
            strange = pc.match_substring_regex(col, r"  |\n\n| \n|\n |\x00|^\s|\s$")
            odd = {i: col[i].as_py() for i in np.flatnonzero(strange.to_numpy(zero_copy_only=False)).tolist()}
            plain = pc.if_else(strange, pa.scalar("", col.type), col)
            # the first word has no space before it, which the mark tells
            lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(FIRST, plain, ""), "\n", " \n"), " ")
        words = lists.values.dictionary_encode()
        taken = self._of_words(words.dictionary).take(words.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64)[np.asarray(lists.offsets)].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        return [self._direct(odd[i]) if i in odd else bytes(data[a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
