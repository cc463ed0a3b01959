"""Token ids of whole texts by the tokenizers library.

A text is cut at single spaces between two non-blank characters, and where it has no
other blanks also at single line ends.  Both public vocabularies used here start a
new word at such a place (one keeps the space with the next word and a line end as a
word of its own, the other drops blanks), so the ids of the text are the ids of the
chunks in a row, and a chunk that occurs again is looked up, not encoded again.  The
strings of special tokens hold no blank, so they stay inside a chunk and get the ids
that the library gives them.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np

from faultatlas.llm.worker import kept

END_ID = 0
_CUT = re.compile(r"(?<=\S) (?=\S)")
# Letters and up to three ASCII marks behind them: separate words to both vocabularies, as no apostrophe is among the marks.
_LETTERS_AND_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]{0,3})")
# How byte-level vocabularies write the bytes: printable ones as they are, the others above 255.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + k for k, b in enumerate(sorted({*range(256)} - _PRINTED))}
_BEYOND_LATIN = "\u0250"


def spelled(word: str) -> str:
    return word.encode().decode("latin-1").translate(_BYTES)


class ChunkEncoder:
    """Encodes texts to little-endian id bytes.

    ``remembered`` bounds the chunks whose ids are kept; chunks beyond it are
    encoded each time they occur, so the bound changes the time only.
    """

    def __init__(self, path: str, remembered: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.code = {2: "H", 4: "I"}[np.dtype(self.dtype).itemsize]
        # How the model spells a word of Latin letters behind a space; None if neither way is its own.
        samples = ["a", "The", "garden", "HELLO", "Xqzjk", "tionerthre", "été", "Größe", "ÑÇÊÀ", "œuvre"]
        whole = self._encode([" " + w for w in samples])
        keeps_space, drops_blanks = ((lambda w: spelled(" " + w)), (lambda w: spelled(w.lower())))
        self.spell = next((f for f in (keeps_space, drops_blanks) if [self._word(f(w)) for w in samples] == whole), None)
        # What a line end adds before a word, and how ASCII letters are spelled behind it and behind a space.
        self.line_end, self.lower, self.space = b"", self.spell is drops_blanks, ""
        if self.spell is keeps_space:
            self.line_end, self.space = self._encode(["\n"])[0], spelled(" ")

    def _encode(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _word(self, spelled: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self._encode([mark])[0]
        return self.marks[mark]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words behind a space, the space included; of words with a line end before them, that included.

        Letters and the marks behind them are separate words to both vocabularies, so
        such a word is its letters and its marks.
        """
        ids, cores, rest = {}, {}, []
        tokenize, code, match = self.tokenizer.model.tokenize, self.code, _LETTERS_AND_MARKS.fullmatch
        for word in words:
            at_line = word[0] == "\n"
            plain = match(word, 1 if at_line else 0) if self.spell is not None else None
            core, mark = plain.groups() if plain is not None else ("", "")
            if not core.isascii():
                # A letter whose lower case is not a letter alone (U+0130 gives i and a mark) is not one word to both.
                known = core.isalpha() and max(core) < _BEYOND_LATIN and core.lower().isalpha()
                core = spelled(core.lower() if self.lower else core) if known else ""
            elif self.lower:
                core = core.lower()
            if not core:
                rest.append(word)
                continue
            if not self.lower and not at_line:
                core = self.space + core
            found = cores.get(core)
            if found is None:
                found = cores[core] = array(code, [t.id for t in tokenize(core)]).tobytes()
            if mark:
                found += self._mark(mark)
            ids[word] = self.line_end + found if at_line else found
        ids.update(zip(rest, self._encode([w if w[0] == "\n" else " " + w for w in rest]), strict=True))
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, without an end id; a null text has none."""
        if not text:
            return b""
        # Single spaces and line ends between other characters are all its blanks, or it is cut at single spaces only.
        words = text.split()
        plain = self.spell is not None and " ".join(words) == text.replace("\n", " ")
        if not plain:
            words = _CUT.split(text)
        elif self.line_end:
            words = f"\n{text}".replace("\n", " \n")[1:].split(" ")
        known = self.known
        found = list(map(known.get, words))
        if not plain:
            found[0] = self._encode(words[:1])[0]
        if None in found:
            missing = [k for k, ids in enumerate(found) if ids is None]
            fresh = self._learn(list({words[k] for k in missing}))
            if len(known) + len(fresh) <= self.remembered:
                known.update(fresh)
            for k in missing:
                found[k] = fresh[words[k]]
        # The first word was looked up as one behind a line end, where that makes a difference.
        body = b"".join(found)
        return body[len(self.line_end) :] if plain else body

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text with the end id behind them."""
        body = self.encode(text) + np.array([END_ID], self.dtype).tobytes()
        return np.frombuffer(body, self.dtype)


def worker_encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker."""
    return kept(("encoder", path), lambda: ChunkEncoder(path))


def id_type(vocabulary: int) -> str:
    """Smallest little-endian unsigned type that holds every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
