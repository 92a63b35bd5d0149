"""Token ids of texts with a public byte-level tokenizer, one lookup per word.

Byte-level pieces never reach over a space between two other characters, so the ids of a text are those of
its space-separated chunks one after the other. A task keeps the ids of chunks and words that it has met and
hands only new ones to the tokenizers library; the ids are those of encoding the text at once. A text that holds
an added token, such as the end mark, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from codecs import charmap_decode

TOKENIZER = "byte_bpe_50k.json"

# Entries of a cache's newer and older half, and marks of what was met once: only what comes again is kept.
ENTRIES = 500_000
MARKS = 1 << 23

# White space other than single blanks and line breaks, and where a blank surely begins a piece.
_OTHER = re.compile(r"[^\S \n]")
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")

# The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_ALPHABET = "".join(chr(256 + _OTHERS.index(b)) if b in _OTHERS else chr(b) for b in range(256))


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Ids(dict):
    """Ids of chunks as they stand (``lead`` empty) or behind a blank."""

    def __init__(self, tokenizer, lead: str, bare: _Ids | None):
        super().__init__()
        self._tokenizer, self._model, self._lead = tokenizer, tokenizer.model, lead
        self._mapped = _ALPHABET[ord(lead)] if lead else ""
        self._bare = self if bare is None else bare
        self._older: dict[str, bytes] = {}
        self._met = bytearray(MARKS)
        size = tokenizer.get_vocab_size()
        self._bytes = [k.to_bytes(id_width(size), "little") for k in range(size)]

    def _letters(self, word: str) -> bytes:
        """A piece that no pattern splits, straight from the merges."""
        mapped = word if word.isascii() else charmap_decode(word.encode(), "strict", _ALPHABET)[0]
        known = self._bytes
        return b"".join([known[t.id] for t in self._model.tokenize(self._mapped + mapped)])

    def __missing__(self, chunk: str) -> bytes:
        ids = self._older.get(chunk)
        if ids is not None:
            self[chunk] = ids
            return ids
        if len(self) > ENTRIES:
            self._older = dict(self)
            self.clear()
        word = chunk.rstrip(".,;:!?")
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            if len(word) == len(chunk):
                ids = self._letters(word)
            else:
                ids = self[word] + self._bare[chunk[len(word) :]]
        elif chunk[0] == "\n" and self._lead:
            ids = self._bare["\n"] + self._bare[chunk[1:]] if chunk[1:2].isalnum() else self._plain(chunk)
        else:
            ids = self._plain(self._lead + chunk)
        mark = hash(chunk) & MARKS - 1
        if self._met[mark]:
            self[chunk] = ids
        else:
            self._met[mark] = 1
        return ids

    def _plain(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([self._bytes[i] for i in ids])


def id_width(vocabulary: int) -> int:
    """Bytes that hold one id."""
    return 2 if vocabulary <= 1 << 16 else 4


class Encoder:
    """Ids of texts as little-endian words of numpy type ``type``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self._added = re.compile("|".join(map(re.escape, added)) or r"(?!)").search
        self.vocabulary = tokenizer.get_vocab_size()
        self.type = f"<u{id_width(self.vocabulary)}"
        self._bare = _Ids(tokenizer, "", None)
        self._spaced = _Ids(tokenizer, " ", self._bare)

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """The chunks of a text, each without the blank before it; a line's first begins with its break."""
        odd = (
            text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text
            or " \n" in text or "\n " in text or _OTHER.search(text)
        )
        return _BOUNDARY.split(text) if odd else text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is empty."""
        out, spaced = [], self._spaced.__getitem__
        for text in texts:
            if text and self._added(text):
                out.append(self._bare._plain(text))
            elif text:
                chunks = self._chunks(text)
                first = self._bare[chunks[0]]
                del chunks[0]
                out.append(first + b"".join(map(spaced, chunks)))
            else:
                out.append(b"")
        return out


_encoders: dict[str, Encoder] = {}


def forget() -> None:
    """Drop the worker's encoders with their caches, for stages that need none."""
    _encoders.clear()


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
