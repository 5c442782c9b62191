"""Token ids of whole texts by the tokenizers library, word by word with a bounded memory of words."""

from __future__ import annotations

import os
import re
import string
import struct
from collections.abc import Callable

REMEMBERED = 500_000
LONGEST_REMEMBERED = 64
_WORD = re.compile("( ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([" + re.escape(string.punctuation.replace("'", "")) + "]*)")
#: Byte-level vocabularies write printable Latin-1 characters as themselves and the other bytes as the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
SPACE = chr(BYTE_CHARACTERS[32])
_BEFORE_SINGLE_SPACE = re.compile(r"(?<=\S)(?= \S)")
_OPEN: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of a text as bytes (little-endian unsigned 32-bit numbers), equal to encoding the text in one call.

    The text is cut where no token can cross: at ASCII white space if the tokenizer drops white space, else before a single space and
    around a single line feed between two other characters. The library encodes each different piece; frequent pieces are remembered. Words of Latin-1 letters,
    with punctuation after them or not, go straight to the library's model, as they are one unit for the steps before it; whether this
    holds for a vocabulary is tried on opening it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.lower = self._whole(["A"]) == self._whole(["a"])
        self.tails: dict[str, bytes] = {}
        self.known = _Known(self._ids)
        tried = ["Word", "\u00c9t\u00e9", "na\u00efve", "STRASSE", "stra\u00dfe", "odd,!!", "x"] + [" Word,", " \u00e0"] * (not self._drops_white_space())
        self.direct = all(self._word(t) == self._whole([t])[0] for t in tried)
        self.encode: Callable[[str], bytes] = self._dropping if self._drops_white_space() else self._keeping

    def _drops_white_space(self) -> bool:
        return self.library.encode("a b", add_special_tokens=False).ids == self.library.encode(" a \n\n b ", add_special_tokens=False).ids

    def _word(self, text: str) -> bytes | None:
        """Ids of a word of Latin-1 letters with ASCII punctuation after it; None for anything else."""
        match = _WORD.fullmatch(text)
        if match is None:
            return None
        core, tail = match.groups()
        shown = core.lower() if self.lower else core
        if shown.isascii():
            shown = shown.replace(" ", SPACE)
        else:
            shown = shown.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        ids = _packed([t.id for t in self.model.tokenize(shown)])
        if not tail:
            return ids
        if tail not in self.tails:
            if len(self.tails) > REMEMBERED:
                self.tails.clear()
            self.tails[tail] = self._whole([tail])[0]
        return ids + self.tails[tail]

    def _ids(self, text: str) -> bytes:
        ids = self._word(text) if self.direct else None
        return self._whole([text])[0] if ids is None else ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _dropping(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, text.encode().split()))

    def _keeping(self, text: str) -> bytes:
        try:
            if "\0" not in text:
                return b"".join(map(self.known.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))
        except _NotAlone:
            pass
        return b"".join(map(self._ids, _BEFORE_SINGLE_SPACE.split(text)))


class _NotAlone(Exception):
    """A piece that has white space beside a cut."""


class _Known(dict):
    """Ids by piece; a new piece is encoded and, if short, remembered. The memory is emptied when full."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.ids = encode

    def __missing__(self, piece: str | bytes) -> bytes:
        if isinstance(piece, bytes):
            ids = self.ids(piece.decode())
        elif _stands_alone(piece):
            ids = self.ids(piece)
        else:
            raise _NotAlone
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


def _stands_alone(piece: str) -> bool:
    """True if a piece between cuts has no white space beside a cut: it is a line feed, or a word with or without a space before it."""
    body = piece[1:] if piece[:1] == " " else piece
    return piece == "\n" or (body != "" and not body[0].isspace() and not body[-1].isspace())


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _packed(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


def _stands_alone(piece: str) -> bool:
    """True if a piece between cuts has no white space beside a cut: it is a line feed, or a word with or without a space before it."""
    body = piece[1:] if piece[:1] == " " else piece
    return piece == "\n" or (body != "" and not body[0].isspace() and not body[-1].isspace())


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, opened once per Python worker."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]
