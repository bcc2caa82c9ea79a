"""Token numbers from a word-level BPE vocabulary in the ``tokenizers`` JSON format, whose rules drop white space.

Nothing in such a vocabulary reaches across white space, so a text's numbers are those of its words in turn.  A
different word is encoded once by ``tokenizers`` and remembered.  A word of plain letters (ASCII and the common
accented Latin ones), digits and ASCII signs is cut into pieces here by the vocabulary's own splitting rule, which
is unambiguous for them, and the library's model encodes each different piece; all other words, and those that may hold
a control string, go through the library whole.  Both ways give the same numbers (tested).
"""

from __future__ import annotations

import os
import re
import struct

# Fixed value: the splitting rule of this kind of vocabulary, for lowered text of the plain characters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9ß-öø-ſ]+")
#: ASCII and accented Latin letters of one code point; U+0130 becomes two when lowered.
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-įı-ſ]*")


def _letters() -> dict[int, str]:
    """Letter of the vocabulary file for each byte: visible Latin-1 as itself, the others from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


def numbers(ids: list[int], width: int) -> bytes:
    """Little-endian, ``width`` bytes each."""
    return struct.pack(f"<{len(ids)}{'H' if width == 2 else 'I'}", *ids)


class _Pieces(dict):
    """Numbers of each piece, as bytes."""

    def __init__(self, model, width: int):
        self.model, self.width, self.letters = model, width, _letters()

    def __missing__(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.letters)
        found = self[piece] = numbers([token.id for token in self.model.tokenize(spelt)], self.width)
        return found


class _Words(dict):
    """Numbers of each word, as bytes."""

    def __init__(self, tokenizer, width: int):
        self.tokenizer, self.width, self.pieces = tokenizer, width, _Pieces(tokenizer.model, width)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isascii() and text.isalpha():
            found = self.pieces[text.lower()]
        elif _PLAIN.fullmatch(text) and "<|" not in text:
            found = b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))
        else:
            found = numbers(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width)
        self[word] = found
        return found


class WordEncoder:
    """Encodes whole texts.  ``path``: a ``tokenizers`` JSON file.  Numbers have ``width`` bytes: two if the
    vocabulary fits into them, else four."""

    #: Words, and pieces, that a worker remembers before it starts anew.
    REMEMBERED = 500_000
    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.width = 2 if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.words = _Words(tokenizer, self.width)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One encoder for each Python worker and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, text: bytes) -> bytes:
        for known in (self.words, self.words.pieces):
            if len(known) > self.REMEMBERED:
                known.clear()
        # bytes.split() cuts at ASCII white space only, all of which the vocabulary's rules drop.
        return b"".join(map(self.words.__getitem__, text.split()))
