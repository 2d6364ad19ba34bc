"""Exact token ids from the tokenizers library at corpus speed.

A whole text is cut only where the tokenizer itself always cuts (beside single
spaces and line ends), the pieces' ids are remembered per Python worker, and new
pieces go through the library: plain Latin pieces straight to its BPE model,
all others through its full pipeline. The ids are those of encoding the text at once.
"""

from __future__ import annotations

import re
from array import array

_ALLOWED = bytes([*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100), 0x0A])
_CUT = re.compile(r"(?<=\S)(?= \S)")
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: How each kind cuts a text of Latin-1 characters into the parts that it encodes one by one.
_SPLITS = {
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^ \n{_L}{_N}]+"),
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^ \n{_L}{_N}]+|[ \n]+(?![^ \n])|[ \n]+"),
}

def _byte_chars() -> dict[int, str]:
    """The visible character by which byte-level BPE stands for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian 16-bit bytes; `kind` is "word" or "byte" by how the tokenizer treats spaces.

    Texts may be empty; a null counts as empty. Memory is bounded: either memory of
    pieces is emptied when it has `limit` entries, which changes speed only.
    """

    def __init__(self, path: str, limit: int = 800_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.word = "</w>" == (spec["model"].get("end_of_word_suffix") or "")
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids beyond 16 bits")
        self.model, self.limit = self.tokenizer.model, limit
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = _SPLITS["word" if self.word else "byte"].findall
        self.chars = _byte_chars()
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        plain = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(self.chars)
        return array("H", [t.id for t in self.model.tokenize(plain)]).tobytes()

    def _join(self, cut: list[str], known: dict[str, bytes], make) -> bytes:
        """The ids of all the cut strings, made where they aren't known."""
        try:
            return b"".join(map(known.__getitem__, cut))
        except KeyError:
            new = set(cut).difference(known)
            if len(known) + len(new) > self.limit:
                known.clear()
                new = set(cut)
            for p in new:
                known[p] = make(p)
            return b"".join(map(known.__getitem__, cut))

    def _any(self, piece: str) -> bytes:
        return array("H", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._any(text)
        try:
            latin = not text.encode("latin-1").translate(None, _ALLOWED)
        except UnicodeEncodeError:
            latin = False
        if latin:
            return self._join(self.split(text.lower() if self.word else text), self.parts, self._part)
        if self.word:
            cut = text.replace("\n", " ").split(" ")
        else:
            cut = _CUT.split(text)
        return self._join(cut, self.pieces, self._any)


_encoders: dict[str, Encoder] = {}


def encoder(path: str, limit: int = 800_000) -> Encoder:
    """The worker's own encoder for a vocabulary file; its memory of parts is kept from task to task."""
    got = _encoders.get(path)
    if got is None:
        got = _encoders[path] = Encoder(path)
    got.limit = limit
    return got
