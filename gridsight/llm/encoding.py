"""Whole texts to token ids, with the work for a repeated piece of text done once per worker.

The byte-level pre-tokenizer always starts a new token before a space that is followed by a character that is no
white space, whatever stands before it, and no token looks back. A text can therefore be cut at these places and
its parts encoded on their own. Parts repeat a great deal, so their ids are kept in a dictionary of bounded size.
Texts that hold one of the vocabulary's special strings, and vocabularies of another kind, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Sequence

#: Parts kept by a worker in each of two generations, and the longest that is worth keeping, in characters.
KEPT_PARTS = 350_000
LONGEST_KEPT = 64
#: Characters that are always a token of their own when letters stand before them and nothing after.
STOPS = ".,;:!?|"

_ODD_SPACE = re.compile(r" \s")
_CUT = re.compile(r"(?= \S)")
_encoders: dict[tuple, object] = {}


def parts_of(text: str) -> tuple[str, list[str]]:
    """The first part, and the others without the space each of them starts with."""
    if _ODD_SPACE.search(text) is None:
        first, *rest = text.split(" ")
    else:
        first, *rest = _CUT.split(text)
        rest = [part[1:] for part in rest]
    return first, rest


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: chr(byte) for byte in shown} | {byte: chr(256 + place) for place, byte in enumerate(hidden)}


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def special_strings(description: dict) -> list[str]:
    """The strings a tokenizer file reads as one token each."""
    return [token["content"] for token in description.get("added_tokens") or []]


def splits_at_spaces(description: dict) -> bool:
    """Whether a tokenizer file is of the kind that can be cut as described above."""
    before = description.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    tokens = description.get("added_tokens") or []
    simple = not any(token.get(flag) for token in tokens for flag in ("single_word", "lstrip", "rstrip"))
    return bool(plain and simple and not description.get("normalizer") and not description.get("truncation"))


class Parts(dict):
    """What a function makes of each part met so far. When it is full, what was used last moves on to the next generation."""

    def __init__(self, make: Callable[[str], bytes], kept: int):
        super().__init__()
        self.make = make
        self.kept = kept
        self.before: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        found = self.before.get(part)
        if found is None:
            found = self.make(part)
        if len(part) <= LONGEST_KEPT:
            if len(self) >= self.kept:
                self.before = dict(self)
                self.clear()
            self[part] = found
        return found


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kept: int = KEPT_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as file:
            description = json.load(file)
        self.specials = special_strings(description)
        self.cut = splits_at_spaces(description)
        self.tokenize = self.library.model.tokenize
        self.shown = byte_characters()
        self.space = self.shown[ord(" ")]
        self.bytes_of = [packed([number]) for number in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.stops = {stop: self._token(stop) for stop in STOPS}
        self.line_end = self._token(self.shown[ord("\n")])
        # no part of a text starts with a line end: with one, those that stand after a line end are kept
        self.known = Parts(lambda part: self._part(part[1:], False) if part[:1] == "\n" else self._part(part, True), kept)

    def _encode(self, texts: Sequence[str]) -> list[bytes]:
        return [packed(one.ids) for one in self.library.encode_batch(list(texts), add_special_tokens=False)]

    def _token(self, shown: str) -> bytes:
        """Ids of one token of the pre-tokenizer."""
        bytes_of = self.bytes_of
        return b"".join([bytes_of[token.id] for token in self.tokenize(shown)])

    def _letters(self, part: str, spaced: bool) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.shown)
        return self._token(self.space + shown if spaced else shown)

    def _part(self, part: str, spaced: bool) -> bytes:
        """Ids of a part, with the space it starts with or without; letters are a single token to the pre-tokenizer, as is a
        line end between two characters that are no white space. What stands before a stop or a line end, or after a line
        end, is a part of its own."""
        if part.isalpha():
            return self._letters(part, spaced)
        if part[:-1].isalpha() and part[-1] in STOPS:
            return self.known[part[:-1] if spaced else "\n" + part[:-1]] + self.stops[part[-1]]
        left, line_end, right = part.partition("\n")
        if left and right and "\n" not in right and not left[-1].isspace() and not right[0].isspace():
            return self.known[left if spaced else "\n" + left] + self.line_end + self.known["\n" + right]
        cut = self.library.pre_tokenizer.pre_tokenize_str(" " + part if spaced else part)
        return b"".join([self._token(shown) for shown, _ in cut])

    def _whole(self, text: str) -> bool:
        return not self.cut or any(special in text for special in self.specials)

    def batch(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text, in the order given; a null text is an empty one."""
        split = [None if text and self._whole(text) else parts_of(text or "") for text in texts]
        firsts = iter(self._encode([parts[0] for parts in split if parts is not None]))
        wholes = iter(self._encode([text for text, parts in zip(texts, split) if parts is None]))
        ids_of, out = self.known.__getitem__, []
        for parts in split:
            out.append(next(wholes) if parts is None else next(firsts) + b"".join(map(ids_of, parts[1])))
        return out


def encoder(path: str, kept: int = KEPT_PARTS) -> Encoder:
    """The encoder of a file, made once per worker."""
    if ("ids", path, kept) not in _encoders:
        _encoders["ids", path, kept] = Encoder(path, kept)
    return _encoders["ids", path, kept]
