"""Cuts texts into the pre-tokens of a byte-level BPE vocabulary, as the tokenizers library does.

Most texts go through a short way: every single space between two words starts a pre-token, so the
words between spaces can be cut on their own, each distinct word once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import regex

# Fixed value: the public pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = regex.compile(PATTERN)
#: White space other than space and newline: such texts are cut as a whole.
_ODD_SPACE = re.compile("[" + "".join(map(chr, (
    *range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
#: The first code point that has no meaning yet is U+0378; below it all Unicode tables agree.
_HIGH = re.compile(f"[{chr(0x378)}-{chr(0x10FFFF)}]")


@cache
def _unassigned() -> re.Pattern:
    """Code points without a meaning in this Python's tables: newer tables may class them otherwise."""
    spans, start = [], None
    for c in range(0x378, 0x110001):
        none = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
        if none and start is None:
            start = c
        elif not none and start is not None:
            spans.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return re.compile("[" + "".join(spans) + "]")


@cache
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class PreTokenizer:
    """Pre-tokens for a `tokenizers` file whose pre-tokenizer is byte-level and which normalises nothing."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"]
        if cut["type"] != "ByteLevel" or not cut.get("use_regex", True) or cut["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        self.spec = spec
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take neighbouring space aren't supported")
        longest_first = sorted(self.added, key=len, reverse=True)
        self._added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        self._letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})

    def parts(self, text: str) -> list[str]:
        """The text cut at added tokens: texts at even places, added tokens at odd ones."""
        if self._added is None or not any(a in text for a in self.added):
            return [text]
        return self._added.split(text)

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens."""
        if _HIGH.search(text) and _unassigned().search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return _CUT.findall(text)

    @staticmethod
    def words(text: str) -> list[str] | None:
        """The text between single spaces, where each space surely starts a pre-token; else None."""
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _ODD_SPACE.search(text):
            return None
        return text.split(" ")

    def pieces(self, token: str) -> int:
        """How many pieces the library's model makes of one pre-token."""
        return len(self.tokenizer.model.tokenize(token.encode().decode("latin-1").translate(self._letters)))
