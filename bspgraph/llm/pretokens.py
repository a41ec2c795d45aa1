"""Splitting texts into the pre-tokens of public tokenizers, exactly as the tokenizers library does.

Texts whose characters all lie in a plain range are split by a compiled pattern that lists the range's letters and numbers. Any
other text (controls, rare scripts, odd spaces) is split by the library itself, so no Unicode tables have to agree.
"""

from __future__ import annotations

import functools
import json
import os
import re

#: Outside these characters the library splits.
ODD = re.compile("[^\t-\r -~\xa1-\xff]")
#: Letters and numbers of the plain range.
LETTER, NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
ENDING = "'(?:[stmd]|re|ve|ll)"
#: The tokenizers' own patterns for texts of the plain range.
BYTE_WORDS = re.compile(rf"{ENDING}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
CASELESS_WORDS = re.compile(rf"{ENDING}|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")


@functools.lru_cache(4)
def library(path: str):
    """The tokenizers object of a file, one per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(4)
def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        return {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}


class BytePretokens:
    """Pre-tokens of a byte-level file: ``split(text)`` gives a list of strings; special strings stand alone in it."""

    def __init__(self, path: str):
        self.path = path
        self.special = special_tokens(path)
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._marks = list(self.special)
        self._find = BYTE_WORDS.findall

    def plain(self, text: str) -> list[str]:
        if ODD.search(text) is None:
            return self._find(text)
        pieces = library(self.path).pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in pieces]

    def split(self, text: str) -> list[str]:
        if not any(mark in text for mark in self._marks):
            return self.plain(text)
        out: list[str] = []
        for part in self._cut.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.plain(part)
        return out
