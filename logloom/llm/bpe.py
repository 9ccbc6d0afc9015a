"""Byte-level BPE vocabularies: exact ids, at the speed of a word cache.

The reference behaviour is that of the ``tokenizers`` library on the whole
text: no added special tokens, special strings inside a text recognised.
A text is cut before every single space or line feed that follows a
non-space character.  The pre-tokenizer always ends a token there, so pieces
of a cut text are the pieces of the text, and equal chunks share one entry.
Texts with other white space are encoded whole.
"""

from __future__ import annotations

import json
from array import array

import regex

from logloom.llm.shared import once

#: Bytes that a worker's cache may take, about; beyond, it starts anew.  Entries of longer chunks aren't kept.  Bounds memory only.
CACHE_BYTES, KEPT_CHUNK = 48 << 20, 200

#: The pre-tokenizer's pattern (a fixed value of the byte-level vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Below this code point Unicode classes are the same in every library.
SETTLED = "ɐ"


class Irregular(Exception):
    """The chunk holds white space that a cut at single spaces doesn't isolate."""


def byte_symbols() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, others follow from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """Encoder for a vocabulary file of the tokenizers library, given as its JSON text."""

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        symbols = byte_symbols()
        special = {x["content"] for x in parsed["added_tokens"]}
        ranks = {bytes(symbols[c] for c in token): i for token, i in parsed["model"]["vocab"].items() if token not in special}
        self.quick = tiktoken.Encoding("quick", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = sorted(special, key=len, reverse=True)
        if any(plain_tokens(x) for x in special):
            raise ValueError("a special string that may be a part of a word")
        self.pattern = regex.compile(PATTERN)

    def settled(self, text: str) -> bool:
        return (text.isascii() or max(text) < SETTLED) and not any(s in text for s in self.special)

    def ids(self, text: str) -> list[int]:
        if not text:
            return []
        if self.settled(text):
            return self.quick.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special string counts as one."""
        if not text:
            return []
        if self.settled(text):
            return self.pattern.findall(text)
        out, rest = [], [text]
        for s in self.special:
            parts: list[str] = []
            for x in rest:
                if x in self.special:
                    parts.append(x)
                    continue
                for i, y in enumerate(x.split(s)):
                    parts += [s] * (i > 0) + [y] * bool(y)
            rest = parts
        for x in rest:
            if x in self.special:
                out.append(x)
            else:
                out += [x[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(x)]
        return out


def chunks(text: str) -> tuple[str, list[str]]:
    """The text's first chunk and the later ones, each without its leading space."""
    first, *rest = text.replace("\n", " \n").split(" ")
    return first, rest


def whole_chunk(key: str) -> str:
    """The text that a later chunk stands for; raises Irregular where cuts aren't safe."""
    body = key[1:] if key[:1] == "\n" else key
    if body.split() != [body]:  # empty, or with white space
        raise Irregular
    return key if key[0] == "\n" else f" {key}"


#: Marks that end a word and are a pre-token of their own (by the pattern).
MARKS = ",.;:!?"


def plain_tokens(key: str) -> tuple[str, ...] | None:
    """Pre-tokens of a later chunk that is an ASCII word, with a mark at its end or without; None for any other."""
    if key.isascii():
        if key.isalpha():
            return (" " + key,)
        if key[:-1].isalpha() and key[-1] in MARKS:
            return (" " + key[:-1], key[-1])
    return None


class Cache(dict):
    """What make gives for a chunk, kept within CACHE_BYTES."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.used = bpe, 0

    def make(self, key: str):
        raise NotImplementedError

    def __missing__(self, key: str):
        out = self.make(key)
        if len(key) <= KEPT_CHUNK:
            self.used += 300 + 5 * len(key)
            if self.used > CACHE_BYTES:
                self.empty()
            self[key] = out
        return out

    def empty(self) -> None:
        self.clear()
        self.used = 0


class IdCache(Cache):
    """chunk -> its ids as little-endian unsigned 32-bit numbers."""

    def make(self, key: str) -> bytes:
        return array("I", self.bpe.ids(whole_chunk(key))).tobytes()

    def encode(self, text: str) -> bytes:
        first, rest = chunks(text)
        try:
            if first and first.split() != [first]:
                raise Irregular
            return array("I", self.bpe.ids(first)).tobytes() + b"".join(map(self.__getitem__, rest))
        except Irregular:
            return array("I", self.bpe.ids(text)).tobytes()


def load(spec_broadcast, kind):
    """One object of a kind for each worker process and vocabulary."""
    spec = spec_broadcast.value
    return once((kind.__name__, spec[:64], len(spec), hash(spec)), lambda: kind(Bpe(spec)))
