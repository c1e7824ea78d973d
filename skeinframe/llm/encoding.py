"""Byte-level BPE of whole texts, each distinct piece of text encoded once per worker.

A byte-level tokenizer cuts a text into pieces before it merges, and a piece's
ids don't depend on its neighbours. Texts are cut at blanks into chunks; a
chunk's ids are kept in a bounded table of the worker, so a text costs a split,
a lookup for each chunk and a join. A bounded table changes no result.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Chunks and pieces whose ids a worker's table keeps, of about 200 bytes each; the table before it is kept too.
KEPT_CHUNKS = 800_000
#: Characters of a chunk or piece that is kept. Longer ones, as of scripts without blanks or of encoded data, are forgotten after their batch, so the tables are bounded in bytes too.
KEPT_CHARS = 64
#: White space as the tokenizer's pattern has it (Unicode's White_Space).
WS = "\t-\r \x85\xa0  -     　"
#: Ends of words that are pieces of their own and begin no contraction.
ENDS = ".,;:!?)"
_ODD = re.compile(r" (?:\s|\Z)").search
_CHUNK = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+").findall


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


ALPHABET = byte_alphabet()


class ChunkEncoder:
    """Ids as the tokenizers library gives them, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kept: int = KEPT_CHUNKS):
        self.path, self.kept = path, kept
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks: dict[str, bytes] = {}  # a key is a chunk without its leading blank; one that has none is kept behind a blank
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces in the byte alphabet, by the library's model."""
        tokenize = self.tokenizer.model.tokenize
        if sys.byteorder == "little" and array("I").itemsize == 4:
            return [array("I", [t.id for t in tokenize(x)]).tobytes() for x in pieces]
        return [np.array([t.id for t in tokenize(x)], "<u4").tobytes() for x in pieces]

    def _keys(self, text: str) -> list[str]:
        if not text:
            return []
        if _ODD(text):
            return [c[1:] if c[0] == " " and len(c) > 1 and not c[1].isspace() else " " + c for c in _CHUNK(text)]
        keys = text.split(" ")
        if keys[0]:
            keys[0] = " " + keys[0]
            return keys
        return keys[1:]

    def _stem(self, key: str) -> tuple[str, str, str] | None:
        """(key, piece, tail) of a chunk that is a word of Latin letters, on which all versions of Unicode agree, and at most one of ENDS; else None."""
        word = key.removeprefix(" ")
        tail = word[-1:] if word[-1:] in ENDS else ""
        stem = word[:-1] if tail else word
        if not stem.isalpha() or max(stem) >= "\u0250":
            return None
        head = "" if key[0] == " " else "Ġ"
        return (key[:-1] if tail else key), head + (stem if stem.isascii() else "".join([ALPHABET[b] for b in stem.encode()])), tail

    def _learn(self, missing: set[str]) -> None:
        chunks, pieces, old, old_pieces = self.chunks, self.pieces, self.old, self.old_pieces
        words: dict[str, str] = {}  # chunks that are one piece
        ended: list[tuple[str, str, str]] = []
        cut: dict[str, list[str]] = {}
        for k in missing:
            if (b := old.get(k)) is not None:
                chunks[k] = b
            elif s := self._stem(k):
                base, piece, tail = s
                if tail:
                    ended.append((k, base, tail))
                if base not in chunks:
                    if (b := old.get(base)) is not None:
                        chunks[base] = b
                    else:
                        words[base] = piece
            else:
                cut[k] = [p for p, _ in self.split(k[1:] if k[0] == " " else " " + k)]
        chunks.update(zip(words, self.encode_pieces(list(words.values()))))
        wanted = dict.fromkeys([t for _, _, t in ended] + [p for ps in cut.values() for p in ps])
        pieces.update((p, old_pieces[p]) for p in wanted if p not in pieces and p in old_pieces)
        new = [p for p in wanted if p not in pieces]
        pieces.update(zip(new, self.encode_pieces(new)))
        chunks.update((k, chunks[base] + pieces[tail]) for k, base, tail in ended)
        chunks.update((k, b"".join([pieces[p] for p in ps])) for k, ps in cut.items())
        for p in new:
            if len(p) > KEPT_CHARS:
                del pieces[p]
        for b, _ in words.items():
            if len(b) > KEPT_CHARS and b not in missing:
                del chunks[b]

    def _plain(self, texts: list[str]) -> list[bytes]:
        chunks, join = self.chunks, b"".join
        known = chunks.__getitem__
        out: list[bytes] = []
        open_: list[tuple[int, list[str]]] = []
        missing: set[str] = set()
        for i, text in enumerate(texts):
            keys = self._keys(text)
            try:  # most texts have no new chunk, and need but one look at each
                out.append(join(map(known, keys)))
            except KeyError:
                missing.update([k for k in keys if k not in chunks])
                open_.append((i, keys))
                out.append(b"")
        if missing:
            self._learn(missing)
            for i, keys in open_:
                out[i] = join(map(known, keys))
        for k in missing:
            if len(k) > KEPT_CHARS:
                self.chunks.pop(k, None)
        # a full table becomes the old one, from which chunks that occur again are taken over
        if len(self.chunks) > self.kept:
            self.old, self.chunks = self.chunks, {}
        if len(self.pieces) > self.kept // 4:
            self.old_pieces, self.pieces = self.pieces, {}
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if not self._special:
            return self._plain(texts)
        parts = [self._special.split(t) if any(s in t for s in self.special) else None for t in texts]
        out = self._plain([t if p is None else "" for t, p in zip(texts, parts)])
        for i, p in enumerate(parts):
            if p is not None:
                plain = iter(self._plain(p[::2]))
                out[i] = b"".join(next(plain) if j % 2 == 0 else np.array([self.special[x]], "<u4").tobytes() for j, x in enumerate(p))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary."""
    return ChunkEncoder(path)
