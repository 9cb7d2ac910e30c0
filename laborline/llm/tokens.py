"""Chunk-wise token ids by the tokenizers library.

A text is cut at places where the vocabulary's own splitting always cuts, each different chunk is encoded once per
Python worker, and the ids of a text are the joined ids of its chunks. The memo is bounded by ``WORD_MEMO`` or ``BYTE_MEMO`` chunks and is
emptied when full, so memory does not follow the input.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import sys
from array import array
from itertools import filterfalse

import numpy as np

#: Chunks that a worker remembers.
WORD_MEMO, BYTE_MEMO = 300_000, 1_300_000
END_ID = {"word": 1, "byte": 0}


#: Marks that are a piece of their own after a letter.
_MARKS = (b",", b".", b";", b":", b"!", b"?")


def _quiet() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@functools.cache
def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies (published rule)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """For each token of two bytes or more, the pair that rank order joins last when it is built from its bytes.

    No merge crosses the ends of a token while it is being built, so this is the one pair that can make it in any text.
    """
    pairs = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best[0] >= rank:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2:
            pairs.append((parts[0], parts[1]))
    return pairs


def tokenizer_from_ranks(path: str, pattern: str):
    """A ``tokenizers`` byte-level BPE with the ranks of a tiktoken file, each match of ``pattern`` on its own."""
    _quiet()
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, to = load_ranks(path), byte_chars()
    name = {t: "".join(to[b] for b in t) for t in ranks}
    model = models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=[(name[a], name[b]) for a, b in merges_of(ranks)], ignore_merges=True)
    out = Tokenizer(model)
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def tokenizer_from_json(path: str):
    _quiet()
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def _pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, dtype="<u4").tobytes()


class _Memo:
    """Chunk -> little-endian 32-bit ids, and piece -> the same, filled in batches."""

    def __init__(self, tokenizer, most: int):
        self.tokenizer = tokenizer
        self.most = most
        self.model = tokenizer.model
        self.chunks: dict = {}
        self.pieces: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """Ids of one piece already in the model's alphabet."""
        got = self.pieces.get(text)
        if got is None:
            got = self.pieces[text] = self.fresh(text)
        return got

    def fresh(self, text: str) -> bytes:
        return _pack([t.id for t in self.model.tokenize(text)])

    def whole(self, texts: list[str]) -> list[bytes]:
        return [_pack(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def room(self) -> None:
        if len(self.chunks) > self.most:
            self.chunks.clear()
        if len(self.pieces) > self.most // 4:
            self.pieces.clear()


class WordEncoder:
    """For vocabularies that lower-case, drop white space and mark word ends."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    LATIN = "ɏ"

    def __init__(self, path: str):
        import regex

        self.memo = _Memo(tokenizer_from_json(path), WORD_MEMO)
        self.pattern = regex.compile(self.PATTERN)
        self.alphabet = "".join(byte_chars()[b] for b in range(256))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        memo = self.memo
        memo.room()
        chunks = memo.chunks
        cut = [(t.lower() if t.isascii() else t).split() for t in texts]
        missing: set[bytes] = set()
        for words in cut:
            missing.update(filterfalse(chunks.__contains__, words))
        self._learn(missing)
        look = chunks.__getitem__
        return [b"".join(map(look, words)) for words in cut]

    def _learn(self, missing: set[bytes]) -> None:
        memo, odd, find, to = self.memo, [], self.pattern.findall, self.alphabet
        for raw in missing:
            chunk = raw.decode("utf-8", "replace")
            if raw.isalpha() and raw.isascii():
                memo.chunks[raw] = memo.fresh(chunk.lower())
            elif raw[-1:] in _MARKS and raw[:-1].isalpha() and raw.isascii():
                memo.chunks[raw] = (memo.chunks.get(raw[:-1]) or memo.fresh(chunk[:-1].lower())) + memo.piece(chunk[-1])
            elif max(chunk) <= self.LATIN and "\u0130" not in chunk:  # no character here composes with another, or lower-cases by context
                memo.chunks[raw] = b"".join([memo.piece(p.encode().decode("latin-1").translate(to)) for p in find(chunk.lower())])
            else:
                odd.append((raw, chunk))
        memo.chunks.update(zip([r for r, _ in odd], memo.whole([c for _, c in odd]), strict=True))


def _single_spaces(t: str) -> bool:
    """Whether the only white space is single spaces and line ends between other characters."""
    if not t or "  " in t or "\n " in t or " \n" in t or "\n\n" in t or t[0] in " \n" or t[-1] in " \n":
        return False
    return t.replace("\n", "").isprintable()


class ByteEncoder:
    """For byte-level vocabularies whose pattern gives a word the one space before it.

    Where every white space character stands alone between two others, the pattern always cuts before it. Texts with
    runs of white space are cut only at such single places.
    """

    LATIN = "ɏ"

    def __init__(self, tokenizer, pattern: str):
        import regex

        self.memo = _Memo(tokenizer, BYTE_MEMO)
        self.pattern = regex.compile(pattern)
        self.safe = re.compile(r"(?<=\S)(?=[ \n]\S)")
        self.alphabet = "".join(byte_chars()[b] for b in range(256))

    def encode(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        memo.room()
        chunks = memo.chunks
        # A chunk is known by its text without the leading space; one that has none is known by a leading "\0".
        cut = []
        missing: set[str] = set()
        for t in texts:
            if _single_spaces(t):
                words = t.replace("\n", " \n").split(" ")
                words[0] = "\x00" + words[0]
            else:
                words = [w[1:] if w[0] == " " and w[1:2] not in ("\n", "\x00", "") else "\x00" + w for w in self.safe.split(t)] if t else []
            cut.append(words)
            missing.update(filterfalse(chunks.__contains__, words))
        self._learn(missing)
        look = chunks.__getitem__
        return [b"".join(map(look, words)) for words in cut]

    def _learn(self, missing: set[str]) -> None:
        memo, odd, names, to = self.memo, [], [], self.alphabet
        for name in missing:
            if name.isalpha() and name.isascii():
                memo.chunks[name] = memo.fresh("\u0120" + name)
                continue
            if name[-1:] in ",.;:!?" and name[:-1].isalpha() and name.isascii():
                memo.chunks[name] = (memo.chunks.get(name[:-1]) or memo.fresh("\u0120" + name[:-1])) + memo.piece(name[-1])
                continue
            chunk = name[1:] if name[:1] == "\x00" else name if name[:1] == "\n" else " " + name
            if not chunk:
                memo.chunks[name] = b""
            elif max(chunk) > self.LATIN:
                odd.append(chunk)
                names.append(name)
            else:
                memo.chunks[name] = b"".join([memo.piece(p.encode().decode("latin-1").translate(to)) for p in self.pattern.findall(chunk)])
        memo.chunks.update(zip(names, memo.whole(odd), strict=True))


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@functools.cache
def byte_encoder(path: str, pattern: str) -> ByteEncoder:
    """By the suffix: ranks of a tiktoken file, or a tokenizers file."""
    return ByteEncoder(tokenizer_from_ranks(path, pattern) if path.endswith(".tiktoken") else tokenizer_from_json(path), pattern)


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: the byte table reversed."""
    if path.endswith(".tiktoken"):
        ranks = load_ranks(path)
        out = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            out[r] = t
        return out
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in byte_chars().items()}
    vocab = spec["model"]["vocab"]
    out = [b""] * (max(vocab.values()) + 1)
    for t, r in vocab.items():
        out[r] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
    for t in spec.get("added_tokens", []):
        if t["id"] >= len(out):
            out.extend([b""] * (t["id"] + 1 - len(out)))
        out[t["id"]] = t["content"].encode()
    return out
