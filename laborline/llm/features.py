"""Dense text statistics for the classifiers, over Arrow batches."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _c in b".,;:'\"()-":
    _CLASS[_c] = 4
for _c in b"!?":
    _CLASS[_c] = 5
for _c in b"#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_c] = 6
_CLASS[0x80:] = 7


def byte_shares(text: bytes) -> np.ndarray:
    """Shares of upper, lower, digit, plain punctuation, exclamation, symbol and non-ASCII bytes."""
    if not text:
        return np.zeros(7)
    return np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)[1:] / len(text)


#: Second-person words of the four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
LEET = str.maketrans("013457@$!|", "oleastasil")
_EDGE = ".,;:!?'\"()[]{}<>|*#$%&-_"
_ODD = re.compile(r"[^\W\d_]+[\d@$!*._-]+[^\W\d_]+")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
PREFIXES = (4, 5, 6)
NEAR = 5


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(_EDGE) for x in text.lower().split()) if w]


def terms_of(words: list[str]) -> Counter:
    """How often whole words, and word beginnings (with a trailing ``*``), occur."""
    whole = Counter(words)
    out = Counter(whole)
    for w, k in whole.items():
        for n in PREFIXES:
            if len(w) >= n:
                out[w[:n] + "*"] += k
    return out


TOXIC_FEATURES = (
    "log_words", "hit_density", "log_hits", "log_terms", "first_hit", "you_density", "near_you", "upper", "caps_words",
    "punctuation", "exclamations", "symbols", "odd_words", "odd_hits", "stretched",
)


def toxic_features(text: bytes, lexicon: frozenset[str], memo: dict[str, bool]) -> list[float]:
    """Lexicon densities, second-person proximity, capitals, punctuation and obfuscation rates of a whole text."""
    raw = text.decode("utf-8", "replace")
    words = words_of(raw)
    n = len(words) or 1
    hits, terms = [], set()
    for k, w in enumerate(words):
        hit = memo.get(w)
        if hit is None:
            hit = w in lexicon or any(w[:i] + "*" in lexicon for i in PREFIXES)
            if len(memo) < 200_000:
                memo[w] = hit
        if hit:
            hits.append(k)
            terms.add(w)
    you = [k for k, w in enumerate(words) if w in SECOND_PERSON]
    near, j = 0, 0
    for k in hits:
        while j < len(you) and you[j] < k - NEAR:
            j += 1
        near += j < len(you) and you[j] <= k + NEAR
    shares = byte_shares(text)
    odd = _ODD.findall(raw)
    odd_hits = sum(re.sub(r"[\W_]", "", x.lower().translate(LEET)) in lexicon for x in odd)
    tokens = raw.split()
    caps = sum(w.isupper() and len(w) > 2 for w in tokens)
    return [
        float(np.log1p(len(words))), len(hits) / n, float(np.log1p(len(hits))), float(np.log1p(len(terms))), (hits[0] + 1) / n if hits else 2.0,
        len(you) / n, near / n, float(shares[0]), caps / n, float(shares[3]), float(shares[4]), float(shares[5]),
        len(odd) / n, float(odd_hits), len(_STRETCH.findall(raw)) / n,
    ]


QUALITY_FEATURES = (
    "log_words", "mean_word", "upper", "lower", "digits", "punctuation", "exclamations", "symbols", "non_ascii", "different",
    "repeats", "caps_words", "symbol_ends", "bare_symbols", "line_words", "same_lines", "longest_run",
)


def quality_features(text: bytes) -> list[float]:
    """Character class shares, word lengths, repetition and layout of a whole text."""
    raw = text.decode("utf-8", "replace")
    words = raw.split()
    n = len(words) or 1
    same = [a == b for a, b in zip(words, words[1:])]
    run = longest = 0
    if any(same):
        for s in same:
            run = run + 1 if s else 0
            longest = max(longest, run)
    lines = [x for x in raw.split("\n") if x.strip()]
    shares = byte_shares(text)
    ends = sum(w[-1] in "#$%&*!|@~^" for w in words)
    bare = sum(not any(c.isalnum() for c in w) for w in words)
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / n, *(float(x) for x in shares), len(set(words)) / n,
        sum(same) / n, sum(w.isupper() and len(w) > 1 for w in words) / n, ends / n, bare / n, len(words) / (len(lines) or 1),
        1 - len(set(lines)) / (len(lines) or 1), float(longest),
    ]
