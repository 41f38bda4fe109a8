"""Pre-tokens in the letters of byte-level vocabularies, for the tokenizer library's merge model."""

from __future__ import annotations

import numpy as np
import regex

from .textvec import Texts

#: Of the 256 bytes, those that stand for themselves; the others take the characters from 256 on, in order.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: b for b in _KEPT} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _KEPT)}


def byte_letters(token: str) -> str:
    return token.encode().decode("latin-1").translate(LETTERS)


class LowerWords:
    """Ids of white-space-free words under the lower-casing word vocabulary.

    A word of characters below U+0250, all of which are composed, goes through its split here and the library's merges,
    a pre-token once while it is kept; any other word goes through the whole library. So do the one letter there whose
    lower case is longer than itself, and words that may hold a special string.
    """

    FIND = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
    PLAIN = regex.compile("[!-~¡-įı-ɏ]*").fullmatch
    KEPT = 100_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.special = {t.content[0] for t in self.whole.get_added_tokens_decoder().values()}
        self.seen: dict[str, list[int]] = {}

    def token(self, token: str) -> list[int]:
        known = self.seen.get(token)
        if known is None:
            if len(self.seen) >= self.KEPT:
                self.seen.clear()
            known = self.seen[token] = [x.id for x in self.merge(token if token.isascii() else byte_letters(token))]
        return known

    def ids(self, word: str) -> list[int]:
        if not (word.isascii() or self.PLAIN(word)):
            return self.whole.encode(word, add_special_tokens=False).ids
        if word.isalpha():
            return self.token(word.lower())
        if word[-1] in ".," and word[:-1].isalpha():
            return self.token(word[:-1].lower()) + self.token(word[-1])
        if not self.PLAIN(word) or not self.special.isdisjoint(word):
            return self.whole.encode(word, add_special_tokens=False).ids
        return [i for token in self.FIND(word.lower()) for i in self.token(token)]


class SpacedWords:
    """Ids of words, each with a space before it, under a byte-level vocabulary: a text of words can be told from them."""

    FIND = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
    KEPT = 100_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merge = Tokenizer.from_file(path).model.tokenize
        self.seen: dict[str, list[int]] = {}

    def token(self, token: str) -> list[int]:
        known = self.seen.get(token)
        if known is None:
            if len(self.seen) >= self.KEPT:
                self.seen.clear()
            known = self.seen[token] = [x.id for x in self.merge(byte_letters(token))]
        return known

    def ids(self, word: str) -> list[int]:
        if word.isalpha():
            return self.token(" " + word)
        if word[-1] in ".," and word[:-1].isalpha():
            return self.token(" " + word[:-1]) + self.token(word[-1])
        return [i for token in self.FIND(" " + word) for i in self.token(token)]


class WordIds:
    """Token ids of words, each distinct word encoded once while it is kept.

    For encoders that never merge across white space: a text's ids are those of its words in turn.
    """

    KEPT = 500_000

    def __init__(self, encoder: LowerWords | SpacedWords):
        self.words = encoder
        self.clear()

    def clear(self) -> None:
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def places(self, t: Texts) -> np.ndarray:
        """Of each word of the texts its place in at; distinct and which: the words' hashes, once each."""
        distinct, first, which = np.unique(t.hashes(), return_index=True, return_inverse=True)
        self.distinct, self.which = distinct, which
        if len(self.hashes) + len(distinct) > self.KEPT:
            self.clear()
        found = np.searchsorted(self.hashes, distinct)
        known = (found < len(self.hashes)) & (self.hashes[np.minimum(found, max(len(self.hashes) - 1, 0))] == distinct) if len(self.hashes) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~known)
        if len(new):
            raw, starts, ends = t.data.tobytes(), t.starts[first[new]].tolist(), t.ends[first[new]].tolist()
            ids = [self.words.ids(raw[a:b].decode("utf-8", "replace")) for a, b in zip(starts, ends, strict=True)]
            base = len(self.at) - 1
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum([len(x) for x in ids])))
            self.ids = np.concatenate((self.ids, np.fromiter((i for x in ids for i in x), np.uint32, self.at[-1] - len(self.ids))))
            hashes = np.concatenate((self.hashes, distinct[new]))
            order = np.concatenate((self.order, base + np.arange(len(new))))
            by = np.argsort(hashes, kind="stable")
            self.hashes, self.order = hashes[by], order[by]
            found = np.searchsorted(self.hashes, distinct)
        return self.order[found][which]

    def of(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other, and where each text's begin."""
        word = self.places(t)
        many = (self.at[1:] - self.at[:-1])[word]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.at[:-1][word], many)
        return self.ids[place], np.concatenate(([0], np.cumsum(np.bincount(t.row, many, t.n).astype(np.int64))))
