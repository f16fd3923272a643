"""Tokenizers for tasks, with a table of frequent pre-tokens and a cache before the library, so that a worker encodes a pre-token once."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash

#: Pre-tokens, and words of ``Many``, whose encoding a worker keeps (a cache starts anew beyond that), and letters of the longest one kept.
CACHE, WORDS, LONGEST = 400_000, 1_000_000, 64

# Fixed pattern of byte-level pre-tokenization.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The same for words of the characters that ``OTHER`` leaves, in Python's own classes.
PLAIN_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+")
OTHER = re.compile("[^\n\x20-\x5e\x60-\x7e\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f\u2010-\u2027]")


def plain(text: str) -> bool:
    """Whether the library cuts the text at its spaces and line feeds: common characters, no white space beside another or at an end."""
    if OTHER.search(text) or text[0] in " \n" or text[-1] in " \n":
        return False
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text)


_assigned: set[str] = set()


def assigned(text: str) -> bool:
    """Whether all characters are assigned in Python's Unicode tables; of others the library's classes may differ from the pattern's."""
    if text.isascii():
        return True
    fresh = set(text) - _assigned
    if any(unicodedata.category(c) in ("Cn", "Cs") for c in fresh):
        return False
    _assigned.update(fresh)
    return True


class LengthTable:
    """A compact table of pre-tokens and their numbers of tokens: sorted 64-bit hashes, lengths, and the bytes they are compared with."""

    def __init__(self, lengths: dict[str, int]) -> None:
        rows = sorted((xxhash.xxh64_intdigest(raw := word.encode()), raw, n) for word, n in lengths.items() if n < 256)
        self.hashes, self.lengths = array("Q", [h for h, _, _ in rows]), bytes(n for _, _, n in rows)
        self.ends = array("I", np.cumsum([len(raw) for _, raw, _ in rows], dtype=np.uint32).tolist())
        self.words = b"".join(raw for _, raw, _ in rows)

    def get(self, word: str) -> int | None:
        raw = word.encode()
        h = xxhash.xxh64_intdigest(raw)
        at = bisect_left(self.hashes, h)
        while at < len(self.hashes) and self.hashes[at] == h:
            if self.words[self.ends[at - 1] if at else 0 : self.ends[at]] == raw:
                return self.lengths[at]
            at += 1
        return None


class Words(dict):
    """Word to encoded value, ``encode(prefix + word)`` once each."""

    def __init__(self, prefix: str, encode: Callable) -> None:
        super().__init__()
        self.prefix, self.encode = prefix, encode

    def __missing__(self, word: str):
        value = self.encode(self.prefix + word)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = value
        return value


class Lookup:
    """Values of a text's parts in order; texts of common characters and single spaces by their words, which are kept whole."""

    def __init__(self, encode: Callable, joined: Callable) -> None:
        self.parts = parts = Words("", encode)
        self.joined = lambda word: joined(map(parts.__getitem__, PLAIN_TOKEN.findall(word)))
        self.spaced, self.bare = Words(" ", self.joined), Words("", self.joined)

    def __call__(self, text: str) -> list:
        if not plain(text):
            return list(map(self.parts.__getitem__, PRE_TOKEN.findall(text)))
        found, feed = [], self.parts["\n"]
        for line in text.split("\n"):
            words = line.split(" ")
            found.append(self.bare[words[0]])
            found.extend(map(self.spaced.__getitem__, islice(words, 1, None)))
            found.append(feed)
        found.pop()
        return found


#: Marks that end a word, and characters of texts that are cut together.
MARKS, CHARS = ".,;:!?", 4_000_000


class Many:
    """Token ids of many texts at a time: words that were not seen before are encoded together, in one call.

    Texts' words are numbered by Arrow, so that Python looks at distinct ones only. A word of a plain text begins with its space or line feed, before which the library cuts, so of a text of words side by side the tokens are
    those of each word in a row; that each word's bytes end where a token ends is checked.
    """

    def __init__(self, model: Pieces) -> None:
        self.model, self.words = model, {}
        self.marks = {c: model.pack(model.encode(c)) for c in MARKS}
        self.bytes = np.zeros(model.vocabulary, np.int64)
        for token, i in model.tokens.items():
            self.bytes[i] = len(token)  # byte-level tokens have a character for each byte

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        simple = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if plain(text) and not self.model.by_library and not any(s in text for s in self.model.special):
                simple.append(i)  # all characters of plain texts are assigned
            else:
                out[i] = self.model.ids(text)
        begin = 0
        while begin < len(simple):
            end, chars = begin, 0
            while end < len(simple) and (end == begin or chars < CHARS):
                chars += len(texts[simple[end]])
                end += 1
            for i, ids in zip(simple[begin:end], self._together([texts[i] for i in simple[begin:end]]), strict=True):
                out[i] = ids
            begin = end
        return out

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: their words are cut and numbered by Arrow, each distinct one looked up once, and put together by number."""
        cut = pa.array(texts, pa.large_string())
        for space in (" ", "\n"):
            cut = pc.replace_substring(cut, space, "\0" + space)  # no plain text holds a zero
        lists = pc.split_pattern(cut, "\0")
        coded = lists.flatten().dictionary_encode()
        words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        values = list(map(self.words.get, words))
        if None in values:
            new = self._learn({w for w, v in zip(words, values, strict=True) if v is None})
            values = [new[w] if v is None else v for w, v in zip(words, values, strict=True)]
        size = self.model.kind.itemsize
        n = np.fromiter(map(len, values), np.int32, len(values)) // size
        held, begin = np.frombuffer(b"".join(values), self.model.kind), np.cumsum(n, dtype=np.int32) - n
        n_of = n[code]
        ends = np.cumsum(n_of, dtype=np.int32)  # of a few million characters
        at = np.repeat(begin[code] - (ends - n_of), n_of)
        at += np.arange(len(at), dtype=np.int32)
        raw = held[at].tobytes()
        last = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py() - 1  # a plain text has a word at least
        stops = (ends[last].astype(np.int64) * size).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not known: of those that end in a mark behind a letter, which the library cuts there, the word's without it and the mark's."""
        marked = [w for w in words if w[-1] in MARKS and w[-2:-1].isalpha()]
        bare = words.difference(marked)
        known = self.words
        bare.update([b for w in marked if (b := w[:-1]) not in known])
        side = [w for w in bare if w[0] in " \n"]
        new, kind = {}, self.model.kind
        if side:
            ids = np.asarray(self.model.together("".join(side)), kind)
            ends, wanted = np.cumsum(self.bytes[ids]), np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in side])
            at = np.searchsorted(ends, wanted)
            if at[-1] < len(ends) and (ends[at] == wanted).all():
                raw, after = ids.tobytes(), ((at + 1) * kind.itemsize).tolist()
                new = {w: raw[a:b] for w, a, b in zip(side, [0, *after], after, strict=False)}
        for w in bare - new.keys():
            new[w] = self.model.pack(self.model.encode(w))
        for w in marked:
            b = w[:-1]
            new[w] = (new[b] if b in new else known[b]) + self.marks[w[-1]]
        if len(self.words) > WORDS:
            self.words.clear()
        self.words.update(new)
        for w in [w for w in new if len(w) > LONGEST]:
            del self.words[w]
        return new


class Pieces:
    """Token ids of whole texts, as the library gives them, without begin, end or added special tokens.

    Pre-tokens of a byte-level ``.json`` tokenizer without normalizer are looked up, in all scripts; texts that hold a special
    string or an unassigned character, and other tokenizers, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.special: list[str] = []
        self.by_library = path.endswith(".model")
        if self.by_library:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = self.together = lambda text: model.encode(text, num_threads=1)
            self.vocabulary, self.tokens = model.get_piece_size(), {}
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda text: model.encode(text, add_special_tokens=False).ids
            self.together = lambda text: model.encode_batch_fast([text], add_special_tokens=False)[0].ids
            self.vocabulary, self.tokens = model.get_vocab_size(), model.get_vocab()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            pre = spec.get("pre_tokenizer") or {}
            by_bytes = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
            self.by_library = not by_bytes
            self.special = [a["content"] for a in spec.get("added_tokens") or []]
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.lookup = Lookup(lambda text: self.pack(self.encode(text)), b"".join)

    def pack(self, ids: list[int]) -> bytes:
        return array(self.kind.char, ids).tobytes()

    def whole(self, text: str) -> bool:
        """Whether the library must see the text as one."""
        return self.by_library or any(s in text for s in self.special) or not assigned(text)

    def ids(self, text: str) -> bytes:
        """Little-endian ids of ``kind``."""
        if not text:
            return b""
        return self.pack(self.encode(text)) if self.whole(text) else b"".join(self.lookup(text))


_loaded: dict[str, Pieces] = {}
_many: dict[str, Many] = {}


def many(path: str) -> Many:
    """The worker's ``Many`` for ``path``; what it has learnt lives as long as the worker."""
    if path not in _many:
        _many[path] = Many(pieces(path))
    return _many[path]


def pieces(path: str) -> Pieces:
    """The worker's tokenizer for ``path``; its cache lives as long as the worker."""
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = Pieces(path)
    return _loaded[path]
