"""Public tokenizers inside tasks, with a bounded cache of words already encoded.

Both tokenizer kinds cut a text into words that are encoded one by one, so a text's ids
are those of its words in order. Arrow cuts and numbers the words of many texts at once,
each distinct word is looked up in the cache, and only new ones go to the tokenizer's
model. Texts in which a word border depends on more than a plain space or line feed go
to the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Entries of a worker's cache; beyond, only words that were met again stay.
CACHE_WORDS = 200_000
#: White space next to white space, at an end, or other than a space and a line feed; control characters.
_ODD = (r"[\x{00}-\x{09}\x{0B}-\x{1F}\x{7F}-\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{FEFF}]"
        r"|[ \n][ \n]|[ \n]\z|\A[ \n]")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the 256 bytes: printable ones as themselves, the others from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class Words:
    """The library's tokenizer, and its model for single words."""

    #: Pretokens of a printable ASCII word without an apostrophe.
    ascii_parts: re.Pattern

    def __init__(self, spec: str, cache_words: int = CACHE_WORDS):
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        form = json.loads(spec)
        self.special = [t["content"] for t in form.get("added_tokens", [])]
        self.letters = _byte_letters()
        self.cache_words = cache_words
        self.cache: dict[str, int] = {}
        self.again = np.zeros(0, dtype=bool)
        pre = form.get("pre_tokenizer") or {}
        self.by_word = form.get("post_processor") is None and self.knows(form.get("normalizer"), pre.get("pretokenizers", [pre]))

    def knows(self, normalizer: dict | None, pre: list[dict]) -> bool:
        raise NotImplementedError

    def whole(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)] if texts else []

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Texts that only the library can cut."""
        out = np.full(len(texts), not self.by_word)
        for s in self.special:
            out |= pc.match_substring(texts, s, ignore_case=True).to_numpy(zero_copy_only=False)
        return out

    def parts(self, word: str) -> list[str] | None:
        """The word's pretokens, or None if only the library can tell."""
        if word.isascii():
            return self.ascii_parts.findall(word) if word.isprintable() and "'" not in word else None
        core, mark = (word[:-1], word[-1:]) if word[-1] in ".," else (word, "")
        return ([core, mark] if mark else [core]) if core.isalpha() else None

    def written(self, part: str) -> str:
        return part if part.isascii() else part.encode("utf-8").decode("latin-1").translate(self.letters)

    def numbers(self, texts: pa.Array, cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cached values of the distinct words, each word's number among them, and each text's number of words."""
        lists = cut(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.get, words))
        if None in found:
            new = [k for k, v in enumerate(found) if v is None]
            if len(self.cache) + len(new) > self.cache_words:
                self.forget()
                found = list(map(self.cache.get, words))
                new = [k for k, v in enumerate(found) if v is None]
            self.met(found)
            self.learn([words[k] for k in new])
            for k in new:
                found[k] = self.cache[words[k]]
        return np.array(found, dtype=np.int64), coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy()

    def met(self, found: list[int | None]) -> None:
        """Told of the values that a block found in the cache before it learnt its new words."""

    def forget(self) -> None:
        self.cache = {}

    def learn(self, words: list[str]) -> None:
        raise NotImplementedError


class WordEncoder(Words):
    """Ids of texts for a tokenizer that drops white space, lower-cases and marks word ends."""

    ascii_parts = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")

    def __init__(self, spec: str, cache_words: int = CACHE_WORDS):
        super().__init__(spec, cache_words)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.forget()

    def knows(self, normalizer: dict | None, pre: list[dict]) -> bool:
        kinds = [n.get("type") for n in (normalizer or {}).get("normalizers", [])]
        return (kinds == ["NFC", "Replace", "Lowercase"] and len(pre) == 2 and pre[0].get("behavior") == "Removed" and pre[0].get("invert", False)
                and pre[1].get("type") == "ByteLevel")

    def met(self, found: list[int | None]) -> None:
        self.again[[k for k in found if k is not None]] = True

    def forget(self) -> None:
        """The cache gives a word's number; its ids stand in ``flat`` from ``starts``. Words met again since the last time stay, up to half a cache."""
        if not self.cache:
            self.names, self.flat, self.starts, self.again = [], array(getattr(self, "code", "H")), array("q", [0]), np.zeros(1024, dtype=bool)
            return
        kept = np.flatnonzero(self.again[: len(self.names)])[: self.cache_words // 2]
        starts, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat, self.dtype)
        n = starts[kept + 1] - starts[kept]
        upto = np.cumsum(n)
        ids = flat[np.repeat(starts[kept] - (upto - n), n) + np.arange(int(n.sum()))]
        del starts, flat  # the arrays may grow again
        self.names = [self.names[k] for k in kept]
        self.cache = dict(zip(self.names, range(len(kept)), strict=True))
        self.flat, self.starts = array(self.code, ids.tobytes()), array("q", np.concatenate([[0], upto]).astype(np.int64).tobytes())
        self.again = np.zeros(2 * len(kept) + 1024, dtype=bool)

    def _put(self, words: Sequence[str], ids: Sequence[Sequence[int]]) -> None:
        first, n = len(self.names), np.fromiter(map(len, ids), np.int64, len(ids))
        self.cache.update(zip(words, range(first, first + len(words)), strict=True))
        self.names.extend(words)
        self.flat.frombytes(np.fromiter(chain.from_iterable(ids), self.dtype, int(n.sum())).tobytes())
        self.starts.frombytes((self.starts[-1] + np.cumsum(n)).tobytes())
        if len(self.names) > len(self.again):
            self.again = np.concatenate([self.again, np.zeros(len(self.names), dtype=bool)])

    def learn(self, words: list[str]) -> None:
        rest, known, ids, tokenize = [], [], [], self.model.tokenize
        normal = self.tokenizer.normalizer.normalize_str
        # words of letters are normalised in one call: nothing in them joins with a space
        plain = [w for w in words if not w.isascii() and (w[:-1] if w[-1] in ".," else w).isalpha()]
        lowered = dict(zip(plain, normal(" ".join(plain)).split(" "), strict=True)) if plain else {}
        for w in words:
            if w.isascii() and w.isalpha():
                known.append(w)
                ids.append([t.id for t in tokenize(w)])
                continue
            low = w if w.isascii() else lowered[w] if w in lowered else normal(w)
            parts = self.parts(low) if low else []
            if parts is None:
                rest.append(w)
            else:
                known.append(w)
                ids.append([t.id for p in parts for t in tokenize(self.written(p))])
        self._put(known + rest, ids + self.whole(rest))

    @staticmethod
    def _cut(texts: pa.Array) -> pa.Array:
        """Words without capitals, and the mark after a word as a word; white space gives no ids."""
        flat = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        return pc.split_pattern(pc.replace_substring_regex(flat, r"([a-z])([.,]) ", r"\1 \2 "), " ")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids end."""
        odd = self.odd(texts)
        plain = pc.if_else(pa.array(odd), pa.scalar(""), texts) if odd.any() else texts
        found, word, words = self.numbers(plain, self._cut)
        starts = np.frombuffer(self.starts, np.int64)
        first, length = starts[found], starts[found + 1] - starts[found]
        del starts  # the array may grow again
        n = length[word]
        upto = np.cumsum(n)
        ids = np.frombuffer(self.flat, self.dtype)[np.repeat(first[word] - (upto - n), n) + np.arange(int(upto[-1]) if len(upto) else 0)]
        ends = np.concatenate([[0], upto])[np.cumsum(words)]
        if odd.any():
            whole = iter(self.whole([t for t, o in zip(texts.to_pylist(), odd, strict=True) if o]))
            each = [np.array(next(whole), dtype=self.dtype) if o else x for o, x in zip(odd, np.split(ids, ends[:-1]), strict=True)]
            ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        return ids, ends


class ByteCounter(Words):
    """Number of ids of texts for a byte-level tokenizer that gives a word its leading space.

    Words of the cache are cut before each space and line feed: one that begins with a
    line feed stands for it and the bare word after it, any other for a space and a word.
    """

    ascii_parts = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")

    def knows(self, normalizer: dict | None, pre: list[dict]) -> bool:
        return normalizer is None and len(pre) == 1 and pre[0].get("type") == "ByteLevel" and bool(pre[0].get("use_regex")) and not pre[0].get("add_prefix_space")

    def odd(self, texts: pa.Array) -> np.ndarray:
        return super().odd(texts) | pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)

    def learn(self, words: list[str]) -> None:
        rest, tokenize, cache, space = [], self.model.tokenize, self.cache, self.letters[0x20]
        for w in words:
            line = w[:1] == "\n"
            lead, bare = ("", w[1:]) if line else (space, w)
            core = bare[:-1] if bare[-1:] in (".", ",") else bare
            if core.isalpha() and core.isascii():
                key = w[: len(core) + line]
                n = cache.get(key)
                if n is None:
                    n = cache[key] = line + len(tokenize(lead + core))
                cache[w] = n + (key != w)
                continue
            parts = self.parts(bare) if bare else [""]
            if parts is None:
                rest.append(w)
                continue
            cache[w] = line + len(tokenize(lead + self.written(parts[0]))) + sum(len(tokenize(self.written(p))) for p in parts[1:]) if bare else int(line)
        for w, x in zip(rest, self.whole([w if w[:1] == "\n" else " " + w for w in rest]), strict=True):
            cache[w] = len(x)

    def count(self, texts: pa.Array) -> np.ndarray:
        odd = self.odd(texts)
        plain = pc.if_else(pa.array(odd), pa.scalar(""), texts) if odd.any() else texts
        # a line feed before the text makes its first word a bare one
        found, word, words = self.numbers(plain, lambda t: pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\n", t, ""), "\n", " \n"), " "))
        upto = np.concatenate([[0], np.cumsum(found[word])])[np.concatenate([[0], np.cumsum(words)])]
        counts = np.diff(upto)
        counts -= 1  # that line feed
        if odd.any():
            counts[odd] = [len(x) for x in self.whole([t for t, o in zip(texts.to_pylist(), odd, strict=True) if o])]
        return counts


def read_spec(path: str) -> str:
    """A tokenizer file, read on the driver; it goes to the tasks by broadcast and is a few MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_LOADED: dict[tuple, Words] = {}


def loaded(kind: type, digest: str, spec) -> Words:
    """One tokenizer per worker process, kept from task to task; ``spec`` gives the file's text when needed."""
    if (kind, digest) not in _LOADED:
        _LOADED[kind, digest] = kind(spec())
    return _LOADED[kind, digest]
