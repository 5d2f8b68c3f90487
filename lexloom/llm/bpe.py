"""Byte-pair encoding by dynamic programming over prefixes.

For every prefix of a word the table keeps the one token that ends the prefix's encoding.
An automaton over the vocabulary reports each token that is a suffix of the prefix; a token
is the last one exactly when it is compatible with the last token of the prefix it leaves.
Two tokens are compatible when no merge joins a piece on the right edge of the first with a
piece on the left edge of the second while both pieces exist. Back-pointers give the ids,
and the count at every prefix follows from the count at the prefix it leaves.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata

import ahocorasick
import numpy as np
import regex

from lexloom.llm.common import Memo, Recent, kept

#: Stands for the end-of-word mark: no byte is shown as this character.
END = "\x00"

_SPACE = regex.compile(r"\s+")
_SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return {b: chr(b) if b in kept else chr(next(moved)) for b in range(256)}


class PrefixBpe:
    """An encoder from a tokenizers file whose model is BPE with an end-of-word suffix."""

    def __init__(self, path: str, memo: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._path, self._library = path, None
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        shown = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        self.pieces = {i: t for t, i in model["vocab"].items()}
        ids = {shown(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: t for t, i in self.special.items()}
        self._specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile(pattern)
        self._bytes = byte_characters()
        # The merge that made each token: its parts and its rank; single symbols have none.
        self._rank: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (shown(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self._rank[ids[a], ids[b]] = rank
            self._parts.setdefault(ids[a + b], (ids[a], ids[b], rank))
        self._right = Memo(lambda t: self._edge(t, 1), 200_000)
        self._left = Memo(lambda t: self._edge(t, 0), 200_000)
        self._fits = Memo(lambda pair: not self._crosses(*pair, len(self._rank)), 100_000)
        self._automaton = ahocorasick.Automaton()
        whole: dict[int, bool] = {}
        for t, i in sorted(ids.items(), key=lambda x: len(x[0])):
            if i in self._parts:
                a, b, rank = self._parts[i]
                whole[i] = whole[a] and whole[b] and not self._crosses(a, b, rank)
            else:
                whole[i] = True
            if whole[i]:
                self._automaton.add_word(t, (i, len(t)))
        self._automaton.make_automaton()
        self._longest = max(map(len, ids), default=1)
        self._memo = Recent(self._word, memo // 8)
        # Pre-tokens hold no white space, so each run between white space is encoded on its own, once.
        self.word_counts = Recent(self._last_count, memo)
        self.chunk_counts = Recent(lambda c: sum(map(self.word_counts.__getitem__, self.words(c))), memo)
        self.word_packed = Recent(self._packed_word, memo)
        self.packed = Recent(self._packed, 2 * memo)
        # Whether runs of letters are pre-tokens of their own, with or without one sign after them.
        self._letters = all(self._words.findall(w + s) == [w, *s] for w in ("a", "ab", "the", "s", "ll") for s in ("", *".,;:!?"))

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces along one edge of the token, each with the rank of the merge that ends it."""
        found, ends = [], len(self._rank)
        while True:
            found.append((token, ends))
            if token not in self._parts:
                return found
            *parts, ends = self._parts[token]
            token = parts[side]

    def _crosses(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of lower rank than ``before`` joins pieces of both tokens.

        Of equal merges the leftmost goes first, so a piece of the first token must
        outlive the joint merge and a piece of the second need only reach it.
        """
        for x, x_ends in self._right[a]:
            for y, y_ends in self._left[b]:
                rank = self._rank.get((x, y))
                if rank is not None and rank < before and rank < x_ends and rank <= y_ends:
                    return True
        return False

    def _table(self, shown: str) -> tuple[list[int], list[int], list[int]]:
        """Last token, its length and the token count for every prefix of the shown word."""
        n = len(shown)
        last, size, count = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        fits = self._fits
        done = -1
        for end, (token, length) in self._automaton.iter(shown):
            if end != done:
                start = end + 1 - length
                if start:
                    before = last[start]
                    if before < 0 or not fits[before, token]:
                        continue
                done = end
                end += 1
                last[end] = token
                size[end] = length
                count[end] = count[start] + 1
        return last, size, count

    def _word(self, word: str) -> list[int]:
        shown = "".join(map(self._bytes.__getitem__, word.encode())) + END
        last, size, _ = self._table(shown)
        ids, at = [], len(shown)
        while at > 0:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def _last_count(self, word: str) -> int:
        """The count at the word's last prefix, which is the word with its end mark."""
        return self._table("".join(map(self._bytes.__getitem__, word.encode())) + END)[2][-1]

    def _packed_word(self, word: str) -> tuple[bytes, str]:
        ids = self._word(word)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.pieces.__getitem__, ids))

    def _packed(self, chunk: str) -> tuple[bytes, str]:
        if self._letters and chunk.isascii():
            get = self.word_packed
            if chunk.isalpha():
                return get[chunk.lower()]
            if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                (a, s), (b, t) = get[chunk[:-1].lower()], get[chunk[-1]]
                return a + b, f"{s} {t}"
        words = list(map(self.word_packed.__getitem__, self.words(chunk)))
        return words[0] if len(words) == 1 else (b"".join([w[0] for w in words]), " ".join([w[1] for w in words]))

    def word_prefix_counts(self, word: str) -> list[int]:
        """Tokens of word[:1], word[:2], ... each as a word of its own, from one table.

        Cutting at code point k leaves the symbols before it in the same states, so only
        the last token, which bears the end mark, is looked up anew.
        """
        shown = "".join(map(self._bytes.__getitem__, word.encode()))
        last, _, count = self._table(shown)
        cuts = np.cumsum([len(c.encode()) for c in word]).tolist()
        found = []
        for cut in cuts:
            tail = shown[max(0, cut - self._longest) : cut] + END
            best = None
            for end, (token, length) in self._automaton.iter(tail):
                start = cut + 1 - length
                if end == len(tail) - 1 and start >= 0 and (start == 0 or self._fits[last[start], token]):
                    best = count[start] + 1
            found.append(best)
        return found

    def words(self, text: str) -> list[str]:
        """The normalised pre-tokens of a text without special strings."""
        if not text.isascii():
            if "Cn" in map(unicodedata.category, text):
                return self._newer_words(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self._words.findall(text.lower())

    def _newer_words(self, text: str) -> list[str]:
        """Pre-tokens of texts with characters that Python's Unicode tables lack and the library's may have."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        shown = self._library.normalizer.normalize_str(text)
        return [shown[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(shown)]

    def chunks(self, text: str) -> list[str]:
        """The runs between white space; four separators are white space to Python but not to the file's pattern."""
        if _SEPARATORS.isdisjoint(text):
            return text.split()
        return [c for c in _SPACE.split(text) if c]

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """The text cut at special strings: (is special, string)."""
        if self._specials is None or not self._specials.search(text):
            return [(False, text)]
        return [(i % 2 == 1, x) for i, x in enumerate(self._specials.split(text)) if x]

    def count(self, text: str) -> int:
        get = self.chunk_counts.__getitem__
        return sum(1 if special else sum(map(get, self.chunks(x))) for special, x in self.parts(text))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for special, x in self.parts(text):
            if special:
                ids.append(self.special[x])
            else:
                for w in self.words(x):
                    ids += self._memo[w]
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by a space each: the file names no decoder."""
        return " ".join(map(self.pieces.__getitem__, ids))

    def spans(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """The normalised text without special strings and the places of its pre-tokens."""
        if not text.isascii():
            if "Cn" in map(unicodedata.category, text):
                self._newer_words("")
                shown = self._library.normalizer.normalize_str(text)
                return shown, [place for _, place in self._library.pre_tokenizer.pre_tokenize_str(shown)]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return text, [m.span() for m in self._words.finditer(text)]

    def prefix_counts(self, text: str, inside: bool = False) -> tuple[list[int], list[int]]:
        """(end, tokens so far) at the end of every pre-token, ends in code points of the normalised text.

        With ``inside``, at every prefix that ends in a pre-token too.
        """
        ends, counts, at, total = [], [], 0, 0
        for special, x in self.parts(text):
            if special:
                at, total = at + len(x), total + 1
                ends.append(at)
                counts.append(total)
                continue
            shown, spans = self.spans(x)
            for a, b in spans:
                if inside:
                    counts += [total + c for c in self.word_prefix_counts(shown[a:b])]
                    ends += range(at + a + 1, at + b + 1)
                    total = counts[-1]
                else:
                    total += self.word_counts[shown[a:b]]
                    ends.append(at + b)
                    counts.append(total)
            at += len(shown)
        return ends, counts

    def digest(self, text: str) -> tuple[int, str, str]:
        """Token count, SHA-256 of the ids and SHA-256 of the decoded text."""
        packed: list[tuple[bytes, str]] = []
        get = self.packed.__getitem__
        for special, x in self.parts(text):
            if special:
                i = self.special[x]
                packed.append((struct.pack("<I", i), self.pieces[i]))
            else:
                packed += map(get, self.chunks(x))
        ids = b"".join([p[0] for p in packed])
        decoded = " ".join([p[1] for p in packed if p[1]])
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encoder(path: str) -> PrefixBpe:
    """One encoder per Python worker and file."""
    return kept(path, lambda: PrefixBpe(path))
