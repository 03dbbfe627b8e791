"""Byte-level BPE over whole texts through a cache of chunks.

A byte-level BPE with the usual word pattern never merges across the point where a character that
is certainly not white space is followed by a plain space, tab or line end. Texts are cut there
into chunks; each distinct chunk is encoded by the tokenizers library once per cache generation,
and a text's ids are the concatenation of its chunks' ids. The result equals an encoding of the
whole text, special strings included, as none of them holds white space.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: Sure white space at which a chunk may begin.
SURE = " \t\n\r"
#: Characters that some definition of white space holds beside those.
UNSURE = "\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿"
CHUNK = re.compile(f"[{SURE}{UNSURE}]*[^{SURE}{UNSURE}]+(?:[{UNSURE}][{SURE}{UNSURE}]*[^{SURE}{UNSURE}]*)*|[{SURE}{UNSURE}]+")

#: Entries of each of the two cache generations in a Python worker, about 200 bytes each.
CACHE = 600_000
#: Chunks longer than this are not cached.
LONG = 200
#: A rank after all merges.
NEVER = 1 << 60


def slices(texts: list[str | None], most: int = 3_000_000):
    """The texts in runs of about so many code points, so that the chunks held at once are bounded."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t or "")
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


class TwoGenerations:
    """A bounded cache: when full, the younger generation becomes the older one."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def unknown(self, keys: set) -> set:
        """Keys in neither generation; those of the older one move to the younger."""
        missing = keys.difference(self.young)
        new = missing.difference(self.old)
        if len(new) < len(missing):
            young, old = self.young, self.old
            for k in missing.difference(new):
                young[k] = old[k]
        return new

    def turn(self) -> None:
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}


class ChunkEncoder:
    """Token ids of whole texts as the tokenizers library gives them, little-endian uint32."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.leads = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = TwoGenerations()
        self.simple = re.compile(f" [^{SURE}{UNSURE}]{{1,{LONG}}}")
        # What all special strings begin with, so that a chunk without it holds none.
        self.lead = os.path.commonprefix(self.special)[:2] or "" if self.special else "\0"

    def _fill(self, chunks: list[list[str]]) -> dict[str, bytes]:
        """Put unknown chunks in the cache; returns the long ones, which are not kept."""
        new = self.cache.unknown(set(chain.from_iterable(chunks)))
        simple, lead = self.simple.fullmatch, self.lead
        plain = [c for c in new if simple(c) and lead not in c]
        rest = list(new.difference(plain))
        once: dict[str, bytes] = {}
        young = self.cache.young
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) != len(part):  # a chunk whose encoding does not begin with its space
                rest += part
                continue
            raw, edges = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            for c, a, b in zip(part, edges, edges[1:]):
                young[c] = raw[a:b]
        for k in range(0, len(rest), 2000):
            part = rest[k : k + 2000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                (once if len(c) > LONG else young)[c] = np.array(e.ids, dtype="<u4").tobytes()
        return once

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: empty)."""
        return list(chain.from_iterable(map(self._encode, slices(texts))))

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        chunks = [CHUNK.findall(t) if t else [] for t in texts]
        once = self._fill(chunks)
        young = self.cache.young
        get = young.__getitem__ if not once else lambda c: once[c] if c in once else young[c]
        out = [b"".join(map(get, c)) for c in chunks]
        self.cache.turn()
        return out


class PrefixCounter:
    """Exact token counts of every prefix of a text, by dynamic programming over last tokens.

    In BPE the encoding of a prefix that ends where a token ends is the encoding of the text up to
    there. So the last token of the prefix of length i is the one vocabulary entry t that ends at i
    for which (last token before t, t) is a pair that BPE leaves apart; the prefix's count is one
    more than that of the prefix before t. Counts are kept as the differences between successive
    code points, one signed byte each, and add up over chunks.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        back = {c: b for b, c in byte_alphabet().items()}
        raw = lambda token: bytes(back[c] for c in token)
        self.tokens = {t: t for t in (raw(t) for t in model["vocab"] if all(c in back for c in t))}
        self.rank = {}
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[raw(a), raw(b)] = k
        self.made = {a + b: (k, (a, b)) for (a, b), k in reversed(self.rank.items())}
        self.suffixes = {t[k:] for t in self.tokens for k in range(len(t))}
        self.left: dict[bytes, list] = {}
        self.right: dict[bytes, list] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parted = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.space = self._spaces()
        own = re.escape(self.space)
        self.words = regex.compile(WORDS.replace(r"[^\s\p{L}\p{N}]", rf"[^{own}\p{{L}}\p{{N}}]").replace(r"\s", f"[{own}]").replace(r"\S", f"[^{own}]"))
        self.chunk = re.compile(f"[{own}]*[^{own}]+|[{own}]+")
        if max(map(len, self.tokens)) > 128:
            raise ValueError("prefix counts are kept in signed bytes, which a token of more than 128 bytes may exceed")
        self.cache = TwoGenerations()
        self.points = TwoGenerations()
        self.apart: dict[tuple[bytes, bytes], bool] = {}

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts at one end of a token while BPE builds it, each with the rank of the merge that ends it."""
        out, ends = [(token, NEVER)], None
        while token in self.made:
            ends, parts = self.made[token]
            token = parts[side]
            out.append((token, ends))
        return out

    def _pair(self, a: bytes, b: bytes) -> bool:
        """Whether BPE leaves two adjacent tokens apart: no merge across comes before those that build them."""
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) > 4 * CACHE:
                self.apart.clear()
            if a not in self.right:
                self.right[a] = self._spine(a, 1)
            if b not in self.left:
                self.left[b] = self._spine(b, 0)
            known, rank = True, self.rank
            for x, until_x in self.right[a]:
                for y, until_y in self.left[b]:
                    r = rank.get((x, y))
                    # Equal ranks are one rule, which runs from left to right.
                    if r is not None and r < until_x and r <= until_y:
                        known = False
            self.apart[a, b] = known
        return known

    def _word(self, word: bytes) -> list[int]:
        """Counts of all byte prefixes of one word of the pattern, the empty one first."""
        last: list[bytes] = [b""]
        count = [0]
        tokens, suffixes, pair = self.tokens, self.suffixes, self._pair
        for i in range(1, len(word) + 1):
            ends = []
            for k in range(i - 1, -1, -1):
                t = word[k:i]
                if t in tokens:
                    ends.append((k, tokens[t]))
                elif t not in suffixes:
                    break
            for k, t in reversed(ends):
                if k == 0 or pair(last[k], t):
                    last.append(t)
                    count.append(count[k] + 1)
                    break
            else:
                raise ValueError("the vocabulary does not hold every byte")
        return count

    def _spaces(self) -> str:
        """The characters that the library takes for white space, as it splits them itself."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        doubtful = sorted(UNSURE_SET | set(SURE))
        # Two of them before a letter are two words only if the pattern takes them for space (a plain one joins the letter).
        return " " + "".join(c for c in doubtful if len(split(f"a{c}{c}b")) > 3)

    def _split(self, text: str) -> list[str]:
        """The words of the pattern by the library's own idea of letters and numbers."""
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _points(self, word: str) -> bytes:
        """The differences at the code points of one word of the pattern."""
        if word in CONTRACTIONS:
            # One word only when whole: its own prefixes are a quote and then a letter.
            return pack([*range(len(word)), self._word(word.encode())[-1]])
        return pack(self._counts(word))

    def _counts(self, word: str) -> list[int]:
        """Counts of the prefixes of one word by code points, the empty one first."""
        counts = self._word(word.encode())
        if word.isascii():
            return counts
        ends = [0]
        for c in word:
            ends.append(ends[-1] + len(c.encode()))
        return [counts[k] for k in ends]

    def _of_words(self, words: list[str]) -> bytes:
        known, old, out = self.points.young, self.points.old, []
        for word in words:
            d = known.get(word)
            if d is None:
                d = old.get(word) or self._points(word)
                if len(word) <= LONG:
                    known[word] = d
            out.append(d)
        return b"".join(out)

    def _plain(self, chunk: str) -> bytes:
        """The differences at the code points of a chunk whose special strings count as common text.

        A chunk is white space and then what holds none, so but for its beginning and contractions
        a prefix has the words of the whole.
        """
        whole = self._of_words(self.words.findall(chunk))
        if not chunk.isascii() and max(chunk) > LATIN:
            # Here versions of Unicode may differ on letters and numbers: the library's split decides.
            total = int(np.frombuffer(whole, np.int8).sum(dtype=np.int64))
            if len(whole) != len(chunk) or total != len(self.encode(chunk)):
                whole = self._of_words(self._split(chunk))
        body = chunk.lstrip(self.space)
        lead = len(chunk) - len(body)
        if lead > 1 and body:
            # A prefix that ends in the leading white space holds it as one word.
            counts = [0, *np.cumsum(np.frombuffer(whole, np.int8), dtype=np.int64).tolist()]
            whole = pack(self._counts(chunk[:lead]) + counts[lead + 1 :])
        return whole

    def encode(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        return [i for part in self.parted.split(text) for i in self.tokenizer.encode(part, add_special_tokens=False).ids] if self.special else self.tokenizer.encode(text, add_special_tokens=False).ids

    def deltas(self, chunk: str) -> bytes:
        """The differences at the code points of a chunk.

        Up to the last code point of a special string a prefix holds it as common text; with that it is
        one token, and what follows is encoded as if it began there.
        """
        if not any(s in chunk for s in self.special):
            return self._plain(chunk)
        out, begin = [], 0
        for m in self.parted.finditer(chunk):
            common = np.frombuffer(self._plain(chunk[begin : m.end() - 1]), np.int8).astype(np.int64)
            upto = int(common.sum())
            before = int(common[: m.start() - begin].sum())
            out += [common, [before + 1 - upto]]
            begin = m.end()
        if begin < len(chunk):
            out.append(np.frombuffer(self._plain(chunk[begin:]), np.int8))
        return pack([0, *np.cumsum(np.concatenate(out), dtype=np.int64).tolist()])

    def count(self, texts: list[str | None]) -> list[bytes]:
        """Differences of the prefix counts of each text (null: empty), one signed byte a code point."""
        return list(chain.from_iterable(map(self._count, slices(texts))))

    def _count(self, texts: list[str | None]) -> list[bytes]:
        chunks = [self.chunk.findall(t) if t else [] for t in texts]
        once = {}
        for c in self.cache.unknown(set(chain.from_iterable(chunks))):
            (once if len(c) > LONG else self.cache.young)[c] = self.deltas(c)
        self.points.turn()
        young = self.cache.young
        get = young.__getitem__ if not once else lambda c: once[c] if c in once else young[c]
        out = [b"".join(map(get, c)) for c in chunks]
        self.cache.turn()
        return out


#: Up to here, versions of Unicode agree on what is a letter or a number.
LATIN = "\u024f"
UNSURE_SET = set(re.findall(f"[{UNSURE}]", "".join(map(chr, range(0x10000)))))


def pack(counts: list[int]) -> bytes:
    """Differences of successive counts, one signed byte each."""
    out = [b - a for a, b in zip(counts, counts[1:])]
    if out and (max(out) > 127 or min(out) < -128):
        raise OverflowError("a single code point changes the count by more than a signed byte holds")
    return bytes(x & 255 for x in out)


#: The word pattern of the byte-level BPE family and its contractions.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in such a vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker process."""
    return ChunkEncoder(path)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)
