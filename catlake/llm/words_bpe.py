"""Token ids of whole buffers by a byte-level tokenizer file of the tokenizers library.

The file's pre-tokenizer splits texts by the usual byte-level rule: contractions, runs of
letters, digits or other signs, each with at most one space before it, and white space.
Here that rule is a few comparisons of neighbouring characters' kinds over a whole buffer,
and each different match is handed to the library once, as long as a verified span table
(``spans.py``) remembers it. Strings of added tokens inside a text become their ids, as the
library does by default; ``added=False`` leaves them ordinary text.
"""

from __future__ import annotations

import functools
import os
import re
import sys

import numpy as np
import pyarrow as pa
import regex

from .spans import SpanTable, buffer_of

#: Kinds of characters: any other sign, white space, letter, digit.
OTHER, SPACE, LETTER, DIGIT = range(4)
#: What may follow an apostrophe that begins a match; fixed values of the rule.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


_CUT = re.compile(rb"[0-9A-Za-z] (?=[0-9A-Za-z])")


@functools.lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point; once a worker."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a == len(m[0]) - 1:
                out[a : b + 1] = kind
            else:  # a run over the gap of the surrogates
                out[list(map(ord, m[0]))] = kind
    return out


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the offsets of their first bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    rest = np.concatenate([data, np.zeros(3, np.uint8)])
    code = lead.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        who = np.flatnonzero((lead >= low) & (lead < (0xE0, 0xF0, 0x100)[size - 2]))
        if len(who):
            value = lead[who] & mask
            for k in range(1, size):
                value = (value << 6) | (rest[at[who] + k] & 0x3F)
            code[who] = value
    return code, at


def matches(code: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The places where matches of the rule begin; ``begins`` are the first places of the texts, of one character at least each."""
    n = len(code)
    kind = kinds()[code]
    head = np.zeros(n + 1, bool)
    head[begins] = head[n] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last character of white space before a sign begins a match, and a plain space takes the sign's run with it.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:n])
    start[last] = True
    start[last[code[last] == 0x20] + 1] = False
    mark = np.flatnonzero((code == 0x27) & start)
    for tail in CONTRACTIONS:
        p = mark[mark + len(tail) < n]
        for k, c in enumerate(tail, 1):
            p = p[(code[p + k] == ord(c)) & ~head[p + k]]
        start[p + 1] = False
        inner = p + len(tail) + 1
        start[inner[inner < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of the rows of Arrow arrays of texts."""

    #: Entries and bytes that are remembered; beyond, those met once since the last time go.
    MOST, ARENA, AT_ONCE = 1_000_000, 1 << 25, 4000

    def __init__(self, path: str, added: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        shown = repr(self.tokenizer.pre_tokenizer)
        if self.tokenizer.normalizer is not None or "ByteLevel" not in shown or "add_prefix_space=False" not in shown or "use_regex=True" not in shown:
            raise ValueError("the file's tokenizer is no plain byte-level one")
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        own = self.tokenizer.get_added_tokens_decoder() if added else {}
        self.added = {t.content.encode(): i for i, t in own.items() if t.content}
        self.find_added = re.compile(b"|".join(sorted(map(re.escape, self.added), key=len, reverse=True))).finditer if self.added else None
        self.tokenizer.encode_special_tokens = True
        self.table, self.ids = None, np.zeros(0, np.int32)
        self.at = self.size = self.met = np.zeros(0, np.int64)
        self.forget()

    def forget(self) -> None:
        """Start anew with the entries that were met more than once, if these are at most half of what may be remembered."""
        old, ids, at, size, met = self.table, self.ids, self.at, self.size, self.met
        keep = np.flatnonzero(met[: old.count] > 1) if old else np.zeros(0, np.int64)
        if old and (2 * len(keep) > self.MOST or 2 * old.length[keep].sum() > self.ARENA):
            keep = keep[:0]
        self.table, self.size = SpanTable(1 << 14), size[keep]
        stops = np.cumsum(self.size)
        self.at, total = stops - self.size, int(stops[-1]) if len(keep) else 0
        self.ids = ids[np.repeat(at[keep] - self.at, self.size) + np.arange(total)]
        self.met = np.zeros(len(keep), np.int64)
        if len(keep):
            self.table.number(old.arena[: old.used], old.start[keep], old.length[keep])

    def _learn(self) -> None:
        """Ids of the entries that have none yet."""
        parts, sizes = [self.ids], [self.size]
        for k in range(len(self.size), self.table.count, self.AT_ONCE):
            words = [self.table.bytes_of(i).decode() for i in range(k, min(k + self.AT_ONCE, self.table.count))]
            coded = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            parts.append(np.asarray(coded.ids, np.int32))
            sizes.append(np.bincount(np.asarray(coded.word_ids, np.int64), minlength=len(words)))
        self.ids, self.size = np.concatenate(parts), np.concatenate(sizes)
        self.at = np.cumsum(self.size) - self.size

    def encode_long(self, text: bytes, step: int = 1 << 21) -> np.ndarray:
        """The ids of one text, encoded in parts of bounded size where it has plain spaces between ASCII letters or digits.

        A match begins at each such space, so the parts' ids are those of the whole.
        """
        out, a = [], 0
        while a < len(text):
            m = _CUT.search(text, a + step)
            b = m.start() + 1 if m else len(text)
            out.append(self.encode(pa.array([text[a:b]], pa.binary()))[0])
            a = b
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and the n + 1 offsets of the rows in them."""
        data, ends = buffer_of(texts)
        if self.table.count > self.MOST or self.table.used > self.ARENA:
            self.forget()
        cuts, special = ends, {}
        if self.find_added:
            # A string of an added token is a text of its own; it lies within a row.
            for m in self.find_added(data.tobytes()):
                if np.searchsorted(ends, m.start(), "right") == np.searchsorted(ends, m.end() - 1, "right"):
                    special[m.start()] = (m.end(), self.added[m[0]])
            cuts = np.unique(np.concatenate([ends, [*special], [e for e, _ in special.values()]]).astype(np.int64)) if special else ends
        code, at = characters(data)
        begins = np.unique(cuts[:-1][cuts[1:] > cuts[:-1]])
        first = matches(code, np.searchsorted(at, begins)) if len(code) else np.zeros(0, np.int64)
        start = at[first]
        if special:
            inside = np.zeros(len(start), bool)
            for a, (b, _) in special.items():
                inside[np.searchsorted(start, a) + 1 : np.searchsorted(start, b)] = True
            start = start[~inside]
        stop = np.append(start[1:], len(data)) if len(start) else start
        entry = self.table.number(data, start, stop - start)
        self._learn()
        met = np.bincount(entry, minlength=self.table.count)
        met[: len(self.met)] += self.met
        self.met = met
        begin, size = self.at[entry], self.size[entry]
        ids, base = self.ids, len(self.ids)
        if special:
            which = np.searchsorted(start, [*special])
            begin, size = begin.copy(), size.copy()
            begin[which], size[which] = base + np.arange(len(which)), 1
            ids = np.concatenate([ids, np.array([i for _, i in special.values()], np.int32)])
        stops = np.cumsum(size)
        total = int(stops[-1]) if len(stops) else 0
        out = ids[np.repeat(begin - (stops - size), size) + np.arange(total)]
        return out, np.append(0, stops)[np.searchsorted(start, ends)]
