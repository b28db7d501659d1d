"""Byte-level BPE ids of whole texts, with a memo of white-space delimited units."""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
import xxhash

from .common import Words

#: Units that the memo keeps before it starts anew.
MEMO = 400_000
_ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80|<\|endoftext\|>")


def default_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Encoder:
    """ids(texts) gives what Tokenizer.encode(text, add_special_tokens=False).ids gives, for many texts at once.

    The tokenizer's splitting pattern never joins what stands on both sides of ASCII white space, except that one space
    goes with the word after it. So a text is cut into units (a word with its one space before, or white space), each
    distinct unit is encoded once by the same vocabulary as ranks, and the ids are gathered by array operations. A unit is known
    by 128 bits. Texts
    with other white space or with a special token's string take the tokenizer itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.slow = Tokenizer.from_file(json_path)
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.feed = self.fast.encode_single_token("\n")
        self._reset()

    def _reset(self) -> None:
        self.keys, self.checks, self.at, self.n, self.ids_of = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, units: list[bytes]) -> None:
        if len(self.keys) > MEMO:
            self._reset()
        # One call for all words: between two of them a line feed is a piece, and an id, of its own.
        space = np.fromiter((u.isspace() for u in units), bool, len(units))
        apart = [self.fast.encode_ordinary(units[i].decode()) for i in np.flatnonzero(space)]
        ids = self.fast.encode_to_numpy(b"\n".join(u for u, s in zip(units, space.tolist(), strict=True) if not s).decode()).astype(np.uint32)
        cut = np.flatnonzero(ids == self.feed)
        n, at = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        if (~space).any():
            at[~space] = np.concatenate(([0], cut + 1))
            n[~space] = np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1
        n[space] = [len(x) for x in apart]
        at[space] = len(ids) + np.cumsum(n[space]) - n[space]
        at += len(self.ids_of)
        self.ids_of = np.concatenate([self.ids_of, ids, *(np.array(x, np.uint32) for x in apart)])
        to = np.searchsorted(self.keys, keys)
        self.keys, self.checks, self.at, self.n = (np.insert(a, to, b) for a, b in ((self.keys, keys), (self.checks, checks), (self.at, at), (self.n, n)))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, before): text i has ids[before[i] : before[i + 1]]."""
        w = Words(texts)
        raw = w.raw.tobytes()
        odd = {int(np.searchsorted(w.offsets, m.start(), "right")) - 1 for m in _ODD_SPACE.finditer(raw)}
        start, end, text = w.start, w.end, w.text_of()
        lead = np.concatenate(([0], w.end[:-1])) if len(w) else start
        if len(w):
            lead = np.maximum(lead, w.offsets[text])
        one = (start > lead) & (w.raw[np.maximum(start - 1, 0)] == 32)  # this space goes with the word
        key = (w.hash ^ np.where(one, np.uint64(0x5851F42D4C957F2D), np.uint64(0))) | np.uint64(1)
        check = w.other
        # What stands before a word and is not its own space: white space, as its last character alone and the rest, or as the rest.
        rest = start - one
        gap = rest - lead
        first = np.where(one, gap, np.maximum(gap - 1, 0))  # the whole rest before an own space, else all but the last
        tail = np.full(len(w.offsets) - 1, 0, np.int64)
        last = w.before[1:] - 1
        has = w.counts > 0
        tail_from = np.where(has, w.end[np.maximum(last, 0)] if len(w) else 0, w.offsets[:-1])
        tail = w.offsets[1:] - tail_from
        spaces: list[tuple[int, int, int, int]] = []  # (text, order, start, end)
        for i in np.flatnonzero(gap > 0).tolist():
            a, f, r = int(lead[i]), int(first[i]), int(rest[i])
            if f:
                spaces.append((int(text[i]), 2 * i, a, a + f))
            if a + f < r:
                spaces.append((int(text[i]), 2 * i, a + f, r))
        for t in np.flatnonzero(tail > 0).tolist():
            spaces.append((t, 2 * int(w.before[t + 1]) - 1, int(tail_from[t]), int(w.offsets[t + 1])))
        if spaces:
            st, so, sa, sb = (np.array(x, np.int64) for x in zip(*spaces, strict=True))
            sk = np.fromiter(((hash(raw[a:b]) & 0x7FFFFFFFFFFFFFFF) << 1 for a, b in zip(sa.tolist(), sb.tolist(), strict=True)), np.uint64, len(sa))
            sc = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(sa.tolist(), sb.tolist(), strict=True)), np.uint64, len(sa))
            order = np.argsort(np.concatenate((2 * np.arange(len(w)) + 1, so)), kind="stable")
            # A gap's units keep their order and come before their word: their order is even, a word's odd; a text's tail follows its last word.
            key, check = np.concatenate((key, sk))[order], np.concatenate((check, sc))[order]
            rest, end, text = (np.concatenate(x)[order] for x in ((rest, sa), (end, sb), (text, st)))
        uniq, at_first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys):
            seen = self.keys[np.minimum(np.searchsorted(self.keys, uniq), len(self.keys) - 1)] == uniq
        else:
            seen = np.zeros(len(uniq), bool)
        if (~seen).any():
            if len(self.keys) + int((~seen).sum()) > MEMO:
                self._reset()
                seen[:] = False
            new = at_first[~seen]
            self._learn(uniq[~seen], check[new], [raw[a:b] for a, b in zip(rest[new].tolist(), end[new].tolist(), strict=True)])
        where = np.searchsorted(self.keys, uniq)[back]
        # Another unit under the same 64 bits differs in the other 64; its text takes the tokenizer itself.
        odd |= set(text[self.checks[where] != check].tolist())
        n, at = self.n[where], self.at[where]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = self.ids_of[np.arange(total) + np.repeat(at - (ends - n), n)] if total else np.zeros(0, np.uint32)
        counts = np.bincount(text, weights=n, minlength=len(w.offsets) - 1).astype(np.int64) if len(text) else np.zeros(len(w.offsets) - 1, np.int64)
        before = np.concatenate(([0], np.cumsum(counts)))
        if not odd:
            return out, before
        parts = [np.array(self.slow.encode(raw[w.offsets[i] : w.offsets[i + 1]].decode(), add_special_tokens=False).ids, np.uint32) if i in odd else out[before[i] : before[i + 1]] for i in range(len(before) - 1)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
