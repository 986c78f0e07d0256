"""Exact, memoised tokenisation with the tokenizers library.

Both public tokenizers split a text before their merges and never join what stands on two sides of such a split.
A text can therefore be encoded run by run, and a run that was met before needs no merges again: the ids of a text
are the ids of its runs one after another. Runs are cut and hashed over the bytes of many texts at once; a memo of
bounded size in each worker holds the bytes and ids of the runs met so far. A run takes the ids of the memo only if its bytes are
those that the memo holds, so that no two runs that share a hash are ever mistaken; a text with a run that lost its
place to another is encoded as one.

A run is a word of ASCII and Latin-1 letters with the one space before it, or what follows such letters up to white
space, or white space. Words with other characters stay whole. A text with white space beyond ASCII is encoded as one, and
so is every text if the tokenizer's own normalizer and splits are not those of which this is known to hold.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from .common import span_hashes, text_bytes

#: Runs that the memo holds before it starts anew, and slots of its table.
MEMO, SLOTS = 1_000_000, 1 << 21
#: White space of Unicode beyond ASCII, as UTF-8.
_ODD_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_CHARS = _byte_chars()


def run_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where each run begins; no run crosses a text's end."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    edge = edge[:n]
    space = _SPACE[data]
    before = np.empty(n, bool)  # white space or the text's start stands before
    before[0], before[1:] = True, space[:-1]
    before |= edge
    token = ~space & before
    latin = _ALPHA[data]
    if (data >= 128).any():
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[lead + 1 < n]
        second = data[lead + 1]
        lead = lead[(second != 0x97) & (second != 0xB7)]
        latin[lead] = latin[lead + 1] = True
    begin = edge.copy()
    ws_first = space.copy()
    ws_first[1:] &= ~space[:-1] | edge[1:]
    begin |= ws_first
    at = np.flatnonzero(token)
    inner = at[~edge[at]]  # tokens with white space before them, of the same text
    begin[inner - 1] = True
    begin[inner[data[inner - 1] != 32]] = True
    # the first character after a token's leading letters, unless the token has characters beyond Latin-1 letters
    odd = np.flatnonzero((data >= 128) & ~latin)
    if len(at):
        cut = ~latin & ~space
        cut[1:] &= latin[:-1] & ~edge[1:]
        cut[0] = False
        cut = np.flatnonzero(cut)
        own = np.searchsorted(at, cut, side="right") - 1
        gap = np.flatnonzero(~latin)
        first_gap = np.searchsorted(gap, at)
        first_gap = np.where(first_gap < len(gap), gap[np.minimum(first_gap, len(gap) - 1)] if len(gap) else n, n)
        good = first_gap[own] == cut
        if len(odd):
            bad = np.zeros(len(at), bool)
            bad[np.searchsorted(at, odd, side="right") - 1] = True
            good &= ~bad[own]
        begin[cut[good]] = True
    return np.flatnonzero(begin)


#: Normalizers and splits that never join across the runs.
KNOWN = (
    (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ),
)


class Encoder:
    """encode(texts) gives all ids, and where each text's ids start."""

    def __init__(self, path: str, memo: int = MEMO, hashes=span_hashes):
        from tokenizers import Tokenizer

        self.hashes = hashes

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        spec = json.loads(open(path, encoding="utf-8").read())
        self.known = (spec["normalizer"], spec["pre_tokenizer"]) in KNOWN
        self.lower = spec["normalizer"] is not None
        self.merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}))
        self.mark = _CHARS[10]  # a line end, as a word of its own: no run of letters holds its id
        self.mark_id = self.merges.encode([self.mark], is_pretokenized=True, add_special_tokens=False).ids[0]
        self.most = memo
        self._new()

    def _new(self) -> None:
        self.key, self.code = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.ids, self.n_ids = np.zeros(1 << 20, np.int32), 0
        self.start, self.n = np.zeros(1 << 18, np.int64), 0
        self.bytes, self.n_bytes = np.zeros(1 << 22, np.uint8), 0
        self.byte_start = np.zeros(1 << 18, np.int64)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The code of each hash, or -1."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        found = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        while len(left):
            code = self.code[slot]
            hit = (self.key[slot] == h[left]) & (code >= 0)
            found[left[hit]] = code[hit]
            go = ~hit & (code >= 0)
            left, slot = left[go], (slot[go] + 1) & (SLOTS - 1)
        return found

    def _insert(self, h: np.ndarray, code: np.ndarray) -> None:
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.code[slot] < 0
            self.key[slot[free]] = h[left[free]]
            self.code[slot[free]] = code[left[free]]
            lost = self.key[slot] != h[left]
            left, slot = left[lost], (slot[lost] + 1) & (SLOTS - 1)

    def _same(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Whether each span of data has the bytes of the run that its code stands for."""
        size, first = end - at, self.byte_start[code]
        ok = self.byte_start[code + 1] - first == size
        if not ok.all():
            at, size, first = at[ok], size[ok], first[ok]
        stop = np.cumsum(size)
        step = np.arange(stop[-1] if len(stop) else 0)
        other = self.bytes[step + np.repeat(first - (stop - size), size)] != data[step + np.repeat(at - (stop - size), size)]
        ok[np.flatnonzero(ok)[np.searchsorted(stop, np.flatnonzero(other), side="right")]] = False
        return ok

    def _learn(self, h: np.ndarray, runs: list[bytes]) -> None:
        texts = [r.decode() for r in runs]
        simple = [bool(_LETTERS.fullmatch(t)) for t in texts]
        heads = [t for t, s in zip(texts, simple, strict=True) if s]
        lists: list = [None] * len(runs)
        if heads:
            heads = [t.lstrip(" ").lower() for t in heads] if self.lower else heads
            words = [w for t in heads for w in (t.encode().decode("latin-1").translate(_CHARS), self.mark)]
            ids = np.asarray(self.merges.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
            marks = np.flatnonzero(ids == self.mark_id)
            parts = [ids[a:b] for a, b in zip([0, *(marks[:-1] + 1).tolist()], marks.tolist(), strict=True)]
            for i, p in zip(np.flatnonzero(simple), parts, strict=True):
                lists[i] = p
        rest = [i for i, s in enumerate(simple) if not s]
        for i, p in zip(rest, self.plain([texts[i] for i in rest]), strict=True):
            lists[i] = p
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(sizes.sum())
        while self.n_ids + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(runs) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.byte_start = np.concatenate([self.byte_start, np.zeros_like(self.byte_start)])
        joined = np.frombuffer(b"".join(runs), np.uint8)
        while self.n_bytes + len(joined) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.n_bytes : self.n_bytes + len(joined)] = joined
        self.byte_start[self.n + 1 : self.n + len(runs) + 1] = self.n_bytes + np.cumsum([len(r) for r in runs])
        self.n_bytes += len(joined)
        if total:
            self.ids[self.n_ids : self.n_ids + total] = np.concatenate([np.asarray(x, np.int32) for x in lists])
        self.start[self.n : self.n + len(runs)] = self.n_ids + np.cumsum(sizes) - sizes
        self._insert(h, np.arange(self.n, self.n + len(runs), dtype=np.int32))
        self.n += len(runs)
        self.n_ids += total
        self.start[self.n] = self.n_ids

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids start (one more than texts). Null: empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        data, starts = text_bytes(texts)
        n = len(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        whole = np.zeros(n, bool)
        raw = data.tobytes()
        if not self.known:
            whole[:] = True
        elif (data >= 128).any():
            odd = [m.start() for m in _ODD_SPACE.finditer(raw)]
            whole[np.searchsorted(starts, odd, side="right") - 1] = True
        if self.n > self.most:
            self._new()
        at = run_starts(data, starts)
        end = np.append(at[1:], len(data))
        doc = np.searchsorted(starts, at, side="right") - 1
        keep = ~whole[doc]
        at, end, doc = at[keep], end[keep], doc[keep]
        h = self.hashes(data, at, end)
        code = self._find(h)
        if len(miss := np.flatnonzero(code < 0)):
            new, first = np.unique(h[miss], return_index=True)
            first = miss[first]
            for i in range(0, len(new), 20_000):
                some = first[i : i + 20_000]
                self._learn(new[i : i + 20_000], [raw[a:b] for a, b in zip(at[some].tolist(), end[some].tolist(), strict=True)])
                if self.n > SLOTS // 2:
                    break
            code[miss] = self._find(h[miss])
            if (code < 0).any():  # a text with more runs than the memo takes
                self._new()
                got = self.plain([t or "" for t in texts.to_pylist()])
                ends = np.cumsum([0, *map(len, got)])
                return np.concatenate([np.asarray(g, np.int32) for g in got]), ends
        whole[doc[~self._same(data, at, end, code)]] = True
        first = self.start[code]
        size = self.start[code + 1] - first
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
        bounds = ends[np.searchsorted(doc, np.arange(n + 1))]
        if whole.any():
            some = np.flatnonzero(whole)
            got = dict(zip(some.tolist(), self.plain([texts[int(i)].as_py() or "" for i in some]), strict=True))
            parts = [np.asarray(got[i], np.int32) if i in got else ids[bounds[i] : bounds[i + 1]] for i in range(n)]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
