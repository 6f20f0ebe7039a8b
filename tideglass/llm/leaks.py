"""Test items that leaked into documents: Wu-Manber search for word patterns, then an exact comparison in place."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions.arrow import by_chars

_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
_BREAKS = re.compile(r"\\[nrt]")
_HIDDEN = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_BLOCK = re.compile(r"</?(?:p|br|div|li|ul|ol|tr|td|th|table|h[1-6])\b[^<>]*>", re.I)
_INLINE = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_BETWEEN = re.compile("[‒-―…/|]")
_DROP = re.compile(r"[\W_]+")


def words(text: str) -> list[str]:
    """Words without case, punctuation, markup, escapes and typography: what is left of each stretch without blanks."""
    if "\\" in text:
        text = _BREAKS.sub(" ", _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text))
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _INLINE.sub("", _BLOCK.sub(" ", text))
    if not text.isascii():
        text = _BETWEEN.sub(" ", unicodedata.normalize("NFKC", _HIDDEN.sub("", text)))
        text = _HIDDEN.sub("", text)
    elif "/" in text or "|" in text:
        text = _BETWEEN.sub(" ", text)
    return [x for w in text.casefold().split() if (x := w if w.isalnum() else _DROP.sub("", w))]


@dataclass(frozen=True)
class LeakConfig:
    """share: of the item's words, in order and close together. weight: where another item explains the same passage better,
    the share of the item's words weighted by rarity among the items that it must have to count beside it. hits: distinctive
    word pairs that must occur close together before the words are compared. spread: how far a copy may be drawn out, in
    item lengths. lanes: text streams searched in step."""

    share: float = 0.5
    weight: float = 0.53
    hits: int = 4
    spread: float = 1.5
    lanes: int = 4096


PATTERN, BLOCK = 2, 1


class WuManber:
    """Patterns of two words over a stream of word ids: block shifts, suffix-hash buckets, direct comparison. A block is one
    word: copies of which every third word was changed keep no longer stretch in common."""

    def __init__(self, patterns: np.ndarray, words: int, bits: int = 16) -> None:
        self.mask = (1 << bits) - 1
        self.shift = np.full(words + 1, PATTERN - BLOCK + 1, np.int64)
        for j in range(PATTERN - BLOCK + 1):
            np.minimum.at(self.shift, patterns[:, j], PATTERN - BLOCK - j)
        suffix = self._hash(patterns[:, PATTERN - 2], patterns[:, PATTERN - 1])
        self.order = np.argsort(suffix, kind="stable")
        self.patterns = patterns
        self.start = np.searchsorted(suffix[self.order], np.arange((1 << bits) + 1))

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.int64) * 40503) ^ (b.astype(np.int64) * 2654435761 >> 7)) & self.mask

    def search(self, ids: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and pattern numbers of all occurrences. The stream is cut into lanes that advance together,
        each by the shift of its own block; a lane owns the occurrences that start in it."""
        n = len(ids)
        if n < PATTERN or not len(self.patterns):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = max(PATTERN, -(-n // lanes))
        pos = np.arange(0, n, width)
        end = np.minimum(pos + width, n - PATTERN + 1)
        found: list[np.ndarray] = []
        keep = pos < end
        pos, end = pos[keep], end[keep]
        while len(pos):
            step = self.shift[ids[pos + PATTERN - BLOCK]]
            stop = step == 0
            if stop.any():
                found.append(pos[stop])
            pos = pos + np.maximum(step, 1)
            keep = pos < end
            if not keep.all():
                pos, end = pos[keep], end[keep]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        bucket = self._hash(ids[at + PATTERN - 2], ids[at + PATTERN - 1])
        many = self.start[bucket + 1] - self.start[bucket]
        where = np.repeat(at, many)
        which = self.order[np.repeat(self.start[bucket], many) + np.arange(len(where)) - np.repeat(np.cumsum(many) - many, many)]
        same = np.ones(len(where), bool)
        for j in range(PATTERN):
            same &= ids[where + j] == self.patterns[which, j]
        return where[same], which[same]


def in_order(item: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest common subsequence of item and segment: which words of the item it has, and where in the segment."""
    best = np.zeros((len(item) + 1, len(seg) + 1), np.int32)
    for k, w in enumerate(item):
        best[k + 1] = np.maximum.accumulate(np.maximum(best[k], np.concatenate([[0], np.where(seg == w, best[k, :-1] + 1, 0)])))
    k, j, words, places = len(item), len(seg), [], []
    while k and j:
        if best[k, j] == best[k - 1, j]:
            k -= 1
        elif best[k, j] == best[k, j - 1]:
            j -= 1
        else:
            k, j = k - 1, j - 1
            words.append(k)
            places.append(j)
    return np.array(words[::-1], np.int64), np.array(places[::-1], np.int64)


def most_in_order(item: np.ndarray, seg: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    best = np.zeros(len(seg) + 1, np.int32)
    for w in item:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(seg == w, best[:-1] + 1, 0)))
    return int(best[-1])


class ItemIndex:
    """The items' words, rarities and distinctive patterns."""

    def __init__(self, items: list[tuple[int, str]], cfg: LeakConfig) -> None:
        self.cfg = cfg
        text = {i: words(t) for i, t in items}
        text = {i: w for i, w in text.items() if len(w) >= 3}
        self.vocab: dict[str, int] = {}
        self.items = {i: np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int32) for i, w in text.items()}
        self.bags = [np.unique(a, return_counts=True) for a in self.items.values()]
        self.ids = np.array(list(self.items), np.int64)
        distinct = {tuple(a.tolist()) for a in self.items.values()}
        df = Counter(w for a in distinct for w in set(a))
        pairs = Counter(g for a in distinct for g in set(zip(a, a[1:])))
        rarity = np.zeros(len(self.vocab) + 1)
        for w, c in df.items():
            rarity[w] = np.log((1 + len(distinct)) / c)
        self.weight = {i: rarity[a] for i, a in self.items.items()}
        owners: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        need = []
        for n, a in enumerate(self.items.values()):
            a = a.tolist()
            at = {g: k for k, g in reversed(list(enumerate(zip(a, a[1:]))))}
            most = max(2, sorted(pairs[g] for g in at)[len(at) // 2])
            mine = [g for g in at if pairs[g] <= most]
            need.append(max(1, min(cfg.hits, len(mine) // 4)))
            for g in mine:
                owners[g].append((n, at[g]))
        self.need = np.array(need, np.int64)
        self.wm = WuManber(np.array(list(owners), np.int32).reshape(-1, PATTERN), len(self.vocab))
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in owners.values()])]).astype(np.int64)
        self.owner, self.owned_at = (np.array([o[k] for x in owners.values() for o in x], np.int64) for k in (0, 1))

    def passages(self, stream: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Document, item, begin and end of the stretches to compare: those with enough hits close together."""
        where, which = self.wm.search(stream, self.cfg.lanes)
        many = self.first[which + 1] - self.first[which]
        row = np.repeat(np.arange(len(which)), many)
        own = self.first[which][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        doc, item, pos, at = np.searchsorted(first, where, side="right")[row] - 1, self.owner[own], where[row], self.owned_at[own]
        by = np.lexsort((pos, item, doc))
        doc, item, pos, at = doc[by], item[by], pos[by], at[by]
        lengths = np.array([len(a) for a in self.items.values()], np.int64)
        # hits within reach of each hit, of the same document and item
        reach = (self.cfg.spread * lengths[item]).astype(np.int64) + 20 if len(item) else item
        group = np.cumsum(np.concatenate([[0], (np.diff(doc) != 0) | (np.diff(item) != 0)])) if len(doc) else doc
        key = group * (len(stream) + 1) + pos
        last = np.searchsorted(group * (len(stream) + 1), (group + 1) * (len(stream) + 1)) if len(group) else group
        upto = np.minimum(np.searchsorted(key, key + reach), last)
        enough = upto - np.arange(len(pos)) >= self.need[item]
        begin = pos - at
        done_group, done_hi = -1, -1
        for k in np.flatnonzero(enough).tolist():
            if group[k] == done_group and upto[k] <= done_hi:
                continue  # all its hits lie in the stretch before
            done_group, done_hi = group[k], upto[k]
            b, n, d = begin[k : upto[k]], lengths[item[k]], doc[k]
            yield int(d), int(item[k]), int(max(first[d], b.min() - 5)), int(min(first[d + 1] - PATTERN, b.max() + n + 5))

    def leaks(self, split: list[list[str]]) -> Iterator[tuple[int, int, float, float, int]]:
        """(text number, item, share, weighted share, word position) of every leak in texts that are split into words."""
        get, gap = self.vocab.get, [0] * PATTERN
        ids: list[int] = []
        starts = []
        for t in split:
            starts.append(len(ids))
            ids.extend([get(w, 0) for w in t])
            ids.extend(gap)
        stream = np.array(ids, np.int32)
        first = np.array(starts + [len(ids)])
        found: dict[int, list] = defaultdict(list)
        for d, k, lo, hi in self.passages(stream, first):
            i = int(self.ids[k])
            a, w, seg = self.items[i], self.weight[i], stream[lo:hi]
            if self.shared(k, seg) < self.cfg.share * len(a):
                continue
            if most_in_order(a, seg) >= self.cfg.share * len(a):
                mine, places = in_order(a, seg)
                found[d].append((len(mine) / len(a), float(w[mine].sum() / max(w.sum(), 1e-9)), i, places + lo, mine))
        for d, got in found.items():
            best: dict[int, tuple[float, float, int]] = {}
            for share, weighted, i, places, mine in got:
                if weighted < self.cfg.weight and self._explained(share, i, places, got):
                    continue
                if i not in best or best[i][:2] < (share, weighted):
                    best[i] = (share, weighted, int(places[0] - first[d]))
            for i, (share, weighted, at) in best.items():
                yield d, i, share, weighted, at

    def shared(self, k: int, seg: np.ndarray) -> int:
        """Words that item and segment have in common in any order: no fewer than those in the same order."""
        mine, often = self.bags[k]
        at = np.searchsorted(mine, seg)
        at = at[mine[np.minimum(at, len(mine) - 1)] == seg]
        return int(np.minimum(np.bincount(at, minlength=len(mine)), often).sum())

    def _explained(self, share: float, i: int, places: np.ndarray, got: list) -> bool:
        """Whether other items that have a larger share of theirs in the same passage leave less than half of the item."""
        left = np.ones(len(places), bool)
        for s, _, j, p, _ in got:
            if s > share and j != i:
                left &= ~np.isin(places, p)
        return left.sum() < self.cfg.share * len(self.items[i])


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, cfg: LeakConfig = LeakConfig(), block: int = 20_000) -> DataFrame:
    """doc id, item id, share, weighted, word: documents that repeat at least half of an item's words in order.

    The items are the stated query set: they are held in memory in blocks of at most ``block`` items (by hash of the id,
    as many blocks as the counted rows need). Every document is read and split once and searched against every block where
    it lies. Nothing is shuffled. An item whose words in a passage are explained by another item that has more of its own
    there counts only if it also has ``weight`` of its words by rarity: items made after one pattern share many words.

    Null ids or texts on either side give no rows, nor do items of under three words and empty texts. Repeated documents
    each count under their own id; equal items each count; repeats of a pair come once per document row. Texts are
    searched whole, whatever their length.
    """
    clean = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).distinct()
    blocks = max(1, -(-clean.count() // block))
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col(doc_text).cast("string").alias("t"))
    parts = [clean.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).orderBy("i", "t") for k in range(blocks)]
    held = [docs.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in part.toLocalIterator()]) for part in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [ItemIndex(h.value, cfg) for h in held]
        for b in batches:
            d, texts = b["d"].to_pylist(), b["t"].to_pylist()
            got = []
            for lo, hi in by_chars(texts, 4_000_000):
                split = [words(t) for t in texts[lo:hi]]
                got += [(d[lo + j], i, s, w, p) for index in indexes for j, i, s, w, p in index.leaks(split)]
            if got:
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*got), types)], names=["d", "i", "share", "weighted", "word"])

    out = rows.mapInArrow(run, "d long, i long, share double, weighted double, word long")
    return out.select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "share", "weighted", "word")
