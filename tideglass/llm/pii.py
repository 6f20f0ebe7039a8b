"""Personal information in free text: a linear-chain conditional random field over word shapes, decoded by Viterbi.

Texts are read as arrays of characters. Words, the stretches between blanks and runs of numbers are found by array
operations and told apart by hashes, so Python looks at each different word, stretch or run once; scores of words are
looked up, and all sequences are decoded in step. There are no patterns beside the model: spans are the labels decoded.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions.arrow import by_chars
from tideglass.llm.pii_labels import REGISTER, labelled

KINDS = {"E": "email", "P": "phone", "D": "id_number", "A": "address", "N": "name"}
LABELS = ["O", *[f"{b}-{k}" for k in KINDS for b in "BI"]]
CODE = {x: i for i, x in enumerate(LABELS)}
PLACE = {k: f"[{v.upper()}]" for k, v in KINDS.items()}
REACH = 2
#: Places from which a word is seen: so far before or behind, and one (L) or two (M) before the run of numbers.
PLACES = [*map(str, range(-REACH, REACH + 1)), "L", "M"]
BITS = 18
#: Longest sequence decoded as one; longer ones are cut.
LONGEST = 400
TITLES = {"dr", "prof", "professor", "frau", "herr", "herrn", "mme", "mlle", "sra", "sr", "mr", "mrs", "ms", "sir", "madame", "monsieur", "señora", "señor"}
BLANK, LINE, DIGIT, LETTER, OTHER = range(5)


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of every character of the basic plane, and whether it is upper case."""
    cls, up = np.full(65536, OTHER, np.int8), np.zeros(65536, bool)
    for i in range(65536):
        c = chr(i)
        if c.isdecimal():
            cls[i] = DIGIT
        elif c.isalnum():
            cls[i] = LETTER
            up[i] = c.isupper() or c.istitle()
        elif c.isspace():
            cls[i] = BLANK
    cls[10] = LINE
    return cls, up


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([one, np.cumprod(np.full(n, b), dtype=np.uint64)]) for b in (_ODD, _INVERSE))


class Hashes:
    """Hashes of stretches of one array of codes, the same wherever the stretch stands."""

    def __init__(self, codes: np.ndarray) -> None:
        n = 1 << max(10, int(len(codes)).bit_length())
        self.up, self.down = _powers(n)
        with np.errstate(over="ignore"):
            x = codes.astype(np.uint64) + np.uint64(1)
            x = (x ^ (x << np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * self.up[: len(codes)], dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64)


@dataclass
class Stream:
    """Words of a text: starts, ends, kinds; the stretch between blanks and the run of numbers each lies in (-1: none),
    with their own starts and ends; flags of the stretch and those beside it; whether a word begins its stretch or run."""

    text: str
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    word: np.ndarray
    chunk: np.ndarray
    chunk_at: np.ndarray
    chunk_end: np.ndarray
    chunk_hash: np.ndarray
    chunk_rich: np.ndarray
    run: np.ndarray
    run_at: np.ndarray
    run_end: np.ndarray
    run_hash: np.ndarray
    flag: np.ndarray
    known: np.ndarray


#: Types of stretches: plain, with an @ and a dot behind it, bracketed at, bracketed dot, number, letters and digits; six more
#: for words that do not begin theirs.
TYPES = 12
_AT = {"(at)", "[at]", "{at}"}
_DOT = {"(dot)", "[dot]", "{dot}"}


def _hash_words(words: list[str]) -> np.ndarray:
    joined = " ".join(words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    return Hashes(codes).of(starts, ends)


def stream(text: str, register: tuple[str, ...] = ()) -> Stream:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls, _ = _classes()
    k = cls[np.minimum(codes, 65535)] if len(codes) else np.zeros(0, np.int8)
    far = np.flatnonzero(codes > 65535)
    if len(far):
        k = k.copy()
        k[far] = [LETTER if chr(c).isalnum() else OTHER for c in codes[far].tolist()]
    before, after = np.concatenate([[-1], k[:-1]]), np.concatenate([k[1:], [-1]])
    grown = (k == DIGIT) | (k == LETTER)
    start = np.flatnonzero((k == LINE) | (k == OTHER) | (grown & (before != k)))
    end = np.flatnonzero((k == LINE) | (k == OTHER) | (grown & (after != k))) + 1
    h = Hashes(codes)
    word = h.of(start, end)
    # stretches between blanks, without the marks at their ends
    solid = (k != BLANK) & (k != LINE)
    cs = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    full = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
    ce, ca = full.copy(), cs.copy()
    if len(cs):
        mark = np.isin(codes, np.array([ord(c) for c in ".,;:!?>\"'”»"], np.uint32))
        lead = np.isin(codes, np.array([ord(c) for c in "<\"'“«"], np.uint32))
        for _ in range(3):
            ce = np.where((ce - ca > 1) & mark[ce - 1], ce - 1, ce)
            ca = np.where((ce - ca > 1) & lead[ca], ca + 1, ca)
    count = lambda m: np.concatenate([[0], np.cumsum(m)])
    digits, letters, ats = count(k == DIGIT), count(k == LETTER), count(codes == ord("@"))
    loose = count((k == OTHER) & ~np.isin(codes, np.array([ord(c) for c in "()+-./–‑"], np.uint32)))
    has = lambda c: c[ce] > c[ca]
    number = has(digits) & ~has(letters) & ~has(loose)
    # runs of numbers apart by one blank
    joins = np.zeros(len(cs), bool)
    if len(cs) > 1:
        joins[1:] = number[1:] & number[:-1] & (ca[1:] == full[:-1] + 1) & (k[full[:-1]] == BLANK) & (ce[:-1] == full[:-1]) & (ca[1:] == cs[1:])
    run_of = np.cumsum(~joins & number) - 1
    first = np.flatnonzero(~joins & number)
    last = np.flatnonzero(number & ~np.concatenate([joins[1:], [False]])) if len(cs) else first
    ra, rb = ca[first], ce[last]
    # hashes with digits made alike
    flat = codes.copy()
    flat[(k == DIGIT)] = ord("9")
    rough = flat.copy()
    for at in (ra, np.minimum(ra + 1, max(len(codes) - 1, 0))):
        zero = at[codes[at] == ord("0")] if len(codes) else at
        rough[zero] = ord("0")
    types = np.zeros(len(cs), np.int8)
    types[has(digits) & has(letters)] = 5
    types[number] = 4
    mail = np.flatnonzero(has(ats))
    for i in mail.tolist():
        s = text[ca[i] : ce[i]]
        at = s.find("@")
        types[i] = 1 if 0 < at and "." in s[at:] else types[i]
        if s[0] in "([":
            ca[i] += 1
    small = np.flatnonzero((ce - ca >= 4) & (ce - ca <= 5) & np.isin(codes[ca] if len(codes) else ca, np.array([ord(c) for c in "([{"], np.uint32)))
    for i in small.tolist():
        s = text[ca[i] : ce[i]].lower()
        types[i] = 2 if s in _AT else 3 if s in _DOT else types[i]
    beside = np.stack([np.concatenate([[0], types[:-1]]), types, np.concatenate([types[1:], [0]])], axis=1) if len(cs) else np.zeros((0, 3), np.int8)
    # of each word
    kind = k[start]
    chunk = np.searchsorted(cs, start, side="right") - 1
    chunk = np.where(kind == LINE, -1, chunk) if len(cs) else np.full(len(start), -1)
    c = np.maximum(chunk, 0)
    rich = (has(digits) | has(ats)) if len(cs) else np.zeros(0, bool)
    if len(cs):
        run = np.where((chunk >= 0) & number[c] & (start >= ca[c]) & (start < ce[c]), run_of[c], -1)
        flag = np.where((chunk >= 0)[:, None], beside[c], 0).astype(np.int8)
        flag[(chunk >= 0) & (start > ca[c]), 1] += TYPES // 2
    else:
        run, flag = np.full(len(start), -1), np.zeros((len(start), 3), np.int8)
    known = np.zeros(len(start), np.int8)
    for phrase in register:
        for p in {phrase, phrase.upper(), phrase.lower()}:
            hs = _hash_words(p.split())
            if len(hs) > len(word) or not len(hs):
                continue
            ok = np.ones(len(word) - len(hs) + 1, bool)
            for j, x in enumerate(hs):
                ok &= word[j : len(word) - len(hs) + 1 + j] == x
            at = np.flatnonzero(ok)
            for j in range(len(hs)):
                known[at + j] = 1
    return Stream(text, start, end, kind, word, chunk, ca, ce, Hashes(flat).of(ca, ce), rich, run, ra, rb, Hashes(rough).of(ra, rb), flag, known)


def cuts(s: Stream) -> np.ndarray:
    """Ends of the sequences: after line ends, where a sentence ends before a capital, and at the latest at LONGEST words."""
    n = len(s.start)
    if not n:
        return np.zeros(0, np.int64)
    t = s.text
    stop = s.kind == LINE
    dots = np.flatnonzero((s.kind == OTHER) & (s.end - s.start == 1))
    dots = dots[(dots > 0) & (dots + 1 < n)]
    dots = dots[(s.kind[dots - 1] == LETTER) & (s.end[dots - 1] - s.start[dots - 1] > 4) & (s.kind[np.minimum(dots + 1, n - 1)] == LETTER) & (s.start[np.minimum(dots + 1, n - 1)] > s.end[dots])]
    for i in dots.tolist():
        if t[s.start[i]] in ".!?" and t[s.start[i - 1]].islower() and t[s.start[i + 1]].isupper():
            stop[i] = True
    stop[-1] = True
    ends = np.flatnonzero(stop) + 1
    size = np.diff(np.concatenate([[0], ends]))
    if size.max() > LONGEST:
        ends = np.unique(np.concatenate([ends, *[np.arange(e - z + LONGEST, e, LONGEST) for e, z in zip(ends[size > LONGEST], size[size > LONGEST])]]))
    return ends


def leads(s: Stream) -> tuple[np.ndarray, np.ndarray]:
    """Words inside runs of numbers, and the first word of the run of each."""
    i = np.flatnonzero(s.run >= 0)
    return i, np.searchsorted(s.start, s.run_at[s.run[i]])


def _slot(f: str) -> int:
    return zlib.crc32(f.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _form(w: str) -> str:
    if w[0].isdecimal():
        return f"9{min(len(w), 6)}"
    if not w[0].isalnum():
        return w
    return "A" if len(w) == 1 and w.isupper() else "a" if len(w) == 1 else "AA" if w.isupper() else "Aa" if w[0].isupper() and w[1:].islower() else "aa" if w.islower() else "aA"


def word_features(w: str, lexicon: dict[str, int]) -> list[str]:
    """Form, spelling, beginning, ending, and how public vocabularies know the word."""
    shape = _form(w)
    if w[0].isdecimal():
        return [f"s{shape}"]
    if not w[0].isalnum():
        return [f"s{w}"]
    low = w.lower()
    v = lexicon.get(low, 0)
    return [f"s{shape}", f"w{low}", f"p{low[:3]}", f"b{low[:2]}", f"e{low[-3:]}", f"f{low[-4:]}", f"h{low[-2:]}", f"l{min(len(w), 9)}{shape}", f"v{v}", f"x{v}{shape}"]


_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def chunk_features(s: str) -> list[str]:
    """Form of a stretch with digits or an @: letters and digits as such, with and without their numbers."""
    if len(s) > 80:
        return ["c-long"]
    rough = _LETTERS.sub(lambda m: "A" if m[0].isupper() else "a", s)
    form = _DIGITS.sub(lambda m: "9" * min(len(m[0]), 12), rough)
    return [f"c{form}", f"k{_DIGITS.sub('9', rough)}", f"@{'@' in s}{len(_DIGITS.findall(s))}"]


def run_features(s: str) -> list[str]:
    """Form of a run of numbers: its groups, how many digits and groups there are, how it begins."""
    n, groups = sum(c.isdecimal() for c in s), _DIGITS.findall(s)
    lead = s[:2] if s[0] in "+(" else s[:1]
    lead = lead if s[0] == "0" or lead[-1:] == "0" else re.sub(r"\d", "9", lead)
    form = _DIGITS.sub(lambda m: "9" * min(len(m[0]), 12), s)
    marks = "".join(sorted(set(_DIGITS.sub("", s))))
    return [f"r{form[:40]}", f"t{min(n, 16)}", f"g{min(len(groups), 7)}{lead}", f"u{lead}{min(n, 16)}", f"m{marks}{min(n, 16)}", f"q{len(groups[0]) if groups else 0}.{len(groups[-1]) if groups else 0}{marks}"]


@lru_cache(maxsize=2)
def default_lexicon(folder: str | None = None) -> dict[str, int]:
    """How the public vocabularies know a word: 1 capitalised, 2 in lower case, 3 both, in the English one; times 4 in the
    one for many languages. Empty where the files are not there."""
    spec = importlib.util.find_spec("public_tokenizers")
    base = folder or (os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers")
    out: dict[str, int] = {}
    for name, unit in (("byte_bpe_50k.tiktoken", 1), ("byte_bpe_multi_50k.tiktoken", 4)):
        path = os.path.join(base, name)
        if not os.path.exists(path):
            continue
        with open(path, "rb") as f:
            for line in f:
                raw = base64.b64decode(line.split()[0]) if line.strip() else b""
                if raw[:1] != b" ":
                    continue
                try:
                    w = raw[1:].decode()
                except UnicodeDecodeError:
                    continue
                if len(w) > 1 and w.isalpha():
                    bit = unit * (2 if w.islower() else 1 if w[0].isupper() else 0)
                    out[w.lower()] = out.get(w.lower(), 0) | bit
    return out


class Crf:
    """Weights of hashed features (words by place -REACH..REACH, stretches and runs by whether the word begins them), of
    the flags of a stretch and those beside it, of registered words, and between labels."""

    def __init__(self, n: int = len(LABELS), lexicon: dict[str, int] | None = None) -> None:
        self.w = np.zeros((1 << BITS, n), np.float32)
        self.flag = np.zeros((3, TYPES, n), np.float32)
        self.known = np.zeros((2, n), np.float32)
        self.move = np.zeros((n, n), np.float32)
        self.lexicon = default_lexicon() if lexicon is None else lexicon
        self.forget()

    def forget(self) -> None:
        n = self.w.shape[1]
        self.seen: list[dict[int, int]] = [{}, {}, {}]
        self.table = [np.zeros((0, k, n), np.float32) for k in (len(PLACES), 2, 2)]

    def slots(self, which: int, s: str) -> list[list[int]]:
        """Slots of the features of a word (0) by place, of a stretch (1) or run (2) by whether the word begins it."""
        if which == 0:
            feats = word_features(s, self.lexicon)
            return [[_slot(f"{d}{f}") for f in feats] for d in PLACES]
        feats = (chunk_features if which == 1 else run_features)(s)
        return [[_slot(f"{b}{f}") for f in feats] for b in ("i", "b")]

    def rows(self, which: int, hashes: np.ndarray, text: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row of each stretch in the table of summed weights; each different one is looked at once."""
        if not len(hashes):
            return np.zeros(0, np.int64)
        uniq, at, inv = np.unique(hashes, return_index=True, return_inverse=True)
        seen = self.seen[which]
        if len(seen) > 400_000:
            seen.clear()
            self.table[which] = self.table[which][:0]
        ids, new = np.empty(len(uniq), np.int64), []
        for j, h in enumerate(uniq.tolist()):
            i = seen.get(h)
            if i is None:
                i = seen[h] = len(seen)
                new.append(at[j])
            ids[j] = i
        if new:
            slots = [self.slots(which, text[a[j] : b[j]]) for j in new]
            add = np.stack([np.stack([self.w[x].sum(axis=0) for x in s]) for s in slots])
            t = self.table[which]
            if len(seen) > len(t):
                grown = np.zeros((max(2 * len(t), len(seen), 4096), *t.shape[1:]), np.float32)
                grown[: len(t)] = t
                t = self.table[which] = grown
            t[len(seen) - len(new) : len(seen)] = add
        return ids[inv]

    def emissions(self, s: Stream) -> np.ndarray:
        """Score of every label at every word; words reach over sequence ends, as in training."""
        n = len(s.start)
        key = s.word.copy()
        number = s.kind == DIGIT
        key[number] = (s.end - s.start)[number].clip(max=6).astype(np.uint64)  # numbers tell nothing by value here
        rows = self.rows(0, key, s.text, s.start, s.end)
        words = self.table[0]
        out = words[rows, REACH].copy()
        for d in range(1, REACH + 1):
            out[: n - d] += words[rows[d:], REACH + d]
            out[d:] += words[rows[: n - d], REACH - d]
        i, lead = leads(s)
        for d in (1, 2):
            ok = lead >= d
            out[i[ok]] += words[rows[lead[ok] - d], 2 * REACH + d]
        for which, of, at, end, hashes, rich in ((1, s.chunk, s.chunk_at, s.chunk_end, s.chunk_hash, s.chunk_rich), (2, s.run, s.run_at, s.run_end, s.run_hash, None)):
            pick = np.arange(len(at)) if rich is None else np.flatnonzero(rich)
            row = np.full(len(at), -1)
            row[pick] = self.rows(which, hashes[pick], s.text, at[pick], end[pick])
            i = np.flatnonzero(of >= 0)
            i = i[row[of[i]] >= 0]
            first = (s.start[i] <= at[of[i]]).astype(np.int64)
            out[i] += self.table[which][row[of[i]], first]
        for j in range(3):
            out += self.flag[j, s.flag[:, j]]
        out += self.known[s.known]
        if s.known.any() and out.shape[1] == len(LABELS):  # what the register names is no person
            at = np.flatnonzero(s.known)
            out[at, CODE["B-N"]] = out[at, CODE["I-N"]] = -1e4
        return out

    def viterbi(self, scores: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Best labels of all sequences, longest first, one word of each at a time. Sequences whose best path is certain to
        be all outside (no run of other labels can gain more than it costs) are not decoded."""
        out = np.zeros(len(scores), np.int8)
        if not len(ends):
            return out
        starts = np.concatenate([[0], ends[:-1]])
        rest = self.move - self.move[0, 0]
        inner = max(float(rest[1:, 1:].max()), 0.0)
        gain = np.maximum(scores[:, 1:].max(axis=1) - scores[:, 0] + inner, 0)
        # a run costs its first and last step; at the ends of a sequence one of them may be missing
        edge = max(float(rest[0, 1:].max()), 0.0) + max(float(rest[1:, 0].max()), 0.0)
        middle = float(rest[0, 1:].max() + rest[1:, 0].max())
        inside = gain.copy()
        inside[starts] = 0
        inside[ends - 1] = 0
        at_edge = np.add.reduceat(gain, starts)
        live = (np.add.reduceat(inside, starts) + middle > 0) | ((gain[starts] > 0) | (gain[ends - 1] > 0)) & (at_edge + edge > 0)
        st, ln = starts[live], (ends - starts)[live]
        by = np.argsort(-ln, kind="stable")
        st, ln = st[by], ln[by]
        if not len(ln):
            return out
        back = np.zeros(scores.shape, np.int8)
        active = np.searchsorted(-ln, -np.arange(1, int(ln[0]) + 1), side="right")
        best = scores[st].copy()
        into = np.ascontiguousarray(self.move.T)
        for t in range(1, int(ln[0])):
            a = active[t]
            trial = best[:a, None, :] + into
            pick = trial.argmax(axis=2)
            back[st[:a] + t] = pick
            best[:a] = np.take_along_axis(trial, pick[:, :, None], 2)[:, :, 0] + scores[st[:a] + t]
        label = best.argmax(axis=1)
        for t in range(int(ln[0]) - 1, -1, -1):
            a = active[t]
            at = st[:a] + t
            out[at] = label[:a]
            label[:a] = back[at, label[:a]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _sparse(crf: Crf, s: Stream, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and slot of every feature of a text. drop: words whose spelling is withheld, so that form and place must do."""
    pos, slot, of_word = [], [], []
    for i, (a, b) in enumerate(zip(s.start.tolist(), s.end.tolist())):
        by_place = crf.slots(0, s.text[a:b])
        of_word.append(by_place)
        for d, slots in zip(range(-REACH, REACH + 1), by_place):
            j = i - d  # the word at j sees this one at place d
            if 0 <= j < len(s.start):
                keep = [x for f, x in enumerate(slots) if f not in (1, 2, 5)] if drop[i] and len(slots) > 5 else slots
                pos += [j] * len(keep)
                slot += keep
    for i, lead in zip(*(x.tolist() for x in leads(s))):
        for d in (1, 2):
            if lead >= d:
                got = of_word[lead - d][2 * REACH + d]
                pos += [i] * len(got)
                slot += got
    for which, of, at, end, rich in ((1, s.chunk, s.chunk_at, s.chunk_end, s.chunk_rich), (2, s.run, s.run_at, s.run_end, None)):
        for i, c in enumerate(of.tolist()):
            if c >= 0 and (rich is None or rich[c]):
                got = crf.slots(which, s.text[at[c] : end[c]])[int(s.start[i] <= at[c])]
                pos += [i] * len(got)
                slot += got
    return np.array(pos, np.int64), np.array(slot, np.int64)


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 7, batch: int = 128, rate: float = 0.22, seed: int = 3, register: tuple[str, ...] = REGISTER, decay: float = 0.02, lexicon: dict[str, int] | None = None) -> Crf:
    """Maximum likelihood by AdaGrad over mini-batches; gradients from the forward-backward recursion."""
    n = len(LABELS)
    crf = Crf(lexicon=lexicon)
    crf.slots = lru_cache(maxsize=None)(crf.slots)
    rng = np.random.default_rng(seed)
    data = []
    for text, spans in rows:
        s = stream(text, register)
        if not len(s.start):
            continue
        y = np.zeros(len(s.start), np.int64)
        for a, b, kind in spans:
            i, j = np.searchsorted(s.start, a), np.searchsorted(s.start, b)
            y[i:j] = CODE[f"I-{kind}"]
            y[i] = CODE[f"B-{kind}"]
        data.append((*_sparse(crf, s, rng.random(len(y)) < 0.15), s.flag, s.known, y))
    acc = [np.full_like(x, 1e-3) for x in (crf.w, crf.flag, crf.known, crf.move)]
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for k in range(0, len(order), batch):
            part = sorted((data[i] for i in order[k : k + batch]), key=lambda d: -len(d[4]))
            size, longest = len(part), len(part[0][4])
            length = np.array([len(p[4]) for p in part])
            live = np.arange(longest) < length[:, None]
            y = np.zeros((size, longest), np.int64)
            flags = np.zeros((size, longest, 3), np.int64)
            known = np.zeros((size, longest), np.int64)
            for i, (_, _, f, kn, label) in enumerate(part):
                y[i, : len(label)], flags[i, : len(label)], known[i, : len(label)] = label, f, kn
            flat = np.concatenate([d[0] + i * longest for i, d in enumerate(part)])
            slot = np.concatenate([d[1] for d in part])
            order_ = np.argsort(flat, kind="stable")
            flat, slot = flat[order_], slot[order_]
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            x = np.zeros((size * longest, n))
            x[flat[first]] = np.add.reduceat(crf.w[slot], first, axis=0)
            x = x.reshape(size, longest, n)
            for j in range(3):
                x += crf.flag[j, flags[:, :, j]]
            x += crf.known[known]
            move = crf.move.astype(float)
            emove, top = np.exp(move - move.max()), move.max()
            alpha, beta = np.zeros_like(x), np.zeros_like(x)
            alpha[:, 0] = x[:, 0]
            for t in range(1, longest):
                m = alpha[:, t - 1].max(axis=1, keepdims=True)
                step = np.log(np.exp(alpha[:, t - 1] - m) @ emove + 1e-300) + m + top + x[:, t]
                alpha[:, t] = np.where(live[:, t, None], step, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                q = x[:, t + 1] + beta[:, t + 1]
                m = q.max(axis=1, keepdims=True)
                beta[:, t] = np.where(live[:, t + 1, None], np.log(np.exp(q - m) @ emove.T + 1e-300) + m + top, 0.0)
            z = _log_sum(alpha[:, -1], 1)
            g = -np.exp(alpha + beta - z[:, None, None]) * live[..., None]
            i, t = np.nonzero(live)
            g[i, t, y[i, t]] += 1
            left = np.exp(alpha[:, :-1] - alpha[:, :-1].max(axis=2, keepdims=True))
            q = x[:, 1:] + beta[:, 1:]
            right = np.exp(q - q.max(axis=2, keepdims=True))
            scale = np.exp(alpha[:, :-1].max(axis=2) + q.max(axis=2) - z[:, None] + top) * live[:, 1:]
            gm = -np.einsum("bti,btj,bt->ij", left, right, scale, optimize=True) * emove
            np.add.at(gm, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
            used, inv = np.unique(slot, return_inverse=True)
            by = np.argsort(inv, kind="stable")
            edge = np.searchsorted(inv[by], np.arange(len(used)))
            gw = np.add.reduceat(g.reshape(-1, n)[flat[by]], edge, axis=0) - decay * crf.w[used]
            acc[0][used] += gw**2
            crf.w[used] += rate * gw / np.sqrt(acc[0][used])
            gflag = np.zeros(crf.flag.shape)
            for j in range(3):
                for v in range(TYPES):
                    gflag[j, v] = g[(flags[:, :, j] == v) & live].sum(axis=0)
            gknown = np.stack([g[(known == v) & live].sum(axis=0) for v in range(2)])
            for a, w, grad in ((acc[1], crf.flag, gflag), (acc[2], crf.known, gknown), (acc[3], crf.move, gm)):
                a += grad**2
                w += (rate * grad / np.sqrt(a)).astype(np.float32)
    del crf.slots
    crf.forget()
    return crf


#: Weights of the model trained from the labelled table, written by ``python -m tideglass.llm.pii``.
WEIGHTS = Path(__file__).with_name("pii_weights.npz")


def trained() -> Crf:
    """The model of the labelled table, trained anew (some two minutes)."""
    lexicon = default_lexicon()
    return train(labelled(words=common_words(lexicon)), lexicon=lexicon)


@lru_cache(maxsize=1)
def default_model() -> Crf:
    """The model of the labelled table: its stored weights, or trained anew where they are not there."""
    if not WEIGHTS.exists():
        return trained()
    with np.load(WEIGHTS) as z:
        return expand({**{k: z[k].astype(np.float32) for k in ("w", "flag", "known", "move")}, "slot": z["slot"], "lexicon": default_lexicon()})


def store(crf: Crf, path: Path = WEIGHTS) -> None:
    """Weights in half precision, the smallest left out."""
    x = compact(crf)
    keep = np.abs(x["w"]).max(axis=1) > 0.02
    np.savez_compressed(path, slot=x["slot"][keep], w=x["w"][keep].astype(np.float16), flag=x["flag"], known=x["known"], move=x["move"])


def common_words(lexicon: dict[str, int]) -> list[str]:
    """Words that the public vocabularies have in lower case, in order of the alphabet."""
    return sorted(w for w, v in lexicon.items() if v & 10 and len(w) > 2)


def compact(crf: Crf) -> dict:
    """The weights that are not zero and the lexicon, to send to the workers."""
    slot = np.flatnonzero(np.abs(crf.w).max(axis=1))
    return {"slot": slot.astype(np.int32), "w": crf.w[slot], "flag": crf.flag, "known": crf.known, "move": crf.move, "lexicon": crf.lexicon}


def expand(x: dict) -> Crf:
    crf = Crf(len(x["move"]), x["lexicon"])
    crf.w[x["slot"]] = x["w"]
    crf.flag, crf.known, crf.move = x["flag"], x["known"], x["move"]
    return crf


def _trim(kind: str, text: str, words: list[tuple[int, int]]) -> tuple[int, int] | None:
    """Characters of a labelled stretch without what does not belong to it; None if it cannot be one of its kind."""
    w = [(a, b, text[a:b]) for a, b in words]
    if kind == "N":
        stop = [i for i in range(1, len(w) - 1) if w[i][2] == "." and len(w[i - 1][2]) > 2 and w[i - 1][2].lower() not in TITLES]
        if stop:  # a full stop after a whole word ends a name
            w = max((w[a:b] for a, b in zip([0, *[i + 1 for i in stop]], [*stop, len(w)])), key=len)
        while w and (not w[0][2][0].isalpha() or w[0][2].lower() in TITLES):
            w.pop(0)
        while w and not (w[-1][2][0].isalpha() or w[-1][2] == "." and len(w) > 1 and len(w[-2][2]) == 1):
            w.pop()
        # a single letter is an initial with its dot, or as a capital that is no word by itself
        parts = [x for i, (_, _, x) in enumerate(w) if x[0].isalpha() and (len(x) > 1 or w[i + 1 : i + 2] and w[i + 1][2] == "." or x.isupper() and x not in "AIOY")]
        if len(parts) < 2 or max(map(len, parts)) < 2:
            return None
        if w[-1][2] == "." and len(parts[-1]) == 1 and not any(x == "," for _, _, x in w):
            w.pop()
    else:
        while kind == "E" and w and w[0][0] and (text[w[0][0] - 1].isalnum() or text[w[0][0] - 1] in "._+-"):
            w.insert(0, (w[0][0] - 1, w[0][0], text[w[0][0] - 1]))  # the rest of the local part
        opening = "+(" if kind == "P" else ""
        while w and not (w[0][2][0].isalnum() or w[0][2] in opening and w[0][2]):
            w.pop(0)
        while w and not w[-1][2][0].isalnum() and w[-1][2] not in ")":
            w.pop()
        inside = "".join(x for _, _, x in w)
        n = sum(c.isdecimal() for c in inside)
        if kind == "P" and n < 6 or kind == "D" and n < 6 or kind == "A" and (n < 1 or len(w) < 2) or kind == "E" and not ("@" in inside or "at" in inside.lower()):
            return None
    return (w[0][0], w[-1][1]) if w else None


def find_spans(crf: Crf, texts: list[str], register: tuple[str, ...] = ()) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of every text, in order and without overlap."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    joined = "\n".join(texts) + "\n"
    s = stream(joined, register)
    if not len(s.start):
        return out
    y = crf.viterbi(crf.emissions(s), cuts(s))
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    hit = np.flatnonzero(y)
    if not len(hit):
        return out
    doc = np.searchsorted(begin, s.start[hit], side="right") - 1
    kind, first = (y[hit] + 1) // 2, y[hit] % 2 == 1
    new = np.concatenate([[True], (np.diff(hit) > 1) | first[1:] | (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])])
    edges = np.append(np.flatnonzero(new), len(hit))
    names = list(KINDS)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        k = names[kind[a] - 1]
        got = _trim(k, joined, list(zip(s.start[hit[a:b]].tolist(), s.end[hit[a:b]].tolist())))
        if got:
            d = int(doc[a])
            out[d].append((got[0] - int(begin[d]), got[1] - int(begin[d]), k))
    return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for lo, hi, k in spans:
        parts += [text[at:lo], PLACE[k]]
        at = hi
    return "".join([*parts, text[at:]])


def _run(df: DataFrame, id_col: str, text_col: str, model: Crf | None, want_text: bool, register: tuple[str, ...]) -> DataFrame:
    kind = dict(df.select(F.col(id_col).alias("id")).dtypes)["id"]
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    held = df.sparkSession.sparkContext.broadcast(compact(model or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = expand(held.value)
        for whole in batches:
            every = whole["t"].to_pylist()
            for lo, hi in by_chars(every):
                texts, ids = every[lo:hi], whole["id"].slice(lo, hi - lo)
                spans = find_spans(crf, texts, register)
                if want_text:
                    yield pa.RecordBatch.from_arrays([ids, pa.array([redacted(t, s) for t, s in zip(texts, spans)], pa.string()), pa.array([len(s) for s in spans], pa.int32())], names=["id", "text", "spans"])
                    continue
                row = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
                flat = [x for s in spans for x in s]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array([KINDS[k] for _, _, k in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int64()), pa.array([b for _, b, _ in flat], pa.int64())], names=["id", "kind", "start_pos", "end_pos"])

    schema = f"id {kind}, text string, spans int" if want_text else f"id {kind}, kind string, start_pos long, end_pos long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def find_personal(df: DataFrame, id_col: str, text_col: str, model: Crf | None = None, register: tuple[str, ...] = ()) -> DataFrame:
    """id, kind, start_pos, end_pos: every occurrence of personal information, by character positions (end excluded).

    register: names of projects, desks and the like, which read as names of persons do but are none; words of theirs are
    shown to the model as such. Null ids and texts are left out, an empty text has none; repeated rows give their spans
    again. Texts are read whole: long ones are cut into sequences at line and sentence ends. Nothing is shuffled. Other
    columns are ignored.
    """
    return _run(df, id_col, text_col, model, False, register)


def redact(df: DataFrame, id_col: str, text_col: str, model: Crf | None = None, register: tuple[str, ...] = ()) -> DataFrame:
    """id, text, spans: the text with typed placeholders in place of what find_personal finds, and how many there are."""
    return _run(df, id_col, text_col, model, True, register)


if __name__ == "__main__":
    store(trained())
