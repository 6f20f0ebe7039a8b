"""Deeply nested records to related flat tables: path-value-ordinal triples, grouped by repeated ancestor, then pivoted."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLES = "doc long, grp string, node string, parent string, ord int, name string, value string, kind string"


@dataclass(frozen=True)
class NestConfig:
    """keyed: objects under these names that hold objects only are lists under keys of their own. refs: names of which the
    first that is there is an object's reference, by the name of the list it stands in ('' for any)."""

    keyed: tuple[str, ...] = ("markets",)
    refs: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"markets": ("ticker", "id"), "": ("event_ticker", "id")})


_SPACE = json.decoder.WHITESPACE.match
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?").match
_MARKS = re.compile(r'["{}\[\]]').search
_NAMES = {"true": "bool", "false": "bool", "null": None, "NaN": "number", "Infinity": "number", "-Infinity": "number"}


def _path_name(k: str) -> str:
    """A name as part of a path: what paths are made of is escaped in it."""
    return re.sub(r"([.\[\]\\])", r"\\\1", k) if "." in k or "[" in k or "]" in k or "\\" in k else k


def _skip(s: str, at: int) -> int:
    """End of the object, list or string that begins there."""
    depth = 0
    while True:
        m = _MARKS(s, at)
        if m is None:
            raise ValueError("not closed")
        c, at = m[0], m.end()
        if c == '"':
            at = scanstring(s, at)[1]
        else:
            depth += 1 if c in "{[" else -1
        if depth <= 0:
            return at


_OPENING = frozenset('{["')


class _Wanted(dict):
    """Whether a group is asked for, by the names its lists may have; each group is looked at once."""

    def __init__(self, tails: tuple[str, ...] | None) -> None:
        self.tails = tails

    def __missing__(self, grp: str) -> bool:
        self[grp] = out = self.tails is None or grp.endswith(self.tails)
        return out


class _Reader:
    """Reads one record token by token and keeps triples, with a stack of what is open; no tree of it is built."""

    def __init__(self, cfg: NestConfig, tails: tuple[str, ...] | None = None) -> None:
        self.cfg = cfg
        self.wanted = _Wanted(tails)
        self.rows: list[tuple] = []
        self.nodes: list[tuple] = []  # node, parent, group, ordinal, names that may be its reference, their values (None: no object)

    def _key(self, s: str, at: int) -> tuple[str, int]:
        if s[at : at + 1] != '"':
            raise ValueError("no key")
        k, at = scanstring(s, at + 1)
        at = _SPACE(s, at).end()
        if s[at : at + 1] != ":":
            raise ValueError("no colon")
        return k, _SPACE(s, at + 1).end()

    def _keyed(self, s: str, at: int) -> bool:
        """Whether the object that begins before ``at`` holds objects (or null) only, none under a reference's name."""
        some = False
        while s[at : at + 1] == '"':
            k, at = self._key(s, at)
            if k in ("id", "ticker"):
                return False
            if s.startswith("null", at):
                at += 4
            elif s[at : at + 1] == "{":
                at = _skip(s, at)
            else:
                return False
            some, at = True, _SPACE(s, at).end()
            at = _SPACE(s, at + 1).end() if s[at : at + 1] == "," else at
        return some

    def read(self, s: str, key: str, grp: str, node: str, parent: str | None, ordinal: int, name: str) -> None:
        """One whole JSON text whose value stands at that place; ValueError if it is not complete."""
        wanted, keep = self.wanted, self.rows.append
        new = False  # whether the value to come is an item of a list, which makes a node of its own unless it is null
        stack: list[list] = []
        at = _SPACE(s, 0).end()
        while True:
            c = s[at : at + 1]
            if new and not s.startswith("null", at):
                if wanted[grp]:
                    keep((grp, node, parent, ordinal, "", None, "node"))
                if c != "{":
                    self.nodes.append((node, parent, grp, ordinal, (), None))
            if c == "{" or c == "[":
                at = _SPACE(s, at + 1).end()
                listed = c == "[" or key in self.cfg.keyed and self._keyed(s, at)
                if listed:
                    frame = ["]" if c == "[" else "}", True, key, f"{grp}.{name}[]" if name else f"{grp}[]", node, f"{node}.{name}" if name else node, -1]
                else:
                    values = None
                    if not name:
                        values = {}
                        self.nodes.append((node, parent, grp, ordinal, self.cfg.refs.get(key, self.cfg.refs[""]), values))
                    frame = ["}", False, values, grp, node, parent, ordinal, name]
                if s[at : at + 1] == frame[0]:
                    at += 1
                else:
                    stack.append(frame)
                    key, grp, node, parent, ordinal, name, new, at = self._next(s, at, frame, c == "{")
                    continue
            elif c == '"':
                text, at = scanstring(s, at + 1)
                if stack and not stack[-1][1] and stack[-1][2] is not None:
                    stack[-1][2][key] = text
                if text[:1] not in _OPENING or not self._embedded(text, key, grp, node, parent, ordinal, name):
                    if wanted[grp]:
                        keep((grp, node, parent, ordinal, name or "value", text, "string"))
            else:
                m = _NUMBER(s, at)
                if m is not None:
                    whole = m[2] is None and m[3] is None
                    text, kind, at = m[0] if whole else json.dumps(float(m[0])), "number", m.end()
                    if whole and stack and not stack[-1][1] and stack[-1][2] is not None:
                        stack[-1][2][key] = text
                else:
                    text = next((x for x in _NAMES if s.startswith(x, at)), None)
                    if text is None:
                        raise ValueError("no value")
                    kind, at = _NAMES[text], at + len(text)
                if kind and wanted[grp]:
                    keep((grp, node, parent, ordinal, name or "value", text, kind))
            while True:  # a value is complete, and with it perhaps what it stands in
                at = _SPACE(s, at).end()
                if not stack:
                    if at < len(s):
                        raise ValueError("text after the record")
                    return
                frame, c = stack[-1], s[at : at + 1]
                if c == ",":
                    key, grp, node, parent, ordinal, name, new, at = self._next(s, _SPACE(s, at + 1).end(), frame, frame[0] == "}")
                    break
                if c != frame[0]:
                    raise ValueError("not closed")
                stack.pop()
                at += 1

    def _next(self, s: str, at: int, frame: list, named: bool) -> tuple:
        """Place of the next member or item of what is open, and where its text begins."""
        k = None
        if named:
            k, at = self._key(s, at)
        if frame[1]:
            _, _, key, sub, node, base, i = frame
            frame[6] = i = i + 1
            return key, sub, f"{base}[{i}]", node, i, "", True, at
        _, _, _, grp, node, parent, ordinal, name = frame
        return k, grp, node, parent, ordinal, f"{name}.{_path_name(k)}" if name else _path_name(k), False, at

    def _embedded(self, text: str, key: str, grp: str, node: str, parent: str | None, ordinal: int, name: str) -> bool:
        """Take a string apart that is JSON itself. True if its triples say all: of a list of plain values the text stays too."""
        rows, nodes = len(self.rows), len(self.nodes)
        if text[0] == "[" and text.rstrip()[-1:] != "]" or text[0] == "{" and text.rstrip()[-1:] != "}":
            return False
        try:
            self.read(text, key, grp, node, parent, ordinal, name)
        except ValueError:
            del self.rows[rows:], self.nodes[nodes:]
            return False
        if text[0] == "[" and not any(n[5] is not None for n in self.nodes[nodes:]):
            return False
        return len(self.rows) > rows or len(self.nodes) > nodes


def triples(doc: int, record: str, cfg: NestConfig, emit, tails: tuple[str, ...] | None = None) -> None:
    """Emit (doc, grp, node, parent, ord, name, value, kind) for every leaf of a record, and a row of kind 'node' for
    every object or item of a repeated list. The record is read token by token, what is open waits on a stack, and no tree
    is built: depth is bounded by memory alone (paths grow with it). A record that breaks off gives nothing.

    grp: path with ordinals left out, down to the nearest repeated ancestor. node, parent: paths with ordinals of that
    ancestor and of the one above it. ord: place in its list. name: path of the leaf below the node; dots, brackets and
    backslashes in names are escaped by a backslash. Of equal names in an object every value gives a triple; as reference
    the last holds. tails: endings of the groups asked for. The reference of the nearest ancestor object that has one comes with every node as '^ref'.
    """
    r = _Reader(cfg, tails)
    if r.wanted["$"]:
        r.rows.append(("$", "$", None, 0, "", None, "node"))
    try:
        r.read(record, "", "$", "$", None, 0, "")
    except ValueError:
        return
    if not r.nodes:
        return  # a mere text or number
    for row in r.rows:
        emit(doc, *row)
    known: dict[str | None, str | None] = {None: None}
    for node, parent, grp, ordinal, names, values in r.nodes:
        above = known.get(parent)
        mine = next((values[n] for n in names if n in values), None) if values is not None else None
        if values is not None and above is not None and r.wanted[grp]:
            emit(doc, grp, node, parent, ordinal, "^ref", above, "ref")
        if mine is not None and r.wanted[grp]:
            emit(doc, grp, node, parent, ordinal, "ref", mine, "ref")
        known[node] = mine if mine is not None else known.get(node) or above


def to_triples(df: DataFrame, id_col: str, text_col: str, cfg: NestConfig = NestConfig(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """The triples of all records. keep: only groups whose last repeated ancestor has one of these names.

    Null ids and null, broken, incomplete or empty texts give none; text that is JSON within a JSON string is taken
    apart too (also whole records). A repeated record gives its triples again; pivots and references count them once.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t"))
    schema = pa.schema([("doc", pa.int64()), ("grp", pa.string()), ("node", pa.string()), ("parent", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("value", pa.string()), ("kind", pa.string())])
    tails = tuple(f"{k}[]" for k in keep) if keep else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []

            def emit(*row) -> None:
                out.append(row)

            for doc, t in zip(b["doc"].to_pylist(), b["t"].to_pylist()):
                triples(doc, t, cfg, emit, tails)
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, TRIPLES)


def list_name(grp: str) -> Column:
    """Name of the list that the nodes of a group stand in; empty for records themselves and lists without a name."""
    return F.regexp_extract(grp, r"(?:^|[.$])([^.$\[\]]*)(?:\[\])+$", 1)


def pivot_group(t: DataFrame, last: tuple[str, ...], columns: dict[str, str]) -> DataFrame:
    """One flat table of the nodes whose list has one of these names: doc, node, parent, ord and the given columns.

    columns: output name -> leaf name ('ref' the node's own reference, '^ref' that of the nearest ancestor with one).
    Optional fields that are missing are null; of a field that occurs twice the larger text holds.
    """
    mine = t.where(list_name("grp").isin(*last))
    value = [F.max(F.when(F.col("name") == leaf, F.col("value"))).alias(out) for out, leaf in columns.items()]
    return mine.groupBy("doc", "node").agg(F.max("parent").alias("parent"), F.max("ord").alias("ord"), F.max("grp").alias("grp"), *value)


def market_refs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, event_ref, market_ref: each distinct market object with the nearest event above it."""
    t = to_triples(df, id_col, text_col, keep=("markets",))
    m = pivot_group(t, ("markets",), {"event_ref": "^ref", "market_ref": "ref"})
    return m.where(F.col("market_ref").isNotNull() & F.col("event_ref").isNotNull()).select("doc", "event_ref", "market_ref").distinct()
