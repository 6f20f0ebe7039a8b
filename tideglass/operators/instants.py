"""Mixed timestamp texts to one UTC instant: parse, choose the offset history, convert."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.session import stored

# US and European zone abbreviations, minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
#: US abbreviations that leave open whether daylight-saving time holds.
GENERAL = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles"}
MONTHS = {m: i + 1 for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}
EPOCH = datetime(1970, 1, 1)
#: Epoch seconds of the century that bare digits must fall into.
CENTURY = (946_684_800, 4_102_444_800)

_TIME = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?\s*(?P<ap>[ap]\.?m\.?(?![a-z]))?"
_DATES = [
    r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})",
    r"(?P<y>\d{4})/(?P<m>\d{1,2})/(?P<d>\d{1,2})",
    r"(?P<y>\d{4})\.(?P<m>\d{1,2})\.(?P<d>\d{1,2})",
    r"(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4})",
    r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4})",
    r"(?:[a-z]{3,9}\.?,?\s+)?(?P<d>\d{1,2})(?:st|nd|rd|th)?[\s-]+(?P<b>[a-z]{3,9})\.?,?[\s-]+(?P<y>\d{4})",
    r"(?:[a-z]{3,9}\.?,\s+)?(?P<b>[a-z]{3,9})\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})",
]
_ZONE = r"\s*(?:(?P<z>[a-z]{1,4})|(?:(?:utc|gmt)\s*)?(?P<o>[+\-−]\d{2}:?(?:\d{2})?)|\[?(?P<n>[a-z]+(?:/[a-z0-9_+\-]+){1,2})\]?)"
_FORMS = [re.compile(rf"{d}(?:(?:\s*t\s*|,?\s+(?:at\s+)?){_TIME}(?:{_ZONE})?)?", re.I | re.A) for d in _DATES]
_PACKED = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:t?(?P<H>\d{2})(?P<M>\d{2})(?:(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?" + rf"(?:{_ZONE})?)?", re.I | re.A)
_DIGITS = re.compile(r"(-?\d{1,20})(?:\.(\d+))?", re.A)


@lru_cache(maxsize=256)
def zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - any unknown or malformed name
        return None


def wall_to_utc(wall_us: int, name: str) -> int | None:
    """UTC microseconds of a wall time: the first of two, or moved forward by the hour that is skipped."""
    z = zone(name)
    if z is None:
        return None
    sec, us = divmod(wall_us, 1_000_000)
    try:
        off = (EPOCH + timedelta(seconds=sec)).replace(tzinfo=z).utcoffset()
    except (OverflowError, ValueError):
        return None
    return wall_us - round(off.total_seconds() * 1e6)


def _from_parts(g: dict[str, str | None]) -> tuple[int, bool, int | None, str | None] | None:
    """Wall microseconds, whether the text has a time, offset in minutes, zone name; None if impossible."""
    month = MONTHS.get(g["b"][:3].lower()) if g.get("b") else int(g["m"])
    if month is None:
        return None
    hour, minute, second = int(g["H"] or 0), int(g["M"] or 0), int(g["S"] or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g["ap"][0].lower() == "p" else 0)
    offset = name = None
    if g["z"]:
        offset, name = ABBREVIATIONS.get(g["z"].upper()), GENERAL.get(g["z"].upper())
        if offset is None and name is None:
            return None
    elif g["o"]:
        o = g["o"].replace(":", "")
        offset = (int(o[1:3]) * 60 + int(o[3:5] or 0)) * (1 if o[0] == "+" else -1)
        if abs(offset) > 18 * 60 or int(o[3:5] or 0) > 59:
            return None
    elif g["n"]:
        name = g["n"]
        if zone(name) is None:
            return None
    try:
        day = datetime(int(g["y"]), month, int(g["d"]))
        if hour == 24 and minute == second == 0:
            day, hour = day + timedelta(days=1), 0
        wall = day.replace(hour=hour, minute=minute, second=min(second, 59) if second == 60 else second)
    except (ValueError, OverflowError):
        return None
    us = int((wall - EPOCH) / timedelta(seconds=1)) * 1_000_000 + (1_000_000 if second == 60 else 0)
    return us + int(((g["f"] or "") + "000000")[:6]), g["H"] is not None, offset, name


@lru_cache(maxsize=100_000)
def parse(text: str) -> tuple[int, bool, int | None, str | None] | None:
    """(microseconds, has a time, offset minutes, zone name) of one text; offset 0 for epochs; None if no instant."""
    s = text.strip().strip("\"'").strip()
    if not s or len(s) > 80:
        return None
    d = _DIGITS.fullmatch(s)
    if d:
        whole, frac = int(d[1]), d[2] or ""
        for unit in (1, 1_000, 1_000_000, 1_000_000_000):
            if CENTURY[0] * unit <= whole < CENTURY[1] * unit:
                return int(d[1] + frac) * 1_000_000 // (unit * 10 ** len(frac)), True, 0, None
        if frac or len(d[1]) not in (8, 12, 14):
            return None
    for form in (*_FORMS, _PACKED):
        m = form.fullmatch(s)
        if m:
            g = m.groupdict()
            return _from_parts({k: g.get(k) for k in ("y", "m", "d", "b", "H", "M", "S", "f", "ap", "z", "o", "n")})
    return None


@lru_cache(maxsize=4096)
def parse_time(text: str | None) -> int | None:
    """Microseconds of day of a time text such as 14:00 or 2:00 PM."""
    m = re.fullmatch(_TIME, (text or "").strip(), re.I | re.A)
    got = _from_parts({"y": "1970", "m": "1", "d": "1", "b": None, "z": None, "o": None, "n": None, **m.groupdict()}) if m else None
    return got[0] if got else None


def best_zone(wall_us: np.ndarray, seen_us: np.ndarray | None, candidates: list[str], slack_us: int = 0) -> str:
    """The candidate whose offset history has the fewest violations; of equals the one with the least median delay.

    Without instants of sight the sequence counts instead: a violation is a time before that of the row before it.
    """
    if len(candidates) == 1 or not len(wall_us):
        return candidates[0]
    scores = []
    for k, name in enumerate(candidates):
        utc = np.array([x if (x := wall_to_utc(int(w), name)) is not None else np.nan for w in wall_us], dtype="float64")
        if seen_us is None:
            scores.append((int(np.sum(np.diff(utc) < -slack_us)), 0.0, k))
        else:
            scores.append((int(np.sum(utc > seen_us + slack_us)), float(np.nanmedian(seen_us - utc)), k))
    return candidates[min(scores)[2]]


def estimate_zones(df: DataFrame, source: str, text: str, seen: str, candidates: list[str], slack_s: int = 0) -> DataFrame:
    """source, zone, violations, values: per source of zone-less texts the offset history that fits the ingestion times.

    Every row scores every candidate where it lies, the scores (counts and a histogram of delays by quarter of an hour)
    are summed map-side per source, and the candidate with the fewest violations is taken; ties go to the least
    median delay, then to the order of the candidates. Rows without a parsable wall time or of null ``seen`` have no say.
    """
    slack = slack_s * 1_000_000
    rows = df.where(F.col(source).isNotNull() & F.col(text).isNotNull() & F.col(seen).isNotNull()).select(F.col(source).cast("string").alias("s"), F.col(text).cast("string").alias("t"), F.unix_micros(seen).alias("u"))

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for s, t, u in zip(pdf["s"], pdf["t"], pdf["u"]):
                p = parse(t)
                if p is None or not p[1] or p[2] is not None or p[3] is not None:
                    continue
                for k, name in enumerate(candidates):
                    utc = wall_to_utc(p[0], name)
                    if utc is not None:
                        out.append((s, k, (u - utc) // 900_000_000, int(utc > u + slack)))
            yield pd.DataFrame(out, columns=["s", "k", "delay", "late"]).groupby(["s", "k", "delay"], as_index=False).agg(late=("late", "sum"), n=("late", "size"))

    hist = rows.mapInPandas(score, "s string, k int, delay long, late long, n long").groupBy("s", "k", "delay").agg(F.sum("late").alias("late"), F.sum("n").alias("n"))
    per = hist.groupBy("s", "k").agg(F.sum("late").alias("late"), F.sum("n").alias("n"), F.expr("percentile(delay, 0.5, n)").alias("delay"))
    best = per.groupBy("s").agg(F.min(F.struct("late", "delay", "k", "n")).alias("b"))
    return best.select(F.col("s").alias(source), F.array(*map(F.lit, candidates))[F.col("b.k")].alias("zone"), F.col("b.late").alias("violations"), F.col("b.n").alias("values"))


PARSED = "array<struct<field:string,text:string,wall:bigint,offset:int,own:string>>"


def _utc(wall: Column, offset: Column, zone_name: Column) -> Column:
    """UTC microseconds of a wall time with an offset in minutes, else in a zone: the first of two, a skipped one moved on."""
    return F.when(offset.isNotNull(), wall - offset.cast("long") * 60_000_000).otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone_name)))


def _by_order(parsed: DataFrame, order: list[tuple[str, str]], default_zone: str, least: float) -> dict[str | None, str]:
    """Stated zone (None: none) -> the offset history with the fewest violations of the order of a row's instants.

    Of each pair (earlier field, later field) with one text whose instant is fixed and one without a zone, every candidate
    (the zones that are stated anywhere, and the default) is tried: a violation is an earlier field after the later one.
    Counts are summed map-side. The stated zone is the prior: another one is taken only if it saves more than ``least`` of
    the comparisons and four standard deviations of their count.
    """
    stated = [r["z"] for r in parsed.groupBy("z").count().collect()]  # at most as many as there are zones
    names = sorted({default_zone, *[z for z in stated if z]})
    tries = F.explode(F.array(*map(F.lit, names))).alias("c")
    got = None
    for early, late in order:
        pick = lambda f: F.get(F.filter("ps", lambda p: p["field"] == f), F.lit(0))
        pair = parsed.select("z", pick(early).alias("a"), pick(late).alias("b"))
        fixed = lambda p: F.col(f"{p}.offset").isNotNull() | F.col(f"{p}.own").isNotNull()
        pair = pair.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (fixed("a") != fixed("b"))).select("z", "a", "b", tries)
        at = lambda p: _utc(F.col(f"{p}.wall"), F.col(f"{p}.offset"), F.coalesce(F.col(f"{p}.own"), F.col("c")))
        one = pair.groupBy("z", "c").agg(F.sum((at("a") > at("b")).cast("long")).alias("bad"), F.count(F.lit(1)).alias("n"))
        got = one if got is None else got.unionByName(one)
    score = {(r["z"], r["c"]): (r["bad"], r["n"]) for r in got.groupBy("z", "c").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).collect()}
    out: dict[str | None, str] = {}
    for z in [None, *[z for z in stated if z]]:
        prior = z or default_zone
        bad, n = score.get((z, prior), (0, 0))
        best = min(names, key=lambda c: (score.get((z, c), (bad, n))[0], c != prior))
        saved = bad - score.get((z, best), (bad, n))[0]
        out[z] = best if saved > max(least * n, 4 * n**0.5) else prior
    return out


def to_instants(df: DataFrame, id_col: str, texts: list[str], zone_col: str | None = None, default_zone: str = "UTC", time_col: str | None = None, default_time: str = "00:00", zones: DataFrame | None = None, source: str | None = None, order: list[tuple[str, str]] | None = None, least: float = 0.02) -> DataFrame:
    """id, field, text, utc_us, zone: every text that denotes an instant, with it in epoch microseconds (finer digits cut).

    A zone, offset or abbreviation in the text wins; else zone_col; else the zone estimated for the row's source
    (``zones`` as estimate_zones gives it); else default_zone. ``order``: pairs of texts of a row of which the first should
    not be later; the offset history of each stated zone (and of rows without one) is then estimated by the fewest
    violations of it, with the stated zone (default_zone) as prior that gives way only to evidence (see _by_order). With
    slashes the month comes first unless the year leads, with dots the day. Bare digits are an epoch in the unit that gives
    a date in this century. A date without a time takes time_col, else default_time. Of a wall time that occurs twice the
    first is meant, a skipped one moves forward.

    Texts are parsed once, by Python; what follows (estimate, conversion) stays in the JVM. With ``order`` what was parsed is
    written to the shared folder, as it is read twice.

    Null, empty, impossible and other texts do not appear; an unknown zone name counts as none. Rows of a null id are left
    out, repeats count once, an empty table gives no rows.
    """
    spark = df.sparkSession
    known = frozenset(spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())
    cols = [F.col(id_col).alias("id"), *[F.col(t).cast("string").alias(f"t{i}") for i, t in enumerate(texts)]]
    cols.append((F.col(zone_col) if zone_col else F.lit(None)).cast("string").alias("z"))
    cols.append((F.col(time_col) if time_col else F.lit(None)).cast("string").alias("h"))
    rows = df.where(F.col(id_col).isNotNull())
    if zones is not None and source is not None:
        est = zones.select(F.col(source).cast("string").alias("_s"), F.col("zone").alias("_zone"))
        rows = rows.join(est, F.col(source).cast("string") == F.col("_s"), "left")
        cols.append(F.col("_zone").alias("e"))
    else:
        cols.append(F.lit(None).cast("string").alias("e"))
    rows = rows.select(*cols).distinct()
    kind = dict(rows.dtypes)["id"]
    plain_time = parse_time(default_time)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        valid = lambda z: z if isinstance(z, str) and z in known else None
        for pdf in it:
            found: list[list] = [[] for _ in range(len(pdf))]
            for i, name in enumerate(texts):
                for row, t, h in zip(found, pdf[f"t{i}"], pdf["h"]):
                    p = parse(t) if isinstance(t, str) else None
                    if p is None or p[3] is not None and p[3] not in known:
                        continue
                    us, timed, offset, own = p
                    if not timed:
                        extra = parse_time(h) if isinstance(h, str) else None
                        us += extra if extra is not None else plain_time
                    row.append((name, t, us, offset, own))
            yield pd.DataFrame({"id": pdf["id"], "z": [valid(z) for z in pdf["z"]], "e": [valid(e) for e in pdf["e"]], "ps": found})

    parsed = rows.mapInPandas(run, f"id {kind}, z string, e string, ps {PARSED}")
    name = F.coalesce("z", "e", F.lit(default_zone))
    if order:
        parsed = stored(parsed, "instants")
        chosen = _by_order(parsed, order, default_zone, least)
        told = [x for z, c in chosen.items() if z is not None for x in (F.lit(z), F.lit(c))]
        name = F.coalesce(F.create_map(*told)[F.col("z")] if told else F.lit(None), F.col("e"), F.lit(chosen[None]))
    each = parsed.select("id", name.alias("zone"), F.explode("ps").alias("p"))
    own = F.coalesce("p.own", "zone")
    utc = _utc(F.col("p.wall"), F.col("p.offset"), own)
    return each.select(F.col("id").alias(id_col), "p.field", "p.text", utc.alias("utc_us"), F.when(F.col("p.offset").isNotNull(), F.lit("offset")).otherwise(own).alias("zone"))
