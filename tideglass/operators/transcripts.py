"""Transcripts as rows of turns: citations held against evidence, tools used, overlap of findings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What counts as a path, and what punctuation may trail it.
PATH = r"([A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+)"
TRAILING = r"[.,:;)'\"]+$"


def turns(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, turn, role, line: lines that begin with a role."""
    lines = docs.select(F.col(doc_id).alias("doc"), F.posexplode(F.split(text, "\n")).alias("turn", "line"))
    role = F.regexp_extract("line", r"^(?:- )?(user|tool|assistant): ", 1)
    return lines.withColumn("role", role).where("role <> ''")


def paths(text: Column) -> Column:
    """Distinct path-like words without trailing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PATH), 1), lambda x: F.regexp_replace(x, TRAILING, "")))


def citations(t: DataFrame) -> DataFrame:
    """doc, cited, supported, precision: cited paths of the assistant among those in tool results; 1 if nothing is cited."""
    said = lambda r: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == r, paths(F.col("line"))))))
    g = t.groupBy("doc").agg(said("assistant").alias("c"), said("tool").alias("e"))
    ok = F.size(F.array_intersect("c", "e"))
    return g.select("doc", F.size("c").alias("cited"), ok.alias("supported"), F.when(F.size("c") == 0, 1.0).otherwise(ok / F.size("c")).alias("precision"))


def keyword_recall(text: Column, keywords: Column) -> Column:
    """Share of keywords in the text, whatever their case; 1 if there are none."""
    hit = F.size(F.filter(keywords, lambda k: F.contains(F.lower(text), F.lower(k))))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(hit / F.size(keywords))


def word_set(text: Column) -> Column:
    """Distinct lower-case words of over four characters, stripped of punctuation."""
    long = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 4)
    return F.array_sort(F.array_distinct(F.transform(long, lambda w: F.lower(F.regexp_replace(w, r"^[.,:;()'\"]+|[.,:;()'\"]+$", "")))))


def similar_links(items: DataFrame, item: str, text: str, checker: str, threshold: float = 0.3) -> DataFrame:
    """item, links: with how many items of other checkers an item's words overlap by at least the threshold.

    Candidates meet only on the rarest words of each set (prefix filter): two sets whose overlap reaches the threshold
    share one of them. Each pair is compared once per item, exactly.
    """
    s = items.where(F.col(item).isNotNull()).select(F.col(item).alias("i"), F.col(checker).alias("c"), word_set(F.col(text)).alias("w")).where(F.size("w") > 0)
    words = s.select("i", "c", "w", F.explode("w").alias("x"))
    freq = words.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    ranked = words.join(freq, "x").withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("n", "x")))
    prefix = ranked.where(F.col("r") <= F.size("w") - F.ceil(F.size("w") * threshold) + 1)
    a, b = prefix.select("i", "c", "x"), prefix.selectExpr("i as j", "c as d", "x")
    pairs = a.join(b, "x").where("i <> j and c <> d").select("i", "j").distinct()
    sets = s.select("i", "w")
    both = pairs.join(sets, "i").join(sets.selectExpr("i as j", "w as v"), "j")
    hit = both.where(F.size(F.array_intersect("w", "v")) / F.size(F.array_union("w", "v")) >= threshold)
    n = hit.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return s.select("i").join(n, "i", "left").select(F.col("i").alias(item), F.coalesce("n", F.lit(0)).alias("links"))


def merge_findings(items: DataFrame, audit: str, item: str, text: str, checker: str, threshold: float = 0.3) -> DataFrame:
    """item, group, convergent: later items of other checkers join the first open one they overlap with, one audit a group."""
    rows = items.select(F.col(audit).alias("a"), F.col(item).cast("long").alias("i"), F.col(checker).alias("c"), word_set(F.col(text)).alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i").reset_index(drop=True)
        sets = [set(w) for w in pdf["w"]]
        group = [-1] * len(pdf)
        for i in range(len(pdf)):
            if group[i] >= 0:
                continue
            group[i] = i
            for j in range(i + 1, len(pdf)):
                if group[j] < 0 and pdf["c"][i] != pdf["c"][j] and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                    group[j] = i
        size = pd.Series(group).map(pd.Series(group).value_counts())
        return pd.DataFrame({"a": pdf["a"], "i": pdf["i"], "g": [pdf["i"][g] for g in group], "m": size > 1})

    return rows.groupBy("a").applyInPandas(run, "a string, i long, g long, m boolean").select(F.col("a").alias(audit), F.col("i").alias(item), F.col("g").alias("group"), F.col("m").alias("convergent"))
