"""Clusters of a term's substitutes, and the mentions they stand for."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_self(top_terms: Column, term: Column, top_k: int) -> Column:
    """The first ``top_k`` of a mention's substitutes; the term itself, if among one more than that, gives way."""
    return F.slice(F.array_remove(F.slice(top_terms, 1, top_k + 1), term), 1, top_k)


def edges(subs: DataFrame, top_k: int = 5, min_count: int = 1) -> DataFrame:
    """``term, a, b, n`` with ``a < b``: how often two substitutes stand in one mention of a term.

    A mention has ``top_k`` substitutes at most, so its pairs are made inside the row and combined on the map side.
    """
    row = subs.select("term", F.array_compact(without_self(F.col("top_terms"), F.col("term"), top_k)).alias("s"))
    left = row.select("term", "s", F.posexplode("s").alias("i", "x"))
    pairs = left.select("term", "x", F.explode(F.slice("s", F.col("i") + 2, top_k)).alias("y")).where("x <> y")
    return pairs.groupBy("term", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def communities(weights: dict[tuple[str, str], float], resolution: float = 1.0, seed: int = 42) -> list[list[str]]:
    """Communities of an undirected weighted graph by local moves and aggregation until modularity grows no more.

    Nodes are visited in the order of a seeded hash of their names, so the result depends on the seed and graph only.
    Communities come largest first, ties by first name, names sorted.
    """
    names = sorted({x for e in weights for x in e})
    near: list[dict[int, float]] = [defaultdict(float) for _ in names]
    number = {x: i for i, x in enumerate(names)}
    for (a, b), w in weights.items():
        near[number[a]][number[b]] += w
        near[number[b]][number[a]] += w
    order = sorted(range(len(names)), key=lambda i: hashlib.md5(f"{seed}|{names[i]}".encode()).digest())
    members = [[i] for i in range(len(names))]
    loops = [0.0] * len(names)  # twice the weight inside a merged node
    total = sum(map(sum, (n.values() for n in near)))
    while total:
        degree = [sum(n.values()) + loops[i] for i, n in enumerate(near)]
        of, mass = list(range(len(near))), list(degree)
        moved, again = False, True
        while again:
            again = False
            for i in order:
                links: dict[int, float] = defaultdict(float)
                for j, w in near[i].items():
                    links[of[j]] += w
                mass[of[i]] -= degree[i]
                gain = lambda c: links.get(c, 0.0) - resolution * mass[c] * degree[i] / total  # noqa: B023, E731
                best = max(sorted(links.keys() | {of[i]}), key=lambda c: (round(gain(c), 12), c == of[i]))  # noqa: B023
                mass[best] += degree[i]
                if best != of[i]:
                    of[i], again, moved = best, True, True
        if not moved:
            break
        new = {c: k for k, c in enumerate(dict.fromkeys(of[i] for i in order))}
        merged: list[dict[int, float]] = [defaultdict(float) for _ in new]
        inner, held = [0.0] * len(new), [[] for _ in new]
        for i, n in enumerate(near):
            c = new[of[i]]
            held[c] += members[i]
            inner[c] += loops[i]
            for j, w in n.items():
                if new[of[j]] == c:
                    inner[c] += w
                else:
                    merged[c][new[of[j]]] += w
        near, loops, members, order = merged, inner, held, list(range(len(new)))
    return sorted((sorted(names[i] for i in m) for m in members), key=lambda m: (-len(m), m[0])) if names else []


def clusters(graph: DataFrame, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """``term, cluster, sub`` from weighted edges ``term, a, b, n``.

    A term's graph is treated in one task; its edges are counted before, so its size is bounded by the pairs of different
    substitutes of the term, however many mentions it has.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        found = communities(dict(zip(zip(g["a"], g["b"], strict=True), g["n"].astype(float), strict=True)), resolution, seed)
        return pd.DataFrame([(g["term"].iloc[0], i, s) for i, m in enumerate(found) for s in m], columns=["term", "cluster", "sub"])

    return graph.groupBy("term").applyInPandas(one, "term string, cluster int, sub string")


def assignments(subs: DataFrame, members: DataFrame, top_k: int = 5) -> DataFrame:
    """``term, id, pos, cluster, similarity``: each mention's cluster of largest Jaccard similarity, ties to the lowest number.

    Clusters are looked up by the substitutes of the mention, so that only clusters which share one are compared; a
    mention that shares none goes to the lowest cluster, as all are equally far.
    """
    size = members.groupBy("term", "cluster").agg(F.count_distinct("sub").alias("size"))
    lowest = size.groupBy("term").agg(F.min("cluster").alias("lowest"))
    rows = subs.select("term", "id", "pos", F.array_distinct(F.array_compact(without_self(F.col("top_terms"), F.col("term"), top_k))).alias("s")).where("size(s) > 0")
    shared = rows.select("term", "id", "pos", F.size("s").alias("own"), F.explode("s").alias("sub")).join(members.distinct(), ["term", "sub"]).groupBy("term", "id", "pos", "own", "cluster").agg(F.count("*").alias("k"))
    similar = shared.join(size, ["term", "cluster"]).withColumn("similarity", F.col("k") / (F.col("own") + F.col("size") - F.col("k")))
    turn = F.row_number().over(Window.partitionBy("term", "id", "pos").orderBy(F.desc("similarity"), "cluster"))
    best = similar.withColumn("turn", turn).where("turn = 1").select("term", "id", "pos", "cluster", "similarity")
    out = rows.select("term", "id", "pos").join(lowest, "term").join(best, ["term", "id", "pos"], "left")
    return out.select("term", "id", "pos", F.coalesce("cluster", "lowest").alias("cluster"), F.round(F.coalesce("similarity", F.lit(0.0)), 9).alias("similarity"))


def cluster_table(members: DataFrame, hist: DataFrame, assigned: DataFrame) -> DataFrame:
    """``term, cluster, n, members``: mentions of each cluster, and its substitutes with counts, commonest first."""
    counts = hist.groupBy("term", "sub").agg(F.sum("n").alias("n"))
    rows = members.join(counts, ["term", "sub"], "left").groupBy("term", "cluster").agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("n", F.lit(0))).alias("minus"), "sub"))).alias("m"))
    n = assigned.groupBy("term", "cluster").agg(F.count("*").alias("n"))
    return rows.join(n, ["term", "cluster"], "left").select("term", "cluster", F.coalesce("n", F.lit(0)).alias("n"), F.transform("m", lambda x: F.struct(x["sub"].alias("sub"), (-x["minus"]).alias("n"))).alias("members"))
