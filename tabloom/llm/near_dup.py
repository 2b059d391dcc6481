"""Near duplicates: fast similarity sketches, banding, exact confirmation, components.

A sketch has a fixed number of coordinates. In round i every element of the set falls into one hashed bin, and a
bin keeps the least value of the first round that reaches it; after as many rounds as bins, round t + j throws
all elements into bin j, so every coordinate fills. Two sets agree in a coordinate with the probability of
their Jaccard similarity, with concentration as for independent coordinates, and a set of n elements costs about
max(n, t log t) steps instead of n * t.

Banding: `BANDS` bands of `ROWS` coordinates. Sets at the threshold 0.85 share no band with probability
(1 - 0.85^6)^32 = 2.6e-7, at 0.8 with 6e-5. Documents with the same set are one node from the start. In each bucket of a band all nodes
are compared with one node picked by hash. Where the links found leave a bucket in several components, its nodes
go through an exact prefix-filtered join that looks for links between components, so no pair that shares a
bucket and is not yet connected is missed. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm import chars, common
from tabloom.llm.components import components

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 32, 6
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for a text without words."""
    out: list[np.ndarray] = []
    for a, b in chars.batches(texts):
        text, starts = chars.codes(texts[a:b])
        text = chars.ascii_lower_table()[text]
        begin, end, first = chars.words(text, starts, chars.blank_word_table())
        found, cut = chars.shingles(chars.hashes(text, begin, end), first, size)
        out += [np.unique(found[i:j]) for i, j in zip(cut[:-1], cut[1:])]
    return out


def sketches(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``size`` coordinates per set; the row of an empty set is all ones."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), size), _FULL)
    element = np.concatenate(sets) if sizes.sum() else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = out.reshape(-1)
    for i, seed in enumerate(chars.seeds(2 * size, 3)):
        if not len(element):
            break
        value = chars.mix(element ^ seed)
        if i < size:
            place = ((value >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        else:
            place = np.full(len(value), i - size)
        at = owner * size + place
        free = flat[at] == _FULL
        best = np.full(len(flat), _FULL) if i < 3 else None
        if best is None:  # few are left: only their own cells
            cell, back = np.unique(at[free], return_inverse=True)
            least = np.full(len(cell), _FULL)
            np.minimum.at(least, back, value[free])
            flat[cell] = least
        else:
            np.minimum.at(best, at[free], value[free])
            flat[best != _FULL] = best[best != _FULL]
        open_rows = (out == _FULL).any(1)
        left = open_rows[owner]
        element, owner = element[left], owner[left]
    return out


def _bands(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sketch), bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = chars.mix(keys * chars.seeds(1, 4)[0] + sketch[:, r::rows][:, :bands])
        return (chars.mix(keys + np.arange(bands, dtype=np.uint64))).view(np.int64)


def _name(found: np.ndarray) -> int:
    """The node of a set: a 64-bit sum over its elements, whatever their order."""
    with np.errstate(over="ignore"):
        total = chars.mix(chars.mix(found) + np.uint64(len(found))).sum(dtype=np.uint64)
    return int(chars.mix(np.array([total + np.uint64(len(found))])).view(np.int64)[0])


def _sketched(size: int, bands: int, rows: int, per: int = 4_000_000):
    """Name, size and band keys of the sets of some texts, sketched some millions of shingles at a time."""

    def work(texts):
        sets = shingle_sets(texts, size)
        ends = np.cumsum([len(s) for s in sets]) // per
        keys = [_bands(sketches([sets[i] for i in np.flatnonzero(ends == e)], bands * rows), bands, rows)
                for e in np.unique(ends)]
        keys = np.concatenate(keys) if keys else []
        return [_name(s) for s in sets], [len(s) for s in sets], [k if len(s) else None for k, s in zip(keys, sets)]

    return work


def _confirm(size: int, percent: int):
    def run(frames):
        for frame in frames:
            texts = list(dict.fromkeys(frame["text_a"].tolist() + frame["text_b"].tolist()))
            sets = dict(zip(texts, shingle_sets(texts, size)))
            keep = []
            for x, y in zip(frame["text_a"], frame["text_b"]):
                x, y = sets[x], sets[y]
                common_n = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = np.concatenate([x, y])
                    both.sort()
                    common_n = int((both[1:] == both[:-1]).sum())
                keep.append(common_n > 0 and 100 * common_n >= percent * (len(x) + len(y) - common_n))
            yield frame.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _spread(size: int):
    def run(frames):
        for frame in frames:
            sets = shingle_sets(frame["text"].tolist(), size)
            yield pd.DataFrame({"node": np.repeat(frame["node"].to_numpy(), [len(s) for s in sets]),
                                "shingle": np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)})

    return run


def _crossing_pairs(nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, n, root) with different roots that can be similar: a prefix-filtered self-join.

    Shingles are ordered by how many of the nodes have them, rare ones first. Similar sets share one of the first
    n - ceil(percent * n / 100) + 1, and at the first they share, enough shingles must be left on both sides.
    Both bounds are exact. A shingle that no other node has only counts for the positions.
    """
    tokens = common.staged(
        nodes.select("node").join(texts, "node").mapInPandas(_spread(size), "node long, shingle long"), "tokens")
    often = common.staged(
        tokens.groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("one")), "often")
    lone = often.where("c = 1").groupBy(F.col("one").alias("node")).agg(F.count("*").alias("lone"))
    alive = nodes.join(lone, "node", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
    alive = alive.where(100 * (F.col("n") - F.col("lone")) >= percent * F.col("n"))
    ranked = tokens.join(alive, "node").join(often.where("c > 1").select("shingle", "c"), "shingle")
    place = F.row_number().over(Window.partitionBy("node").orderBy("c", "shingle")) - 1 + F.col("lone")
    prefix = ranked.withColumn("i", place).where(F.col("i") <= F.col("n") - F.ceil(percent * F.col("n") / 100))
    prefix = common.staged(prefix.select("shingle", "node", "n", "root", "i"), "prefixes")
    mixed = prefix.groupBy("shingle", "root").count().groupBy("shingle").agg(
        F.count("*").alias("roots"), F.max_by("root", F.struct("count", "root")).alias("main")).where("roots > 1")
    mixed = common.staged(mixed.select("shingle", "main"), "mixed")  # both sides are dealt out, so hot shingles can be split
    prefix = common.staged(prefix.join(mixed, "shingle"), "prefixes")
    # one side leaves out the largest component of each shingle: its members are connected already
    x = prefix.where("root <> main").select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "root", "i")])
    y = prefix.select("shingle", "main", *[F.col(c).alias(f"y_{c}") for c in ("node", "n", "root", "i")])
    left = F.least(F.col("x_n") - F.col("x_i"), F.col("y_n") - F.col("y_i"))
    pairs = x.join(y, "shingle").where(
        (F.col("x_root") != F.col("y_root"))
        & ((F.col("y_root") == F.col("main")) | (F.col("x_node") < F.col("y_node")))
        & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
        & ((100 + percent) * left >= percent * (F.col("x_n") + F.col("y_n"))))
    return pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def find_links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS,
               rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """A staged table (doc_id, row_key, node, n_shingles) of all rows, and confirmed links (a, b) between nodes.

    The links connect all that similar pairs connect; pairs inside a component found earlier are not listed.
    """
    keyed = docs.select("doc_id", "text", common.row_key("doc_id", "text").alias("row_key"))
    made = common.map_texts(keyed, ["doc_id", "row_key"], "text", "node long, n_shingles long, bands array<long>",
                            _sketched(size, bands, rows))
    made = common.staged(made, "sketches")
    nodes = made.where("n_shingles > 0").groupBy("node").agg(
        F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = common.staged(nodes, "nodes")
    members = nodes.select("node", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(
        F.count("*").alias("c"), F.min_by("node", F.xxhash64("node", "key")).alias("leader")).where("c > 1")
    buckets = common.staged(buckets.select("key", "leader"), "buckets")
    shared = common.staged(members.join(buckets, "key"), "members")
    wanted = shared.select("node").distinct().join(nodes.select("node", "row_key"), "node")
    texts = keyed.select("row_key", "text").join(wanted, "row_key").select("node", "text").dropDuplicates(["node"])
    texts = common.staged(texts, "texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return both.mapInPandas(_confirm(size, percent), "a long, b long")

    first = shared.where("node <> leader").select(
        F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    first = common.staged(first, "pairs")
    links = common.staged(confirm(first), "links")
    root = components(links)
    placed = shared.select("key", "node", "n").join(root, "node", "left")
    placed = placed.select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    parts = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    still = placed.join(parts.select("key"), "key").select("node", "n", "root").distinct()
    rest = _crossing_pairs(common.staged(still, "open"), texts, size, percent)
    rest = common.staged(rest.join(first, ["a", "b"], "left_anti"), "pairs")
    more = common.staged(confirm(rest), "links")
    return made.drop("bands"), links.unionByName(more)


def dedup(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id of the component, its own included; kept marks the row with that id. A
    null or wordless text has no shingle and is alone. Rows without an id that are alone are kept; in a component
    with any id they are not. Rows that repeat an id and a text get equal rows.
    """
    rows, links = find_links(docs, size, percent)
    root = components(links)
    placed = rows.join(root, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    full = placed.where("n_shingles > 0")
    least = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    least = least.select(F.bitwise_not("root").alias("k"), "component_id")  # dealt out anew, see components
    full = full.withColumn("k", F.bitwise_not("root")).join(least, "k").select("doc_id", "n_shingles", "component_id")
    alone = placed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component, with its own columns only: a row with the smallest id.

    Of rows that share id and text one stays, whatever their other columns say. Textless rows are alone
    and stay, one for each id.
    """
    rows, links = find_links(docs.select("doc_id", "text"), size, percent)
    placed = rows.join(components(links), "node", "left").select(
        "doc_id", "row_key", "n_shingles", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    kept = placed.where("n_shingles > 0").groupBy("root").agg(F.min_by("row_key", order).alias("__key")).select("__key")
    kept = kept.unionByName(placed.where("n_shingles = 0").select(F.col("row_key").alias("__key")).distinct())
    whole = docs.select(F.struct("*").alias("__row"), common.row_key("doc_id", "text").alias("__key"))
    return whole.join(kept, "__key").dropDuplicates(["__key"]).select("__row.*")
