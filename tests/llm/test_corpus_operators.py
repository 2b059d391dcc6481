"""Operators on whole tables: brute force, edge cases, the pipeline, and what the rest may import."""

import math
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm import ann, mixing, near_dup
from tabloom.llm.components import components

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ROOT = Path(__file__).resolve().parents[2]


def _sets(rows):
    out = []
    for _, t in rows:
        w = BLANK.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def _components(rows):
    """doc_id -> smallest doc_id reachable over links of 0.85 or more."""
    sets = _sets(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * min(len(x), len(y)) >= 85 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 85 * (len(x) + len(y) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def _corpus(seed, n=260):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(30, 220))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(bases[0] if i % 3 == 0 else rnd.choice(bases))
        for _ in range(rnd.randrange(0, 7)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        if rnd.random() < 0.2:
            words = words[: rnd.randrange(1, len(words))]
        rows.append((1000 - i, " ".join(words).upper() if i % 5 == 0 else "\n".join(words)))
    return rows + [(5, None), (6, ""), (7, " \t"), (8, "a b"), (9, "A  b"), (10, "a b c"), (11, "ü" * 3000), (12, "x y z w v " * 900), (13, "x y z w v " * 800)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    rows = _corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("kept", F.lit("x"))
    got = near_dup.dedup(df.select("doc_id", "text")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _components(rows) and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    stay = near_dup.drop_duplicates(df)
    assert stay.columns == df.columns and {r.doc_id for r in stay.collect()} == {r.doc_id for r in got if r.kept}


def test_near_duplicate_edges(spark):
    kind = "doc_id long, text string"
    assert near_dup.dedup(spark.createDataFrame([], kind)).collect() == []
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "q"), (None, None), (4, None)]
    got = [tuple(r) for r in near_dup.dedup(spark.createDataFrame(rows, kind)).collect()]
    assert sorted(got, key=str) == sorted(
        [(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (None, 1, None, True), (None, 0, None, True), (4, 0, 4, True)], key=str)
    assert near_dup.drop_duplicates(spark.createDataFrame(rows, kind)).count() == 4


def test_near_dup_stage_takes_eighty_percent(spark):
    rows = []
    for i, n in enumerate((9, 10, 11)):  # the last n of 100 words differ
        base = [f"b{i}x{k}" for k in range(100)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:-n] + [f"c{i}x{k}" for k in range(n)]))]
    sets = _sets(rows)
    alike = [len(sets[j] & sets[j + 1]) / len(sets[j] | sets[j + 1]) for j in (0, 2, 4)]
    assert 0.8 <= alike[1] < alike[0] < 0.85 and alike[2] < 0.8
    kept = {r.doc_id for r in corpus_pipeline.near_dup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == {0, 2, 4, 5}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    for shared in (0, 50, 80, 100):
        common = rng.integers(0, 2**63, shared, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, 100 - shared, dtype=np.uint64)])) for _ in range(2))
        s = near_dup.sketches([a, b, a[:1], a[:0]], 400)
        assert (s[:3] != near_dup._FULL).all() and (s[3] == near_dup._FULL).all()
        assert abs((s[0] == s[1]).mean() - shared / (200 - shared)) < 0.12


def test_components_against_brute_force(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(1, None), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: find(i) for i in root}


def _targets(sizes):
    """Water filling by its definition, sources in code-point order with null last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped = {s for s in names if sizes[s] == 0}
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        open_w = sum(weight[s] for s in names if s not in capped)
        new = {s for s in names if s not in capped and left * weight[s] / open_w > 3 * sizes[s]}
        if not new:
            return {s: 3 * sizes[s] if s in capped else left * weight[s] / open_w for s in names}
        capped |= new


def test_mixing(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(3000):
        source = rnd.choice(["a", "a", "a", "B", "ü", None, "tiny"] if i % 40 == 0 else ["a", "a", "B", "ü", None])
        rows.append((i, "w " * min(int(rnd.expovariate(1 / 60)), 900), source))
    rows += [(9, None, "a"), (10, "", None), (None, "x y", "a"), (2**60 + 1, "x y z", "a"), (11, None, "empty")] + [(77, "one two three", "B")] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(BLANK.findall(t or ""))
    want = {round(v, 6) for v in _targets(sizes).values()}
    assert {round(r.target, 6) for r in got} == want
    taken, goal = {}, {}
    for r in got:
        assert r.doc_id is None or r.doc_id < 3000 or r.doc_id == 2**60 + 1
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        key = (r.source_size, round(r.target, 6))
        taken[key] = taken.get(key, 0) + r.taken
        goal[key] = r.target
    assert all(abs(taken[k] - goal[k]) <= max(3, 0.001 * goal[k]) for k in taken)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(df.where("false")).collect() == []


@pytest.mark.parametrize("land", [False, True])
def test_flight_keeps_totals(land):
    rng = np.random.default_rng(2)
    size, pi = rng.integers(1, 500, 700), rng.random(700)
    out = mixing.fly(size, pi, np.random.default_rng(1), land)
    open_n = int(((out > 0) & (out < 1)).sum())
    assert open_n == 0 if land else open_n <= 2
    assert abs((out * size).sum() - (pi * size).sum()) < (3 if land else 1e-4)
    assert land or abs(out.sum() - pi.sum()) < 1e-6
    mean = np.mean([mixing.fly(size[:30], pi[:30], np.random.default_rng(s), False) for s in range(3000)], axis=0)
    assert np.abs(mean - pi[:30]).max() < 0.05  # probabilities are kept


def _nearest(rows, k=10):
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    out = {}
    for i in ids[ids % 100 == 0]:
        d = np.sqrt(((x - good[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(2500)]
    rows = [(i, rows[7][1] if i % 3 == 0 else v) for i, v in rows]  # one vector holds a third of all rows
    rows[300] = (300, None)
    rows[5], rows[6], rows[8] = (5, [0.0] * 8), (6, [None] * 8), (8, [math.nan] * 8)
    rows[10], rows[11] = (10, [1.0] * 3), (11, [math.inf] * 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = _nearest(rows)
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    x = {i: v for i, v in rows}
    for q, found in got.items():
        assert len(found) == 10 and found == sorted(found, key=lambda p: (p[1], p[0]))
        assert all(s == pytest.approx(float(np.linalg.norm(np.subtract(x[q], x[v]))), abs=1e-12) for v, s in found)


def test_few_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    search = lambda rows: ann.search(spark.createDataFrame(rows, kind), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert search([]) == [] and search([(0, [1.0, 2.0])]) == [] and search([(None, [1.0])]) == []
    got = search([(0, [1.0, 0.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (100, [4.0, 4.0])])
    assert [tuple(r)[:3] for r in got] == [(0, 1, 2), (0, 2, 3), (0, 3, 100), (100, 1, 2), (100, 2, 3), (100, 3, 0)]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dup", "decontaminate", "mix"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        left = {r.doc_id for r in out.select("doc_id").collect()}
        assert left <= ids and (left == ids if name in ("line_dedup", "mix") else left < ids)
        assert name == "mix" or out.columns == columns
        docs, ids = spark.createDataFrame(out.collect(), out.schema), left
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_empty_and_odd_tables(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    odd = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "word " * 20000, "en", None, 1), (3, "!!", None, "s", 2)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs.collect()


def test_rest_does_not_import_this_package():
    for path in (ROOT / "tabloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tabloom.llm" not in path.read_text(), path


def test_entry_works_without_this_package(tmp_path):
    (tmp_path / "tabloom").mkdir()
    for path in (ROOT / "tabloom").iterdir():
        if path.name != "llm":
            (tmp_path / "tabloom" / path.name).symlink_to(path)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n.startswith('op') or n == 'pipeline']; print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
