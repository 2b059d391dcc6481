"""Ranked search, token files and periodic runs: brute force, round trips and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, duck

from tabloom.llm import periodic, queries, ranked, simple8b, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string"


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _terms(text):
    return TERM.findall(_lower(text))


def _ranked(docs, items, k=10):
    """Plain scoring of every document for every item."""
    bags = [(d, Counter(_terms(t)), len(_terms(t))) for d, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(w for _, bag, _ in bags for w in bag)
    out = []
    for item, text in items:
        rows = []
        for d, bag, n in bags:
            score = 0
            for w in _terms(text):
                if bag[w]:
                    m = 100 - 75 + (75 * n * n_docs) // n_terms
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += weight * ((1000000000 * bag[w]) // (1000 * bag[w] + 8 * m))
            if score > 0:
                rows.append((-score, d is not None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def test_ranked_search_by_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    common = ["the", "of", "And", "é", "10"]
    docs = []
    for i in range(400):
        words = [rng.choice(common) if rng.random() < 0.6 else f"w{rng.randint(0, 300)}" for _ in range(rng.choice([1, 5, 30, 200]))]
        docs.append((i, rng.choice([" ", "-", "\n", "_"]).join(words)))
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # ties
    docs += [(None, docs[7][1]), (2000, None), (2001, ""), (2002, "--- ..."), docs[3], docs[3]]
    items = [(f"i{j}", " ".join(docs[rng.randrange(400)][1].split()[:rng.choice([1, 10, 40])])) for j in range(20)]
    items += [("tie", docs[7][1]), ("none", None), ("blank", " .. "), ("unknown", "zzz yyy"), ("the", "THE the")]
    want = _ranked(docs, items)
    for shard in (1 << 14, 16):
        monkeypatch.setattr(ranked, "SHARD_DOCS", shard)
        table = spark.createDataFrame(docs, DOCS).repartition(3)
        got = ranked.rank(table, spark.createDataFrame(items + items[:3], "item_id string, text string"))
        assert sorted(map(tuple, got.collect()), key=str) == want
    blocks = ranked.rank(table, spark.createDataFrame(items, "item_id string, text string"), block=7)
    assert sorted(map(tuple, blocks.collect()), key=str) == want


def test_ranked_search_prunes():
    rng = np.random.default_rng(0)
    doc = np.repeat(np.arange(4000), 8)
    term = np.minimum(rng.geometric(0.08, len(doc)) - 1, 99)
    pair = np.unique(doc * 100 + term)
    shard = ranked.Shard(pair // 100, pair % 100, rng.integers(1, 1000, len(pair)) * (1 + pair % 100), 4000, 100)
    for lo, hi in [(0, 1), (0, 7), (3, 900), (5, int(shard.first[1]))]:
        at = int(shard.best(np.array([lo]), np.array([hi]))[0])
        assert lo <= at < hi and shard.impact[at] == shard.impact[lo:hi].max()
    whole = np.zeros(4000, np.int64)
    np.add.at(whole, shard.doc, shard.impact)
    found, score = shard.search(np.arange(100), np.ones(100, np.int64), 10)
    assert sorted(score.tolist())[-10:] == np.sort(whole)[-10:].tolist() and (whole[found] == score).all()
    assert len(found) < 400


def test_ranked_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ranked.rank(docs, items).collect() == []
    assert ranked.rank(spark.createDataFrame([(1, None)], DOCS), items).collect() == []
    assert ranked.rank(spark.createDataFrame([(1, "a")], DOCS), items.limit(0)).collect() == []


def test_ranked_search_ignores_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (2, "a", 6, "y")], f"{DOCS}, score int, rank string")
    items = spark.createDataFrame([("q", "a", 3)], "item_id string, text string, item_no int")
    rows = ranked.rank(docs, items).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in sorted(rows, key=lambda r: r["rank"])] == [("q", 1, 2), ("q", 2, 1)]


def test_op11_agrees_with_its_sql(spark, sf_dir):
    name = "op11_ranked_search"
    ok, note, _ = compare(spark, duck(sf_dir), name, queries.QUERIES[name], queries.ORACLES[name], sf_dir)
    assert ok, note


@pytest.mark.parametrize("bits", [1, 2, 7, 16, 20, 31, 33, 59, 60, 61, 64])
def test_simple8b_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 59, 60, 61, 500):
        values = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) >> np.uint64(64 - bits)
        for v in (values, np.repeat(values, 5), np.where(rng.random(n) < 0.9, np.uint64(3), values)):
            words, tail = simple8b.encode(v)
            assert simple8b.decode(words, tail, len(v)).tolist() == v.tolist()
    same = np.full(100_000, 7, np.uint64)
    assert len(simple8b.encode(same)[0]) == 1
    assert len(simple8b.encode(np.full(400, 50_000, np.uint64) - np.arange(400, dtype=np.uint64))[0]) == 134  # 16 bits: three a word


def test_token_file_round_trip():
    rng = np.random.default_rng(1)
    docs = [(None if i == 3 else i * 7, rng.integers(0, 50_000, rng.choice([0, 1, 5, 9000]))) for i in range(40)]
    for block in (1, 64, 1 << 13):
        out = pa.BufferOutputStream()
        assert token_files.write_file(out, docs, block) == (40, sum(len(t) for _, t in docs))
        data = out.getvalue().to_pybytes()
        for step in (1, 3, 64):
            got = list(token_files.read_file(pa.BufferReader(data), step))
            assert [k for k, _ in got] == [k for k, _ in docs]
            assert all((a == b).all() for (_, a), (_, b) in zip(got, docs))
    bad = bytearray(data)
    bad[20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_files.read_file(pa.BufferReader(bytes(bad))))
    assert list(token_files.read_file(pa.BufferReader(_empty()))) == []


def _empty():
    out = pa.BufferOutputStream()
    token_files.write_file(out, [])
    return out.getvalue()


def test_coder_keeps_the_ids(monkeypatch):
    """Whatever is cut, remembered or forgotten, the ids are those of the whole text."""
    coder = token_files.Coder(token_files.TOKENIZER)
    rng = random.Random(2)
    parts = ["word", " ", "  ", "\n", "é", "7", "!", "'s", " the", "\t x", "\u00a0", "\x1c", "\u2003 ", " a", "\0", " Th'll"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 60]))) for _ in range(1500)]
    texts += [" ".join(rng.choice(["alpha", "b,", "c!"]) for _ in range(20_000)), None, ""]
    want = [[*tokenized.ids, 2] for tokenized in coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert all("".join(token_files.pieces(t)) == t for t in texts if t)
    for size, kept in ((1 << 23, 1 << 20), (50, 1 << 20), (500, 10)):
        monkeypatch.setattr(token_files, "BYTES", size)
        monkeypatch.setattr(token_files, "KEPT", kept)
        assert [ids.tolist() for ids in coder.code(pa.array(texts), 2)] == want


def test_coder_cuts_behind_lines_and_keeps_recent_pieces(monkeypatch):
    coder = token_files.Coder(token_files.TOKENIZER)
    rng = random.Random(8)
    ends = ["\n", ".\n", " ", " ", ", ", "\n\n", " \n", "\n ", "\u2003\n", "\n\u2003", "\x1c\n", "\x85\n", "\r\n", "\t"]
    words = ["alpha", "Beta", "'s", "É", "a", "12", "$$", "x\ny", "don't", "\u200b", "語", "1,0.5", "a.'s?!", "x\0,", "\0"]
    texts = ["".join(rng.choice(words) + rng.choice(ends[:rng.choice([5, 14])]) for _ in range(rng.choice([0, 1, 3, 9]))) for _ in range(3000)]
    texts += ["a\nb\nc\nd", "\n", "a\n", "\na", " a\n", "a \n", "a \nb c", "a\n'll\nthe", None, *(f"w{i} v{i % 50}.\nu{i}," for i in range(2000))]
    want = [[*tokenized.ids, 2] for tokenized in coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for size, kept in ((1 << 23, 1 << 20), (300, 150), (2000, 1000)):
        monkeypatch.setattr(token_files, "BYTES", size)
        monkeypatch.setattr(token_files, "KEPT", kept)
        assert [ids.tolist() for ids in coder.code(pa.array(texts), 2)] == want
    lines = token_files.Coder(token_files.TOKENIZER)
    text = " ".join(f"word{i % 7}.\nNext{i % 11} and" for i in range(1000))
    monkeypatch.setattr(token_files, "KEPT", 30)
    assert [*lines.code(pa.array([text]), 2)][0].tolist() == [*lines.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert lines.pieces < 25  # 7 + 11 words and some marks, not 77 pairs
    texts = [f"some other words {i % 10}" for i in range(50)]
    assert len([*lines.code(pa.array(texts), 2)]) == 50 and [*lines.begin] == ["some"]  # the last texts' pieces stay
    assert sorted(lines.after) == sorted(["other", "words", *map(str, range(10))]) and lines.pieces == 13


def test_token_files_by_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "Beta", "ñandú", "12", "?!"]) for _ in range(rng.choice([0, 1, 40, 3000]))) for _ in range(60)]
    docs = list(enumerate(texts)) + [(100, None), (101, ""), (-5, "first"), (7, texts[9]), (7, texts[7]), (None, "no id")]
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], f"{DOCS}, n_tokens int").repartition(5)
    manifest = token_files.write(table)
    got = [tuple(r) for r in token_files.read(manifest).orderBy("start").collect()]
    tokenizer = token_files.coder(token_files.TOKENIZER).tokenizer
    want = []
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted([(r[0], r[2], r[3]) for r in got], key=str) == sorted(want, key=str)
    assert [r[0] for r in got] == sorted([d for d, _ in docs], key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    assert manifest.agg({"n_ids": "sum"}).first()[0] == sum(r[2] for r in got)
    assert token_files.read(token_files.write(table.limit(0))).collect() == []


def _runs(w, least=periodic.LEAST):
    """Every maximal repetition by its definition: each distance, each stretch; the smallest period of a stretch counts."""
    seen, out = set(), []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _periodic_lists():
    rng = random.Random(11)
    for _ in range(500):
        n, kinds = rng.choice([0, 5, 11, 12, 13, 40, 150]), rng.choice([1, 2, 3, 50])
        w = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 4:
                p, a = rng.randint(1, n // 3), rng.randrange(n)
                for i in range(a, min(n, a + rng.randint(p, 5 * p))):
                    w[i] = w[a + (i - a) % p]
        yield w
    yield [0] * 5000
    yield list(range(90)) * 7 + list(range(89)) * 3


def test_runs_by_brute_force():
    lists = list(_periodic_lists())
    for w, got in zip(lists, periodic.runs_of(lists)):
        assert [tuple(r) for r in got.tolist()] == _runs(w), w


def test_catcher_is_online():
    """Any cut of the stream gives the same runs, and a square is told of as soon as its last word is there."""
    rng = random.Random(3)
    for w in list(_periodic_lists())[:200]:
        catcher, i = periodic.SquareCatcher(), 0
        while i < len(w):
            step = rng.choice([1, 1, 4, 50])
            catcher.append(w[i:i + step])
            i += step
        assert [(a, b - a, q) for a, b, q in catcher.runs().tolist()] == _runs(w), w
    w = [1, 2, 3, 4, 5, 6, 7] * 2 + [8]
    catcher, told = periodic.SquareCatcher(), []
    for x in w:
        told.append(catcher.append([x]).tolist())
    assert [i for i, t in enumerate(told) if t] == [13, 14] and told[13] == [[0, 14, 7]]


def test_collapsed():
    words = list("xyababababababzz")
    runs = periodic.runs_of([words])[0]
    assert runs.tolist() == [[2, 12, 2]] and periodic.collapsed(words, runs) == list("xyabzz")


def test_op13_by_brute_force(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 3, 40, 200])))) for i in range(300)]
    docs += [(500, None), (501, "  \n "), (502, "a b c " * 6), (503, "x " * 400), docs[4], docs[4], (None, "y y " * 9)]
    spark.createDataFrame([(d, t, 5) for d, t in docs], f"{DOCS}, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in docs:
        w = WORD.findall(t or "")
        h = 1 if d is None else zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = _runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(left.encode()).hexdigest()))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sum(r[1] > 0 for r in want) > 10
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    empty = periodic.find(spark.createDataFrame([], f"{DOCS}, collapsed string"))
    assert empty.columns == ["doc_id", "n_words", "runs", "collapsed"] and empty.collect() == []
