"""Near joins, passages, decontamination and components against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tablewarden.llm import decontamination, near_join, substring_dedup
from tablewarden.llm.components import components, local_components
from tablewarden.llm.signature_tree import links


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def roots(nodes, edges) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(n: int, seed: int) -> list[tuple[int, str]]:
    """Random texts, families of near copies at all similarities, exact copies, short and odd texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [r.choice(words) for _ in range(r.randint(1, 120))]
        for _ in range(r.choice((1, 1, 1, 2, 6))):
            copy = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 4))):
                copy[r.randrange(len(copy))] = r.choice(words)
            text = " ".join(copy)
            out.append(text.upper() if r.random() < 0.1 else text + "\n" if r.random() < 0.1 else text)
    out += ["", " \t\n", "a", "A", "a b c d", "a b c d", "é é é é é", "\x00 x\x01y z q"]
    return list(enumerate(out))


def linked(a: set, b: set) -> bool:
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


@pytest.mark.parametrize("task", [2_000_000, 300])
def test_near_classes(spark, task):
    docs = corpus(60, task)
    sets = {i: shingles(t) for i, t in docs}
    want = roots(sets, [(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b])])
    rows = [(i, t, "x", 1) for i, t in docs] + [(9000, None, "x", 1), (None, docs[0][1], "x", 1), (3, docs[3][1], "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node string, component int").repartition(5)
    got = near_join.near_classes(frame, task_shingles=task).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == len(sets[0])
        elif r.doc_id == 9000:
            assert (r.n_shingles, r.component_id) == (0, 9000)
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])


def test_near_classes_of_nothing(spark):
    assert near_join.near_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_tree_spans_all_components(seed):
    r = np.random.default_rng(seed)
    sets = []
    for _ in range(30):
        base = r.integers(0, 2**63, r.integers(1, 60)).astype(np.uint64)
        for _ in range(r.integers(1, 9)):
            copy = base.copy()
            copy[r.random(len(copy)) < 0.08] = r.integers(0, 2**63)
            sets.append(np.unique(copy))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    found = links(np.concatenate(sets), bounds)
    as_sets = [set(s.tolist()) for s in sets]
    assert all(linked(as_sets[a], as_sets[b]) for a, b in found)
    every = [(a, b) for a in range(len(sets)) for b in range(a) if linked(as_sets[a], as_sets[b])]
    assert roots(range(len(sets)), found) == roots(range(len(sets)), every)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(-80, 80), r.randrange(-80, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)]
    want = roots({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    frame = spark.createDataFrame([*edges, (5, 5), (None, 3), edges[0]], "a long, b long")
    for size in (1_000_000, 20):
        assert {x.node: x.component for x in components(frame, task_edges=size).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    node, least = local_components(np.array([3, 5]), np.array([5, 9]))
    assert node.tolist() == [3, 5, 9] and least.tolist() == [3, 3, 3]


PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_decontamination(docs, items, window):
    windows: dict[tuple, set] = {}
    for i, t in (x for x in items if x[0] is not None):
        w = PATTERN.findall(lower(t or ""))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = PATTERN.findall(lower(t or "")), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if got := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= got
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize(("block", "buffer"), [(8 << 20, 8 << 20), (200, 300)])
def test_decontamination(spark, block, buffer, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontamination, "BUFFER_BYTES", buffer)
    r = random.Random(7)
    words = [f"w{i}" for i in range(12)] + ["É", "zürich", "9"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(str(i), say(r.choice((1, 3, 6, 7, 9)))) for i in range(20)] + [("20", ""), ("21", "..."), ("22", None), ("23\x00", "W1, w2! w3"), (None, "w1 w2")]
    docs = [(i, say(r.randint(0, 60)) + r.choice(("", ". " + items[i % 20][1].upper() + "!", "\n"))) for i in range(60)] + [(60, None), (61, ""), (62, "!!"), (5, "w1")]
    frame = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, n_words string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.decontaminate(frame, bench, window=6).collect()
    want = [(d, *brute_decontamination([(d, t)], items, 6)[d]) for d, t in docs]
    assert sorted(map(tuple, got)) == sorted(want)
    none = decontamination.decontaminate(frame, bench.limit(0), window=6).collect()
    assert len(none) == len(docs) and not any(x.contaminated for x in none)
    assert decontamination.decontaminate(frame.limit(0), bench).collect() == []
    kept = decontamination.decontaminate(frame, bench, window=6, keep=["item_id", "text", "doc_id"])
    assert kept.columns[:3] == ["item_id", "text", "doc_id"] and kept.count() == len(docs)


def complements(n: int = 1024) -> tuple[str, str]:
    """A Thue-Morse word and its complement: equal under every polynomial fingerprint modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("et"[x] for x in bits), "".join("te"[x] for x in bits)


def test_complementary_words_are_different_words(spark):
    one, other = complements()
    docs = spark.createDataFrame([(1, one), (2, other), (3, " ".join([one, *map(str, range(60))])), (4, " ".join(["b " * 3, other]))], "doc_id long, text string")
    got = {x.doc_id: x for x in near_join.near_classes(docs).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 2, 3, 4]
    found = decontamination.decontaminate(docs, spark.createDataFrame([("q", one)], "item_id string, text string")).collect()
    assert {x.doc_id for x in found if x.contaminated} == {1, 3}
    lines = [" ".join([w] * 5 + [f"w{i}" for i in range(30)][:25]) for w in (one, other)]
    passages = spark.createDataFrame([(1, " ".join([one] * 40)), (2, " ".join([other] * 40)), (3, lines[0])], "doc_id long, text string")
    assert {x.doc_id for x in substring_dedup.repeated_passages(passages).collect()} <= {1, 2}


def test_windows_are_verified_letter_by_letter(spark, monkeypatch):
    """With words that all have one fingerprint, only real occurrences are found."""
    real = decontamination.words_of

    def blind(raw, ends, table):
        words = real(raw, ends, table)
        words.hashes[:] = 7
        return words

    monkeypatch.setattr(decontamination, "words_of", blind)
    block = decontamination._block([("a", "one two three four five six"), ("b", "ten two")], 4)
    keys = decontamination._shingle_keys(block)
    path = f"{decontamination.fresh_path(spark, 'blind')}/x.npz"
    decontamination._save(path, block | decontamination._prefixes(block, {k: np.ones(len(v), np.int64) for k, v in keys.items()}))
    raw = np.frombuffer(b"zero one two three four five ten two three four six", np.uint8)
    docs, starts, windows = decontamination.Matching(path).hits(blind(raw, np.array([0, len(raw)]), decontamination.ALPHANUMERIC))
    assert sorted(starts.tolist()) == [1, 2, 6]


def sentences(r: random.Random, n: int, tag: str) -> str:
    return " ".join(" ".join(f"{tag}{r.randrange(10**6)}" for _ in range(r.randint(4, 15))) + "." for _ in range(n))


def test_repeated_passages(spark):
    r = random.Random(3)
    passages = [sentences(r, 7, "p") for _ in range(6)]
    docs, holds = [], {}
    for i in range(60):
        text = sentences(r, 6, "a") + ("\n" if i % 2 else " ")
        if i % 3 == 0:
            k = r.randrange(6)
            holds.setdefault(k, []).append(i)
            text += passages[k] + " "
        docs.append((i, text + sentences(r, 5, "b")))
    near = sentences(r, 8, "n").replace(". ", ", ")
    docs += [(100, near), (101, near.replace("n1", "m1", 1)), (102, None), (103, ""), (104, "short line"), (None, passages[0])]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, node string").repartition(4)
    got = substring_dedup.repeated_passages(frame).collect()
    texts = dict(docs)
    later = {d for k, ds in holds.items() for d in ds[1:]}
    assert {x.doc_id for x in got} == later | {101}
    for x in got:
        if x.doc_id in later:
            k = next(k for k, ds in holds.items() if x.doc_id in ds)
            assert x.keep_doc_id == holds[k][0]
            assert len(set(texts[x.doc_id][x.start : x.end].split()) & set(passages[k].split())) >= 30
            assert passages[k].split()[0] in texts[x.doc_id][x.start : x.end]
    assert substring_dedup.repeated_passages(frame.limit(0)).collect() == []


def test_merged_spans_keep_all_their_links(spark):
    r = random.Random(8)
    a, b = sentences(r, 6, "a"), sentences(r, 6, "b")
    both = f"{a} {b}"
    docs = spark.createDataFrame([(1, a), (2, b), (3, both), (3, both), (4, "é " * 100_000 + both)], "doc_id long, text string")
    got = substring_dedup.repeated_passages(docs, percent=100).collect()
    long = [x for x in got if x.doc_id == 4 and x.start >= 200_000]
    assert {x.keep_doc_id for y in long for x in y.links} == {1, 2, 3} or {x.keep_doc_id for y in long for x in y.links} == {1, 2}
    third = [x for x in got if x.doc_id == 3]
    assert {x.keep_doc_id for y in third for x in y.links} >= {1, 2}
    assert all(y.class_id == min(x.class_id for x in y.links) and y.keep_doc_id == min(x.keep_doc_id for x in y.links) for y in got)
    assert sum(len(y.links) for y in third) == len({(x.class_id, y.start) for y in third for x in y.links})


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_spans_are_merged_across_batches(size):
    r = random.Random(size)
    rows = sorted((r.randrange(6), a := r.randrange(300), a + r.randrange(1, 12), r.randrange(5), r.randrange(4)) for _ in range(150))
    table = pa.table({k: pa.array([x[i] for x in rows], pa.int64()) for i, k in enumerate(("doc_id", "start", "end", "class_id", "keep_doc_id"))})
    got = [x for b in substring_dedup._merged(iter([*table.to_batches(max_chunksize=size), *table.slice(0, 0).to_batches()])) for x in b.to_pylist()]
    want = []
    for doc, a, b, k, d in rows:
        if not (want and want[-1]["doc_id"] == doc and a <= want[-1]["end"]):
            want.append({"doc_id": doc, "start": a, "end": b, "links": set()})
        want[-1]["end"] = max(want[-1]["end"], b)
        want[-1]["links"].add((k, d))
    assert [(x["doc_id"], x["start"], x["end"], [tuple(y.values()) for y in x["links"]]) for x in got] == [(x["doc_id"], x["start"], x["end"], sorted(x["links"])) for x in want]
    assert all(x["class_id"] == min(y["class_id"] for y in x["links"]) and x["keep_doc_id"] == min(y["keep_doc_id"] for y in x["links"]) for x in got)
    assert list(substring_dedup._merged(iter([]))) == []


def test_recall_of_near_passages(spark):
    """Passages whose five-word shingles are 0.8 alike, as lines and inside lines: found at all, against brute force."""
    r = random.Random(12)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    docs, planted = [], []
    for i in range(120):
        base = say(r.randint(55, 200))
        copy = list(base)
        for _ in range(r.choice((1, 1, 2, 3))):
            copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
        if not linked(shingles(" ".join(base)), shingles(" ".join(copy))):
            continue
        join = "\n" if i % 2 else " "
        docs += [(2 * i, join.join(map(" ".join, (say(20), base, say(20))))), (2 * i + 1, join.join(map(" ".join, (say(25), copy, say(25)))))]
        planted.append((2 * i + 1, i % 2))
    got = {x.doc_id for x in substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert not {d for d in got if d % 2 == 0}
    for line, name in ((1, "lines"), (0, "inside lines")):
        of = [d for d, x in planted if x == line]
        recall = sum(d in got for d in of) / len(of)
        print(f"near passages as {name}: {recall:.3f} of {len(of)}")
        assert recall >= 0.9


@pytest.mark.parametrize("size", [8 << 20, 0])
def test_hot_groups(spark, size, monkeypatch):
    """Half of all rows are copies of one text, near copies of it or empty; lists too large to be broadcast."""
    from tablewarden.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_BYTES", size)
    monkeypatch.setattr(near_join, "BROADCAST_BYTES", size)
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", size)
    monkeypatch.setattr(shared, "HOT_PARTS", 4)
    r = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    near = lambda: " ".join([*base[: (k := r.randrange(60))], f"x{r.randrange(9**9)}", *base[k + 1 :]])
    texts = [" ".join(base)] * 60 + [near() for _ in range(60)] + [""] * 60 + [" ".join(f"y{r.randrange(9**9)}" for _ in range(60)) for _ in range(60)]
    docs = list(enumerate(texts))
    sets = {i: shingles(t) for i, t in docs}
    want = roots(sets, [(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b])])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert {x.doc_id: x.component_id for x in near_join.near_classes(frame, task_shingles=600).collect()} == want
    found = {x.doc_id for x in substring_dedup.repeated_passages(frame).collect()}
    assert found == set(range(1, 120))


def brute_windows(docs, least):
    """Words (by document and place) of every run of ``least`` words that stands earlier."""
    seen, out = set(), set()
    for d, t in sorted(docs):
        w = lower(t).split()
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            if key in seen:
                out |= {(d, j) for j in range(i, i + least)}
            seen.add(key)
    return out


def test_passages_cut_anywhere(spark):
    r = random.Random(5)
    say = lambda n: [f"é{r.randrange(10**6)}" + r.choice(("", "", "", ".", '."')) for _ in range(n)]
    bare = [f"w{i}" for i in range(90)]
    docs = []
    for i in range(80):
        a = r.randrange(40)
        part = (bare if i % 2 else docs[r.randrange(i)][1].split() if i else bare)[a : a + r.randint(29, 50)]
        docs.append((i, " ".join(say(r.randint(0, 40)) + part + say(r.randint(0, 60)))))
    docs += [(80, "a " * 100), (81, "b c d e f g h " * 12), (82, " ".join(bare * 2)), (83, " ".join(bare[:29]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got, texts = set(), dict(docs)
    for x in substring_dedup.repeated_passages(frame, percent=100).collect():
        text = texts[x.doc_id]
        before = len(text[: x.start].split())
        got |= {(x.doc_id, before + j) for j in range(len(text[x.start : x.end].split()))}
    assert got == brute_windows(docs, 30)
