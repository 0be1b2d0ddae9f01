import random
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import shingle_links, simhash_balls
from tessera.llm.common import Scratch

WORDS = 5


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)} if len(w) >= WORDS else {tuple(w)} if w else set()


def brute_kept(rows):
    """Least doc_id of each component of: fingerprints within 4 bits, or similarity 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    prints = simhash_balls.fingerprints([(t or "").encode() for _, t in rows], WORDS)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    similar = 0
    for i in range(len(rows)):
        near = np.bitwise_count(prints[:i] ^ prints[i]) <= 4
        for j in range(i):
            both = len(sets[i] & sets[j])
            alike = bool(sets[i]) and bool(sets[j]) and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)
            similar += alike and not near[j]
            if alike or near[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values()), similar


def edited(rng, words, share):
    return [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in words]


def planted(rng):
    """Edited copies in chains and stars, one passage in many documents, short texts, nulls."""
    texts = [None, "", " \n", "a b", "A  b", "a b c d e", "a b c d e f", "long " * 3000]
    passage = [f"p{k}" for k in range(40)]
    for k in range(12):
        source = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 200]))]
        chain = source
        for _ in range(6):
            chain = edited(rng, chain, 0.02)
            texts += [" ".join(chain), " ".join(edited(rng, source, 0.015))]
        texts += [" ".join(passage + [f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 9, 30]))]) for _ in range(6)]
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_documents(spark, seed):
    rows = planted(random.Random(seed))
    want, similar = brute_kept(rows)
    assert similar > 20  # links that fingerprints alone don't give
    df = spark.createDataFrame([(d, t, "h", 1) for d, t in rows], "doc_id bigint, text string, h string, uid int")
    got = simhash_balls.keep_first(df, words=WORDS, similar_sets=True)
    assert got.columns == df.columns
    assert {r["doc_id"] for r in got.collect()} == want


def test_kept_of_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want, _ = brute_kept([tuple(r) for r in docs.collect()])
    assert {r["doc_id"] for r in simhash_balls.keep_first(docs, words=WORDS, similar_sets=True).collect()} == want


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash_balls.keep_first(empty, words=WORDS, similar_sets=True).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a b c d e f"), (3, None)], "doc_id bigint, text string")
    assert sorted(map(tuple, simhash_balls.keep_first(nulls, words=WORDS, similar_sets=True).collect()), key=str) == [(3, None), (None, "a b c d e f")]


ALPHA, BETA = "zz alpha " + " ".join(f"a{k}" for k in range(30)), "beta " + " ".join(f"b{k}" for k in range(30))


@pytest.mark.parametrize("similar", [False, True])
def test_repeated_and_missing_ids(spark, similar):
    """One row of each class stays, whichever ids its rows share with others."""
    rows = [(1, ALPHA, "x"), (1, BETA, "y"), (0, BETA, "y"), (0, BETA, "y"), (None, ALPHA, "z"), (None, "gamma", "z"), (None, "gamma", "z"), (7, ALPHA + "  ", "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key_0 string").withColumnRenamed("key_0", "own_id")
    got = simhash_balls.keep_first(df, words=WORDS, similar_sets=similar)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, ALPHA, "x"), (0, BETA, "y"), (None, "gamma", "z")], key=str)


def test_components_over_tasks(spark):
    """Chains, stars and cycles over several tasks against union-find."""
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(50)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in simhash_balls.components(df, Scratch(spark, "test"), task_links=20).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}


def test_hubs_in_rounds(spark, monkeypatch):
    """More members of one place than a round has hubs: no link between those left apart is lost."""
    monkeypatch.setattr(shingle_links, "MORE_HUBS", 2)
    rng, texts = random.Random(5), []
    for k in range(24):
        own = [f"s{k}x{j}" for j in range(rng.choice([20, 24, 28]))]
        texts += [" ".join(["p0 p1 p2 p3 p4 p5", *own]), " ".join(["p0 p1 p2 p3 p4 p5", *own[:-1], "end"])]
    rows = list(enumerate(texts))
    want, _ = brute_kept(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in simhash_balls.keep_first(df, words=WORDS, similar_sets=True).collect()} == want


def test_row_groups_of_tables(spark, tmp_path):
    """A task holds a whole row group, so that those of written sets stay small, however long the sets."""
    texts = [" ".join(f"{k}x{j}" for j in range(12000)) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    scratch = Scratch(spark, "groups")
    scratch.keep(shingle_links.sets_of(docs, "doc_id", "text", WORDS), "sets")
    found = [pq.ParquetFile(f).metadata for f in Path(scratch.path("sets").removeprefix("file:")).glob("*.parquet")]
    sizes = [m.row_group(k).total_byte_size for m in found for k in range(m.num_row_groups)]
    scratch.close()
    assert sum(sizes) > 20 << 20 and max(sizes) < 16 << 20


def test_long_sets_that_differ_are_never_compared(spark):
    """Long sets with a passage in common are told apart by counts, on which their whole sets needn't meet; similar ones stay a pair."""
    rng = random.Random(9)
    one, other = ([f"w{rng.randrange(10**9)}" for _ in range(6000)] for _ in range(2))
    texts = [" ".join(one), " ".join(one[:300] + other), " ".join(edited(rng, one, 0.01)), " ".join(other)]
    scratch = Scratch(spark, "counted")
    sets = scratch.keep(shingle_links.sets_of(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), "doc_id", "text", WORDS), "sets")
    uid = {r.doc_id: r.uid for r in sets.select("doc_id", "uid").collect()}
    pairs = spark.createDataFrame([(uid[a], uid[b]) for a in range(4) for b in range(a)], "x bigint, y bigint")
    # Parities let all pass.
    assert shingle_links._allowed(pairs, sets).count() == 6
    got = shingle_links._counted(pairs, sets.select("uid"), sets).collect()
    assert {frozenset((r.x, r.y)) for r in got} == {frozenset((uid[0], uid[2])), frozenset((uid[1], uid[3]))}
    scratch.close()


def test_bytes_of_emission():
    """A print costs 8 bytes a bucket, not some for each of its values."""
    prints, ball = np.random.default_rng(4).integers(0, 1 << 63, 1000, dtype=np.uint64), simhash_balls.masks(2)
    sent = sum(len(p) for k in range(4) for _, p in simhash_balls._emit(prints, ball, k, 4, 64))
    assert sent < 1000 * 8 * 4 * 64 * 1.01
