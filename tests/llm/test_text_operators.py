"""Each operator against brute force, on small and awkward inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import bpe_prefix, common, exact_fingerprint, gif_media, packing, quality_crf, simhash_balls, suffix_dedup, token_counts, token_store, toxic_mil, vocab
from tessera.llm.common import Scratch
from tessera.llm.text_kernels import auc
from tessera.llm.vocab import library, library_ids, pattern, read_ranks, vocabulary

SF = "/root/testdata/sf0.01"
AWKWARD = [None, "", " ", "  a  b ", "a\n\n b\n", "x <|endoftext|> y", "<|startoftext|>Hi<|EndOfText|>", "café ñandú Ünï  İstanbul ΣΑΣ", "é ä́", "日本語 テスト 한국어", "it's we'll I'D don't 123 4567", "\t\ttab nb x \x1c y\x1fz \u0085 q", "a" * 3000, "ab" * 300 + " " + "!" * 99, "😀😀 👨‍👩‍👧 z", "x\x1cy \x1d", "\n", " a", "a ", "a b c d", "a b c d"]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i if i else None, t, "ids", 1, "spans") for i, t in enumerate(AWKWARD)], "doc_id long, text string, ids string, n_tokens int, spans string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_prefix_bpe(awkward, docs):
    import tiktoken

    for df in (awkward, docs.limit(200)):
        enc = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=read_ranks(vocabulary(bpe_prefix.VOCABULARY)), special_tokens={})
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in bpe_prefix.encode_digests(df).collect():
            ids = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4")
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    back = bpe_prefix.decode_ids(bpe_prefix.encode_texts(awkward)).collect()
    assert Counter(bytes(r.data).decode() for r in back) == Counter(t or "" for t in AWKWARD)


def test_prefix_edits():
    bpe, rng = bpe_prefix.codec(vocabulary(bpe_prefix.VOCABULARY)).bpe, random.Random(1)
    data = "".join(rng.choices("abcdeth in", k=300)).encode()
    state = bpe_prefix.PrefixState(bpe, data)
    for _ in range(40):
        a = rng.randrange(len(state.data))
        z, new = min(len(state.data), a + rng.randrange(5)), "".join(rng.choices("abcdeth", k=rng.randrange(5))).encode()
        state.edit(a, z, new)
        data = data[:a] + new + data[z:]
        assert state.data == data and state.ids == bpe.encode(data)
    state.append(b" tail")
    assert state.ids == bpe.encode(data + b" tail")


def test_counts(awkward, docs):
    lib = library(vocabulary(token_counts.VOCABULARY))
    for df in (awkward, docs.limit(200)):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in token_counts.count_tokens(df).collect():
            t = texts[r.doc_id]
            n = len(lib.encode(t, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 2048)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_library_ids(name):
    path = vocabulary(name)
    for t in AWKWARD:
        assert np.frombuffer(library_ids(path)(t), "<u4").tolist() == library(path).encode(t or "", add_special_tokens=False).ids, t


def test_words_are_merged_once():
    path = vocabulary(packing.VOCABULARY)
    ids, runs = vocab.LibraryIds(path), Counter()
    piece = ids.by.merges.piece
    ids.by.merges.piece = lambda word: runs.update([word]) or piece(word)
    text = "Zyxgluon zyxgluon ZYXGLUON, (zyxgluon) zyxgluon's " * 5000  # of many stretches
    for t in (text, text + "日本 zyxgluon.", "<|endoftext|>" + text, "zyxgluon " * 40 + "日本" * 9000, "日本" * 9000 + " Zyxgluon" * 3000 + " — zyxgluon"):
        assert np.frombuffer(ids(t), "<u4").tolist() == library(path).encode(t, add_special_tokens=False).ids
    assert set(runs.values()) == {1}


def test_plain_words():
    rng, by = random.Random(5), vocab.split_regex(vocab.WORD_SPLIT)
    plain, common_ones = [chr(i) for i in range(0x250)], "aZé09²½'' \t\n\x1c\x85\xa0.,<stredvml"
    for _ in range(300):
        t = "".join(rng.choices(plain, k=150) + rng.choices(common_ones, k=150)).lower()
        assert vocab.plain_words().findall(t) == by.findall(t)
    t = "".join(rng.choices("abc  \n", k=500))
    assert " ".join(vocab.stretches(t, 7)) == t and max(map(len, vocab.stretches("ab " * 50, 7))) == 8
    assert [*vocab.stretches("", 7)] == [""] and [*vocab.stretches("a" * 50 + " ", 7)] == ["a" * 50, ""]


def test_fingerprints(spark, awkward):
    rows = [(1, "Ａbc  Straße x\n"), (2, "abc strasse x"), (3, None), (4, "  "), (5, "é É"), (6, "é é"), (7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.copies) for r in exact_fingerprint.fingerprints(df).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[5] == got[6] and len({v for v, _ in got.values()}) == 4
    # Colliding digests are told apart by their bytes.
    same = lambda c: exact_fingerprint.F.lit("0")
    weak = exact_fingerprint.fingerprints(df, digest_of=same)
    assert len({r.fingerprint for r in weak.collect()}) == 4
    # ... in both columns by one rule, so that equal texts have equal fingerprints.
    both = {r.doc_id: r for r in exact_fingerprint.edited_neighbours(df, digest_of=same).collect()}
    assert both[3].fingerprint == both[3].edited_fingerprint == both[4].fingerprint and both[7].fingerprint == both[7].edited_fingerprint
    assert both[1].fingerprint == both[2].fingerprint != both[1].edited_fingerprint
    out = {r.doc_id: r for r in exact_fingerprint.edited_neighbours(df).collect()}
    order = sorted(rows, reverse=True)
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (out[d].n_chars, out[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert out[d].near_next == float(got[d][0] == got[order[(i + 1) % len(order)][0]][0])
    assert exact_fingerprint.edited_neighbours(df.limit(0)).count() == 0
    assert exact_fingerprint.edited_neighbours(awkward).count() == len(AWKWARD)


def test_next_over_ranges(spark):
    df = spark.createDataFrame([(i * 7, str(i), i) for i in range(500)], "doc_id long, text string, key long")
    got = {r.doc_id: r.next_text for r in exact_fingerprint.with_next(df, ["text"], bucket_rows=20).collect()}
    assert got == {i * 7: str((i - 1) % 500) for i in range(500)}
    # A frequent id and missing ids are dealt over several ranges by the hash; the whole is still one circle.
    rows = [(5 if i % 3 else None if i % 2 else i, str(i), (i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) - (1 << 63)) for i in range(600)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    got = {r.text: r.next_text for r in exact_fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string, key long"), ["text"], bucket_rows=20).collect()}
    follows = {a[1]: b[1] for a, b in zip(order, [*order[1:], order[0]])}
    assert set(got) == set(follows) and sorted(got.values()) == sorted(follows.values())
    assert {k: v for k, v in got.items() if rows[int(k)][0] not in (5, None)} == {k: v for k, v in follows.items() if rows[int(k)][0] not in (5, None)}
    seen, at = set(), order[0][1]
    while at not in seen:
        seen.add(at)
        at = got[at]
    assert len(seen) == 600


def test_canonical_of_tables(spark, docs):
    """Against Python's own normalisation and case folding, over whole tables."""
    import re
    import unicodedata

    pages = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("html AS text")
    rows = docs.select("text").unionByName(pages).unionByName(spark.createDataFrame([(t,) for t in AWKWARD], "text string"))
    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    for r in rows.select("text", exact_fingerprint.canonical(rows["text"]).alias("canon")).collect():
        plain = nfkc(nfkc(r.text or "").casefold())
        assert r.canon == re.sub("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ", plain).strip(" ")


def test_lzw_round_trips():
    r = np.random.default_rng(0)
    for data in (b"", b"a", b"ab" * 5000, *(bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (1, 3837, 3838, 3839, 7676, 7677, 20000)), bytes(r.integers(0, 2, 90000, dtype=np.uint8))):
        assert gif_media.lzw_decode(gif_media.lzw_encode(data), 8, len(data) + 1) == data


def test_gif_rendering():
    red_green_blue = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    frames = [gif_media.Frame(np.zeros((3, 4), np.uint8), delay_ms=100), gif_media.Frame(np.array([[1, 3], [1, 1]], np.uint8), 1, 1, 50, gif_media.TO_BACKGROUND, 3), gif_media.Frame(np.full((3, 1), 2, np.uint8), 0, 0, 20, gif_media.TO_PREVIOUS, None, None, True), gif_media.Frame(np.full((1, 1), 1, np.uint8), 3, 0)]
    shown = list(gif_media.decode(gif_media.encode(gif_media.Gif(4, 3, red_green_blue, 0, frames))).rendered())
    assert [t for t, _ in shown] == [0, 100, 150, 170]
    assert shown[1][1][1, 2].tolist() == [255, 0, 0, 255] and shown[1][1][2, 2].tolist() == [0, 255, 0, 255]  # transparent, then green
    assert not shown[2][1][1:3, 1:3].any() and shown[2][1][0, 0].tolist() == [0, 0, 255, 255]  # cleared; blue column
    assert shown[3][1][0, 0].tolist() == [255, 0, 0, 255]  # the column is gone again


def test_media(spark, awkward):
    out = gif_media.store_texts(awkward)
    for r in out.collect():
        raw = (AWKWARD[r.doc_id or 0] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
    frames = gif_media.frames_of(out)
    assert frames.filter("error IS NULL AND opaque = width * height").count() >= len(AWKWARD)


def foreign_gif(width, height, colours, indices, least=2):
    """A GIF as another encoder would write it: a clear code before every sample, so that no code is ever added."""
    bits = "".join(f"{c:0{least + 1}b}"[::-1] for i in indices for c in (1 << least, i)) + f"{(1 << least) + 1:0{least + 1}b}"[::-1]
    data = bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    blocks = b"".join(bytes([len(p)]) + p for p in (data[k : k + 100] for k in range(0, len(data), 100)))
    screen = width.to_bytes(2, "little") + height.to_bytes(2, "little")
    return b"GIF87a" + screen + b"\x91\0\0" + bytes(colours) + b"\x2c" + bytes(4) + screen + b"\0" + bytes([least]) + blocks + b"\0;"


def test_foreign_and_broken_gifs(spark):
    rng = random.Random(9)
    indices = [rng.randrange(4) for _ in range(60 * 60)]
    good = foreign_gif(60, 60, range(12), indices)
    gif = gif_media.decode(good)
    assert gif.frames[0].indices.reshape(-1).tolist() == indices and not gif.frames[0].missing
    cut = gif_media.decode(good[:400])
    assert cut.frames[0].missing > 0
    assert cut.frames[0].indices.reshape(-1)[: 3600 - cut.frames[0].missing].tolist() == indices[: 3600 - cut.frames[0].missing]
    with pytest.raises(ValueError):
        gif_media.restore(gif_media.store(b"x" * 5760)[:-20])
    size = good.index(b"\x2c") + 10
    broken = {"magic": b"PNG" + good[3:], "code size": good[:size] + b"\x0b" + good[size + 1 :], "canvas": good[:6] + b"\xff" * 4 + good[10:], "head": good[:9], "block": good[: size - 10] + b"\x77" + good[size - 9 :], "cut": good[:400]}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in broken.items()] + [("null", None), ("good", bytearray(good))], "doc_id string, media binary")
    got = {r.doc_id: r for r in gif_media.frames_of(rows).collect()}
    assert set(got) == {*broken, "good"} and got["good"].error is None and got["good"].opaque == 3600
    assert all(got[k].error and got[k].frame is None for k in broken if k != "cut") and "missing" in got["cut"].error and got["cut"].frame == 0
    for _ in range(300):  # whatever bytes come: frames or ValueError
        raw = bytearray(good)
        for _ in range(rng.randrange(1, 6)):
            raw[rng.randrange(6, len(raw))] = rng.randrange(256)
        try:
            gif_media.decode(bytes(raw[: rng.randrange(6, len(raw))]))
        except ValueError:
            pass


def brute_prints(texts, words=4):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def test_simhash(spark, awkward, docs):
    for df, key in ((awkward, lambda r: r.doc_id), (docs.limit(300), lambda r: r.doc_id)):
        rows = df.collect()
        prints = brute_prints([r.text for r in rows])
        root = list(range(len(rows)))
        find = lambda i: i if root[i] == i else find(root[i])
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    root[find(i)] = find(j)
        least = {}
        for i, r in enumerate(rows):
            if r.doc_id is not None:
                least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
        expected = Counter((r.doc_id, f"{prints[i]:016x}", least.get(find(i))) for i, r in enumerate(rows))
        assert Counter(tuple(r) for r in simhash_balls.classes(df).collect()) == expected
    assert simhash_balls.classes(docs.limit(0)).count() == 0


def test_simhash_planted_pairs():
    r = np.random.default_rng(1)
    prints = {int(x) for x in r.integers(0, 1 << 63, 200, dtype=np.uint64)}
    for x in list(prints):
        for _ in range(r.integers(0, 5)):
            y = x
            for bit in r.choice(64, r.integers(0, 7), replace=False):
                y ^= 1 << int(bit)
            prints.add(y)
    p, ball = np.array(sorted(prints), np.uint64), simhash_balls.masks(2)
    edges = []
    for k in range(4):
        by = {}
        for at in range(0, len(p), 300):
            for b, payload in simhash_balls._emit(p[at : at + 300], ball, k, 4, 3):
                by.setdefault(b, []).append(payload)
        edges += [simhash_balls._meet(v, ball, 4) for v in by.values()]
    place = {int(x): i for i, x in enumerate(p)}
    a, b = ([place[int(x)] for e in edges for x in e[k]] for k in (0, 1))
    i, j = np.nonzero(np.bitwise_count(p[:, None] ^ p[None, :]) <= 4)
    assert (simhash_balls._forest(np.array(a), np.array(b), len(p)) == simhash_balls._forest(i, j, len(p))).all()


def test_token_store(spark, awkward, docs):
    lib = library(vocabulary(token_store.VOCABULARY))
    for df in (awkward, docs.limit(100), docs.limit(0)):
        scratch = Scratch(spark, "test")
        token_store.write_store(spark, df, scratch)
        got = sorted(token_store.read_store(spark, scratch).collect(), key=lambda r: r.start)
        rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
        at = 0
        for r, g in zip(rows, got, strict=True):
            ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
            assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32, bytes(g.ids)) == (r.doc_id, at, len(ids) // 4, zlib.crc32(ids), ids)
            at += g.n_tokens


def test_code_lengths():
    for counts in (np.array([0, 5, 0]), np.array([1, 1, 2, 4, 8, 16, 32, 64, 128]), np.arange(3000)):
        lengths = token_store.code_lengths(counts, 12)
        assert lengths.max() <= 12 and ((lengths > 0) == (counts > 0)).all()
        assert (counts > 0).sum() == 1 or abs((0.5 ** lengths[lengths > 0].astype(float)).sum() - 1) < 1e-12


def test_packing(awkward, docs):
    lib = library(vocabulary(packing.VOCABULARY))
    for df in (awkward, docs.limit(200)):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        rows = packing.pack_documents(df).collect()
        by_doc, by_sequence = {}, {}
        for r in rows:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_sequence.setdefault(r.sequence_id, []).append(r)
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        for d, t in texts.items():
            parts = sorted(by_doc[d], key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in parts) == np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
            assert {r.doc_tokens for r in parts} == {sum(r.length for r in parts)}
        for parts in by_sequence.values():
            at = 0
            for r in sorted(parts, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 4096
    assert all(len(r.ids) in (4 * 4096, 4 * r.length) for r in packing.sequences(packing.pack_documents(awkward)).collect())
    got = packing.padding(packing.pack_documents(docs, with_ids=False)).first()
    assert got.tokens > 200 * 4096 and got.share < 0.02


def test_best_fit_is_tightest():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 101, 400)
    where, offset, n = packing.best_fit_decreasing(sizes, 100)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            room[room.index(min(fits))] -= sizes[i]
        else:
            room.append(100 - sizes[i])
    filled = np.bincount(where, sizes, n)
    assert sorted(100 - filled) == sorted(room)


def brute_removal(texts, m=200):
    raw = [(t or "").encode() for t in texts]
    c = Counter(r[i : i + m] for r in raw for i in range(len(r) - m + 1))
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - m + 1):
            if c[r[i : i + m]] > 1:
                gone[i : i + m] = b"\1" * m
        runs = sum(1 for i in range(len(r)) if gone[i] and (not i or not gone[i - 1]))
        yield len(r), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(r, gone) if not g)).hexdigest()


@pytest.mark.parametrize("bucket", [1_000_000, 3000])
def test_suffixes(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    passages = [" ".join(rng.choices(words, k=rng.randint(20, 120))) for _ in range(10)]
    texts = [*AWKWARD, "x" * 199, "De " * 500]
    for _ in range(80):
        t = " ".join(rng.choices(words, k=rng.randint(1, 200)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            t += " " + p[a : a + rng.randint(100, 800)] + " " + " ".join(rng.choices(words, k=rng.randint(0, 40)))
        texts.append(t)
    texts += [texts[40], texts[40][:150] + "Z" + texts[40][150:]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removal_digests(df).collect()}
    assert got == dict(enumerate(brute_removal(texts)))
    cut = {r.doc_id: r for r in suffix_dedup.cut_texts(df).collect()}
    assert cut[0].text is None and cut[0].spans == "x" and all(len((cut[i].text or "").encode()) <= got[i][0] - got[i][1] for i in got)
    twice = spark.createDataFrame([(1, texts[45]), (1, texts[45]), (None, texts[46])], "doc_id long, text string")
    assert Counter(tuple(r)[1:] for r in suffix_dedup.removal_digests(twice).collect()) == Counter(brute_removal([texts[45], texts[45], texts[46]]))
    assert suffix_dedup.removal_digests(df.limit(0)).count() == 0


def test_places_of_a_frequent_line_meet_in_their_slice(spark, monkeypatch):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choices("abcde", k=5)) for _ in range(n))
    line, copied = words(15), words(60)
    texts = [f"{words(30)} {line * 60}{words(rng.randint(1, 50))}" for _ in range(12)] + [f"{words(9)} {copied} {words(9)}" for _ in range(3)]
    rows = {}

    def keep(self, df, name, held=common.Scratch.keep, **options):
        out = held(self, df, name, **options)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(common.Scratch, "keep", keep)
    # The second has rows of one doc_id and text in slices with other neighbours.
    for df in (list(enumerate(texts)), [(i, t) for i in (3, 12, 3, 14, 3) for t in (texts[i],)]):
        got = suffix_dedup.removal_digests(spark.createDataFrame(df, "doc_id long, text string").repartition(3)).collect()
        assert Counter(tuple(r)[1:] for r in got) == Counter(brute_removal([t for _, t in df]))
        assert 0 < rows["shared"] < 10 * len(df) and 0 < rows["whole"] < 10 * len(df)


def test_multikey_quicksort():
    keys = np.random.default_rng(5).integers(0, 40, (20000, 2))
    order = suffix_dedup.multikey_quicksort(keys, small=50)
    assert (keys[order] == keys[np.lexsort((keys[:, 1], keys[:, 0]))]).all() and sorted(order) == list(range(20000))


@pytest.mark.parametrize("module, label, least", [(quality_crf, "quality", 0.95), (toxic_mil, "toxic", 0.7)])
def test_classifiers(spark, docs, labels, awkward, module, label, least):
    model = module.learn(docs, labels, label)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    rows = [r for r in module.score(docs, model).collect() if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert auc(np.array([truth[r.doc_id] for r in rows]), np.array([r.score for r in rows])) >= least
    some = module.score(awkward, model).collect()
    assert len(some) == len(AWKWARD) and all(0 <= r.score <= 1 for r in some)
    assert module.score(docs.limit(0), model).count() == 0
    nobody = module.learn(docs, labels.limit(0), label)
    assert {round(r.score, 9) for r in module.score(awkward, nobody).collect()} == {0.5}


def test_chain_marginals():
    """Forward-backward against all labellings."""
    rng = np.random.default_rng(6)
    field = quality_crf.LineField(np.zeros(1), rng.normal(size=(2, 2)), 0.0)
    lines = np.array([3, 1, 4])
    good = rng.normal(size=8)
    p, _, _ = field.marginals(good, lines)
    at = 0
    for n in lines:
        weight = np.zeros(n)
        total = 0.0
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(good[at + k] * y[k] for k in range(n)) + sum(field.steps[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            weight += w * np.array(y)
        assert np.allclose(p[at : at + n], weight / total)
        at += n


def test_chain_gradient():
    """The gradient of the line field's objective against finite differences, on chains of unequal length."""
    rng = np.random.default_rng(8)
    lines = np.array([3, 1, 7, 2])
    features = rng.integers(-1, quality_crf.FEATURES, (lines.sum(), 5))
    features[features < 0] = 0
    y, theta = np.array([1.0, 0, 1, 0]), rng.normal(size=quality_crf.FEATURES + 5) / 3
    _, g = quality_crf.objective(theta, features, lines, y, 0.1)
    for k in [*sorted(set(features[:, 0]))[:4], *range(quality_crf.FEATURES, len(theta))]:
        step = np.zeros_like(theta)
        step[k] = 1e-5
        up, down = (quality_crf.objective(theta + s * step, features, lines, y, 0.1)[0] for s in (1, -1))
        assert abs((up - down) / 2e-5 - g[k]) < 1e-7
    # The likelihood itself, by all labellings.
    field, at, total = quality_crf._field(theta), 0, 0.0
    good = field.emissions(features)
    for n, label in zip(lines, y):
        paths = [sum(good[at + k] * (c >> k & 1) for k in range(n)) + sum(field.steps[c >> k - 1 & 1, c >> k & 1] for k in range(1, n)) for c in range(1 << n)]
        total += (paths[-1 if label else 0] - np.log(np.exp(paths).sum())) / np.sqrt(n)
        at += n
    assert np.isclose(quality_crf.objective(theta, features, lines, y, 0.0)[0], total / sum(np.sqrt(n) for n in lines))


def test_noisy_or():
    """Document scores and the gradient by plain loops over sentences and finite differences."""
    rng = np.random.default_rng(9)
    texts = [t.encode() for t in ("Bad grum here. Fine. So grum, so vile!", "All fine. Nothing else.", "vile grum", "", "Fine?\nvile. Vile. ok")]
    hashes = toxic_mil.bags([b"grum vile"])[0][:, -1]
    model = toxic_mil.SentenceModel(np.sort(hashes), rng.normal(size=2) + 1, -2.5)
    weight = dict(zip(np.sort(hashes).tolist(), model.weights))
    for t, got in zip(texts, model.scores(texts)):
        clean = 1.0
        for sentence in __import__("re").split(r"[.!?\n]", t.decode().lower()):
            held = {int(h) for h in toxic_mil.bags([sentence.encode()])[0][:, -1]} & set(weight)
            if held:
                clean *= 1 - 1 / (1 + np.exp(-(sum(weight[h] for h in held) - 2.5)))
        assert np.isclose(got, 1 - clean)
    where, what, doc, y = np.array([0, 0, 1, 2, 3]), np.array([0, 1, 1, 2, 0]), np.array([0, 0, 1, 2]), np.array([1, 1, 0, 1])
    theta = rng.normal(size=3)
    _, g = toxic_mil.objective(theta, -1.0, where, what, doc, 4, y)
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        up, down = (toxic_mil.objective(theta + s * step[:3], -1.0 + s * step[3], where, what, doc, 4, y)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - g[k]) < 1e-7


def test_offending_sentences():
    texts = [f"Some words here. You are a grumbol indeed {k}. More words." if k % 3 == 0 else f"Some words here. You are a friend indeed {k}. More words." for k in range(300)]
    model = toxic_mil.fit(texts, [int(k % 3 == 0) for k in range(300)])
    found = model.offending("All fine here. What a grumbol you are. Fine again.")
    assert [(a, b) for a, b, _ in found] == [(14, 37)]
