"""The training-data operators against brute force, SQL and the tokenizers' own libraries, with odd rows of every kind."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from quillmark.llm import bpe, embedding_dedup, exact_dedup, html_extract, minhash_dedup, packing, suffix_dedup, token_counts, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _kept string, _spans int, _digest string, id int, key string, part int, rank int, comp int"


def _texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("the an in er on st ing é ß 日".split()) for _ in range(rng.randrange(1, 4)))
    base = [" ".join(word() for _ in range(rng.randrange(1, 160))) for _ in range(40)]
    shared = "This very passage of more than fifty bytes stands in many of the texts here. "
    out = [None, "", " \t\n", "one", "a b c d e", "a b c d e", "A b c d\te", "  double  blanks \n and lines ", "x" * 3000, "<|endoftext|> it's 12 ½ ²", "\U0001f600 é \u0000 \x1c z"]
    out += base + base[:5] + [b + " more" for b in base[:10]] + [shared + b for b in base[10:20]] + [b[:len(b) // 2] + shared + b[len(b) // 2:] for b in base[20:30]]
    long = " ".join(word() for _ in range(6000))
    out += [long, long + " end", long.replace(" ", "  ")]
    for b in base[30:36]:  # near copies: a word changed in every twenty-five
        w = b.split(" ")
        out.append(" ".join("zz" if i % 25 == 7 else x for i, x in enumerate(w)))
    return out


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(_texts()))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1, "clash", 2, "clash", 3, 4, 5) for i, t in texts.items()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _by(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_bpe_as_the_library(docs, none, texts):
    import tiktoken

    with open(P.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = _by(bpe.round_trip(docs))
    for i, t in texts.items():
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ref.encode_ordinary(t or "")
        assert bytes(got[i]["decoded"]) == (t or "").encode()
    assert bpe.round_trip(none).count() == 0


def test_bpe_long_words_merge_alike():
    import tiktoken

    codec = bpe.codec(P.path(bpe.VOCABULARY), P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    words = ["".join(rng.choice("theainrs") for _ in range(n)) for n in (2, 3, 17, 64, 255)]
    assert codec.merge_matrix([w.encode() for w in words]) == [codec.merge_long(w.encode()) for w in words]
    words += ["".join(rng.choice(a) for _ in range(n)) for n in (257, 1000, 20_000) for a in ("a", "ab", "theainrs ", "aé日😀")] + ["=" * 100_001, "ab" * 3000 + "a"]
    for w in words:
        assert np.frombuffer(codec.merge_long(w.encode()), "<u4").tolist() == ref.encode_ordinary(w)


def test_bpe_of_repeated_and_missing_ids(spark):
    rows = [(1, "w " * 9), (1, "w " * 9), (None, "q" * 600), (2, None)]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in got) == sorted((str(i), t or "") for i, t in rows)


def test_packing(docs, none, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(packing.VOCABULARY))
    rows = packing.packed(docs).toPandas()
    for i, g in rows.sort_values("piece").groupby("doc_id"):
        ids, at = tok.encode(texts[i] or "", add_special_tokens=False).ids + [0], 0
        for r in g.itertuples():
            part = ids[r.start:r.start + r.length]
            assert r.start == at and r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and (r.piece == 0 or r.length == 2048)
            at += r.length
        assert at == len(ids)
    assert set(rows.doc_id) == set(texts)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.concatenate([[0], g.length.cumsum()[:-1]]).tolist() and g.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 2048) + 1
    assert packing.packed(none).count() == 0
    assert packing.packed(none).columns == packing.packed(docs).columns


def test_packing_of_repeated_rows_ties_and_added_tokens(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(packing.VOCABULARY))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "a <|endoftext|>", "é<|endoftext|> é", "<|endoftext", "same length", "same lengths"] * 3
    rows = [(i % 5 if i % 4 else None, t, 7, 8) for i, t in enumerate(texts)] + [(9, None, 1, 2)] * 4 + [(9, "w " * 5000, 1, 2)] * 2
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, rank int, sequence_id int")).toPandas()
    want = []
    for i, t, _, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        for k, at in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[at:at + (first if k == 0 else 2048)]
            want.append((-1 if i is None else i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(want) == sorted((-1 if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.concatenate([[0], g.length.cumsum()[:-1]]).tolist() and g.length.sum() <= 2048


def test_packing_splits_as_the_library_at_every_code_point():
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(P.path(packing.VOCABULARY)), packing.encoder(P.path(packing.VOCABULARY))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 50_000):
        some = [f"a{c}b 1{c}2 {c}{c} '{c}s\n{c} {c}x  {c}" for c in points[k:k + 50_000]]
        for x, e, ids in zip(some, tok.encode_batch_fast(some, add_special_tokens=False), encode(some)):
            assert np.array(e.ids, "<u4").tobytes() == ids, x


def _rounds(lengths, capacity):
    """The sweeps' rounds one gap at a time: {sequence: pieces}, rounds."""
    waiting, held, rounds, placed, ranks = {n: lengths.count(n) for n in set(lengths)}, [], 0, {}, set()
    while waiting:
        free = {}
        for h in held:
            free[capacity - sum(h)] = free.get(capacity - sum(h), 0) + 1
        free.pop(0, None)
        entries, more = packing.sweep(waiting, free, capacity, placed)
        held += [[] for _ in range(more)]
        by = {}
        for h in held:
            by.setdefault(capacity - sum(h), []).append(h)
        seen = set()
        for gap, first, many, runs in entries:
            for k in range(first, first + many):
                assert (gap, k) not in seen
                seen.add((gap, k))
                by[gap][k] += [n for n, _, take in runs for _ in range(take)]
            for n, rank, take in runs:
                own = {(n, rank + x) for x in range(take * many)}
                assert not own & ranks
                ranks |= own
                waiting[n] -= take * many
                placed[n] = placed.get(n, 0) + take * many
        waiting = {n: k for n, k in waiting.items() if k}
        rounds += 1
    assert ranks == {(n, k) for n in set(lengths) for k in range(lengths.count(n))}
    return held, rounds


def test_packing_rounds_are_as_good_as_best_fit_decreasing():
    rng = random.Random(2)
    for top in (100, 100, 60, 30, 12) * 4:
        lengths = [rng.randrange(1, top + 1) for _ in range(rng.randrange(1, 400))]
        held, rounds = _rounds(lengths, 100)
        assert sorted(n for h in held for n in h) == sorted(lengths) and all(0 < sum(h) <= 100 for h in held)
        gaps = []  # one by one
        for n in sorted(lengths, reverse=True):
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - n)
            else:
                gaps.append(100 - n)
        assert len(held) <= len(gaps) * 1.03 + 1 and rounds <= 20


def _shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_dedup(docs, none, texts):
    sets = {i: _shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = _by(minhash_dedup.near_dedup(docs))
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in sets}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert minhash_dedup.near_dedup(none).count() == 0
    kept = minhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in sets if find(i) == i}


def test_near_dedup_beyond_the_bound_and_of_odd_ids(spark, docs, texts, monkeypatch):
    """Salted joins and distributed labels in place of broadcasts and one task; repeated and null ids."""
    from quillmark.llm import common

    want = sorted(map(tuple, minhash_dedup.near_dedup(docs).collect()))
    for module in (common, minhash_dedup):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "SALTS", 3)
    assert sorted(map(tuple, minhash_dedup.near_dedup(docs).collect())) == want
    monkeypatch.undo()
    one, two = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(5, one), (5, one), (3, one + " more"), (None, one), (7, two), (7, two + " end"), (2, two + " last"), (9, None), (9, "")]
    got = minhash_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [
        ("2", "2", True), ("3", "3", True), ("5", "3", False), ("5", "3", False), ("7", "2", False), ("7", "2", False), ("9", "9", True), ("9", "9", True), ("None", "None", True)]


def test_large_joins_copy_hot_keys_only(spark, monkeypatch):
    """A table over the bound is shuffled as it is; only keys of many rows are copied over salts. A dozen broadcasts, as hash tables of three times their bytes, take less than half of a small driver's heap."""
    from quillmark.llm import common

    assert 12 * 3 * common.BROADCAST_BYTES < 750 << 19
    rows = spark.createDataFrame([(1, k) for k in range(40)] + [(k, 100 + k) for k in range(2, 30)] + [(None, 7)], "k long, v long")
    found = spark.createDataFrame([(k, f"f{k}") for k in range(1, 40, 2)], "k long, f string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, rows.join(found, "k", how).collect()))
        monkeypatch.setattr(common, "HOT_ROWS", 10)
        salted = common.spread(rows, found, 1 << 40, "k", how)
        monkeypatch.setattr(common, "HOT_ROWS", 100)
        plain = common.spread(rows, found, 1 << 40, "k", how)
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect())) == want
        assert "explode" in salted._jdf.queryExecution().toString() and "explode" not in plain._jdf.queryExecution().toString()


def test_sieve_loses_no_match(spark, monkeypatch):
    """Rows that meet none of a large table's keys go before the shuffle, but for a few; a small table will be broadcast."""
    from quillmark.llm import common

    rows = spark.range(200_000).selectExpr("id * 7919 AS key", "id AS v")
    found = common.Kept(spark.range(0, 200_000, 20).selectExpr("id * 7919 AS key"))
    assert common.sifted(rows, found, "key") is rows
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    for most in (common.SLICES, 1):  # one slice is 52 bits a key here
        monkeypatch.setattr(common, "SLICES", most)
        left = common.sifted(rows, found, "key")
        assert left.columns == ["key", "v"] and left.where("v % 20 = 0").count() == 10_000 and left.count() < 12_000
    monkeypatch.setattr(common, "SLICE_BITS", 1 << 12)  # 52 bits a key in many small slices
    monkeypatch.setattr(common, "SLICES", 128)
    left = common.sifted(rows, found, "key")
    assert left.where("v % 20 = 0").count() == 10_000 and left.count() < 14_000


def test_near_dedup_shuffles_bands_once(spark, monkeypatch):
    """Beyond the bound, only bands that two classes share and texts that have a candidate are moved after the count."""
    from quillmark.llm import common

    rng = random.Random(8)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(3000)]
    rows = list(enumerate(texts + [t + " end" for t in texts[:50]]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    assert df.count() == 3050

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}

    for module in (common, minhash_dedup):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # these tables are small enough for Spark's own broadcasts
    try:
        got = _by(minhash_dedup.near_dedup(df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {i for i, r in got.items() if not r["kept"]} == set(range(3000, 3050)) and all(got[3000 + i]["component_id"] == i for i in range(50))
    moved = sum(n for k, n in written().items() if k not in before)
    assert 48 * 3050 <= moved < 2 * 48 * 3050


def test_components_in_rounds(spark, monkeypatch):
    """A chain, a star and loose pairs, by one task and by distributed rounds."""
    from quillmark.llm import common

    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 120)] + [(7, 200 + k) for k in range(50)] + [(300 + 2 * k, 301 + 2 * k) for k in range(20)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(b, a) for a, b in edges] + edges[:9] + [(5, 5)], "a long, b long")
    want = {**{k: 100 for k in range(100, 121)}, **{200 + k: 7 for k in range(50)}, 7: 7, **{300 + k: 300 + k // 2 * 2 for k in range(40)}}
    for most in (10**6, 8):
        monkeypatch.setattr(common, "TASK_EDGES", most)
        assert {r["x"]: r["p"] for r in common.merged_labels(df).df.collect()} == want
    assert common.merged_labels(df.where("a = b")) is None


def test_near_dedup_of_one_hot_group(spark):
    """Edited copies of one text, some of which link only through others."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(0, 9)):
            w[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    sets = {i: _shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    while True:
        new = {a: min(root[b] for b in sets if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])) for a in sets}
        new = {a: min(new[a], root[a]) for a in sets}
        if new == root:
            break
        root = new
    got = _by(minhash_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r["component_id"] for i, r in got.items()} == root


def test_near_dedup_ends_in_few_rounds(spark, monkeypatch):
    """Texts of one family that meet in many buckets and mostly don't link: few tables, and the same rows with and without the round of all pairs."""
    rng = random.Random(9)
    rows = []
    for f in range(8):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for i in range(24):
            w = list(base)
            for k in rng.sample(range(150), rng.randrange(4, 12)):
                w[k] = f"x{rng.randrange(10**9)}"
            rows.append((100 * f + i, " ".join(w)))
    sets = {i: _shingles(t) for i, t in rows}
    near = {a: [b for b in sets if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])] for a in sets}
    want, new = None, {a: a for a in sets}
    while new != want:
        want, new = new, {a: min(new[b] for b in near[a]) for a in sets}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = []

    class Counted(minhash_dedup.Kept):
        def __init__(self, *a, **b):
            made.append(1)
            super().__init__(*a, **b)

    monkeypatch.setattr(minhash_dedup, "Kept", Counted)
    assert {i: r["component_id"] for i, r in _by(minhash_dedup.near_dedup(df)).items()} == want
    assert len(made) <= 36, len(made)
    for name, value in (("ALL_PAIRS", 0), ("HUBS", 4)):  # rounds to the end; then hubs by parts of the ids as well
        monkeypatch.setattr(minhash_dedup, name, value)
        assert {i: r["component_id"] for i, r in _by(minhash_dedup.near_dedup(df)).items()} == want


def test_hyperminhash_estimate():
    rng = np.random.default_rng(4)
    for n, share in ((2000, 0.75), (500, 0.3), (2000, 0.0)):
        both = rng.integers(0, 2**64, n, dtype=np.uint64)
        k = int(n * share)
        a, b = both[: k + (n - k) // 2], np.concatenate([both[:k], both[k + (n - k) // 2:]])
        ra, rb = (minhash_dedup.registers(np.sort(x)) for x in (a, b))
        got, used = minhash_dedup.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))
        assert abs(got[0] - share) < 0.16 and used[0] > 100


def _removed_by_hand(rows):
    """[(bytes left, bytes removed)] of rows (doc_id, text); a null doc_id is the greatest."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k:k + 50]] = min(first.get(b[k:k + 50], 2**63), 2**63 - 1 if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < (2**63 - 1 if i is None else i):
                gone[k:k + 50] = True
        out.append((np.frombuffer(b, np.uint8)[~gone].tobytes(), gone))
    return out


@pytest.mark.parametrize("split", [False, True])
def test_suffix_dedup(docs, none, texts, split, monkeypatch):
    if split:  # ranges in parts, texts across small chunks
        monkeypatch.setattr(suffix_dedup, "SPLITTERS", 3)
        monkeypatch.setattr(suffix_dedup, "SHARE", 2000)
        monkeypatch.setattr(suffix_dedup, "CHUNK", 3000)
    size, spans, kept, _ = suffix_dedup._helpers(docs)
    assert kept == "__kept" and spans == "__spans"
    got = _by(suffix_dedup.removed(docs))
    for i, (left, gone) in zip(texts, _removed_by_hand(texts.items())):
        assert bytes(got[i][kept]) == left and got[i][size] == len(gone) and got[i]["_kept"] == "clash"
        found = [(s["begin"], s["end"]) for s in got[i][spans]]
        assert sum(e - a for a, e in found) == int(gone.sum()) and all(x[1] < y[0] for x, y in zip(found, found[1:]))
    assert suffix_dedup.removed(none).count() == 0
    clean = suffix_dedup.keep_first(docs)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert r["text"] == (bytes(got[r["doc_id"]][kept]).decode("utf-8", "ignore") if got[r["doc_id"]][spans] else texts[r["doc_id"]])


def test_suffix_dedup_of_repeated_and_missing_ids(spark):
    rng = random.Random(12)
    part = ["".join(rng.choice("abcdefgh é") for _ in range(70)) for _ in range(6)]
    rows = [(rng.choice([None, 1, 2, 3, 3]), "".join(rng.sample(part, rng.randrange(0, 4)))) for _ in range(40)] + [(4, None), (None, ""), (5, part[0] * 3)]
    rows = [(*r, k) for k, r in enumerate(rows)]
    got = _by(suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(4)), "row")
    for (i, _, k), (left, _) in zip(rows, _removed_by_hand([r[:2] for r in rows])):
        assert bytes(got[k]["_kept"]) == left, (i, k)


def test_suffix_dedup_across_blocks(spark):
    """Texts of more than a block and a chunk, alike in the middle."""
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shared = word(suffix_dedup.BLOCK * 2)
    rows = [(1, word(1000) + shared), (2, shared[5000:] + word(700) + shared[: suffix_dedup.BLOCK]), (3, word(suffix_dedup.CHUNK)), (4, shared[-60:])]
    got = _by(suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)))
    for (i, _), (left, _) in zip(rows, _removed_by_hand(rows)):
        assert bytes(got[i]["_kept"]) == left


def test_loser_tree():
    rng = random.Random(3)
    runs = []
    for _ in range(7):
        keys = sorted(bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randrange(0, 30)))
        common = [0] + [next((i for i in range(12) if x[i] != y[i]), 12) for x, y in zip(keys, keys[1:])]
        runs.append((keys, common[: len(keys)]))
    order, shares = suffix_dedup.LoserTree(runs).merge()
    at = [0] * len(runs)
    out = []
    for r in order:
        out.append(runs[r][0][at[r]])
        at[r] += 1
    assert out == sorted(k for ks, _ in runs for k in ks)
    assert shares[1:] == [next((i for i in range(12) if x[i] != y[i]), 12) for x, y in zip(out, out[1:])]


def test_exact_dedup(docs, none, texts):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in texts.items()}
    groups = {}
    for i, n in norm.items():
        groups.setdefault(n, []).append(i)
    keep = {n: min(ids, key=lambda i: (-len(texts[i] or ""), i)) for n, ids in groups.items()}
    got = _by(exact_dedup.exact_dedup(docs))
    for i, n in norm.items():
        assert tuple(got[i]) == (i, keep[n], len(groups[n]), keep[n] == i, hashlib.sha256(n.encode()).hexdigest())
    assert exact_dedup.exact_dedup(none).count() == 0
    assert {r["doc_id"] for r in exact_dedup.keep_first(docs).collect()} == set(keep.values())


def test_exact_dedup_beyond_the_bound(spark, docs, texts, monkeypatch):
    """Winners that are too large to be broadcast, with hot groups apart, and texts that share a digest."""
    want = sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()))
    monkeypatch.setattr(exact_dedup.common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact_dedup, "HOT", 3)
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect())) == want
    real = exact_dedup.F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: real(exact_dedup.F.substring(c, 1, 2), n))
    assert sorted(tuple(r)[:4] for r in exact_dedup.exact_dedup(docs).collect()) == [w[:4] for w in want]


def test_exact_dedup_of_repeated_and_missing_ids(spark):
    rows = [(1, "a"), (1, "a"), (2, " a"), (2, "b"), (None, "c"), (None, "c"), (-5, "d"), (3, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(exact_dedup.keep_first(df).collect(), key=str) == sorted([r for r in spark.createDataFrame([(2, " a"), (2, "b"), (None, "c"), (-5, "d")], "doc_id long, text string").collect()], key=str)


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(scale=s, size=(20, 16)) for c, s in zip(centre, np.linspace(0.05, 0.4, 12))])
    rows = [(i, [float(v) for v in np.float32(v)], i % 2) for i, v in enumerate(x)]
    rows += [(1000 + k, rows[0][1], 0) for k in range(5)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, rows[0][1], None), (2004, [None] * 16, 0), (2005, [1.0, 2.0], 0), (2006, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = _by(embedding_dedup.near_duplicates(df), "vec_id")
    assert len(got) == len(rows)
    good = [(i, np.float32(v).astype(float), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    true = found = 0
    for i, a, la in good:
        n = sum(1 for j, b, lb in good if i != j and la == lb and len(a) == len(b) and a @ b / np.sqrt(a @ a * (b @ b)) >= 0.93)
        assert got[i]["n_links"] <= n
        true, found = true + n, found + got[i]["n_links"]
    assert found >= 0.9 * true > 0
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006))


def test_embeddings_recall_by_size_and_odd_rows(spark):
    """Recall of links at several sizes; ties among pivots, repeated and null ids, an empty table."""
    kind = "vec_id long, embedding array<float>, label int, cid int, pivot int"
    for n in (400, 2500):
        rng = np.random.default_rng(n)
        centre = rng.normal(size=(n // 10, 24))
        x = np.float32(np.repeat(centre, 10, axis=0) + rng.normal(scale=0.19, size=(n, 24)))
        rows = [(i, [float(v) for v in r], i % 2, 1, 2) for i, r in enumerate(x)]
        got = _by(embedding_dedup.near_duplicates(spark.createDataFrame(rows, kind)), "vec_id")
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        link = (u @ u.T >= 0.93) & (np.arange(n)[:, None] % 2 == np.arange(n) % 2)
        np.fill_diagonal(link, False)
        want = link.sum(axis=1)
        found = np.array([got[i]["n_links"] for i in range(n)])
        assert (found <= want).all() and found.sum() >= 0.9 * want.sum() > n, (n, found.sum() / want.sum())
    rows = [(1, [1.0, 0.0], 0, 1, 1), (1, [1.0, 0.0], 0, 1, 1), (None, [1.0, 0.0], 0, 1, 1), (2, [0.0, 1.0], 0, 1, 1), (3, [2.0, 0.0], 0, 1, 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, kind)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == [("1", 2, "1"), ("1", 2, "1"), ("2", 0, "2"), ("3", 2, "1"), ("None", 0, "None")]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0


def test_token_counts(docs, none, texts):
    with open(P.path(token_counts.VOCABULARY), "rb") as f:
        known = {base64.b64decode(a) for a, _ in map(bytes.split, f)}
    longest = max(map(len, known))

    def greedy(b):
        i = n = 0
        while i < len(b):
            j = min(len(b), i + longest)
            while b[i:j] not in known:
                j -= 1
            i, n = j, n + 1
        return n

    got = _by(token_counts.token_counts(docs))
    for i, t in texts.items():
        w = (t or "").split()
        assert (got[i]["n_words"], got[i]["n_tokens"]) == (len(w), sum(greedy(b" " + x.encode()) for x in w))
    assert token_counts.token_counts(none).count() == 0


def test_urls(spark):
    urls = ["http://a.b.example.net/x", "https://X.example.net/en/1", "http://example.com/de/", "http://example.com/fr", "http://s.org/fr/", "http://s.org", "net/x", None, "http://notexample.net", "http://c.net?x=://y/", "://h#f"]
    got = _by(url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")), "page_id")
    assert [got[i]["rule"] for i in range(len(urls))] == ["net/", "example.net/en/", "example.com/de/", None, "org/fr/", None, None, None, None, None, None]
    assert [got[i]["host"] for i in (1, 6, 7, 9, 10)] == ["x.example.net", "", "", "c.net", "h"] and [got[i]["path"] for i in (0, 5, 9)] == ["/x", "", ""]
    assert [got[i]["verdict"] for i in (0, 1, 2, 4)] == ["block", "allow", "block", "allow"]
    many = [(i, f"http://bad.net/{i}") for i in range(30)] + [(100, "http://bad.net"), (101, "http://fine.org/x")] + [(200 + i, f"http://fine.org/fr/{i}") for i in range(30)]
    got = _by(url_filter.url_filter(spark.createDataFrame(many, "page_id long, url string")), "page_id")
    assert got[100]["rule"] is None and got[100]["verdict"] == "block" and got[101]["verdict"] == "allow"
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_of_odd_rows(spark, monkeypatch):
    """Repeated rows, a null id, a very long url and clashing names, by broadcast and over salted hosts."""
    from quillmark.llm import common

    rows = [(1, "http://bad.net/a"), (1, "http://bad.net/a"), (None, "http://bad.net"), (2, "http://x.org/" + "p/" * 100_000), (3, None)]
    df = spark.createDataFrame([(*r, "h", "p", 1, 2, "v") for r in rows], "page_id long, url string, host string, path string, n int, k int, bound string")
    for most in (common.BROADCAST_BYTES, 0):
        monkeypatch.setattr(common, "BROADCAST_BYTES", most)
        got = sorted((str(r["page_id"]), r["host"], len(r["path"]), r["rule"]) for r in url_filter.url_filter(df).collect())
        assert got == [("1", "bad.net", 2, "net/"), ("1", "bad.net", 2, "net/"), ("2", "x.org", 200_001, None), ("3", "", 0, None), ("None", "bad.net", 0, None)]


def _page(k, body, extra=""):
    return f"<!DOCTYPE html><html><head><title>t{k}</title><script>var x='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">Buy {k}</div>{extra}<article><h1>Head {k}</h1>{body}<div class='comments'><p>me too {k}</p></div></article><aside>more {k}</aside><footer>&copy; us</footer></body></html>"


def test_html(spark):
    pages = [(k, "http://h.org/x", _page(k, f"<p><b>One &amp; two {k}<br><p>three\n  {k}</p>", "<div id='cookie-notice'>We use cookies</div>")) for k in range(5)]
    pages += [(10, "http://one.org", "<p>alone &lt;x&gt;<p>two"), (11, None, None), (12, "http://one.org", ""), (13, "http://h.org/y", "<article><p>cut off")]
    got = _by(html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id")
    for k in range(5):
        assert got[k]["text"] == f"Head {k}\nOne & two {k}\nthree {k}"
    assert got[10]["text"] == "alone <x>\ntwo" and got[11]["text"] == "" and got[12]["text"] == "" and got[13]["text"] == "cut off"


def _rows_of(pages):
    """deduce()'s rows of one layout's pages, summed here one by one."""
    out = {}
    for k, page in enumerate(pages):
        keys = {n.key for n, opens, _ in html_extract.walk(page) if opens}
        for at, v in [*html_extract._sums(k, page, keys).items(), ((0, False), [0, 0, True, 0, 1, 0, 0, 0, 0])]:
            r = out.setdefault(at, [*v[:4], 0, 0, 0, 0, 0, v[8], v[8]])
            r[4] += 1
            for i, x in enumerate(v[4:8], 5):
                r[i] += x
            r[9], r[10] = min(r[9], v[8]), max(r[10], v[8])
    return [(*at, *r) for at, r in out.items()]


def _mark(pages, key):
    return next((n.mark for p in pages for n, opens, _ in html_extract.walk(p) if opens and n.key == key), None)


def test_template_deduction():
    """Three tokens with equal vectors on part of the pages are template; with vectors of their own they lie in a slot."""
    def page(k, shown):
        box = "".join(f"<div class='{c}'>" for c in "xyz" if c in shown) + f"<p>story {k} {'w' * 40}</p>" + "</div>" * len(shown)
        return f"<html><body><div class='top'><p>Part {k}</p></div>{box}</body></html>"
    together = [page(k, "xyz" if k < 6 else "") for k in range(10)]
    apart = [page(k, "xyz"[:1 + k % 3] if k < 9 else "x") for k in range(10)]
    assert _mark(together, html_extract.deduce(_rows_of(together))[0]) == "div.z"
    assert _mark(apart, html_extract.deduce(_rows_of(apart))[0]) == "div.x"  # on all pages: a class of one
    rows = _rows_of(together)
    changed = [(*r[:8], r[8] + i, *r[9:]) if r[6] == 6 else r for i, r in enumerate(rows)]
    assert _mark(together, html_extract.deduce(changed)[0]) == "body"
    assert html_extract.deduce(_rows_of(together[:2])) == (None, [])


def test_classes_against_brute_force(spark):
    """Layouts by fingerprints are those by whole vectors, nested one by one."""
    rng = random.Random(3)
    for _ in range(20):
        shapes = ["".join(f"<div class='{rng.choice('abcdef')}'>" for _ in range(rng.randrange(1, 5))) for _ in range(3)]
        pages = ["<html><body>" + "".join(f"{s}t{k}" + "</div>" * s.count("<div") for s in shapes if rng.random() < 0.7) + "</body></html>" for k in range(8)]
        vectors, up, depth = {}, {}, {}
        for k, page in enumerate(pages):
            for n, opens, _ in html_extract.walk(page):
                if opens:
                    vectors.setdefault(n.key, [0] * 8)[k] += 1
                    up[n.key], depth[n.key] = n.up.key, n.depth
        once = {k: tuple(v) for k, v in vectors.items() if max(v) == 1 and sum(v) >= html_extract.LEAST}
        inside = set()
        for k in sorted(once, key=lambda k: (depth[k], k)):
            if depth[k] == 1 or up[k] in inside:
                inside.add(k)
        by = {}
        for k in inside:
            by.setdefault(once[k], set()).add(k)
        want = {frozenset(ks) for v, ks in by.items() if len(ks) >= html_extract.CLASS or sum(v) == 8}
        found = [(0, 0, 0, True, 8, 8, 0)] + [(k, up[k], depth[k], True, sum(1 for x in v if x), sum(v), sum(html_extract._part(i, x) for i, x in enumerate(v) if x)) for k, v in vectors.items()]
        _, classes = html_extract.nested(found, html_extract.LEAST, 8)
        assert {frozenset(ks) for ks in classes.values()} == want
        assert {next(ks for ks in want if k in ks) for k in html_extract.layouts_of(found)} == want


def test_html_parser_is_linear_and_keeps_markup_out():
    import time

    long = {
        "deep": "<div>" * 50_000 + "x", "open quotes": "<article><p>x</p>" + "<p title=\"" * 50_000, "closes": "<article><p>x</p>" + "</b></i>" * 50_000,
        "items": "<ul>" * 300 + "<li>x" * 30_000, "marks": "<article>x" + " < 3" * 50_000, "apostrophes": "<article><p title=it's>x</p>" + "<a href=o'>" * 50_000,
    }
    for name, page in long.items():
        begin = time.time()
        assert "x" in html_extract.page_text(page, None), name
        assert time.time() - begin < 5, name
    main = lambda page: html_extract.page_text(page, None)
    assert main("<article><p title=\"x>Hello</p><p>World</p></article>") == "Hello\nWorld"
    assert main("<article><p title='a>b'>one</p><p data-x=\"</p>\">two</p></article>") == "one\ntwo"
    assert main("<article><header><h1>T</h1></header><div class='share-price'>12</div><div class='related links'>no</div><p>x &amp;lt; y</article>") == "T\n12\nx &lt; y"
    assert main("plain <b>text</b>\n only") == "plain text only" and main("<!-- a <p> b") == "" and main("<p") == ""


def test_html_of_odd_rows(spark):
    """An empty table, repeated rows, a null page_id, a very long page, clashing names."""
    kind = "page_id long, url string, html string, host string, key long, layout long"
    assert html_extract.extract(spark.createDataFrame([], kind)).count() == 0
    long = "".join(f"<p>part {k} {'w' * 50}</p>" for k in range(20_000))
    rows = [(1, "http://a.org", f"<html><body><article>{long}</article></body></html>", "x", 1, 2)] * 2 + [(None, None, "<p>a</p>", "x", 1, 2), (2, "http://a.org", None, None, None, None)]
    got = sorted((str(r["page_id"]), r["text"]) for r in html_extract.extract(spark.createDataFrame(rows, kind)).collect())
    whole = "\n".join(f"part {k} {'w' * 50}" for k in range(20_000))
    assert got == [("1", whole), ("1", whole), ("2", ""), ("None", "a")]


def _layouts(spark):
    """Three layouts, none on half of the host's pages, each with a neutrally named sidebar."""
    def body(kind, k):
        art = "".join(f"<p>story {kind} {k} {j} {'w' * 30}</p>" for j in range(3 + k % 3))
        side = f"<div class='box{kind}'><div class='inner{kind}'><p>also {k} {kind}</p></div></div>"
        return f"<html><body><div class='wrap{kind}'><div class='top{kind}'><p>Part {k * 7}</p></div><div class='text{kind}'>{art}</div>{side}</div></body></html>"
    return spark.createDataFrame([(10 * t + k, "http://l.org/x", body("abc"[t], k)) for t in range(3) for k in range(8)], "page_id long, url string, html string")


def test_html_layouts(spark):
    for r in html_extract.extract(_layouts(spark)).collect():
        assert r["text"].startswith("story") and "also" not in r["text"] and "Part" not in r["text"]
        assert r["text"].count("story") == 3 + r["page_id"] % 10 % 3


def test_html_rare_paths_keep_their_weight(spark):
    """An article element with a class of its own on each page, on hosts of more and less than 1 / 0.05 pages."""
    for n in (20, 21, 60):
        pages = [(k, "http://r.org/x", f"<html><body><div class='meta'><p>Updated {k} May</p></div><article class='post-{k} post'><p>story {k} {'w' * 60}</p></article></body></html>") for k in range(n)]
        got = _by(html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id")
        assert all(f"story {k} " in got[k]["text"] for k in range(n)), n


def test_html_copies_and_fixed_blocks(spark):
    one = "<html><body><div class='text'><h2>Fixed head</h2><p>the same story</p></div></body></html>"
    pages = [(k // 2, "http://c.org/x", one) for k in range(8)]  # copies, and repeated rows
    pages += [(100 + k, "http://f.org/x", f"<html><body><div class='text'><h2>Fixed head</h2><div class='lead'><p>Same lead</p></div><p>story {k}</p></div></body></html>") for k in range(6)]
    pages += [(200 + k, "http://b.org/x", f"<html><body><div class='box'><p>Same box</p></div><p>story {k} {'w' * 40}</p></body></html>") for k in range(6)]
    rows = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        k = r["page_id"] % 100
        assert r["text"] == {0: "Fixed head\nthe same story", 1: f"Fixed head\nSame lead\nstory {k}", 2: f"story {k} {'w' * 40}"}[r["page_id"] // 100]


def test_toxicity(spark):
    rng = random.Random(9)
    clean = [f"c{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    bad = ["scumbag", "moronic", "idiotic"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(clean) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for k in rng.sample(range(40), 4):
                w[k] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, "you 1D10T1C m0ronіc ca"), (1001, None), (1002, "")]
    docs, labs = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = _by(toxicity.toxicity(docs, labs))
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} >= set(held)
    assert all(got[i]["predicted"] == dict(labels)[i] for i in held)
    assert got[1000]["predicted"] == 1 and got[1001]["predicted"] == 0 and got[1002]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.reject(docs, labs)
    assert kept.columns == ["doc_id", "text"] and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert {r["score"] for r in toxicity.toxicity(docs, labs.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_scores_keep_their_meaning_when_sampled(spark):
    rng = random.Random(4)
    clean = [f"c{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows, labels = [], []
    for i in range(1800):
        toxic = i % 9 == 0
        w = [rng.choice(clean) for _ in range(30)]
        if rng.random() < (0.6 if toxic else 0.01):
            w[5] = rng.choice(("scumbag", "moronic"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, labs = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    for n in (10_000, 120):  # all rows; classes sampled at different rates
        model = toxicity.fit(docs, labs, n)
        got = [r["score"] for r in toxicity.scored(docs, model).collect()]
        assert abs(sum(got) / len(got) - 1 / 9) < 0.05, n


def test_toxicity_exceptions_spare_a_phrase():
    lex = toxicity.Lexicon({" trash ": 5.0, " scum": 4.0}, ["trash can"], (-2.0, 1.0, 1.0))
    assert lex.features("the trash can") == (0.0, 0.0) and lex.features("the trash")[0] > 0 and lex.features("scummy")[0] > 0 and lex.features("ascum")[0] == 0


def test_toxicity_against_a_plain_recount(spark):
    """Weights, exceptions and scores counted again without the automaton, the sampling and Spark."""
    rng = random.Random(21)
    clean = [f"k{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(clean) for _ in range(25)]
        if i % 5 == 0:
            w[rng.randrange(25)] = rng.choice(("scumbag", "scumbags", "m0r0nic"))
            w[rng.randrange(20)] = "trash"
        elif i % 3 == 0:
            k = rng.randrange(24)
            w[k:k + 2] = ["trash", "can"]
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    extra = [(1000, None), (1001, ""), (1002, "trash can trash scumbagging " * 2000), (1003, "trash can can trash")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string")
    weights, spared, curve = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    fitted = [(t, dict(labels)[i]) for i, t in docs if zlib.crc32(str(i).encode()) % 5]
    size = [sum(1 for _, y in fitted if y == k) for k in (0, 1)]
    df_ = ({}, {})
    pairs = ({}, {})
    for t, y in fitted:
        words = t.lower().translate(toxicity.FOLD).split()
        own = {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in (4, 5, 6) if len(w) > n}
        for e in own:
            df_[y][e] = df_[y].get(e, 0) + 1
        for p in {f"{a} {b}" for a, b in zip(words, words[1:])}:
            pairs[y][p] = pairs[y].get(p, 0) + 1
    odds = {e: np.log((n + 0.5) / (size[1] + 1)) - np.log((df_[0].get(e, 0) + 0.5) / (size[0] + 1)) for e, n in df_[1].items() if n >= toxicity.MIN_DF}
    want = {e: o for e, o in odds.items() if o >= toxicity.MIN_ODDS}
    assert dict(weights).keys() == want.keys() and all(abs(w - want[e]) < 1e-9 for e, w in weights)
    near = lambda w: any(e in want for e in (f" {w} ", *(f" {w[:n]}" for n in (4, 5, 6) if len(w) > n)))
    assert set(spared) == {p for p, n in pairs[0].items() if n >= toxicity.MIN_DF and n > pairs[1].get(p, 0) and any(map(near, p.split()))}
    for r in toxicity.scored(df, (weights, spared, curve)).collect():
        words = (dict(docs + extra)[r["doc_id"]] or "").lower().translate(toxicity.FOLD).split()
        total = 0.0
        for k, w in enumerate(words):
            if any(" ".join(words[j:j + 2]) in spared and len(words[j:j + 2]) == 2 for j in (k - 1, k) if j >= 0):
                continue
            total += max((v for e, v in want.items() if e == f" {w} " or not e.endswith(" ") and w.startswith(e[1:])), default=0.0)
        x = np.array([1.0, np.log1p(total), total / (len(words) + toxicity.SMOOTH)])
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(x @ np.array(curve), -40, 40)))) < 1e-9
    assert toxicity.toxicity(df.where("false"), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0
    assert {r["score"] for r in toxicity.toxicity(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()} == {0.0}


def test_pipeline_stages(spark, texts, tmp_path):
    """The stages' rows against brute force, one stage after the other, with toxic, equal and near texts, odd ids and clashing names."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(30)
    clean = [f"m{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows = [(i, t) for i, t in texts.items()]
    for i in range(1000, 1200):
        w = [rng.choice(clean) for _ in range(30)]
        if i % 4 == 0:
            for k in rng.sample(range(30), 4):
                w[k] = rng.choice(("scumbag", "m0ronic"))
        rows.append((i, " ".join(w)))
    rows += [(3000, "you scumbag scumbags moronic"), (None, "a text without an id of its own"), (55, rows[20][1])]
    kind = "doc_id long, text string, lang string, source string, n_chars long, _kept string, _spans int, digest string, key int"
    spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), "clash", 1, "x", 2) for r in rows], kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(1000, 1200)] + [(None, 0, 1), (0, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "suffix dedup", "packing"]

    planted = {3000, *range(1000, 1200, 4)}
    docs, labels = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    judged = {(r["doc_id"], r["text"]): r["score"] >= 0.5 for r in toxicity.scored(docs, toxicity.fit(docs, labels)).join(docs.select("doc_id", "text"), "doc_id").collect()}
    rejected = {k for k, v in judged.items() if v}  # a plain recount of the scores is a test of its own
    assert planted <= {i for i, _ in rejected} and len(rejected) <= len(planted) + 8
    left = [r for r in rows if r not in rejected]
    norm = {}
    for i, t in left:
        n, rank = re.sub(r"[\x20\x09-\x0D]", "", t or ""), (-len(t or ""), 2**63 if i is None else i)
        if n not in norm or rank < norm[n][0]:
            norm[n] = (rank, i, t)
    left = sorted(((i, t) for _, i, t in norm.values()), key=lambda r: (r[0] is None, r[0]))
    sets = [(i, _shingles(t)) for i, t in left]
    root = {i: i for i, _ in sets}
    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    left = [(i, t) for i, t in left if root[i] == i]
    cut = [(i, b.decode("utf-8", "ignore") if gone.any() else t or "") for (i, t), (b, gone) in zip(left, _removed_by_hand(left))]
    tok = Tokenizer.from_file(P.path(packing.VOCABULARY))
    want = []
    for i, t in cut:
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        for k, at in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[at:at + (first if k == 0 else 2048)]
            want.append((str(i), k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    assert (set(found) - set(want), set(want) - set(found)) == (set(), set()) and found == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
