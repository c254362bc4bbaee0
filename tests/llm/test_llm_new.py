"""Filter audits, byte-pair codecs and centroid clusters against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshfront.llm import audit, bpe, clustering
from meshfront.llm.queries import QUERIES, public_tokenizer
from tests.test_entry import SF

# filter audit


def masks(rows):
    """(part, mask, id) of each (doc_id, text, lang) row."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        own = len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]
        yield lang or "", sum(b << k for k, b in enumerate(own)), i


def audited(rows, labels):
    """Every order applied to every document."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    out, shares = {}, Counter()
    found = list(masks(rows))
    for part in {p for p, _, _ in found}:
        own = [(m, i) for p, m, i in found if p == part]
        for order in permutations(range(5)):
            name, left = "".join("ABCDE"[k] for k in order), own
            for step, k in enumerate(order, 1):
                gone = [(m, i) for m, i in left if m >> k & 1]
                left = [(m, i) for m, i in left if not m >> k & 1]
                failing = sum(m >> k & 1 for m, _ in own)
                out[part, name, step] = [len(left), len(gone), failing - len(gone), sum(m == 1 << k for m, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
                shares[part, k] += len(gone)
    return sorted((p, o, s, *v, shares[p, "ABCDE".index(o[s - 1])]) for (p, o, s), v in out.items())


def test_audit(spark, documents):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words[: rng.choice((40, 400))], k=rng.choice((0, 5, 99, 100, 101, 150)))) + rng.choice(("", " #", " ABCDEFGHIJ" * 30)) for _ in range(60)]
    rows = [(k, rng.choice(texts), rng.choice(("en", "de", None, ""))) for k in range(300)]
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (5, rows[5][1], "fr"), (5, rows[5][1], "fr"), (5, "other", "fr"), (900, None, None), (901, "", None), (902, "x " * 30_000, "de"), (903, "Ü" * 9 + "A", "de")]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1))) for k in range(0, 300, 2)] + [(2, 1, 1), (None, 1, 1), (10_000, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents([(i, t, lang) for i, t, lang in rows])
    got = audit.audit(docs, table).collect()
    assert sorted(map(tuple, got)) == audited(rows, labels)
    assert audit.audit(docs.limit(0), table).count() == 0
    assert sum(r.good_lost for r in audit.audit(docs, table.limit(0)).collect()) == 0


def test_a_third_of_all_rows_in_one_group_of_copies(spark, documents):
    rows = [(k, "same text" if k % 3 else f"text {k}", "en") for k in range(600)] + [(1, "same text", "en")] * 100
    got = {r.mask: r.n for r in audit.cells(documents(rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got == Counter(m for _, m, _ in masks(rows))


# byte pairs


@pytest.fixture(scope="module")
def file():
    path, _, pattern = public_tokenizer()
    return path, pattern


@pytest.fixture(scope="module")
def library(file):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file[0])


@pytest.fixture(scope="module")
def codec(file):
    return bpe.Codec(*file)


NEWER = chr(0x10940) + chr(0x11DE0)  # a letter and a digit that not all Unicode tables know
ODD = ["", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "don't I'LL we've", "\x1c\x85  　x", f"a{NEWER}b {NEWER}", "ab" * 5000, " " * 20_000 + "x", "\n\n\r\n\t x", "é́ñ", "日本語テキスト", "😀👩‍👩‍👧", "\x00\x01", "²½Ⅳ１", "a" * 64, "a" * 65, "ä" * 33]


def test_ids_and_texts_are_the_librarys(codec, library):
    rng = random.Random(5)
    pool = [*map(chr, range(256)), *(chr(rng.randrange(0x20000)) for _ in range(1000)), *"aaaa   \n\t'''stdrevemll01", *NEWER, "<|endoftext|>"]
    pool = [c for c in pool if not (len(c) == 1 and 0xD800 <= ord(c) < 0xE000)]
    texts = ODD + ["".join(rng.choices(pool, k=rng.randrange(80))) for _ in range(1500)]
    for t, own in zip(texts, codec.encode(texts), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own, "<i4").tolist() == ids, t
        assert codec.decode(pa.array([ids], pa.list_(pa.int32()))) == [library.decode(ids, skip_special_tokens=False)], t


def merged_by_hand(ids, codec):
    """The lowest rank, then the leftmost place, one merge at a time."""
    while found := [(r, i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := codec.ranks.get(p[0] << 32 | p[1])) is not None]:
        rank, i = min(found)
        ids = [*ids[:i], codec.made[rank >> 32], *ids[i + 2 :]]
    return ids


def test_trees_make_the_leftmost_lowest_merges(codec):
    rng = random.Random(7)
    words = ["".join(rng.choices("aethniorsx", k=rng.choice((2, 3, 8, 9, 31, 64)))) for _ in range(300)] + ["aaaaaaa", "anananana", "hehehehe"]
    for w in words:
        first = codec.first[np.frombuffer(w.encode(), np.uint8)].tolist()
        want = merged_by_hand(first, codec)
        assert bpe.merge_all(first, codec.ranks, codec.made) == want
        columns = np.full((64, 2), -1)
        columns[: len(first), 1] = first
        left = codec.forest.merge(columns)
        assert left[left[:, 1] >= 0, 1].tolist() == want
        assert (left[:, 0] == -1).all()


def test_rare_words_leave_the_cache_and_stay_right(file, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 20)
    small = bpe.Codec(*file)
    for k in range(8):
        texts = [f"word{j} common {j * k}" for j in range(30)]
        assert [np.frombuffer(x, "<i4").tolist() for x in small.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(small.cache) <= 120


def test_codec_tables(spark, documents, file, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id"), (99, None), (100, "long text " * 150_000)]
    encoded = bpe.encode(documents(rows), file)
    got = bpe.decode(encoded, file).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert sorted(map(str, [(r.doc_id, list(r.ids), r.decoded) for r in got])) == sorted(map(str, want))
    assert bpe.encode(documents(rows).limit(0), file).count() == 0
    odd = spark.createDataFrame([("x", [0, None, 10**6, 50256]), (None, None), ("y", [170, 121])], "name string, n array<int>")
    texts = {r.doc_id: r.decoded for r in bpe.decode(odd, file, "name", "n").collect()}
    assert texts == {"x": "!<|endoftext|>", None: "", "y": library.decode([170, 121], skip_special_tokens=False)}


def test_op12_by_hand(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_bpe"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got.pop(r.doc_id) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not got


# clusters


def clustered_by_hand(rows, k=16, rounds=3, width=64):
    kept = [(i, [int(x) * 64 if abs(x) > 2**60 else math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    byte = lambda x: np.array(x, "<i4").tobytes() if max(map(abs, x)) < 2**31 else np.array(x, float).tobytes()
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), byte(r[1])))
    centers = [x for _, x in start[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        centers = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else old for j, old in enumerate(centers)]
    last = [(i, *nearest(x)) for i, x in kept]
    held = lambda n: min(n, 2**63 - 1)
    own = Counter()
    for _, d, j in last:
        own[j] += held(d)
    return sorted(((i, j, held(d), held(own[j]), held(sum(own.values())), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for i, d, j in last), key=str)


def table_of(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "clash", 1.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, distance double").repartition(3)


def vectors(n, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(k, [float(x) for x in rng.normal(rng.integers(4), spread, 64).astype(np.float32)]) for k in range(n)]


@pytest.mark.parametrize("rows", [
    vectors(300, 1),
    vectors(200, 2, 0.01) + [(k, [0.5] * 64) for k in range(300, 400)],
    [(k, [float(k % 3), float(k % 5)] * 32) for k in range(120)],
    [(k, [0.0] * 64) for k in range(40)],
    vectors(9, 3),
    [*vectors(40, 4), (1, [1.0] * 64), (1, [1.0] * 64), (None, [2.0] * 64), (None, [3.0] * 64), (50, None), (51, []), (52, [1.0] * 63), (53, [None, *[1.0] * 63]), (54, [float("nan")] * 64), (55, [float("inf")] * 64)],
], ids=["spread", "copies", "ties", "equal", "few", "odd"])
def test_clusters(spark, rows):
    assert sorted(map(tuple, clustering.cluster(table_of(spark, rows)).collect()), key=str) == clustered_by_hand(rows)


def test_clusters_of_large_components(spark):
    rows = vectors(60, 5) + [(100 + k, [x * 1e30 * (k + 1) for x in v]) for k, (_, v) in enumerate(vectors(30, 6))] + [(200, [1e300] * 64), (201, [-1e9] * 64)]
    assert sorted(map(tuple, clustering.cluster(table_of(spark, rows, "double")).collect()), key=str) == clustered_by_hand(rows)


def test_no_vectors(spark):
    assert clustering.cluster(table_of(spark, [(1, [1.0])])).collect() == []


def test_annulus_leaves_centroids_out_and_compares_its_border():
    near = [[k * 100, 0] for k in range(50)]
    search = clustering.Annulus(near)
    seen = []
    exact, search.c = search.c, type("Seen", (), {"__getitem__": lambda _, k: (seen.extend(np.atleast_1d(k).tolist()), exact[k])[1], "__len__": lambda _: len(exact)})()
    assert search.assign(np.array([[1000, 3]]))[0].tolist() == [10]
    assert len(seen) <= 3
    # (5, 0) and (0, 5) lie equally far from (4, 4) in floats and integers; (-5, 0) has the same length and is farther.
    assert clustering.Annulus([[-5, 0], [0, 5], [5, 0]]).assign(np.array([[4, 4]]))[0].tolist() == [1]
    assert clustering.Annulus([[10, 0], [0, 0]]).assign(np.array([[5, 0]]))[0].tolist() == [0]  # both at the border
