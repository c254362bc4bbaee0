"""URL rules, exact search, WARC, media, the registered queries and the pipeline against brute force."""

import gzip
import hashlib
import math
import random
import re
import struct
import zipfile
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshfront.llm import media, simhash, topk, url_filter, warc
from meshfront.llm.queries import ALLOW, BLOCK, ORACLES, QUERIES
from tests.test_entry import SF, same

# url rules


def judged_by_hand(url, block, allow):
    rest = (url or "").partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for r in {*block, *allow}:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r), r))
    rule = max(fits)[1] if fits else None
    return host, path, rule, "allow" if rule is None or rule not in block else "block"


URLS = [None, "", "no scheme", "http://", "http://example.net", "https://A.Example.NET/en/1?x#y", "http://example.com/de/", "http://x.example.com/de", "ftp://evil.org/fr/a", "http://org/fr/", "http://fr.org/FR/", "http://notexample.net/en/", "http://É.org/fr/ü", "http://a://b.net/", "http://net/", "http://x.net?/en/", "http://a..net/", "http://.net/", "http://" + "a." * 5000 + "net/", "http://h/" + "p/" * 5000]


def test_rules(spark):
    rows = [(i, u, "clash", "clash", "clash", "clash") for i, u in enumerate([*URLS, *URLS[:5]])] + [(None, "http://example.net/en/", *["clash"] * 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, best string, key string")
    got = [tuple(r) for r in url_filter.judge_urls(pages, BLOCK, ALLOW).collect()]
    assert sorted(got, key=str) == sorted(((r[0], *judged_by_hand(r[1], BLOCK, ALLOW)) for r in rows), key=str)
    assert url_filter.judge_urls(pages.limit(0), BLOCK, ALLOW).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, [], []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages, ["nopath"], [])


def test_few_rules_have_filters_too(spark):
    """The contract's rules over hosts enough that level 0 errs: what corrects it is a filter, never a list of keys."""
    pages = spark.range(30_000).select(F.concat(F.lit("http://a"), F.col("id") % 4001, F.lit(".net/en/"), F.col("id")).alias("url"))
    host, path = url_filter.url_parts(F.col("url"))
    universe = pages.select(F.explode(url_filter.candidate_keys(host, path, [*BLOCK, *ALLOW])).alias("key"))
    for salt, rules in enumerate((BLOCK, ALLOW), 1):
        cascade = url_filter.build_cascade(url_filter.rule_table(spark, rules), universe, salt)
        assert len(cascade.levels) >= 2 and all(level.keys is None and level.bits >= 64 for level in cascade.levels)
        listed = universe.distinct().where(cascade.holds(F.col("key"))).collect()
        assert {r.key for r in listed} == {r.key for r in universe.distinct().collect()} & set(rules)


def test_many_rules_need_several_levels(spark):
    rng = random.Random(1)
    hosts = [f"h{i}.example" for i in range(3000)]
    block, allow = [f"{h}/" for h in hosts[:300]] + [f"{h}/a/" for h in hosts[100:200]], [f"{h}/a/" for h in hosts[:100]] + [f"{h}/b/" for h in hosts[2000:2100]]
    urls = [f"http://{rng.choice(['', 'www.', 'x.y.'])}{rng.choice(hosts)}/{rng.choice(['', 'a/', 'b/q', 'c'])}" for _ in range(6000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge_urls(pages, block, allow).collect()
    assert all((r.host, r.path, r.rule, r.verdict) == judged_by_hand(urls[r.page_id], block, allow) for r in got)
    keys = spark.createDataFrame([(f"{h}/",) for h in hosts], "key string")
    cascade = url_filter.build_cascade(keys.where("key < 'h2'"), keys)
    assert url_filter.rule_table(spark, ["a/", "\ue000/", ""]).collect() == [("a/",), ("\ue000/",), ("",)]
    assert len(cascade.levels) > 1 and keys.where(cascade.holds(F.col("key"))).subtract(keys.where("key < 'h2'")).count() == 0 and keys.where(cascade.holds(F.col("key"))).count() == keys.where("key < 'h2'").count()


def test_rules_of_many_lengths_are_a_small_plan(spark):
    """Two hundred path lengths and six counts of labels: the plan holds functions over arrays, not an expression for each."""
    rng = random.Random(7)
    block = [f"{'x.' * (i % 6)}h/{'p' * i}/" for i in range(200)]
    urls = [f"http://{'x.' * rng.randrange(7)}h/{'p' * rng.randrange(210)}/q" for _ in range(500)] + [None, "http://h/" + "p" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_filter.judge_urls(pages, block, ["h/ppp/"])
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    assert all((r.host, r.path, r.rule, r.verdict) == judged_by_hand(urls[r.page_id], block, ["h/ppp/"]) for r in found.collect())


# search


def test_top_k(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 12)) * rng.gamma(1, 1, 400)[:, None]
    rows = [(int(i), [float(x) for x in v], 0) for i, v in enumerate(base)] + [(1000 + i, [float(x) for x in base[50]], 0) for i in range(30)]
    rows += [(2000, None, 0), (2001, [1.0, None], 0), (2002, [float("nan")], 0), (2003, [float("inf")], 0), (2004, [], 0), (2050, [0.5], 0), (None, [9.0], 0), (-50, [1.0] * 12, 0), (7, [0.25] * 12, 0), (100, [float(x) for x in base[100]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, norm int").repartition(5)
    got = {}
    for r in topk.top_k(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = [(i, np.floor(np.array(v + [0.0] * (12 - len(v))) * 256)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q, x in [(i, x) for i, x in ok if i % 50 == 0]:
        best = sorted((-int(x @ y), i) for i, y in ok if i != q)[:5]
        assert [(k, i, -s) for k, (s, i) in enumerate(best, 1)] == sorted(got[q])[:: 2 if q == 100 else 1]
    assert set(got) == {i for i, _ in ok if i % 50 == 0}
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 50")).count() == 0


def test_large_products_stay_exact(spark):
    q, x = np.array([[2.0**30, 3.0]]), np.array([[2.0**30, 5.0]])
    assert topk._products(q, x, 2.0**60)[0, 0] == 2**60 + 15
    assert topk._products(q * 2.0**40, x * 2.0**40, 2.0**142)[0, 0] == (2**60 + 15) << 80
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 1.0, -3.0, 2.0**23, -(2.0**31), 2.0**40, 1e200, -1e308, 0.75]) if rng.random() < 0.2 else rng.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = [(i, [int(v) for v in topk.quantize(x).tolist()]) for i, x in rows]
    assert all(a == int(np.floor(v * 256)) for (_, x), (_, y) in zip(rows, whole, strict=True) for v, a in zip(x, y, strict=True) if abs(v) < 1e300)
    held = lambda s: max(-(2**63), min(2**63 - 1, s))
    for i, x in whole[::50]:
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in whole if j != i)[:5]
        assert sorted(got[i]) == [(k, j, held(-s)) for k, (s, j) in enumerate(best, 1)]


# warc

BIG = "x" * 1500
PAGES = [(1, "http://b.example/1", BIG, 0), (9, "http://a.example/2?q=1 2", BIG, 0), (4, None, BIG, 0), (5, "http://a.example/\r\nX: y", "small", 0), (6, "http://a.example/", "small", 0), (7, "u", None, 0), (8, "", "", 0), (None, "http://n.example/", BIG, 0), (10, "http://é.example/ü", "é" * 700 + "\r\n\r\n", 0), (11, "http://é.example/ü", "é" * 700 + "\r\n\r\n", 0), (11, "http://é.example/ü", "é" * 700 + "\r\n\r\n", 0), (12, "http://c/", "WARC/1.1\r\n" * 100_000, 0), (None, None, "y" * 2000, 0)]


def pages_by_hand(pages):
    want = []
    for i, _, h, *_ in pages:
        body = (h or "").encode()
        ids = [j for j, _, g, *_ in pages if (g or "") == (h or "") and j is not None]
        again = len(body) >= 1000 and bool(ids) and (i is None or i < max(ids))
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", max(ids) if again else None))
    return sorted(want, key=str)


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int")
    for c in ("salt", "first", "key", "file", "found_id", "size"):
        pages = pages.withColumn(c, F.lit("clash"))
    a = warc.write_archive(pages, f"file://{tmp_path}/w", lines=3)
    got = [tuple(r)[:5] for r in warc.read_archive(spark, a).collect()]
    assert sorted(got, key=str) == pages_by_hand(PAGES)
    assert a.directory.count() > 1
    hits = warc.lookup(a, ["http://é.example/ü", "http://a.example/", "http://missing.example/", "http://b.example/1", "http://a.example/2?q=1 2"])
    assert [len(h) for h in hits.values()] == [3, 1, 0, 1, 1]
    stored = b"".join(gzip.decompress(f.read_bytes()) for f in Path(tmp_path, "w/archive").iterdir() if f.suffix == ".gz")
    assert stored.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES) and b"\r\nX: y" not in stored
    names = re.findall(rb"WARC-Record-ID: (.*)\r", stored)
    assert len(names) == len(set(names)) == len(PAGES)
    empty = warc.write_archive(pages.limit(0))
    assert warc.read_archive(spark, empty).count() == 0 and warc.lookup(empty, ["u"]) == {"u": []}


def test_bisection_finds_what_a_scan_finds(spark, tmp_path):
    """One key on a third of all captures, keys over several files and blocks, and few range reads for each."""
    rng = random.Random(4)
    pages = [(i, "http://hot.example/" if i % 3 == 0 else f"http://h{rng.randrange(40)}.example/{rng.randrange(30)}", f"p{i}") for i in range(1500)] + [(None, "http://hot.example/", "none")]
    a = warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5), f"file://{tmp_path}/w", lines=10)
    files = warc.index_files(a)
    index = warc.Index(a.folder, files)
    for url in sorted({u for _, u, _ in pages})[::7] + ["http://hot.example/", "http://none.example/"]:
        assert sorted((h["page_id"] is not None, h["page_id"] or 0) for h in index.find(warc.surt(url))) == sorted((i is not None, i or 0) for i, u, _ in pages if u == url)
    for i, u, _ in pages[::50]:
        before = index.reads
        assert [h["page_id"] for h in index.find(warc.surt(u), i, any_page=False)] == [i]
        assert index.reads - before < 50
    assert index.find(warc.surt("http://hot.example/"), 10**9, any_page=False) == []


def test_sorted_finds_read_a_directory_about_once(spark, tmp_path):
    """A thousand finds over one file of 2,000 blocks, in order and out of it."""
    pages = [(i, f"http://h{i // 7:04d}.example/", "p") for i in range(6000)]
    captures = warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/w").captures
    blocks = captures.coalesce(1).sortWithinPartitions("key", "page_id").mapInArrow(warc._blocks(f"file://{tmp_path}/one", 3), warc._BLOCK)
    a = warc.Archive(captures, warc.materialize(blocks, "directory"), f"file://{tmp_path}/w")
    assert a.directory.count() == 2000 and len(warc.index_files(a)) == 1
    index = warc.Index(a.folder, warc.index_files(a))
    for i in range(0, 6000, 6):
        assert [h["page_id"] for h in index.find(warc.surt(pages[i][1]), i, any_page=False)] == [i]
    # A find that begins with a block's first capture looks at the block before too.
    assert index.reads < 3 * 1000 and len(index.pages) <= warc.PAGES
    index = warc.Index(a.folder, warc.index_files(a))
    for i in random.Random(6).sample(range(6000), 300):
        assert [h["page_id"] for h in index.find(warc.surt(pages[i][1]), i, any_page=False)] == [i]
        assert index.find(warc.surt(pages[i][1]) + "none") == [] and len(index.find(warc.surt(pages[i][1]))) == min(7, 6000 - i // 7 * 7)


def test_reading_tasks_have_a_ceiling():
    assert [warc.reading_tasks(n) for n in (0, 16 << 20, 200 << 20, 100 << 40)] == [1, 2, 13, 10_000]


def test_reading_is_spread_by_bytes(spark, tmp_path):
    pages = spark.range(400).select("id", F.concat(F.lit("http://x/"), "id").alias("url"), F.concat(F.repeat(F.lit("lorem ipsum "), 20_000), F.col("id").cast("string")).alias("html")).withColumnRenamed("id", "page_id")
    a = warc.write_archive(pages, f"file://{tmp_path}/w")  # 96 MB of payload
    found = warc.read_archive(spark, a)
    seen = spark.read.parquet(*{p.rpartition("/")[0] for p in found.inputFiles() if "records-" in p}).groupBy(F.input_file_name()).count().collect()
    assert len(seen) > 3 and sum(r["count"] for r in seen) == 400 and max(r['count'] for r in seen) < 200


def test_a_lost_response_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int")
    a = warc.write_archive(pages, f"file://{tmp_path}/w")
    gone = a.captures.where("NOT (page_id = 9 AND type = 'response')")
    b = warc.Archive(gone, warc.materialize(gone.repartitionByRange(2, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset").mapInArrow(warc._blocks(f"{a.folder}/less", 3), warc._BLOCK), "directory"), a.folder)
    with pytest.raises(Exception, match="response is missing"):
        warc.read_archive(spark, b).collect()


def test_surt():
    assert [warc.surt(u) for u in (None, "http://www.Example.com/a?b", "https://x.org")] == ["", "com,example,www)/a?b", "org,x)"]


# media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_png_round_trip(n):
    data = bytes(random.Random(n).randrange(256) for _ in range(n))
    p = media.pad(data)
    assert len(p) % 64 == 0 and len(p) >= 64 and media.from_png(media.to_png(p, n)) == (p, n)
    with pytest.raises(ValueError):
        media.from_png(media.to_png(p, n).replace(b"IDAT", b"IDAX"))


def described_by_hand(i, t):
    """The stored form written out by struct and zlib, and the feature by counting."""
    b = (t or "").encode()
    p = b + bytes(64 if not b else -len(b) % 64)
    chunk = lambda k, x: struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x))
    rows = b"".join(b"\0" + p[s : s + 64] for s in range(0, len(p), 64))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(p) // 64, 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"Length\0" + str(len(b)).encode())
    png += chunk(b"IDAT", zlib.compress(rows, media.LEVEL)) + chunk(b"IEND", b"")
    count = Counter(p)
    mean = sum(v * n for v, n in count.items()) / len(p)
    std = math.sqrt(max(sum(v * v * n for v, n in count.items()) / len(p) - mean**2, 0))
    entropy = abs(sum(n / len(p) * math.log2(n / len(p)) for n in count.values()))
    hist = ",".join(str(sum(n for v, n in count.items() if v // 32 == k)) for k in range(8))
    text = f"rows={len(p) // 64} mean={mean:.4f} std={std:.4f} entropy={entropy:.4f} hist={hist}"
    return i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(png), hashlib.sha256(png).hexdigest(), text


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")
def test_op3_by_hand(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op3_media"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted((described_by_hand(i, t) for i, t in texts), key=str)


def test_media_ids_of_any_type(spark, tmp_path):
    rows = [("null", "a"), (None, "b"), ("x/y.png", "c"), ("é =%", "d"), ("", "e")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "name string, body string, member string")
    got = media.media_features(docs, f"file://{tmp_path}/m", "name", "body").select("doc_id", "payload_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, hashlib.sha256(t.encode() + bytes(63)).hexdigest()) for i, t in rows), key=str)


def test_media(spark, documents, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abé日 \n") for _ in range(rng.randrange(300)))) for i in range(120)] + [(500, None), (501, ""), (502, "z" * 300_000), (None, "no id"), (3, "again"), (3, "again")]
    docs = documents(rows).repartition(3)
    folder = f"file://{tmp_path}/m"
    got = media.media_features(docs, folder).collect()
    assert sorted(map(tuple, got), key=str) == sorted((described_by_hand(i, t) for i, t in rows), key=str)
    same_text = [tuple(r)[1:] for r in got if r.doc_id == 3 and r.n_bytes == 5]
    assert len(set(same_text)) == 1 and len(same_text) == 2
    # Small ranges cut each archive into many partitions that together read every member once.
    spark.dataSource.register(media.ArchiveMembers)
    cut = spark.read.format("archive_members").option("rangeBytes", "2000").load(folder)
    assert cut.rdd.getNumPartitions() > 10 and cut.count() == len(rows) and cut.select("archive", "offset").distinct().count() == len(rows)
    assert media.media_features(docs.limit(0), f"file://{tmp_path}/none").count() == 0


def test_a_bad_read_is_retried_at_its_member(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(5):
            z.writestr(f"{i}.png", bytes([i]) * 100)
    reader = media.MemberReader({"path": f"file://{tmp_path}"})
    (part,) = reader.partitions()
    real, failed = zipfile.ZipFile.read, []

    def flaky(self, member, *a):
        if member.filename == "3.png" and len(failed) < 2:
            failed.append(1)
            raise OSError("gone")
        return real(self, member, *a)

    monkeypatch.setattr(zipfile.ZipFile, "read", flaky)
    opened, real_open = [], zipfile.ZipFile.__init__

    def flaky_open(self, *a, **k):
        opened.append(1)
        if len(opened) in (1, 3):
            raise OSError("not yet")
        return real_open(self, *a, **k)

    monkeypatch.setattr(zipfile.ZipFile, "__init__", flaky_open)
    (batch,) = reader.read(part)
    assert batch.column(3).to_pylist() == [bytes([i]) * 100 for i in range(5)] and len(failed) == 2
    failed[:] = [1] * -9
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda *a: (_ for _ in ()).throw(OSError("gone for good")))
    with pytest.raises(OSError):
        list(reader.read(part))


# registered queries and the pipeline


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    """Those with SQL; the others are held against brute force by a test of their own, test_op<N>_by_hand."""
    same(spark, QUERIES[name], ORACLES[name])


def test_pipeline_of_odd_tables(spark, documents, tmp_path):
    """Empty tables, clashing columns, nulls everywhere, long runs of blanks and a repeated row go through every stage."""
    base = [(1, None, None, None), (None, None, None, None), (2, "", "en", "a"), (3, " " * 1_100_000 + "x y z", "en", "a"), (4, "word " * 300_000, "en", None), *[(5, "one row many times over", "en", "b")] * 200, (5, "another text of five", None, "b")]
    labels = spark.createDataFrame([(1, None, None), (None, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for k, rows in enumerate((base, [])):
        sf = f"file://{tmp_path}/sf{k}"
        docs = documents(rows)
        for c in ("_row", "_FP", "_copies", "_pii_new", "n_card", "_pii_Found"):
            docs = docs.withColumn(c, F.lit("clash"))
        docs.write.parquet(f"{sf}/documents.parquet")
        (labels if rows else labels.limit(0)).write.parquet(f"{sf}/labels.parquet")
        now = spark.read.parquet(f"{sf}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, sf)
            assert out.columns == docs.columns, name
            out.write.parquet(f"{sf}/{name}")
            now = spark.read.parquet(f"{sf}/{name}")
        assert now.where("`_pii_new` <> 'clash' OR `_FP` <> 'clash' OR `_row` <> 'clash'").count() == 0
        packed = corpus_pipeline.run(spark, sf).collect()
        assert {r.doc_id for r in packed} == ({3, 4, 5} if rows else set())


def test_pipeline(spark, documents, tmp_path):
    """Each stage's decision takes effect, and what is left is packed whole."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, line(60), "en", f"s{i % 2}") for i in range(200)]
    rows += [(300 + i, f"{line(30)} scumbag {line(20)} vileness", "en", "s0") for i in range(40)]
    rows += [(400, rows[7][1], "en", "s1"), (401, rows[7][1].upper(), "en", "s1"), (402, "pay 4111111111111111 " + line(50), "en", "s1"), (403, None, None, None), (404, "", "en", "s0")]
    docs = documents(rows, extra=False)
    docs.write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    spark.createDataFrame([(i, 0, int(300 <= i < 340)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/sf/labels.parquet")
    sf = f"file://{tmp_path}/sf"
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        now = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = now.collect()
    ids = {k: {r.doc_id for r in v} for k, v in kept.items()}
    assert ids["toxicity"] == {i for i, *_ in rows if not 300 <= i < 340}
    assert ids["simhash"] == ids["toxicity"] - {400, 401, 404} and len(kept["simhash"]) == len(ids["simhash"])
    text = {r.doc_id: r.text for r in kept["pii"]}
    assert "4111111111111111" not in text[402] and all(text[r[0]] == r[1] for r in rows if r[0] in text and r[0] != 402)
    total = sum(len((t or "").split()) for t in text.values())
    assert abs(sum(len((r.text or "").split()) for r in kept["mixing"]) - total) <= 130
    packed = corpus_pipeline.run(spark, sf).collect()
    copies = {}
    for r in kept["mixing"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert {r.doc_id: sum(1 for x in packed if x.doc_id == r.doc_id and x.piece == 0) for r in packed} == copies
    assert corpus_pipeline.ORACLE_SQL is None and simhash.MAX_BITS == 4
