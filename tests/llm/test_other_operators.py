"""Pages, vectors, images and the pipeline against brute force and planted truth."""

import base64
import hashlib
import io
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidebars.llm import html, media, topk, warc
from tidebars.llm._shared import connected_components, shared_dir

PAGES = "page_id long, url string, html string, digest string, archive string"


def sha(x):
    return base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()


def test_warc(spark):
    data = [(i, f"http://x/{i}", h) for i, h in enumerate(["<p>a</p>", "<p>b é</p>", "<p>a</p>", "", None, "\r\n\r\n", "x" * 100_000])]
    data += [(2, "http://x/2", "<p>a</p>"), (None, None, "<p>b é</p>"), (None, "u", "only")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in data], PAGES)
    got = warc.roundtrip(pages)
    first = {}
    for i, _, h in data:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted((str(i), len((h or "").encode()), sha(h), "response" if first.get(h or "", i) == i else "revisit", str(None if first.get(h or "", i) == i else first[h or ""])) for i, _, h in data)
    rows = got.collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in rows) == want
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in rows)
    few = warc.roundtrip(pages, least_bytes=50)
    assert few.where("record_type = 'revisit'").count() == 0
    assert warc.roundtrip(pages.limit(0)).count() == 0


def test_warc_small_archives_and_members(spark):
    from tidebars.llm._shared import fresh_path, materialize

    pages = spark.createDataFrame([(i, "u", "y" * i) for i in range(50)], "page_id long, url string, html string")
    folder = fresh_path(spark, "warc-test")
    written = materialize(warc.write(pages.coalesce(1), folder, most_bytes=200), "w")
    assert written.select("archive").distinct().count() > 3 and written.count() == 50
    with pytest.raises(ValueError):
        list(warc.records(iter([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"])))


def test_warc_streams_are_bounded_and_whole():
    record = warc.response(1, "u", b"x" * 20_000_000)
    packed = zlib.compress(record, 9, 31)
    assert len(packed) < 100_000 and max(map(len, warc.inflate(io.BytesIO(packed)))) <= 1 << 20
    (head, block), = warc.records(warc.inflate(io.BytesIO(packed)))
    assert head["X-Page-ID"] == "1" and block.endswith(b"x" * 20_000_000)
    two = zlib.compress(warc.response(1, "u", b"a"), 9, 31) + zlib.compress(warc.response(2, "u", b"b"), 9, 31)
    assert [h["X-Page-ID"] for h, _ in warc.records(warc.inflate(io.BytesIO(two)))] == ["1", "2"]
    whole = zlib.compressobj(0, zlib.DEFLATED, 31)
    cut = whole.compress(warc.response(1, "u", b"a")) + whole.flush(zlib.Z_SYNC_FLUSH)  # ends with the record, not with the member
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(io.BytesIO(cut))))


def test_html_bare_pages_and_depth():
    weights = html.train()
    text = "Seen text is here and it is long enough to be main text."
    for source in (f"<article><p>{text}</p></article>", f"<div><div>{text * 4}</div></div>", f"<table><tr><td>{text}</table>", text, f"<body><nav><a href='/'>Home</a></nav><div><p>{text}</p><p>{text}</p></div></body>"):
        got = [t for t, _ in html.main_texts([source], weights)[0]]
        assert got and all(t.startswith(text) for t in got), source
    start = time.perf_counter()
    html.Page("<div>" * 100_000 + "</p>" * 100_000)
    assert time.perf_counter() - start < 5


def test_html_learned_layouts():
    weights = html.train()
    exact = 0
    for seed in range(9_000_000, 9_000_080):
        source, kept = html.labelled_page(seed)
        exact += [t for t, _ in html.main_texts([source], weights)[0]] == kept
    assert exact >= 72


def test_html_marginals_are_exact():
    rng = np.random.default_rng(0)
    page = html.Page("<body><div><p>a<p>b</div><ul><li>c</ul></body>")
    forest, n = html.Forest([page]), len(page.parent)
    unary, pair = rng.normal(size=n), rng.normal(size=(2, 2, 2))
    total, weight = np.zeros(n), 0.0
    for bits in range(1 << n):
        s = [bits >> i & 1 for i in range(n)]
        w = np.exp(sum(u * x for u, x in zip(unary, s)) + sum(pair[forest.kind[i], s[page.parent[i]], s[i]] for i in range(1, n)))
        weight += w
        total += w * np.array(s)
    got, joint = forest.marginals(unary, pair)
    assert np.allclose(got, total / weight) and np.allclose(joint[1:].sum((1, 2)), 1)


def test_html_rows(spark):
    good = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>m</a></li></ul></nav><article><h1>Head &amp; tail</h1><p><b>First  par\n graph<br><p>Second &eacute;&nbsp;x</article><footer>&copy; f</footer>"
    rows = spark.createDataFrame([(1, "u", good), (1, "u", good), (None, None, None), (2, "v", ""), (3, "w", "<<<>>< p <!-- x")], "page_id long, url string, html string")
    got = html.extract(rows).collect()
    assert len(got) == 5 and sorted(r["text"] for r in got)[-1] == "Head & tail\nFirst par graph\nSecond é x"
    assert [r["text"] for r in got if r["page_id"] in (None, 2)] == ["", ""]
    assert html.extract(rows.limit(0)).count() == 0


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 8)) * 0.1, np.repeat(rng.normal(size=(1, 8)), 150, 0), np.zeros((5, 8))])
    ids = rng.permutation(len(x))
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids, x)] + [(9001, None), (9002, [1.0, None]), (9003, [float("nan")] * 8), (None, [1.0] * 8), (int(ids[0]), [float(v) for v in x[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.quantize(df)
    q = np.floor(256 * x.astype(np.float32).astype(float)).astype(int)
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = q @ q[i]
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:5]
        want += [(ids[i], k + 1, ids[j], s[j]) for k, j in enumerate(best)]
    got = [tuple(r) for r in topk.search(v, v.where("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want)
    monkeypatch.setattr(topk, "CHUNK", 40)
    again = [tuple(r) for r in topk.search(v, v.where("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(again) == sorted(want)
    with pytest.raises(OverflowError):
        topk.products(np.array([[1 << 40]]), np.array([[1 << 40]]))
    two = v.where("vec_id in (1, 2)")
    assert topk.search(two, two, 5).count() == 2
    assert topk.search(v.limit(0), v.limit(0), 5).count() == 0


def test_media(spark):
    rng = np.random.default_rng(2)
    pictures = [media.draw([float(i)]) for i in range(12)]
    rows = [(i, bytearray(media.encode_pgm(p))) for i, p in enumerate(pictures)]
    rows += [(100 + i, bytearray(media.encode_pgm(media.edit(pictures[i], i)))) for i in range(6)]
    rows += [(200, rows[3][1]), (300, None), (301, bytearray(b"junk")), (None, rows[4][1]), (400, bytearray(media.encode_pgm(rng.integers(0, 2, (4, 4)) * 255)))]
    rows += [(500, bytearray(media.encode_pgm(pictures[10]))), (500, bytearray(media.encode_pgm(pictures[11]))), (501, bytearray(media.encode_pgm(np.zeros((80, 80))))), (502, bytearray(b"P5\n0 0\n255\n"))]
    table = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], "image_id long, image binary, sha string, node long, spots string")
    got = {(r["image_id"], r["component_id"]): r for r in media.copies(table).collect()}
    assert len(got) == len(rows)
    assert sum((100 + i, i) in got for i in range(6)) >= 5
    assert got[200, 3]["exact"] == 2 and (None, 4) in got and got[200, 3]["class_size"] == 3 + ((103, 3) in got) - 1
    assert (500, 10) in got and (500, 11) in got
    assert all((i, i) in got for i in (6, 7, 8, 9, 300, 301, 400, 501, 502))
    assert media.copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0


def families() -> dict[int, np.ndarray]:
    """Six pictures, each with five copies: two cropped, one quarter-turned, one enlarged, one turned by some angle; and strangers."""
    out = {}
    for f in range(6):
        picture = media.draw([float(100 + f)])
        out[10 * f] = picture
        for k, seed in enumerate((f, f + 50)):
            rng = np.random.default_rng(seed)
            t, left = rng.integers(2, 10, 2)
            out[10 * f + 1 + k] = picture[t:-3, left:-5] * 0.8 + 15
        out[10 * f + 3] = np.rot90(picture[4:, :-6], f % 3 + 1)
        out[10 * f + 4] = media.resize(picture[6:-6, 4:-4], 168, 176)
        out[10 * f + 5] = media.spin(picture * 0.9, 0.3 + f)
    out |= {200 + i: media.draw([float(-500 - i)]) for i in range(20)}
    return {i: media.decode_pgm(media.encode_pgm(np.rint(p))) for i, p in out.items()}


def classes_of(nodes, edges) -> dict[int, int]:
    root = {i: i for i in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("few", [256, 3, 1])
def test_media_as_by_brute_force(spark, monkeypatch, few):
    """Classes are those of all pairs compared; small limits send all through stars and blocks."""
    monkeypatch.setattr(media, "FEW", few)
    if few < 256:
        monkeypatch.setattr(media, "LOCAL", 1)
        monkeypatch.setattr(media, "BLOCK", 4)
    images = families()
    known = {i: media.describe(p) for i, p in images.items()}
    entries = {i: media.entries_of(*d) for i, d in known.items()}
    edges = [(u, v) for u in images for v in images if u < v and len(np.intersect1d(entries[u], entries[v])) >= 2 and media.agreeing(known[u][0], known[v][0]) >= 8]
    want = classes_of(images, edges)
    rows = [(i, bytearray(media.encode_pgm(p))) for i, p in images.items()]
    got = {r["image_id"]: r["component_id"] for r in media.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert got == want
    planted = [(u, v) for u in images for v in images if u < v < 200 and u // 10 == v // 10]
    assert sum(got[u] == got[v] for u, v in planted) >= 0.9 * len(planted)
    assert all(got[i] == i for i in images if i >= 200)


def test_media_entries_are_told_apart():
    """Entries depend on the table, the tests, the sight and the scale: no two of one picture's corners fall together by the code."""
    spots, looks = media.describe(media.draw([1.0]))
    assert len(spots) > 40 and set(spots["level"]) == {0, 1, 2}
    one = media.entries_of(spots, looks)
    assert len(one) > 0.9 * 10 * len(spots)
    assert len(np.intersect1d(one, media.entries_of(*media.describe(media.draw([2.0]))))) < 5


def test_components(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(7, 7)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in e:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert all(got.get(x, x) == root(x) for p in e for x in p)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.values == (g.length.cumsum() - g.length).values).all() and g.length.sum() <= 4096
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0.5 * docs.count() < out.doc_id.nunique() < docs.count()
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns
        assert kept.join(rows.select("doc_id"), "doc_id", "left_anti").count() == 0
        rows = kept


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shared_folder_follows_the_session(spark):
    assert shared_dir(spark)
    assert spark.range(3).select(F.lit(shared_dir(spark))).count() == 3
