"""Text operators against brute force on a small, awkward table."""

import hashlib
import re
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidebars.llm import bpe, licenses, packing, simhash, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, rk string, spans string"
PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdeghilnorstu"), rng.integers(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words, n))
    base = say(120)
    passage = say(60)
    out = [say(int(n)) for n in rng.integers(1, 150, 40)]
    out += [base] * 5 + [base.replace(" a", " zz", 1), base + " end", base[:-3]]
    out += [f"{say(10)} {passage} {say(12)}", f"{say(30)} {passage}", f"{passage} {passage}"]
    out += ["for " * 90, "for " * 45, "", None, " \t\n", "\x0b\x1c", "Ünïcode ÀÉ ñandú İstanbul ΑΣ", "a", "A  b\tC", say(6000)]
    out += ["UNDER the MIT License, under the mit license.", "x Apache License, Version 2.0 y cc by-nc cc-by-nc", "Licensed under the GNU general public license version 3"]
    out += ["<|endoftext|> it's We'LL 12 ½ <|startoftext|>", "line\n" * 30]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    ids = list(range(len(t)))
    return pd.DataFrame({"doc_id": ids, "text": t})


def table(spark, pdf):
    data = [(int(i) if i == i and i is not None else None, t, None, "s", 1, "clash", "clash", "clash") for i, t in zip(pdf.doc_id, pdf.text)]
    return spark.createDataFrame(data, SCHEMA)


def odd(spark, pdf):
    """Repeated rows, and a row without doc_id."""
    return table(spark, pdf).unionByName(table(spark, pdf.head(3))).unionByName(spark.createDataFrame([(None, pdf.text[0], None, None, None, None, None, None)], SCHEMA))


def plain_fingerprint(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, rows):
    got = simhash.near_duplicates(table(spark, rows)).toPandas().set_index("doc_id")
    fp = {i: plain_fingerprint(t, 4) for i, t in zip(rows.doc_id, rows.text)}
    assert {i: int(x) % (1 << 64) for i, x in got.fp.items()} == fp
    least = dict(zip(fp, fp))
    comp = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            for j in fp:
                if (fp[i] ^ fp[j]).bit_count() <= 4 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    assert got.component_id.to_dict() == comp and least


def test_simhash_blocks_are_exact(spark, rows, monkeypatch):
    want = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table(spark, rows)).collect()}
    monkeypatch.setattr(simhash, "BLOCK", 2)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table(spark, rows)).collect()} == want


def test_simhash_odd_rows_and_representatives(spark, rows):
    got = simhash.near_duplicates(odd(spark, rows))
    assert got.count() == len(rows) + 4
    assert got.where("doc_id is null").first()["component_id"] == 0
    kept = simhash.representatives(odd(spark, rows))
    assert kept.columns == table(spark, rows).columns
    left = [r["text"] for r in kept.select("doc_id", "text").collect()]
    assert left.count(rows.text[40]) == 1 and len(left) == len({x or "" for x in left})
    assert simhash.near_duplicates(table(spark, rows.head(0))).count() == 0


def plain_near_copies(pdf, least=0.8):
    """Pairs of different texts whose five-word shingles have a Jaccard similarity of ``least`` or more, by brute force."""
    texts_ = {}
    for i, t in zip(pdf.doc_id, pdf.text):
        texts_.setdefault(" ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))), i)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := t.split(" ") if t else []) else set() for t, i in texts_.items()}
    return sets, {(u, v) for u in sets for v in sets if u < v and sets[u] and sets[v] and len(sets[u] & sets[v]) >= least * len(sets[u] | sets[v])}


@pytest.mark.parametrize("few", [256, 4])
def test_representatives_have_the_similarity(spark, monkeypatch, few):
    """Nine of ten pairs are found, as planted copies with a word or a few words changed; no text goes without a near copy."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdeghilnorstu"), rng.integers(2, 8))) for _ in range(2000)]
    data = []
    for f in range(30):
        base = list(rng.choice(words, int(rng.integers(60, 400))))
        data.append(" ".join(base))
        for _ in range(int(rng.integers(1, 8))):
            copy = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(1, max(2, len(base) // 60)))):
                copy[at] = str(rng.choice(words))
            data.append(" ".join(copy))
    data += [" ".join(rng.choice(words[:40], 30)) for _ in range(60)]
    pdf = pd.DataFrame({"doc_id": range(len(data)), "text": data})
    sets, pairs = plain_near_copies(pdf)
    root = dict(zip(sets, sets))
    for _ in range(10):
        for u, v in pairs:
            root[u] = root[v] = min(root[u], root[v])
    want = {i for i in sets if root[i] == i}
    kept = {r["doc_id"] for r in simhash.representatives(table(spark, pdf)).collect()}
    assert want <= kept and len(kept - want) <= 0.1 * (len(sets) - len(want))


def test_first_meeting_is_one_of_the_common_variants():
    rng = np.random.default_rng(8)
    masks = simhash.segments(5)
    x = np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 8)), replace=False)) for _ in range(500)], np.uint64)
    hits = sum(simhash.first_meeting(x, b, masks, 5).astype(int) for b in range(64))
    assert (hits == (np.bitwise_count(x) <= 5)).all()


def plain_repeats(pdf, length):
    seen, out = set(), {}
    for i, t in zip(pdf.doc_id, pdf.text):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            if k in seen:
                gone[s : s + length] = [True] * length
            seen.add(k)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substring(spark, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.deduplicate(table(spark, rows)).collect()}
    assert got == plain_repeats(rows, 20)


def test_substring_odd_rows(spark, rows):
    want = plain_repeats(rows, 20)
    got = substring.deduplicate(odd(spark, rows)).collect()
    assert len(got) == len(rows) + 4
    assert all(r["doc_id"] is None or (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]] for r in got)
    assert substring.deduplicate(table(spark, rows.head(0))).count() == 0
    kept = substring.trim(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and kept.count() == sum(1 for n, g, _ in want.values() if not g or g < n)


def shuffles(spark):
    """Numbers of the shuffles that have files on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return {int(x) for x in re.findall(r"shuffle_(\d+)_", files)}


def test_substring_steps_leave_no_shuffle_files(spark, rows, monkeypatch):
    """When a step begins, the files of those before it are gone."""
    before, left, write = max(shuffles(spark), default=-1), {}, substring.materialize

    def watched(df, name):
        until = time.monotonic() + 3  # Spark deletes them in the background
        while (old := {x for x in shuffles(spark) if x > before}) and time.monotonic() < until:
            time.sleep(0.1)
        left[name] = old
        return write(df, name)

    monkeypatch.setattr(substring, "materialize", watched)
    assert substring.deduplicate(table(spark, rows)).count() == len(rows)
    assert len(left) == 8 and not any(left.values()), left


def test_rolling_hashes_depend_on_content_only():
    h = substring.word_hashes([str(i).encode() for i in range(50)])
    for n in (1, 2, 7, 10, 20):
        r = substring.rolling(np.concatenate([h, h]), n, substring._BASE[0])
        assert len(r) == 101 - n and (r[: 51 - n] == r[50:]).all() and len(set(r[:50].tolist())) == 50


def test_bpe_equals_the_library(spark, rows):
    lib = Tokenizer.from_file(PATH)
    lib.no_truncation(), lib.no_padding()
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(table(spark, rows), PATH), PATH).collect()}
    for i, t in zip(rows.doc_id, rows.text):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["text"] == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode(table(spark, rows.head(0)), PATH).count() == 0


def test_bpe_random_words():
    lib, own = Tokenizer.from_file(PATH), bpe.codec(PATH)
    rng = np.random.default_rng(1)
    for _ in range(3000):
        w = "".join(rng.choice(list("aeinsthrloé'1 .ß中"), rng.integers(1, 25)))
        assert np.frombuffer(own.encode(w), "<u4").tolist() == lib.encode(w, add_special_tokens=False).ids, w


def test_bpe_long_runs_and_newer_characters():
    lib, own = Tokenizer.from_file(PATH), bpe.codec(PATH)
    rng = np.random.default_rng(4)
    run = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000))
    start = time.perf_counter()
    ids = own.encode(run)
    assert time.perf_counter() - start < 5 and own.decode(ids).replace(b" ", b"") == run.encode() + b"</w>"
    for text in (run[:20_000], "ab" * 5000, "a" * 3000, "\x00\x7f a\x01b"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    newer = [*bpe.newer_characters()[1]][::40] + [*bpe.newer_characters()[3]]
    for c in [*map(chr, newer), *map(chr, rng.integers(0x80, 0xD800, 3000).tolist())]:
        assert np.frombuffer(own.encode(f"a{c}b 1{c}"), "<u4").tolist() == lib.encode(f"a{c}b 1{c}", add_special_tokens=False).ids, hex(ord(c))


def test_a_worker_lets_go_of_words_between_tasks():
    own = bpe.Codec(PATH)
    text = " ".join(f"{k:x}th word{k}" for k in range(bpe._KEPT))
    ids, pairs = own.encode(text), dict(own.pairs)
    assert len(own.words) > bpe._KEPT
    own.rest()
    assert not own.words and own.pairs == pairs and own.encode(text) == ids


def test_packing(spark, rows):
    lib = Tokenizer.from_file(PATH)
    for width in (64, 4096):
        got = packing.pack_documents(odd(spark, rows), PATH, width).toPandas()
        ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in zip(rows.doc_id, rows.text)}
        own = got[got.doc_id.notna() & (got.doc_id > 2)]
        for i, g in own.groupby("doc_id"):
            g = g.sort_values("piece")
            parts = [ids[i][s : s + width] for s in range(0, len(ids[i]), width)]
            assert g.length.tolist() == [len(x) for x in parts] and g.start.tolist() == [width * k for k in range(len(parts))]
            assert g.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in parts]
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert (g.offset.values == (g.length.cumsum() - g.length).values).all() and g.length.sum() <= width
        assert got.sequence_id.nunique() <= 1.03 * -(-got.length.sum() // width) + 1
    assert packing.pack_documents(table(spark, rows.head(0)), PATH).count() == 0


def test_solve_places_each_piece_once():
    rng = np.random.default_rng(2)
    for width in (10, 100, 4096):
        hist = {int(n): int(rng.integers(1, 40)) for n in rng.integers(1, width + 1, 60)}
        configs = packing.solve(hist, width)
        made = {}
        for times, config in configs:
            assert sum(n * k for n, k in config) <= width and times > 0
            for n, k in config:
                made[n] = made.get(n, 0) + n * 0 + k * times
        assert made == hist
    assert packing.solve({}, 10) == []


def test_program_against_best_fit_and_bound():
    """Never more sequences than best fit; fewer where lengths must be combined with care; never fewer than the bound."""
    rng = np.random.default_rng(5)
    count = lambda x: {int(n): int(c) for n, c in zip(*np.unique(x, return_counts=True))}
    cases = [rng.integers(1000, 2201, 20000), np.repeat([2100, 1380, 1300, 700, 610], [1000, 1000, 1500, 900, 1200]), np.clip(rng.lognormal(7.2, 0.6, 5000).astype(int), 1, 4096), rng.integers(1, 4097, 300)]
    saved = []
    for x in cases:
        configs, plain, _, low = packing.planned(count(x), 4096)
        used = sum(t for t, _ in configs)
        assert low <= used <= plain and sum(t * n * k for t, c in configs for n, k in c) == x.sum()
        saved.append(plain - used)
    assert saved[0] > 200 and saved[1] > 0
    for _ in range(40):
        x = rng.integers(1, 11, 8).tolist()
        fit = [sum(x[i] for i in range(8) if m >> i & 1) <= 10 for m in range(256)]
        least = [0] + [99] * 255
        for m in range(1, 256):
            part = m
            while part:
                if fit[part]:
                    least[m] = min(least[m], least[m ^ part] + 1)
                part = (part - 1) & m
        configs, plain, _, low = packing.planned(count(x), 10)
        assert low <= least[255] <= sum(t for t, _ in configs) <= plain


def test_program_packs_what_best_fit_packs_as_well(monkeypatch):
    """Where best fit meets the bound, the sequences come from the program all the same, and meet it too."""
    rng = np.random.default_rng(7)
    calls, fractional = [], packing.fractional
    monkeypatch.setattr(packing, "fractional", lambda *a, **k: calls.append(1) or fractional(*a, **k))
    for x, width in ((np.append(np.clip(rng.lognormal(6.3, 0.8, 20000).astype(int), 2, 4095), rng.integers(2, 60, 2000)), 4096), (np.clip(rng.lognormal(3, 0.7, 50000).astype(int), 2, 400), 4096)):
        hist = {int(n): int(c) for n, c in zip(*np.unique(x, return_counts=True))}
        low = packing.lower_bound(hist, width)
        assert sum(t for t, _ in packing.best_fit([], hist, width)) == low
        del calls[:]
        assert sum(t for t, _ in packing.solve(hist, width)) == low and calls
        made, _ = packing.program(hist, width)
        assert sum(t * n * k for t, c in made for n, k in c) > 0.9 * x.sum()
        assert low == packing.planned(hist, width)[2]  # nothing given back


def test_licenses(spark, rows):
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, rows)).collect()}
    for i, t in zip(rows.doc_id, rows.text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = [(s, label) for label, p in licenses.BASE for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(hits))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits}))
        assert (r["first_word"], r["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not hits
        assert 0 <= r["score"] <= 1
    assert "gpl-3" in {r["labels"] for r in got.values()}
    assert licenses.scan(odd(spark, rows)).count() == len(rows) + 4
    assert licenses.scan(table(spark, rows.head(0))).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    data, labels = [], []
    for i in range(900):
        s = [" ".join(rng.choice(words, 8)) for _ in range(rng.integers(1, 12))]
        bad = rng.random() < 0.2
        if bad:
            k = rng.integers(len(s))
            s[k] = s[k] + " " + str(rng.choice(["scum", "moron"]))
        data.append((i, ". ".join(s)))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    got = toxicity.score(docs, model).join(lab.where("toxic is not null"), "doc_id").where(toxicity.held_out("doc_id")).toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97 and (zlib.crc32(b"5") % 5 == 0) == bool(docs.where("doc_id = 5").select(toxicity.held_out("doc_id")).first()[0])
    hit = toxicity.score(spark.createDataFrame([(1, "wa wb. wc moron wd! we")], "doc_id long, text string"), model).first()
    assert [(s["start"], s["end"]) for s in hit["offending"]] == [(6, 18)]
    strange = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "!!! 123")], "doc_id long, text string")
    assert {r["score"] for r in toxicity.score(strange, model).collect()} == {0.0}
    assert toxicity.clean(strange, model).count() == 4 and toxicity.score(strange.limit(0), model).count() == 0
    plain = " ".join(f"{x}." for x in rng.choice(words, 30_000))
    long = toxicity.score(spark.createDataFrame([(1, plain), (2, plain + " w moron w.")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["predicted"] for r in long] == [0, 1]
    none = toxicity.train(docs.limit(0), lab.limit(0))
    assert toxicity.score(docs, none).agg(F.max("predicted")).first()[0] == 0


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).where(toxicity.held_out("doc_id")).join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    bad, good = got[got.toxic == 1], got[got.toxic == 0]
    rank = got.score.rank()
    auc = (rank[got.toxic == 1].sum() - len(bad) * (len(bad) + 1) / 2) / (len(bad) * len(good))
    print(f"AUC {auc:.3f}, {bad.predicted.sum()} of {len(bad)} toxic, {good.predicted.sum()} of {len(good)} others")
    assert auc > 0.93 and bad.predicted.mean() > 0.75 and good.predicted.mean() < 0.01


def test_digests_are_of_utf8(spark, rows):
    got = substring.deduplicate(table(spark, rows)).select("doc_id", "kept", F.sha2(F.encode("kept", "UTF-8"), 256).alias("h"))
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["h"] for r in got.collect())
