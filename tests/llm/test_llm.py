"""The training-data operators against brute force on small fixtures."""

from __future__ import annotations

import collections
import functools
import hashlib
import itertools
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from plan_tree import moved_columns
from pyspark.sql import functions as F

import corpus_pipeline
from perdura.llm import context_mixing, embedding_dedup, near_dedup, quality, suffix_dedup, toxicity, url_filter
from perdura.llm.components import connected_components
from perdura.llm.decontaminate import PhraseIndex, clean_documents, decontaminate, keyed_texts
from perdura.llm.embedding_dedup import near_duplicate_vectors
from perdura.llm.mixing import mix, mixed_documents
from perdura.llm.near_dedup import keep_one_of_each_group, near_duplicates
from perdura.llm.suffix_dedup import removed_passages, without_passages
from perdura.llm.token_counts import PieceCounter, count_tokens
from perdura.sources.staging import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=("a", "b", None)):
    """Rows with a null id, a clashing extra column and repeated rows among them."""
    rows = [(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("mine")).withColumn("size", F.lit(-1))


def some_texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 200))) for _ in range(25)]
    for t in texts[:8]:  # near copies
        w = t.split()
        for _ in range(3):
            copy = list(w)
            for _ in range(rng.randint(0, 3)):
                if copy:
                    copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    passage = " ".join(word() for _ in range(150))
    texts += [f"{word()} {passage} {word()}", f"{word()} {word()}\n{passage}", passage[:405], passage[1:401]]
    return [*texts, "", "  \n", None, "One Two", "one  two", "x" * 1000, ("long " * 4000).strip()]


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    links += [(500, i) for i in range(501, 560)]
    want = roots({n for e in links for n in e}, links)
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(frame, "a", "b").collect()}
    assert got == {n: want[n] for e in links if e[0] != e[1] for n in e}
    assert connected_components(frame.limit(0), "a", "b").count() == 0


def test_near_duplicates(spark):
    texts = some_texts()
    sets = [shingles(t) for t in texts]
    pairs = [
        (a, b) for a, b in itertools.combinations(range(len(sets)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    want = roots(range(len(texts)), pairs)
    docs = documents(spark, texts)
    got = near_duplicates(docs, 85).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            n = r["doc_id"]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[n]), want[n], want[n] == n)
    kept = keep_one_of_each_group(docs, 85)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert near_duplicates(docs.limit(0)).count() == 0


def test_different_texts_under_one_id_are_each_judged(spark):
    rng = random.Random(13)
    x, y, z, u = (" ".join(f"{c}{rng.randint(0, 999)}" for _ in range(60)) for c in "xyzu")
    rows = [(7, x, "b"), (7, y, "b"), (7, x, "a"), (9, y, "c"), (9, z, "c"), (5, z + " end", "d"), (8, u, "e"), (None, u, "f"), (7, "", "g"), (7, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("node", F.lit("mine"))
    want = [(7, x, "a"), (7, y, "b"), (5, z + " end", "d"), (8, u, "e"), (None, u, "f"), (7, "", "g")]
    for part in (docs, docs.orderBy(F.desc("source"))):
        kept = keep_one_of_each_group(part, 80)
        assert kept.columns == docs.columns
        assert sorted(map(str, (tuple(r)[:3] for r in kept.collect()))) == sorted(map(str, want))


def test_near_duplicates_around_the_bound(spark, monkeypatch):
    """A dense group with pairs on both sides of the bound, in blocks of four; two texts under one doc_id."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for at in rng.sample(range(120), rng.randint(1, 4)):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    pairs = [
        (a, b) for a, b in itertools.combinations(range(60), 2)
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    want = roots(range(60), pairs)
    assert 3 < len(set(want.values())) < 60
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[0], None, None, 0), (100, "quite another text of seven words", None, None, 0)]
    got = [(r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, DOCS), 85).collect()]
    assert sorted(r for r in got if r[0] < 100) == sorted(want.items())
    assert sorted(r for r in got if r[0] == 100) == [(100, want[0]), (100, 100)]


def strip_repeats(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        yield len(d), sum(gone), spans, kept


def test_repeated_passages(spark):
    texts = some_texts(3)
    docs = documents(spark, texts)
    rows = [*texts, texts[0], texts[0]]
    want = list(strip_repeats(rows))
    got = {r["doc_id"]: tuple(r)[1:] for r in removed_passages(docs).collect()}
    assert got == {
        i: (n, gone, spans, hashlib.sha256(kept).hexdigest())
        for i, (n, gone, spans, kept) in zip([*range(len(texts)), 0, None], want)
    }
    cleaned = without_passages(docs)
    assert cleaned.columns == docs.columns
    by_id = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    for i, (_, gone, _, kept) in enumerate(want[: len(texts)]):
        assert by_id[i] == (kept.decode("utf-8", "ignore") if gone else texts[i])
    assert removed_passages(docs.limit(0)).count() == 0


def plain_words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in low).split(" ")


def test_decontaminate(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "Éa", "b1", "c", "d", "e"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 12, 10, 3, 1, 40])] + [(6, None), (7, "!"), (8, "")]
    texts = []
    for _ in range(40):
        w = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            source = items[rng.choice([0, 1, 2, 5])][1].split()
            at = rng.randrange(len(source))
            w[len(w) // 2 : len(w) // 2] = source[at : at + rng.randint(5, 20)]
        texts.append(rng.choice([" ", "-", ", "]).join(w).upper() if rng.random() < 0.3 else " ".join(w))
    texts += ["", None, items[0][1]]
    windows = []
    for i, t in items:
        w = [x for x in plain_words(t) if x]
        if w:
            k = min(10, len(w))
            windows += [(i, w[s : s + k]) for s in range(len(w) - k + 1)]
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate(docs, bench).collect()}
    clean = set()
    for n, t in enumerate(texts):
        w = [x for x in plain_words(t) if x]
        hit, found = set(), set()
        for i, k in windows:
            for p in range(len(w) - len(k) + 1):
                if w[p : p + len(k)] == k:
                    hit |= set(range(p, p + len(k)))
                    found.add(str(i))
        ids = ",".join(sorted(found))
        assert got[n] == (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)), n
        if not hit:
            clean.add(n)
    assert {r["doc_id"] for r in clean_documents(docs, bench).collect()} - {None} == clean
    near = PhraseIndex(keyed_texts(docs), bench).proximities(2)
    assert near.columns == ["key", "item_id", "start", "at"] and near.count() > 0
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate(docs, bench.limit(0)).collect())


def test_mixing(spark):
    rng = random.Random(5)
    texts = [" ".join("w" for _ in range(rng.randint(0, 40))) for _ in range(900)]
    docs = documents(spark, texts, sources=("a", "a", "a", "b", "c", None))
    got = mix(docs).collect()
    assert len(got) == 902
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(docs).collect()), key=str)
    by = collections.defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        of = by[r["source_size"]]
        of[0], of[1], of[2] = of[0] + r["size"], of[1] + r["taken"], r["target"]
    for size, (total, taken, target) in by.items():
        assert size == total and target <= 2 * size and abs(taken - target) <= 200
    assert sum(v[2] for v in by.values()) == pytest.approx(1.5 * sum(by))
    taken = mixed_documents(docs)
    assert taken.columns == [*docs.columns, "mix_size", "mix_target", "mix_copies"]
    assert taken.agg(F.sum(F.col("mix_size") * F.col("mix_copies"))).first()[0] == sum(r["taken"] for r in got)
    assert mix(docs.limit(0)).count() == 0
    assert {r["taken"] for r in mix(documents(spark, ["", None])).collect()} == {0}


def test_fold_and_exceptions():
    assert toxicity.fold("Ідіоt 1d10t, $cum ｔｒａｓｈ!") == " idiot idiot scum trash "
    lexicon = toxicity.Lexicon({" trash ": 2.0, " vequ": 1.0}, frozenset({" trash can "}))
    machine = lexicon.automaton()
    assert toxicity.hits(machine, toxicity.fold("trash vequal trash can")) == {0: 2.0, 6: 1.0}
    assert toxicity.hits(toxicity.Lexicon().automaton(), " a ") == {}


def test_toxicity(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    texts, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [word() for _ in range(rng.randint(5, 40))] + (["sc" + "um" + rng.choice("abc")] * 2 if bad else [])
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append((i, 1, int(bad)))
    texts += ["", None]
    docs = documents(spark, texts)
    lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, lexicon).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    assert toxicity.drop_toxic(docs, lexicon).columns == docs.columns
    empty = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["predicted"] for r in toxicity.score(docs, empty).collect()} == {0}


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s))  # every length collides
    path = tmp_path / "list"
    path.write_bytes(url_filter.pack({"aa": 0, "bb": 1, "ccc": 2}))
    assert url_filter.DigestArray(str(path)).find(["bb", "aa", "cc", "ccc", "", "dddd"]).tolist() == [1, 0, -1, 2, -1, -1]
    path.write_bytes(url_filter.pack({}))
    assert url_filter.DigestArray(str(path)).find(["a"]).tolist() == [-1]


def test_url_rules(spark):
    urls = ["http://EXAMPLE.org/en/12", "http://x.example.org/es/?a", "http://example.org", "ftp://a.org/#", "no", None, "",
            "http://m.com/fr/x", "http://m.com/de/", "http://xcom/de/", "http://www.spam-farm.example.net/a", "http://a://b.org/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("example.org", "/en/12", "example.org/en/1", "block"), ("x.example.org", "/es/", "example.org/es/", "block"),
        ("example.org", "", None, "allow"), ("a.org", "/", "org/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("m.com", "/fr/x", "com/fr/", "allow"), ("m.com", "/de/", "com/de/", "block"),
        ("xcom", "/de/", None, "allow"), ("www.spam-farm.example.net", "/a", None, "block"), ("a:", "//b.org/x", None, "allow"),
    ]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_quality(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["good", "fine", "text"] if i % 3 else ["junk", "$$$", "win"]) for _ in range(30)) for i in range(300)]
    docs = documents(spark, [*texts, "", None])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = quality.resample(docs, labels, share=0.6).collect()
    assert len(got) == 304 and abs(sum(r["kept"] for r in got) - math.floor(304 * 0.6)) <= 2
    assert sum(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and r["doc_id"] % 3 == 0) <= 5
    assert {r["log_weight"] for r in got if r["doc_id"] in (300, 301)} == {0.0}
    assert quality.resample(docs.limit(0), labels).count() == 0


def test_context_mixing(spark):
    rng = random.Random(8)
    words = ["the", "of", "Cat", "dog", "sat", "mat", "ran"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["", None, "zzz"]
    docs = documents(spark, texts)
    got = context_mixing.score(docs).collect()
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[0])]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts = collections.Counter(w for i, t in rows if fold(i) for w in tokens(t))
    total, size = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        t = tokens(texts[r["doc_id"] or 0])
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (size + 1))) for w in t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in counts for w in t), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0 and r["held_out"] == (fold(r["doc_id"]) == 0)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 1.1 * sum(r["base_score"] for r in held)
    assert context_mixing.score(docs.limit(0)).count() == 0


def test_context_odds_are_those_of_exact_counts(spark):
    rng = random.Random(12)
    streams_of = [b"\n" * 6 + bytes(rng.choice(b"ab d\n") for _ in range(400)) for _ in range(20)]
    seen = collections.Counter(s[i : i + 7] for n, s in enumerate(streams_of) for i in range(len(s) - 6))
    tuned = {w: rng.randint(0, 2) for w in seen}
    name = lambda w: int.from_bytes(w, "big")
    frame = spark.createDataFrame([(name(w), n, tuned[w]) for w, n in seen.items()], "window long, fit long, tune long").repartition(5)
    got = {r["string"]: r for r in context_mixing.context_odds(frame).collect()}
    assert got.keys() == {name(w) for w in seen}

    def word(w):  # the letters since the last space or end
        at = max([i for i in range(6) if w[i] in b" \n"], default=-1)
        return w[at + 1 : 6]

    for kind, count in (("f", seen), ("a", {w: n + tuned[w] for w, n in seen.items()})):
        met = collections.Counter()
        for w, n in count.items():
            contexts = [w[5 - k : 6] for k in range(6)] + [word(w)]
            for k, c in enumerate(contexts):
                for place in range(8):
                    met[k, c, place, w[6] >> (7 - place)] += n
        for w in random.Random(1).sample(sorted(seen), 300):
            for k, c in enumerate([w[5 - k : 6] for k in range(6)] + [word(w)]):
                head = [(w[6] >> (8 - place)) << 1 for place in range(8)]
                odds = [math.log((met[k, c, p, h | 1] + 0.4) / (met[k, c, p, h] + 0.4)) for p, h in enumerate(head)]
                packed = np.array([got[name(w)][f"{kind}{'w' if k == 6 else k}"]]).view(np.int8)
                assert np.abs(packed - np.clip(odds, -8, 8) * context_mixing.SCALE).max() <= 0.51


def test_context_mixing_moves_packed_windows_only(spark):
    rng = random.Random(15)
    texts = [" ".join(rng.choice(["tea", "Ox", "ruin", "ü", "xylophone"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    docs = documents(spark, texts)
    one, many = context_mixing.score(docs.coalesce(1)), context_mixing.score(docs.repartition(9, "doc_id"))
    assert moved_columns(many) and not moved_columns(many) & {"text", "texts", "window", "string"}
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["base_score"])
    for x, y in zip(sorted(one.collect(), key=key), sorted(many.collect(), key=key), strict=True):
        assert x[:5] == y[:5] and x["base_score"] == pytest.approx(y["base_score"]) and x["score"] == pytest.approx(y["score"], abs=1e-3)


def test_packed_windows_come_back():
    rng = np.random.default_rng(3)
    window = rng.integers(0, 1 << 56, 5000, dtype=np.uint64)
    turned = np.sort(context_mixing._turned(window))
    assert (np.sort(context_mixing._turned(turned)) == np.sort(window)).all()
    bucket, place = context_mixing._by_bucket(turned, 16)
    count = rng.integers(0, 1 << 40, len(turned))
    rows = pa.Table.from_batches([context_mixing._rows_by_bucket(bucket, 7, turned[place], count, count + 1)])
    assert rows.num_rows == 16 and sum(rows.column("n").to_pylist()) == len(turned)
    keys, fit, tune = context_mixing._entries(rows)
    assert (keys == turned[place]).all() and (fit == count).all() and (tune == count + 1).all()
    space, end = (np.array([int.from_bytes(b, "big")], np.uint64) for b in (b"ab cdex", b"ab\ncdex"))
    assert context_mixing._bucket(context_mixing._turned(space), 1 << 16) == context_mixing._bucket(context_mixing._turned(end), 1 << 16)


def test_counts_past_float32_are_exact(spark):
    x, p = 0x2078, 0x2070  # a space and x; a space and p
    rare = spark.range(2_000_000).select((F.shiftleft(F.col("id") + 1, 16) + x).alias("window"), F.lit(1).cast("long").alias("fit"))
    many = spark.createDataFrame([((1 << 50) + x, 1 << 24), ((1 << 50) + p, 1 << 24)], "window long, fit long")
    windows = many.coalesce(1).unionByName(rare.coalesce(1)).coalesce(1).withColumn("tune", F.lit(0).cast("long"))
    row = context_mixing.context_odds(windows).where(F.col("string") == (1 << 50) + x).first()
    place = 4  # where x and p part: 2**24 + 2,000,000 to 2**24
    odds = np.array([row["f0"]]).view(np.int8)[place]
    assert odds == round(math.log(((1 << 24) + 2_000_000) / (1 << 24)) * context_mixing.SCALE) == 2


def test_streams_hold_the_words():
    data = np.frombuffer(b"ab  c\n\nd", dtype=np.uint8)
    offsets = np.array([0, 6, 7, 8])
    window, first = context_mixing.streams(data, offsets, context_mixing.word_spans(data, offsets))
    last = bytes((window & np.uint64(0xFF)).astype(np.uint8))
    assert [last[a:b] for a, b in zip(first[:-1], first[1:])] == [b"ab c\n", b"\n", b"d\n"]


def test_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 16))
    rows = [(i, list(map(float, base[i % 40] + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.6])))) for i in range(400)]
    rows += [(400 + i, list(map(float, base[0]))) for i in range(30)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None]), (905, [1.0, 2.0]), (None, rows[0][1])]
    frame = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").withColumn("label", F.lit(None).cast("int"))
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    ids = [r[0] for r in rows]
    want = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked))])
    got = {r["vec_id"]: tuple(r)[1:] for r in near_duplicate_vectors(frame).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(got[i] == (linked[n].sum(), want[i], want[i] == i) for n, i in enumerate(ids))
    assert all(got[i] == (0, i, True) for i in range(900, 906)) and got[None] == (0, None, True)
    assert near_duplicate_vectors(frame.limit(0)).count() == 0


def test_vectors_of_few_directions_in_small_cells(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = np.r_[rng.normal(size=(700, 4)) @ rng.normal(size=(4, 48)), rng.normal(size=(100, 48))]
    shift = rng.normal(size=48)
    copies = x[700:] + 0.38 * np.linalg.norm(x[700:], axis=1)[:, None] * shift / np.linalg.norm(shift)
    x = np.r_[x, copies]
    monkeypatch.setattr(embedding_dedup, "fit_cells", functools.partial(embedding_dedup.fit_cells, cell=25))
    monkeypatch.setattr(embedding_dedup, "BLOCK", 30)
    frame = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x = x / np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r["n_links"] for r in near_duplicate_vectors(frame).collect()}
    assert [got[i] for i in range(len(x))] == linked.sum(axis=1).tolist()


def test_vectors_are_stored_a_few_times_however_many_cells_are_near(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(embedding_dedup, "fit_cells", functools.partial(embedding_dedup.fit_cells, cell=25))
    folder = Path(shared_dir(spark).removeprefix("file:")) / "perdura"
    before = set(folder.glob("*"))
    assert near_duplicate_vectors(frame).where("n_links = 0 and kept").count() == len(x)
    stored = sum(f.stat().st_size for new in set(folder.glob("*")) - before for f in new.rglob("*.parquet"))
    assert stored < 4 * x.nbytes


def test_vectors_that_meet_in_small_packs(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 40)).astype(np.float32).astype(float)
    x = np.r_[x, x[:80] + 0.2 * rng.normal(size=(80, 40)), x[:1] + 0.2 * rng.normal(size=(120, 40)), -x[:20], x[200:220], 2 * x[220:240]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 3)))]
    frame = spark.createDataFrame(rows + rows[:30] + [(None, rows[0][1])], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(embedding_dedup, "fit_cells", functools.partial(embedding_dedup.fit_cells, cell=25))
    for name, value in (("BLOCK", 30), ("PACK_BYTES", 4 << 10), ("STEP", 8), ("WIDEST", 12), ("EDGES", 40), ("SEEN", 10)):
        monkeypatch.setattr(embedding_dedup, name, value)
    got = {r["vec_id"]: tuple(r)[1:] for r in near_duplicate_vectors(frame).collect() if r["vec_id"] is not None}
    assert len(got) == len(rows)
    for size in (40, 3):
        ids = [i for i, v in rows if len(v) == size]
        v = np.array([v for _, v in rows if len(v) == size])
        v /= np.linalg.norm(v, axis=1)[:, None]
        linked = v @ v.T >= 0.9
        np.fill_diagonal(linked, False)
        want = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked))])
        assert [got[i] for i in ids] == [(linked[n].sum(), want[i], want[i] == i) for n, i in enumerate(ids)]


def longest_match(word, starts, continuations):
    at = n = 0
    while at < len(word):
        pieces = continuations if at else starts
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_piece_counts(spark):
    rng = random.Random(10)
    piece = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    for _ in range(300):
        starts, more = ({piece() for _ in range(rng.randint(0, 6))} for _ in range(2))
        counter = PieceCounter(starts, more)
        for _ in range(10):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
            assert counter.count(word) == longest_match(word, starts, more)
    docs = documents(spark, ["ab abc zz", "", None])
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in count_tokens(docs, (["a", "ab"], ["b", "c"])).collect()}
    assert got == {0: (3, 4), 1: (0, 0), 2: (0, 0), None: (3, 4)}


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    texts = some_texts(11)
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[3])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mix":
            assert now.columns == docs.columns
    ids = [r["doc_id"] for r in now.collect()]
    assert 3 not in ids and len(set(ids)) == len(ids)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids)


CLASHING = ("hash", "times", "below", "of", "target", "_k1", "_K2", "_ranges", "_key", "_plan", "_hash", "mix_target")


def test_pipeline_stages_keep_columns_with_names_of_their_own(spark, tmp_path):
    texts = some_texts(12)
    docs = documents(spark, texts).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[3])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        rows = now.where("doc_id is not null").collect()
        assert rows
        for c in CLASHING[: None if name != "mix" else -1]:
            assert c in now.columns and all(r[c] == f"{c}{r['doc_id']}" for r in rows)
    assert all(isinstance(r["mix_target"], float) for r in rows) and len(set(now.columns)) == len(now.columns)


def test_repeated_passages_where_a_text_exceeds_a_part(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1 << 10)
    rng = random.Random(21)
    passage = "".join(rng.choice("abc ") for _ in range(700))
    noise = lambda n: "".join(rng.choice("defghi ") for _ in range(n))
    texts = [noise(9000) + passage + noise(3000), noise(500), passage, "", noise(50) + passage[:399], noise(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_removed"] for r in removed_passages(docs).collect()}
    assert got == {0: 700, 1: 0, 2: 700, 3: 0, 4: 0, 5: 0}


def test_pipeline_cuts_passages_of_over_fifty_words(spark):
    rng = random.Random(31)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(1 + i % 9)) for i in range(n))
    passage, phrase = prose(55), prose(30)
    assert 300 < len(passage) < 400
    texts = [f"{prose(80)} {p} {prose(80)}" for p in (passage, passage, phrase, phrase, prose(55))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()}
    assert all(passage not in cut[i] and 0 <= len(texts[i]) - len(cut[i]) - len(passage) <= 3 for i in (0, 1))
    assert [cut[i] for i in (2, 3, 4)] == texts[2:]
    # strings of op9's length stay within its contract
    assert {r["n_removed"] for r in removed_passages(docs).collect()} == {0}


def test_records_of_single_samples_are_not_moved_by_their_bytes(spark, monkeypatch):
    kept = {}
    plain = suffix_dedup.stage_table

    def counted(df, name):
        out = plain(df, name)
        kept.setdefault(name, out.count())
        return out

    monkeypatch.setattr(suffix_dedup, "stage_table", counted)
    rng = random.Random(32)
    noise = lambda n: "".join(rng.choice("defghi ") for _ in range(n))
    passage = noise(500)
    texts = [noise(20_000), noise(9000) + passage, passage + noise(9000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in removed_passages(docs).collect()} == {0: 0, 1: 500, 2: 500}
    assert kept["groups"] <= 20 < 150 < kept["runs"]


def test_repeated_rows_are_one_node(spark, monkeypatch):
    most = []
    confirm = near_dedup.confirm

    def counted(pairs, signs, sets, percent):
        most.append((signs.count(), sets.count()))
        return confirm(pairs, signs, sets, percent)

    monkeypatch.setattr(near_dedup, "confirm", counted)
    words = [f"w{i}" for i in range(300)]
    near, far = [*words[:299], "other"], [f"v{i}" for i in range(300)]
    texts = {1: " ".join(words), 2: " ".join(near), 3: " ".join(far)}
    rows = [(1, texts[1])] * 5000 + [(2, texts[2])] * 5000 + [(3, texts[3])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    counts = {(r["doc_id"], r["component_id"], r["kept"]): r["count"]
              for r in got.groupBy("doc_id", "component_id", "kept").count().collect()}
    assert counts == {(1, 1, True): 5000, (2, 1, False): 5000, (3, 3, True): 1}
    assert set(most) == {(2, 2)}
