"""Each operator against brute force on a small table with nulls, ties, copies, long texts and clashing columns, and on an empty one."""

import hashlib
import os
import zlib
from collections import Counter
from math import log, log10

import numpy as np
import public_tokenizers
import pytest
from conftest import lower, split
from tokenizers import Tokenizer

from arborix.llm import decontaminate, embedding_dedup, host_reputation, lm, ngram_join, packing, quality, rans, sharding, substring_dedup, token_file
from arborix.llm._spark import scratch, shared_dir, sieve


def key(i):
    return (i is not None, i)


def crc_ids(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# -- 1 ---------------------------------------------------------------------------------------------------


def test_decontamination(spark, odd, none):
    item = "what is the colour of the old house at the end of the long road by the river answer it is green with a red door"
    other = "which bird sings at night in the garden behind the church answer the small brown nightingale of course sings there"
    docs = odd.select("doc_id", "text", "score").unionByName(
        spark.createDataFrame(
            [(100, "before " * 300 + item.upper() + " after" * 300, 0.1), (101, item, 0.1), (102, " ".join(item.split()[:12]) + " and then something else entirely follows", 0.1), (103, other + " " + item, 0.1), (None, item, 0.1)],
            "doc_id bigint, text string, score double",
        )
    )
    items = spark.createDataFrame([(1, item, "q"), (2, other, "q"), (3, None, "q"), (4, "", "q"), (5, item, "q"), (6, "w w w", "q")], "item_id bigint, text string, score string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(d, i) for d in (100, 101, 103, None) for i in (1, 5)} | {(103, 2)}
    assert {r.doc_id for r in decontaminate.contaminated(docs, items, max_bytes=1).collect()} == {100, 101, 103, None}
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} & {100, 101, 103} == set()
    assert kept.count() == docs.count() - 4
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0


def test_decontamination_judges_the_whole_item(spark):
    item = "what is the colour of the old house at the end of the long road by the river answer it is Élan green with a red door"
    w = item.split()
    rows = [
        (1, "intro " + item + "less and more"),
        (2, "intro " + item.replace("door", "gate") + " more"),
        (3, "(«" + "», — ".join(w).upper() + "»)!"),
        (4, " ".join(w[:14]) + " and nothing of the rest"),
        (5, " ".join(w[:16]) + " blue as the sea and the sky above the harbour wall"),
        (6, "-- ... !!"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, "?!")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1)} and got[3, 1].overlap == 1 and got[3, 1].question_overlap is None
    both = spark.createDataFrame([(1, " ".join(w[:17]), " ".join(w[17:]))], "item_id bigint, question string, answer string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, both, share=0.1).collect()} == {1, 2, 3}
    assert {r.doc_id for r in decontaminate.contaminated(docs, both, share=0.1, least_overlap=0.9).collect()} == {3}


def test_search_equals_bm25_by_definition(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"t{i}" for i in range(300)]
    items = {k: " ".join(rng.choice(vocabulary, rng.integers(5, 40))) for k in range(70)} | {70: " ".join(rng.choice(vocabulary, 150)), 71: "t1"}
    texts = {k: " ".join([*rng.choice(vocabulary, rng.integers(0, 200)), *items[k].split(), *rng.choice(vocabulary, 90)]) for k in range(40)} | {40: "t3 t4", 41: "x " * 90 + items[70], 42: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    table = spark.createDataFrame(list(items.items()), "item_id bigint, text string").repartition(2)
    words = {i: Counter(t.split()) for i, t in items.items()}
    df = Counter(w for c in words.values() for w in c)
    mean = sum(sum(c.values()) for c in words.values()) / len(items)
    impact = lambda i, w: log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * words[i][w] * 2.2 / (words[i][w] + 1.2 * (0.25 + 0.75 * sum(words[i].values()) / mean))
    want = {}
    for d, t in texts.items():
        w = t.split()
        for i in items:
            span = 64 if sum(words[i].values()) <= 64 else 256
            starts = range(0, max(1, len(w) - span), span)
            scores = [sum(impact(i, x) for x in set(w[a : a + 2 * span]) if x in words[i]) for a in starts]
            good = [s for s in scores if s >= 0.3 * sum(impact(i, x) for x in words[i]) - 1e-6]
            if good:
                want[d, i] = (round(max(good), 6), len(good))
    assert len(want) > 60
    for size in (1, 3000, 1 << 25):
        got = {(r.doc_id, r.item_id): (round(r.score, 6), r.n_passages) for r in decontaminate.contaminated(docs, table, 0.3, 0.0, size).collect()}
        assert got == want


# -- 2 ---------------------------------------------------------------------------------------------------


def test_quality(spark, odd, none):
    good = [(1000 + i, " ".join(f"word{(i * k) % 97}" for k in range(1, 60)) + ".") for i in range(120)]
    bad = [(2000 + i, " ".join(f"WORD{(i * k) % 97}!!" for k in range(1, 60))) for i in range(120)]
    docs = odd.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(i, t, 0.0) for i, t in good + bad], "doc_id bigint, text string, score double"))
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None), (6, 1), (6, 1)], "doc_id bigint, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    said = {r.doc_id: r.predicted for r in rows if r.held_out}
    assert np.mean([said[i] == 1 for i, _ in good if i in said] + [said[i] == 0 for i, _ in bad if i in said]) > 0.97
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {i for i, _ in good} <= {r.doc_id for r in kept.collect()}


def test_weights_and_scores_by_definition():
    """Hashed n-grams as counts in dictionaries, one coordinate at a time, against the arrays."""
    import pyarrow as pa
    from math import exp, sqrt

    rng = np.random.default_rng(13)
    texts = [" ".join(rng.choice(["Good", "bad!", "the", "12", "THE"], rng.integers(0, 12))) for _ in range(40)]
    labels = rng.integers(0, 2, 40).astype(float)
    grams, off = quality.features(pa.array(texts), 10)
    for k, t in enumerate(texts):
        assert off[k + 1] - off[k] == 4 * len(t.split())  # a word and a pair of words, as they are and by their form
    same = quality.features(pa.array(["a b", "x a b"]), 10)[0]
    assert set(same[4:8].tolist()) & set(same[12:].tolist())
    rows = []
    for k in range(40):
        count = Counter(grams[off[k] : off[k + 1]].tolist())
        rows.append({g: np.float32(n * (4 / max(1, off[k + 1] - off[k]))).item() for g, n in count.items()} | {1 << 10: 1.0})
    z, n = Counter(), Counter()

    def weight(g):
        if abs(z[g]) <= 0.0005:
            return 0.0
        return -(z[g] - (0.0005 if z[g] > 0 else -0.0005)) / ((1 + sqrt(n[g])) / 1.5 + 0.01)

    for _ in range(3):
        for x, y in zip(rows, labels.tolist(), strict=True):
            w = {g: weight(g) for g in x}
            p = 1 / (1 + exp(-sum(w[g] * v for g, v in x.items())))
            for g, v in x.items():
                d = (p - y) * v
                z[g] += d - (sqrt(n[g] + d * d) - sqrt(n[g])) / 1.5 * w[g]
                n[g] += d * d
    got = quality.train(pa.array(texts), labels, 10)
    assert np.allclose(got, [weight(g) for g in range((1 << 10) + 1)], atol=1e-9)
    want = [1 / (1 + exp(-sum(weight(g) * v for g, v in x.items()))) for x in rows]
    assert np.allclose(quality.score(pa.array(texts), got, 10), want, atol=1e-6)


# -- 3 ---------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24))
    near = base[:20] + 0.15 * rng.normal(size=(20, 24))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, near, base[:5], base[:3] * 2]))]
    rows += [(500, None, 1), (501, [0.0] * 24, 1), (502, [float("nan")] * 24, 1), (503, [None] + [1.0] * 23, 1), (504, [], 1), (505, [1.0, 2.0], 1), (None, base[7].tolist(), 1), (3, base[40].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({"class": __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x")})
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    cut = embedding_dedup.near_duplicates(df, tile=3).collect()  # every bucket in several blocks
    assert Counter(cut) == Counter(got)
    good = [(i, np.array(v, float)) for i, v, _ in rows if v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    link = x @ x.T >= 0.95
    n = Counter()
    for k, (i, _) in enumerate(good):
        n[i] += int(link[k].sum()) - 1
    have = Counter()
    for r in got:
        have[r.vec_id] += r.n_links
    assert sum(have.values()) >= 0.9 * sum(n.values()) and all(have[i] <= n[i] for i in have)
    lone = {r.vec_id: r for r in got if r.vec_id in (500, 501, 502, 503, 504, 505)}
    assert all(r.n_links == 0 and r.kept and r.component_id == i for i, r in lone.items())
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=24) + 0.04 * rng.normal(size=(400, 24)), rng.normal(size=(100, 24))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, tile=90).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    n = (u @ u.T >= 0.95).sum(1) - 1
    have = np.array([got[i].n_links for i in range(len(x))])
    assert (have <= n).all() and have.sum() >= 0.99 * n.sum()
    assert {got[i].component_id for i in range(400)} == {0}


def test_hadamard_is_orthogonal():
    h = embedding_dedup.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, 16 * np.eye(16))


# -- 4 ---------------------------------------------------------------------------------------------------


def test_language_model(spark, odd, plain, none):
    got = lm.score(odd).collect()
    assert len(got) == len(plain)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = Counter()
    for i, t in plain:
        if not held(i):
            train.update([*split(lower(t)), None])
    total, kinds = sum(train.values()), len(train)
    want = Counter()
    for i, t in plain:
        w = [*split(lower(t)), None]
        want[(i, held(i), len(w), sum(train[x] > 0 for x in w), round(sum(log10((train[x] + 1) / (total + kinds + 1)) for x in w), 4))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}
    assert all(r.score < 0 for r in got)
    assert lm.score(none).count() == 0


def test_context_tree_keeps_every_context(spark):
    from math import exp, lgamma, log, log2, pi

    D = lm.DEPTH

    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("abcdefghijklmnopqrst"), 40_000))
    texts = {4: long, 1: long[20_000:20_060], 5: "zebra " + long[7:30] + " é", 6: ""}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    assert long in train and len(train) < len(texts)
    runs = lambda t: [(b"\xff" * D + t.encode() + b"\xff")[k : k + D + 1] for k in range(len(t.encode()) + 1)]
    decisions = lambda x: [((256 | x) >> 8 - j, x >> 7 - j & 1) for j in range(8)]
    count = {}
    for t in train:
        for r in runs(t):
            for d in range(D + 1):
                for k, bit in decisions(r[D]):
                    count.setdefault((r[D - d : D], k), [0, 0])[bit] += 1
    assert len({c for c, _ in count}) > 2 * 32_768
    block = lambda a, b: lgamma(a + 0.5) + lgamma(b + 0.5) - log(pi) - lgamma(a + b + 1)
    below, stop = Counter(), {}
    for c, k in sorted(count, key=lambda x: -len(x[0])):
        own = weighted = block(*count[c, k])
        if len(c) < D:
            high = max(own, below[c, k])
            weighted = high + log(0.5 * exp(own - high) + 0.5 * exp(below[c, k] - high))
        stop[c, k] = 1 if len(c) == D else exp(log(0.5) + own - weighted)
        below[c[1:], k] += weighted if c else 0

    def bits(r):
        total = 0
        for k, bit in decisions(r[D]):
            p = 0.5
            for d in range(D, -1, -1):
                at = r[D - d : D], k
                if at in count:
                    a, b = count[at]
                    p = stop[at] * (b + 0.5) / (a + b + 1) + (1 - stop[at]) * p
            total -= log2(p if bit else 1 - p)
        return total

    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    for i, t in texts.items():
        want = sum(map(bits, runs(t)))
        assert got[i].n_bytes == len(runs(t)) and got[i].bits_per_byte * got[i].n_bytes == pytest.approx(want, rel=1e-5), i


# -- 5 ---------------------------------------------------------------------------------------------------


def covered(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: key(r[0])):
        w = split(text)
        hit = [False] * len(w)
        for a in range(len(w) - 19):
            x = tuple(w[a : a + 20])
            if x in seen:
                hit[a : a + 20] = [True] * 20
            seen.add(x)
        out[i] = (len(w), sum(hit), hashlib.sha256(" ".join(x for x, h in zip(w, hit, strict=True) if not h).encode()).hexdigest())
    return out


def test_substring_dedup(spark, odd, plain, none):
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{i}" for i in range(60))
    extra = [(100 + i, " ".join([*rng.choice(["a", "b", "c", "d"], 30), passage, *rng.choice(["x", "y"], 40), passage[: 100 + i]])) for i in range(12)]
    extra += [(200, "the " * 50), (201, "the " * 25)]
    unique = [(i, t) for i, t in dict(plain).items() if i is not None] + extra  # one row for each id
    df = spark.createDataFrame([(i, t, "k") for i, t in unique], "doc_id bigint, text string, kid string").repartition(4)
    want = covered(unique)
    for batches in (1, 3):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(df, batches).collect()}
        assert got == want
    index = scratch(spark, "prints")
    substring_dedup.find(df, root=index).count()
    assert substring_dedup.FingerprintIndex(spark, index, 4).runs() == [(1, 5)]  # the query's own settings end in a compacted run
    assert substring_dedup.dedup(odd).count() == odd.count()
    text = {r.doc_id: r for r in substring_dedup.without_repeats(df).collect()}
    assert text[1].text is None and set(text[5].asDict()) == {"doc_id", "text", "kid"} and text[6].text == ""
    assert substring_dedup.dedup(none).count() == 0


def test_fingerprint_runs_are_sorted_and_compacted(spark):
    index = substring_dedup.FingerprintIndex(spark, scratch(spark, "index"), 4)
    before, found = None, 0
    base = " ".join(f"w{i}" for i in range(40))
    for k in range(5):
        batch = spark.createDataFrame([(k, base + f" tail{k}")], "kid bigint, text string")
        spans = substring_dedup.append(index, batch, before)
        found += spans.where(f"kid = {k}").count()
        before = batch if before is None else before.unionByName(batch)
    assert found == 4  # every batch but the first meets history
    assert index.runs() == [(0, 5), (1, 5)] or len(index.runs()) == 2
    for r in index.read(index.runs()).collect():
        assert (np.diff(np.frombuffer(r["keys"], "<u8").astype(float)) >= 0).all()


# -- 6 ---------------------------------------------------------------------------------------------------


def test_host_reputation(spark):
    urls = ["https://A.Example.ORG/es/1?x", "http://b.example.org/en/12#t", "http://x.org", "https://shop.com/fr/2/", "https://com/de/3", "no url", None, "http://x.net?q/a", "ftp://x.net/7/\nz", "http://evil.net/5", "http://evil.net/6.html", "http://a.co.uk/8"]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)] + [(None, None, None, None)], "page_id bigint, url string, html string, host string")
    labels = spark.createDataFrame([(5, 0, 0), (6, 0, 1), (7, 1, 0), (8, 1, None), (None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: r for r in host_reputation.judge(pages, labels).collect()}
    assert len(got) == len(urls) + 1
    shown = {i: (r.host, r.path, r.rule) for i, r in got.items()}
    assert shown[0] == ("a.example.org", "/es/1", "example.org/es/") and got[0].verdict == "block"
    assert shown[1] == ("b.example.org", "/en/12", "example.org/en/1") and got[1].verdict == "block"
    assert shown[2] == ("x.org", "", None) and shown[3] == ("shop.com", "/fr/2/", "com/fr/") and shown[4] == ("com", "/de/3", "com/de/")
    assert shown[5] == shown[6] == shown[None] == ("", "", None) and shown[7] == ("x.net", "", None) and shown[8] == ("x.net", "/7/\nz", None)
    assert got[9].posterior_mean < got[7].posterior_mean and got[3].verdict == "allow"
    more = spark.createDataFrame([("a.com:8080", 0, 1), ("10.0.0.7", 0, 1), ("10.0.0.7:80", 1, 2), ("b.co.uk:1", 1, 1)], "host string, good long, n long")
    split = {r.host: (r.s, r.d) for r in more.select("host", *[c.alias(n) for c, n in zip(host_reputation.suffix_and_domain(more.host), "sd", strict=True)]).collect()}
    assert split == {"a.com:8080": ("com", "a.com"), "10.0.0.7": ("10.0.0.7",) * 2, "10.0.0.7:80": ("10.0.0.7",) * 2, "b.co.uk:1": ("co.uk", "b.co.uk")}
    assert host_reputation.judge(pages.where("false"), labels).count() == 0
    assert {r.verdict for r in host_reputation.judge(pages, labels.where("false")).collect()} <= {"allow", "block"}


# -- 7 ---------------------------------------------------------------------------------------------------


def test_sharding(odd, plain, none):
    rows = sharding.by_bytes(odd).collect()
    assert len(rows) == len(plain)
    byte = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len(byte(t)) + 1, zlib.crc32(byte(t))) for i, t in plain)
    rows.sort(key=lambda r: (r.shard, r.slot))
    assert [key(r.doc_id) for r in rows] == sorted(key(r.doc_id) for r in rows)
    total, upto = sum(r.size for r in rows), 0
    for r in rows:
        assert r.shard == min(7, (2 * upto + r.size) * 8 // (2 * total)) and r.law == "bytes" and r.grown_shard is None
        upto += r.size
    for s in range(8):
        slots = [r.slot for r in rows if r.shard == s]
        assert slots == list(range(len(slots)))
    assert sharding.by_bytes(none).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------------


def test_token_file(spark, odd, plain, none):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(vocabulary)
    path = scratch(spark, "tokens")
    token_file.write(odd, path, vocabulary)
    rows = sorted(token_file.read(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [key(r.doc_id) for r in rows] == sorted(key(i) for i, _ in plain)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == crc_ids(r.ids)
        at += r.n_tokens
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((i, (*tok.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in plain)
    path = scratch(spark, "tokens")
    token_file.write(none, path, vocabulary)
    assert token_file.read(spark, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 129, 70_001])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.4, n) - 1, 49_000).astype(np.uint32)
    coder = rans.Coder(*rans.table(ids))
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all()
    assert (np.concatenate([coder.decode(block, 0), coder.decode(block, 1)]) == ids).all()
    if n > 100:
        with pytest.raises(ValueError):
            coder.decode(block | {"crc": block["crc"] ^ 1})


# -- 9 ---------------------------------------------------------------------------------------------------


def test_packing(odd, plain, none):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(vocabulary)
    rows = packing.pack(odd, vocabulary).collect()
    texts = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in plain if i is not None}
    have = {}
    for r in rows:
        if r.doc_id is not None:
            ids = texts[r.doc_id]
            assert r.doc_tokens == len(ids) and r.ids_crc32 == crc_ids(ids[r.start : r.start + r.length])
            have.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, got in have.items():
        copies = sum(x == i for x, _ in plain)
        assert sum(n for _, n in got) == len(texts[i]) * copies
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert set(by) == set(range(len(by)))
    assert packing.pack(none, vocabulary).count() == 0


def test_padding_is_small(spark):
    rng = np.random.default_rng(12)
    docs = spark.createDataFrame([(i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 1500, 4000))], "doc_id bigint, text string").repartition(6)
    size = Counter()
    for r in packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect():
        size[r.sequence_id] += r.length
    padded = sum(0 if n & (n - 1) == 0 else 1024 - n for n in size.values())
    assert padded < 0.01 * sum(size.values())


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    hist = np.bincount(rng.integers(1, 1024, 20_000), minlength=1025)
    hist[700] += 5000
    steps = packing.plan(hist, 1024)
    used = np.zeros(1025, np.int64)
    for length, a, b, _, _ in sorted(steps):
        assert a == used[length]
        used[length] = b
    assert (used == hist).all()


# -- 10 --------------------------------------------------------------------------------------------------


def jaccard_components(rows):
    sets = []
    for _, t in rows:
        w = split(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    names = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            names[find(a)] = min(i, names.get(find(a), i))
    return Counter((i, len(sets[a]), names.get(find(a)) if sets[a] else i) for a, (i, _) in enumerate(rows))


def test_ngram_join(spark, odd, plain, none):
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in range(120)]
    rows = list(plain)
    for i in range(70):  # near copies that link in chains, more than a short list holds
        w = list(base)
        for k in rng.integers(0, 120, i % 5):
            w[k] = f"z{rng.integers(1e6)}"
        rows.append((1000 + i, " ".join(w)))
    passage = " ".join(f"q{i}" for i in range(30))
    rows += [(2000 + i, " ".join([*(f"u{i}_{k}" for k in range(40)), passage])) for i in range(30)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id bigint, text string, n int, skey string").repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df).collect())
    assert got == jaccard_components(rows)
    assert ngram_join.join(none).count() == 0


def test_bit_counts_never_drop_a_link():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        x = np.sort(rng.choice(1 << 40, n, replace=False)).astype(np.uint64)
        y = np.unique(np.concatenate([x[rng.random(n) < 0.9], rng.choice(1 << 40, int(rng.integers(0, 1 + n // 5))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 75 * (len(x) + len(y) - both):
            sig = ngram_join.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            assert ngram_join.may_link(len(x), sig[0], len(y), sig[1])


def test_components_in_rounds(spark):
    from arborix.llm.graph import components, local_labels

    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-500, 500, (450, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(7)
    nodes, roots = local_labels(*np.array([p for p in pairs if p[0] != p[1]]).T)
    got = {(r.node, r.root) for r in components(edges).collect()}
    assert got == set(zip(nodes.tolist(), roots.tolist(), strict=True)) and (1040, 1000) in got
    assert components(edges.where("false")).count() == 0


def test_crowded_postings_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):  # all texts share a passage; some are near copies
        w = [f"{'abc'[i % 3]}{k}" for k in range(40)] + [f"q{k}" for k in range(30)]
        for k in rng.integers(0, 70, i % 4):
            w[k] = f"z{rng.integers(1e6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    monkeypatch.setattr(ngram_join, "CROWD", 2)
    monkeypatch.setattr(ngram_join, "LONG", 5)
    monkeypatch.setattr(ngram_join, "TILE_SIZE", 1000)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df).collect())
    assert got == jaccard_components(rows)


def test_one_row_of_each_component_stays(spark, odd, none):
    near = " ".join(f"k{i}" for i in range(60))
    rows = [(1, near), (1, near), (1, "another text that has nothing to do with it"), (2, near + " more"), (None, near), (None, near), (3, ""), (3, None), (None, "a lone text without an id here"), (None, "a lone text without an id here")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, skey string, kept int").repartition(4)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([(1, near), (1, rows[2][1]), (3, ""), (3, None), (None, rows[8][1])])
    assert ngram_join.keep_one(none).count() == 0 and ngram_join.keep_one(odd).columns == odd.columns


def test_filters_leave_little_on_disk(spark, odd):
    folder = shared_dir(spark).removeprefix("file://")
    for filtered, left in ((ngram_join.keep_one, {"kept-sets", "repeated-ids"}), (substring_dedup.without_repeats, {"spans"})):
        before = set(os.listdir(folder))
        assert filtered(odd).count()
        assert {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before} == left


def test_sieve_keeps_all_ids_and_few_others(spark, none, monkeypatch):
    ids = spark.range(-3000, 200_000, 7).selectExpr("id").unionByName(spark.createDataFrame([(None,), (-(1 << 63),)], "id bigint"))
    all_ids = spark.range(-3000, 200_000).unionByName(spark.createDataFrame([(-(1 << 63),)], "id bigint"))
    few = sieve(ids)
    assert ids.where("id is not null").where(~few("id")).count() == 0
    assert all_ids.where(few("id")).count() < 1.03 * ids.count()
    assert all_ids.where(sieve(none.select("doc_id"))("id")).count() == 0
    monkeypatch.setattr("arborix.llm._spark.SIEVE_BITS", 19)  # too small for so many: never a loss
    full = spark.range(500_000)
    assert full.where(~sieve(full)("id")).count() == 0


def test_bitmaps_of_a_megabyte_and_more():
    wide, half = np.full((1, 1 << 17), 3, np.uint64), np.full((1, 1 << 16), 3, np.uint64)
    sigs, width = {1 << 20: wide, 1 << 19: half}, np.array([1 << 20, 1 << 20, 1 << 19])
    sigs[1 << 20] = np.concatenate([wide, wide])
    n, row = np.full(3, 5_000_000), np.array([0, 1, 0])
    assert ngram_join._survivors(n, sigs, width, row, np.array([0, 0, 2]), np.array([1, 2, 1])).all()
