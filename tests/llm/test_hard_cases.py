"""Colliding words, texts that aren't made of words, hot and sparse keys, many languages, lost chunks; each against brute force or the library."""

import collections
import itertools
import random
import unicodedata
import zlib

import numpy as np
import pytest

from cadenza.llm import chat, common, decontaminate, languages, media_chunks, near_dups, pieces, pii, quality, sst, token_counts, vocab, wordhash

WORDS, BYTES, PIECES = (vocab.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
D = "/root/testdata/sf0.001"


def folded(n, a, b):
    """The Thue-Morse word of n letters: with its complement it has the same value in every polynomial hash modulo 2**64."""
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("a,b", [("H", "2"), ("a", "b")])
def test_folded_words_are_told_apart(a, b):
    for n in (64, 256, 512, 2048):
        one, two = folded(n, a, b), folded(n, b, a)
        assert near_dups.set_of(one.encode())[0] != near_dups.set_of(two.encode())[0]
        assert decontaminate.hashes(one)[0] != decontaminate.hashes(two)[0]
        for own in (vocab.byte_level(BYTES), pieces.model(PIECES)):
            text = f"x {one} {two} {one}"
            assert own.encode_all([text.encode(), two.encode()]) == [own.whole(text), own.whole(two)]


@pytest.mark.parametrize("bits", [0, 4])
def test_word_tables_survive_colliding_hashes(monkeypatch, bits):
    plain, rng = wordhash.Lanes.hashes, random.Random(bits)
    monkeypatch.setattr(wordhash.Lanes, "hashes", lambda self: plain(self) & np.uint64((1 << bits) - 1))
    texts = [" ".join(rng.choice(["alpha", "beta", "gam", "ma", "x"]) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    for own in (vocab.ByteLevelEncoder(BYTES), pieces.Model(pieces.read_pieces(PIECES))):
        for _ in range(2):
            assert own.encode_all([t.encode() for t in texts]) == [own.whole(t) for t in texts]
    counter = token_counts.Counter(WORDS)
    assert [int(p[2][-1]) if len(p[2]) else 0 for p in counter.profiles(texts)] == [counter.library(t) for t in texts]


PARTS = ["a", "b", "the", "ing", "E", "é", "é", "́", "̖", "'", "'s", "'re", "'l", "r", "e", "v", "l", "!", "?", "1", "23", " ", "\n", "\t", "\xa0", "　", "\x1c", "<|endoftext|>", "<|", "endo", "|>", "İ", "Σ", "ﬁ", "한", "ᄒ", "ᅡ", "ᆫ", "日本", "😀", "Å", "≠", "Ω", "ொ", "‍", "_", "-", "﻿", "\x85"]


def test_counts_at_every_prefix_equal_the_library():
    own, rng = token_counts.counter(WORDS), random.Random(11)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    for text in [*texts, "a'b" * 60, "é" * 80, "x" * 90, "!<|endoftext|>" * 5]:
        profile, want = own.profile(text), [own.library(text[:k]) for k in range(len(text) + 1)]
        assert [own.at_prefix(profile, k) for k in range(len(text) + 1)] == want
        for budget in (0, 1, 3, 7, 40):
            assert own.cut(profile, budget) == max(k for k, n in enumerate(want) if n <= budget)


@pytest.mark.parametrize("part", ["alpha\tBeta\tgam7\t", "it's;don't=x(1)", unicodedata.normalize("NFD", "éàüñ"), "abcdefghij"])
def test_counting_is_linear_whatever_the_text(part):
    import time

    own, took = token_counts.counter(WORDS), []
    for size in (100_000, 400_000):
        text = part * (size // len(part))
        start = time.process_time()
        profile = own.profile(text)
        cut = own.cut(profile, 2048)
        took.append(time.process_time() - start)
        assert int(profile[2][-1]) == own.library(text) and own.library(text[:cut]) <= 2048 < own.library(text[: cut + 8])
    assert took[1] < 10 * took[0] + 1


def test_windows_keep_the_system_turn_and_do_not_depend_on_turn_numbers(spark):
    rng, rows = random.Random(3), []
    for conv, (n, step, size) in enumerate([(9, 1, 700), (300, 1, 3), (300, 10**6, 3), (5, 200, 4000), (40, 0, 5)]):
        said = [("system", "be brief " * 20)] + [("user" if k % 2 else "assistant", " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, size)))) for k in range(1, n)]
        rows += [(conv, k * step, r, t) for k, (r, t) in enumerate(said)]
    rows += [(None, k, "assistant", f"t{k}") for k in range(5)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7), WORDS).collect()
    by_conv = collections.defaultdict(list)
    for r in sorted(made, key=lambda r: (r.block, r.window)):
        by_conv[r.conv_id].append(r)
    for conv, windows in by_conv.items():
        own = [(r[2], r[3]) for r in rows if r[0] == conv]
        if conv == 4:  # all turns have one number: they are ordered by role, then text, and no system turn comes first
            own.sort()
        turns = [chat.parsed(w.text) for w in windows]
        assert [t[:2] for w, t_ in zip(windows, turns) for t in t_[w.n_repeated :]] == own
        if conv in (0, 1, 2, 3):
            assert all(t[0][:2] == own[0] for t in turns)
        fresh = [token_counts.counter(WORDS).library(chat.written(*own[0])[0]) for _ in range(1)][0]
        assert all(w.n_tokens <= chat.BUDGET or (w.n_new == 1 and w.n_repeated <= 1) for w in windows), fresh
    assert [(w.text, w.n_repeated) for w in by_conv[1]] != [] and len(by_conv[2]) <= -(-300 // chat.BLOCK) + 1


def test_any_number_of_languages(spark):
    rng = random.Random(4)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(12)] for k in range(150)}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(sorted(words) * 8)]
    docs = spark.createDataFrame([*rows, (-1, None, "l000"), (-2, "123 ...", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in languages.identify(docs).collect()}
    assert got[-1].lang_pred == got[-2].lang_pred == "und" and got[-1].score == 0
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[i].held_out for i, *_ in held) and sum(got[i].lang_pred == lang for i, _, lang in held) > 0.98 * len(held)


def test_predictions_equal_a_filter_of_plain_sets(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    own = languages.learn(docs.select("lang", "text").fillna({"text": ""}))
    counts = collections.defaultdict(collections.Counter)
    texts = [(r.lang, r.text or "") for r in docs.collect()]
    for lang, text in texts:
        if lang is not None:
            counts[lang].update(languages.ngrams(text).tolist())
    langs = sorted(counts)
    has = {lang: {c for c, n in counts[lang].items() if n >= languages.SHARE * sum(counts[lang].values())} for lang in langs}
    assert own.langs == langs
    every = np.array(sorted(set().union(*has.values())), np.int64)
    held = own.holding(every)
    for k, lang in enumerate(langs):  # all languages that have an n-gram, and few by chance
        bits = (held[:, k >> 6] >> np.uint64(k & 63) & np.uint64(1)).astype(bool)
        true = np.array([c in has[lang] for c in every.tolist()])
        assert bits[true].all() and bits[~true].mean() < 0.02
    filled = [set() for _ in langs]
    for k, lang in enumerate(langs):
        for s in languages.slots(np.array(sorted(has[lang]), np.int64), len(own.masks)):
            filled[k] |= set(s.tolist())
    for _, text in texts[:60]:
        codes = languages.ngrams(text)
        if not len(codes):
            assert own.predict(text) == ("und", 0.0)
            continue
        at = list(zip(*[s.tolist() for s in languages.slots(codes, len(own.masks))]))
        fair = []
        for f in filled:
            chance = (len(f) / len(own.masks)) ** languages.PLACES
            fair.append(max(0.0, (sum(all(p in f for p in places) for places in at) - len(at) * chance) / (1 - chance)))
        best = max(range(len(langs)), key=lambda k: (fair[k], -k))
        assert own.predict(text) == (langs[best], pytest.approx(fair[best] / sum(fair)))


def test_lost_chunks_raise(spark):
    text = " ".join(f"w{k}" for k in range(4000))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "short")], "doc_id long, text string")
    media, chunks = media_chunks.write_store(common.id_bytes(docs))
    assert media_chunks.read_media(media, chunks).count() == 3
    with pytest.raises(Exception, match="damaged or missing"):
        media_chunks.read_media(media, chunks.limit(0)).collect()


def test_shards_grow_in_number_with_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sst, "SHARD_BYTES", 5000)
    docs = spark.createDataFrame([(k, f"text {k} " * 40) for k in range(300)], "doc_id long, text string")
    manifest = sst.write_shards(common.id_text(docs), str(tmp_path / "plain"), BYTES, 2)
    assert manifest.count() > 10 and all(r.path.startswith("file:") for r in manifest.collect())
    got = sst.read_shards(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(300))
    assert [r.start for r in got] == list(itertools.accumulate((r.n_tokens for r in got[:-1]), initial=0))


def test_shared_openings_and_repeated_words_take_little_memory():
    rng, opening = random.Random(5), "the quick brown fox jumps over"
    items = [(i, f"{opening} " + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(20))) for i in range(2000)]
    index = decontaminate.Index(items)
    assert list(decontaminate.covering(index, decontaminate.hashes(f"{opening} x y z " * 1000), 0.8)) == []
    found = list(decontaminate.covering(index, decontaminate.hashes(f"{opening} x " * 500 + items[7][1]), 0.8))
    assert [f[0] for f in found] == [7]
    same = decontaminate.Index([(1, "a " * 300)])
    assert list(decontaminate.covering(same, decontaminate.hashes("a " * 5000), 0.8)) == [(1, 300, 300, 1)]


def test_slices_of_hits_change_nothing(monkeypatch):
    rng = random.Random(6)
    for _ in range(200):
        item, text = (" ".join(rng.choice("abcx") for _ in range(rng.randint(5, 30))) for _ in range(2))
        index, found = decontaminate.Index([(1, item)], 3), []
        for hits in (1, 3, 1 << 20):
            monkeypatch.setattr(decontaminate, "HITS", hits)
            found.append(list(decontaminate.covering(index, decontaminate.hashes(text), 0.0)))
        assert found[0] == found[1] == found[2]


def test_marginals_equal_enumeration_where_the_graph_is_a_tree():
    rng = np.random.default_rng(7)
    for _ in range(10):
        n = 5
        field = pii.Field(np.zeros((pii.L, pii.N_FEATURES)), rng.normal(size=(pii.L, pii.L)), 2.0)
        scores = rng.normal(size=(n, pii.L))
        edges = [(int(rng.integers(0, j)), j, int(rng.integers(0, 2))) for j in range(1, n)]
        total = np.zeros((n, pii.L))
        for labels in itertools.product(range(pii.L), repeat=n):
            p = np.exp(sum(scores[k, x] for k, x in enumerate(labels)) + sum((field.skip if kind else field.chain)[labels[i], labels[j]] for i, j, kind in edges))
            for k, x in enumerate(labels):
                total[k, x] += p
        assert np.allclose(field.marginals(scores, edges), total / total.sum(axis=1, keepdims=True), atol=5e-3)


def test_the_learned_field_does_not_depend_on_partitions(spark):
    rng = random.Random(8)
    rows = [(k % 40, f"call +1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)} or token: ab12cd34ef56ab78{k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (pii.learn(docs.repartition(n), 20) for n in (1, 9))
    assert np.array_equal(one.unary, two.unary) and np.array_equal(one.chain, two.chain)


def test_many_addresses_take_linear_time():
    import time

    took = []
    for n in (1000, 4000):
        text = " ".join(f"mail user.{i}@host.org and user.{i}" for i in range(n))
        start = time.process_time()
        nodes = pii.graph(text)
        took.append(time.process_time() - start)
        assert len(nodes) == 2 * n
    assert took[1] < 10 * took[0] + 0.5


def test_posteriors_equal_plain_python(spark):
    """Every document's posterior from its evidence, by the formulas alone."""
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).collect()
    good = [1 / (1 + np.exp(-r.evidence)) for r in rows]
    rate = float(np.mean(good))

    def weight(sites):  # (n, rate, parent)
        n = sum(s[0] for s in sites)
        noise, spread, sampled = (sum(x) for x in zip(*[(m * p * (1 - p), m * (r - p) ** 2, p * (1 - p)) for m, r, p in sites]))
        between = (spread - sampled) / n
        return min(quality.MOST_WEIGHT, max(quality.LEAST_WEIGHT, noise / n / between - 1)) if between > 0 else quality.MOST_WEIGHT

    def sums(key):
        out = collections.defaultdict(lambda: [0, 0.0])
        for r, g in zip(rows, good):
            out[key(r)][0] += 1
            out[key(r)][1] += g
        return out

    hosts = sums(lambda r: r.host)
    w = weight([(n, g / n, rate) for n, g in hosts.values()])
    hosts = {h: (g + w * rate) / (n + w) for h, (n, g) in hosts.items()}
    paths = sums(lambda r: (r.host, r.path))
    w = weight([(n, g / n, hosts[h]) for (h, _), (n, g) in paths.items()])
    paths = {k: (g + w * hosts[k[0]]) / (n + w) for k, (n, g) in paths.items()}
    for r in rows:
        p = min(1 - 1e-6, max(1e-6, paths[r.host, r.path]))
        odds = r.evidence + np.log(p / (1 - p)) - np.log(rate / (1 - rate))
        assert r.path_rate == pytest.approx(p, abs=1e-9) and r.posterior == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-9) and r.kept == (r.posterior >= 0.5)


def test_quality_on_documents_that_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    seen = labels.where("doc_id % 3 <> 0")
    got = {r.doc_id: r.kept for r in quality.classify(docs, seen).collect()}
    rest = [(r.doc_id, r.quality, r.toxic) for r in labels.where("doc_id % 3 = 0").collect() if r.doc_id in got]
    share = lambda test, kept: np.mean([got[d] == kept for d, q, t in rest if test(q, t)])
    assert share(lambda q, t: q == 1 and t == 0, True) > 0.98
    assert share(lambda q, t: q == 0, False) > 0.97 and share(lambda q, t: t == 1, False) > 0.88


def test_logistic_regression_reaches_its_optimum():
    rng = np.random.default_rng(10)
    n, k = 200, 6
    full = (rng.random((n, k)) < 0.4) * rng.random((n, k))
    shapes, y = rng.normal(size=(n, 3)) * [1, 10, 0.1] + 5, rng.random(n) < 0.3
    rows, at = np.nonzero(full)
    w, own, bias = quality.fit(rows, at, full[rows, at], shapes, y, k)
    p = 1 / (1 + np.exp(-(full @ w + shapes @ own + bias)))
    pull = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum()) * (p - y)
    assert abs(pull.sum()) < 1e-6 and np.allclose(full.T @ pull + quality.RIDGE * w, 0, atol=1e-6)


def test_the_model_is_the_same_whatever_the_partitions(spark):
    rows = [(k, " ".join(f"{'good' if k % 2 else 'bad'}{j * 7 % 1000}" for j in range(2000))) for k in range(60)] + [(4, "again")] * 3
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    own, again = quality.learn(docs, labels), quality.learn(docs.repartition(5), labels.repartition(3))
    assert own.of([rows[1][1]])[0] > 0 > own.of([rows[2][1]])[0]
    assert np.array_equal(own.buckets, again.buckets) and np.allclose(own.of([r[1] for r in rows]), again.of([r[1] for r in rows]))


def test_sites_of_urls(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet")
    host, path = quality.site_of(pages["url"])
    docs = pages.select(pages["page_id"].alias("doc_id"), pages["html"].alias("text"), host.alias("site"), path.alias("part"))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, "site", "part").collect()
    assert len(got) == docs.count() and all("." in r.host and "/" not in r.path for r in got)


def test_pipeline_by_brute_force_on_awkward_rows(spark, tmp_path):
    """Plain Python decides who stays: no labels reject anyone, one of each group of near copies stays, benchmark passages go, addresses are hidden."""
    import re

    import corpus_pipeline

    rng = random.Random(9)
    passage = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    a, b, item = passage(104), passage(60), passage(30)
    near, far = list(a), list(a)
    near[30], near[70] = "x", "y"  # 0.818
    for k in range(5, 100, 12):
        far[k] = f"z{k}"
    texts = {
        1: " ".join(a), 2: " ".join(near), 3: " ".join(far), 4: " ".join(a), 5: " ".join(b), 6: " ".join(passage(20) + item + passage(20)), 7: None, 8: "", 9: " \n\t", 10: "one two",
        11: " ".join(passage(12)) + " mail jane.doe@example.org or call +1 555 123 4567", 12: " ".join(passage(20000)), 13: "日本語 é " + " ".join(passage(8)),
    }
    rows = [(d, t, "en", "s", None, True, "k", 5, "z") for d, t in texts.items()] + [(5, texts[5], None, None, 3, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, key string, component_id long, host string"
    for n, some in enumerate((rows, [])):
        folder = str(tmp_path / f"t{n}")
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        if not some:
            assert out == []
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for d, w in ((d, (t or "").split()) for d, t in texts.items()) if w}
    gone = {max(x, y) for x, y in itertools.combinations(sorted(sets), 2) if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    leaks = {d for d, t in texts.items() if " ".join(item) in " ".join(re.findall(r"\w+", t or ""))}
    own, got = pieces.model(PIECES), {}
    for r in corpus_pipeline.run(spark, str(tmp_path / "t0")).collect():
        assert r.doc_id not in got and r.exact
        got[r.doc_id] = own.decode(np.array(r.ids, np.int64))
    assert gone == {2, 4} and leaks == {6} and set(got) == set(texts) - gone - leaks
    hidden = re.sub(r"\S+@\S+", "[EMAIL]", re.sub(r"\+1 555 123 4567", "[PHONE]", texts[11]))
    assert got[11] == hidden and all(got[d] == (texts[d] or "") for d in got if d != 11)
