"""The ten operators against brute force, libraries and round trips, on the smallest tables and on a table of awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cadenza.llm import chat, common, components, decontaminate, languages, media_chunks, near_dups, pieces, pii, quality, sst, token_counts, vocab

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, key string, component_id long"
LONG = "Lorem ipsum dolor sit amet consectetur " * 4000
TEXTS = [None, "", " \n\t ", "one two", "One TWO", LONG, LONG, "a b c d e f g h", "a b c d e f g h", "mail x.y@z.org and again x.y", "tab\tand　wide  spaces \n\n end ", "▁ mark <|endoftext|> it's", "日本語 テキスト é İ ﬁ", "y" * 5000, "é" * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, ["en", None, "fr"][i % 3], ["h", None][i % 2], None, True, "k", 5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[7:9], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_chunks(docs, odd, none):
    for df in (docs, odd):
        want = collections.Counter()
        for r in df.collect():
            p = media_chunks.payload_of((r.text or "").encode())
            want[r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
        got = media_chunks.store_and_read(df).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
        assert len({(r.payload_sha256, r.media_sha256, r.media_bytes, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert media_chunks.store_and_read(none).count() == 0


def test_chunks_follow_content_and_damage_is_found():
    data = random.Random(1).randbytes(100_000)
    ends = media_chunks.cut(data)
    shifted = media_chunks.cut(b"x" * 77 + data)
    assert len({e + 77 for e in ends} & set(shifted)) > len(ends) * 0.9
    assert all(media_chunks.MIN_CHUNK <= n <= media_chunks.MAX_CHUNK for n in np.diff([0, *ends])[:-1])
    h = media_chunks.gear_hashes(data[:100])
    assert all(int(h[i]) == sum(int(media_chunks.GEAR[data[i - k]]) << k for k in range(32) if k <= i) % 2**32 for i in (0, 31, 99))
    d = hashlib.sha256(b"abc").digest()
    recipe = d + (3).to_bytes(4, "little")
    assert media_chunks.rebuild(recipe, b"abc", {}) == b"abc"
    with pytest.raises(ValueError):
        media_chunks.rebuild(recipe, b"abd", {})


def test_chunk_store_takes_new_chunks_only(spark, docs):
    some = common.id_bytes(docs.limit(20))
    media, chunks = media_chunks.write_store(some.union(some))
    n = chunks.count()
    media, both = media_chunks.write_store(some.union(some), chunks)
    assert n > 0 and both.count() == n and media_chunks.read_media(media, both).count() == 40


PIECES = vocab.path("piece_bpe_32k.model")


def unigram():
    import sentencepiece

    data = open(PIECES, "rb").read()
    at = data.rindex(b"\x18\x02 \x80\xfa\x01")  # the model's kind, in its trainer settings
    return sentencepiece.SentencePieceProcessor(model_proto=data[:at] + b"\x18\x01" + data[at + 2 :])


def test_pieces_are_the_best_segmentation():
    m, lib, rng = pieces.model(PIECES), unigram(), random.Random(2)
    scores = {p: (s, i) for i, (p, s, kind) in enumerate(m.pieces) if kind == pieces.NORMAL}

    def brute(text):
        best = [0.0] + [None] * len(text)
        for e in range(1, len(text) + 1):
            every = [best[s] + (scores[text[s:e]][0] if text[s:e] in scores else m.least) for s in range(max(0, e - 48), e) if text[s:e] in scores or (s == e - 1 and text[s:e] not in scores)]
            best[e] = max(every)
        return best[-1]

    def score(ids):
        return sum(m.pieces[i][1] for i in ids)

    for _ in range(300):
        s = "".join(rng.choice(["the", "tion", " ", "a", "n", "ing", "re"]) for _ in range(rng.randint(1, 8))).strip()
        s = re.sub(" +", " ", s)
        if s:
            ids = m.encode(s).tolist()
            assert abs(score(ids) - brute(pieces.MARK + s.replace(" ", pieces.MARK))) < 1e-6
            assert score(ids) >= score(lib.encode(s)) - 1e-6
            assert abs(score(ids) - score(lib.nbest_encode_as_ids(s, 4)[0])) < 1e-3


def test_pieces_round_trip(docs, odd, none):
    for df in (docs, odd):
        want = texts_of(df)
        out = pieces.encode(df, PIECES).cache()
        got = out.collect()
        assert len(got) == df.count()
        assert all(r.exact == (pieces.MARK not in (want[r.doc_id] or "")) for r in got)
        assert all(hashlib.sha256(want[r.doc_id].encode()).hexdigest() == r.decoded_sha256 for r in got if r.exact)
        assert all(r.text == want[r.doc_id] for r in pieces.decode(out, PIECES).collect() if pieces.MARK not in want[r.doc_id])
    assert pieces.encode(none, PIECES).count() == 0
    m = pieces.model(PIECES)
    for t in filter(None, TEXTS[:13]):
        assert m.encode(t).tolist() == m.viterbi(pieces.MARK + t.replace(" ", pieces.MARK))


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if (k == 0) or (k == 1 and all(int(q) <= 255 for q in m[0].split("."))) or (k == 2 and 13 <= len(d) <= 19 and luhn) or (k == 3 and 9 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def test_pii_base_spans():
    rng = random.Random(3)
    some = list("a1@.+- ()5\nZ_%") + ["12.1.1.1", "4111 1111 1111 1111", "a.b@c.de", "+49 30 1234567"]
    for _ in range(20_000):
        s = "".join(rng.choice(some) for _ in range(rng.randint(0, 14)))
        assert sorted(pii.base_spans(s)) == sorted(brute_pii(s)), s


def test_pii_find_and_redact(docs, odd, none):
    for df in (docs, odd):
        want = texts_of(df)
        for r in pii.find(df).collect():
            base = pii.written(brute_pii(want[r.doc_id]))
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert pii.redact(df).columns == df.columns and pii.redact(df).count() == df.count()
    assert pii.find(none).count() == 0 and pii.redact(none).count() == 0
    assert pii.redacted("a b@c.de +49 30 1234567", pii.base_spans("a b@c.de +49 30 1234567")) == "a [EMAIL] [PHONE]"


def test_skip_edges_make_labels_agree():
    field = pii.Field(np.zeros((pii.L, pii.N_FEATURES)), np.zeros((pii.L, pii.L)), 4.0)
    scores = np.zeros((3, pii.L))
    scores[0] = -30
    scores[0, 0] = 0
    assert field.marginals(scores, [(0, 2, 1)])[2].argmax() == 0
    exact = np.exp(4.0) / (np.exp(4.0) + pii.L - 1)
    assert abs(field.marginals(scores, [(0, 2, 1)])[2, 0] - exact) < 1e-3
    assert any(n[0] == pii.NONE and n[3] == ("local", "jane.doe") for n in pii.graph("mail jane.doe@z.org and again jane.doe"))


WORDS = vocab.path("word_bpe_49k.json")


def test_token_counts(docs, odd, none):
    own, tok, rng = token_counts.counter(WORDS), vocab.tokenizer(WORDS), random.Random(4)
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    for df in (docs, odd):
        want = texts_of(df)
        for r in token_counts.count(df, WORDS).collect():
            t = want[r.doc_id]
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), count(t), count(t) > 2048)
            assert count(t[: r.cut_chars]) <= 2048 and (r.cut_chars == len(t) or r.over_limit)
        for t in list(want.values())[:40]:
            profile = own.profile(t)
            for n in {0, len(t), rng.randint(0, len(t)), rng.randint(0, min(len(t), 50))}:
                assert own.at_prefix(profile, n) == count(t[:n])
    assert token_counts.count(none, WORDS).count() == 0
    table = token_counts.count(docs, WORDS, table=True).first()
    assert table.counts[-1] == table.n_tokens and table.ends[-1] == table.n_chars


def test_chat(spark):
    tricky = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "be good"), *[(1, k, ["assistant", "user"][k % 2], f"{tricky} {k} " + "word " * (k % 90)) for k in range(1, 400)]]
    rows += [(2, 0, "user", None), (2, 0, "user", None), (2, None, None, "x"), (None, 1, "assistant", ""), (3, 5, "assistant", "long " * 6000), (3, 4, "a:b\\", "### </turn>"), (3, 6, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(turns.repartition(4), WORDS).cache()
    assert all(r.n_tokens <= chat.BUDGET or r.n_new == 1 for r in made.collect())
    hot = made.where("conv_id = 1").orderBy("block", "window").collect()
    assert len(hot) > 4 and all(chat.parsed(r.text)[0][0] == "system" for r in hot)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    for c, own in by.items():
        own.sort()
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), sha("".join(f"{r}\n{t}\n" for _, _, r, t in own)), len(loss), sha(loss))
    assert chat.digests(chat.windows(turns.limit(0), WORDS)).count() == 0


def test_escape_round_trip():
    rng = random.Random(5)
    for _ in range(5000):
        t = "".join(rng.choice(["\\", "#", "###", "</turn>", "\n", ":", "a", "<", "### user: "]) for _ in range(rng.randint(0, 8)))
        assert chat.unescape(chat.escape(t)) == t
        assert [p[:2] for p in chat.parsed(chat.written(t, t)[0] * 2)] == [(t, t)] * 2


BYTES = vocab.path("byte_bpe_50k.json")


def test_shards(spark, docs, odd, none):
    tok = vocab.tokenizer(BYTES)
    for df in (docs, odd):
        got = sst.write_and_read(df, BYTES, n_shards=3).orderBy("start").collect()
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()))
        assert [r.doc_id for r in got] == [i if has else None for has, i, _ in rows]
        at = 0
        for r, (_, _, t) in zip(got, rows):
            ids = tok.encode(t, add_special_tokens=False).ids + [2]
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    assert sst.write_and_read(none, BYTES).count() == 0


def test_shard_lookup(spark, docs, tmp_path):
    manifest = sst.write_shards(common.id_text(docs), f"file://{tmp_path}/s", BYTES, 2, 3)
    want = texts_of(docs)
    got = {r.doc_id: r.ids for r in sst.lookup(spark, manifest, [0, 7, 199, 10**9, None]).collect()}
    tok = vocab.tokenizer(BYTES)
    assert got == {i: tok.encode(want[i], add_special_tokens=False).ids + [2] for i in (0, 7, 199)}
    path = manifest.first().path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[10] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        list(sst.open_shard(path))


def test_byte_level_words():
    own, rng = vocab.byte_level(BYTES), random.Random(6)
    some = ["a", "the", "it's", " ", "\n", "\t", "é", "日本", "12", "!?", "<|endoftext|>", "\xa0", "\r\n", "'ll", "　", "\x1f", "́", "y" * 300]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 9))) for _ in range(6000)]
    for k in range(0, 6000, 100):
        part = texts[k : k + 100]
        assert own.encode_all([t.encode() for t in part]) == [own.whole(t) for t in part]


def test_languages(spark, docs, odd, none):
    got = languages.identify(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    got = {r.doc_id: r for r in languages.identify(odd).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[5].lang_pred in ("en", "fr")
    assert languages.identify(none).count() == 0
    same = {r.doc_id: r.lang_pred for r in languages.identify(docs.withColumn("source", docs.lang)).collect()}
    assert same == {r.doc_id: r.lang_pred for r in languages.identify(docs).collect()}


def test_filter_corrects_for_chance():
    masks = np.zeros(1 << 10, np.uint64)
    known = np.unique(languages.ngrams("the quick brown fox jumps over"))
    for s in languages.slots(known, len(masks)):
        masks[s] |= np.uint64(1)
    own = languages.Filter(["xx", "yy"], masks)
    assert (own.holding(known) & np.uint64(1)).all() and own.predict("the quick brown fox jumps over")[0] == "xx"


def test_quality(spark, docs, odd, none):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    got = {r.doc_id: r.kept for r in quality.classify(docs, labels).collect()}
    good = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    assert len(got) == docs.count() and np.mean([got[d] == g for d, g in good.items()]) > 0.95
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, k in got.items() if k}
    assert quality.classify(odd, labels).count() == odd.count() and quality.classify(none, labels).count() == 0
    assert quality.classify(odd, labels.limit(0)).where("not kept").count() == 0


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 3.0)] * 200 + [("big", "b", -3.0)] * 200 + [("poor", "a", -3.0)] * 300 + [("big", "c", -3.0)]
    sites, rate = quality.site_rates(spark.createDataFrame(rows, "host string, path string, evidence double"))
    got = {(r.host, r.path): r for r in sites.collect()}
    one = 1 / (1 + np.exp(3.0))
    assert got["big", "a"].path_rate > 0.8 and got["poor", "a"].path_rate < 0.2
    assert one < got["big", "c"].path_rate < 0.5 and got["big", "c"].path_rate > got["big", "b"].path_rate


def brute_cover(text, item, least):
    """Greedy tiles by trying every pair of places."""
    a, b = decontaminate.hashes(item), decontaminate.hashes(text)
    in_a, in_b = [False] * len(a), [False] * len(b)
    while True:
        best = (0, 0, 0)
        for q in range(len(a)):
            for p in range(len(b)):
                n = 0
                while q + n < len(a) and p + n < len(b) and a[q + n] == b[p + n] and not in_a[q + n] and not in_b[p + n]:
                    n += 1
                if n > best[0]:
                    best = (n, q, p)
        n, q, p = best
        if n < least:
            return sum(in_a)
        in_a[q : q + n] = [True] * n
        in_b[p : p + n] = [True] * n


def test_tiling_against_brute_force():
    rng = random.Random(7)
    for _ in range(150):
        item = " ".join(rng.choice("abcdefg") for _ in range(rng.randint(5, 16)))
        words = item.split()
        cut = rng.randint(0, len(words))
        text = " ".join(words[cut:] + [rng.choice("abcxyz") for _ in range(rng.randint(0, 5))] + words[:cut])
        index = decontaminate.Index([(1, item)], 3)
        got = list(decontaminate.covering(index, decontaminate.hashes(text), 0.0))
        assert sum(g[2] for g in got) == brute_cover(text, item, 3)


def test_decontamination(spark, docs, odd, none):
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    items, texts = texts_of(bench.withColumnRenamed("item_id", "doc_id")), texts_of(docs)
    want = {(d, i) for d, t in texts.items() for i, b in items.items() if " ".join(re.findall(r"[^\W_]+", b.lower())) in " ".join(re.findall(r"[^\W_]+", t.lower()))}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).collect()}
    assert want and want <= got and got == {(r.doc_id, r.item_id) for r in decontaminate.find(docs, bench, block_chars=900).collect()}
    clean = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert clean == set(texts) - {d for d, _ in got}
    awkward = spark.createDataFrame([(None, "a b c d e f g h"), (2, None), (3, "one two"), (4, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find(odd, awkward).collect()}
    assert found == {(7, None), (8, None), (None, 3), (4, 3)}
    assert decontaminate.find(none, bench).count() == 0 and decontaminate.find(odd, awkward.limit(0)).count() == 0
    moved = spark.createDataFrame([(1, "f g h i j k l x a b c d e")], "doc_id long, text string")
    assert decontaminate.find(moved, spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")).first().n_tiles == 2


def brute_groups(df, percent=85):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    rows = [(r.doc_id, (r.text or "").translate(low)) for r in df.collect()]
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append(frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    out = collections.Counter()
    for i, (d, _) in enumerate(rows):
        own = [x for x in least[find(i)] if x is not None]
        c = min(own) if own else None
        out[d, len(sets[i]), c, d == c] += 1
    return out


def variants(n, seed):
    """Copies of a passage with more and more words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_near_dups(spark, docs, odd, none):
    many = spark.createDataFrame(list(enumerate([t for s in range(3) for t in variants(60, s)])), "doc_id long, text string")
    for df in (docs, odd, many):
        got = near_dups.cluster(df).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_groups(df)
    assert near_dups.cluster(none).count() == 0
    kept = near_dups.keep(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 7").count() == 1 and kept.where("doc_id in (6, 8)").count() == 0


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if any(x in (a, b) and a != b for a, b in links)}


def test_pipeline(spark, docs):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["quality", "near_dups", "decontaminate", "pii", "pieces"]
    out = {r.doc_id: r for r in C.run(spark, D).collect()}
    labels, bench = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("labels", "benchmark"))
    step = common.materialize(quality.keep(docs, labels), "t")
    groups = {d for d, _, _, kept in brute_groups(step, percent=80) if kept}
    leaks = {r.doc_id for r in decontaminate.find(step, bench).collect()}
    assert set(out) == groups - leaks
    m = pieces.model(PIECES)
    for d, t in texts_of(docs).items():
        if d in out:
            back = m.decode(np.array(out[d].ids))
            assert not pii.base_spans(back) and (back == t or "[" in back)
