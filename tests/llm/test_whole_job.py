"""What a stage or query did only in part before: each test failed on the code of df14a55."""

import random

import numpy as np
import pytest

import corpus_pipeline
from cadenza.llm import near_dups, pii


def passage(rng, n=120):
    return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def staying(rows, percent):
    """Ids that stay by brute force: the least of each component of links at ``percent``."""
    sets, root = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                a0, b0 = find(a), find(b)
                root[max(a0, b0)] = min(a0, b0)
    return {d for d in sets if find(d) == d}


def test_near_dup_stage_links_at_080(spark):
    rng, rows = random.Random(1), []
    for k in range(40):  # one word changed at 2 places of 104: 10 of 110 shingles differ, 90 / 110 = 0.818
        w = passage(rng, 104)
        other = list(w)
        other[30], other[70] = "x", "y"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    assert staying(rows, 85) == {d for d, _ in rows} and len(staying(rows, 80)) == 40
    kept = corpus_pipeline.near_dup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), None)
    assert {r.doc_id for r in kept.collect()} == staying(rows, 80)


def test_half_bands_meet_at_080():
    """A pair at the threshold meets in a table for all but 0.1 % of pairs."""
    miss = 1 - (1 - (1 - 0.8**near_dups.ROWS) ** near_dups.HALVES) ** 2
    assert miss < 0.001


def plain_field(skip):
    """No evidence but for skip edges."""
    return pii.Field(np.zeros((pii.L, pii.N_FEATURES)), np.zeros((pii.L, pii.L)), skip)


@pytest.mark.parametrize("repeats", [3, 15, 100])
@pytest.mark.parametrize("skip", [2.0, 3.0, 4.0])
def test_every_repeat_of_an_entity_is_found(repeats, skip):
    text = "mail jane.doe@z.org " + "and so on with many other words between the names jane.doe " * repeats
    base, every = plain_field(skip).spans(text)
    assert len(base) == 1 and [text[a:b] for k, a, b in every if k == 0] == ["jane.doe@z.org"] + ["jane.doe"] * repeats


def test_evidence_reaches_back_and_past_other_repeats():
    words = "and so on with many other words between the names "
    text = (words + "jane.doe ") * 30 + words + "jane.doe@z.org " + (words + "jane.doe ") * 30
    assert len(plain_field(4.0).spans(text)[1]) == 61
    nodes = pii.graph(text)
    assert len(pii.edges_of(nodes)) <= 3 * len(nodes)


def test_phone_variants_have_one_key():
    words = " and so on with many other words between the numbers "
    variants = ["(555) 123-4567", "555 123 4567", "1 (555) 123 4567", "555.123.4567", "5551234567"]
    text = "+1 555 123 4567" + words + words.join(variants) + words + "rows 10 20 30 40 50 60 70 80 90 100 555 123 4567 12"
    numbers = [text[a:b] for _, a, b, key in pii.graph(text) if key == ("digits", "551234567")]
    assert numbers == ["+1 555 123 4567", *variants, "555 123 4567"]
    assert [text[a:b] for k, a, b in plain_field(4.0).spans(text)[1] if k == 3] == numbers


def test_keep_leaves_one_row_of_each_group_whatever_the_ids(spark):
    rng = random.Random(2)
    a, b, c, d, e = (passage(rng) for _ in range(5))
    near = lambda w: " ".join([*w[:-1], "x"])
    rows = [(None, " ".join(a))] * 3 + [(None, near(a))]  # a group of null ids
    rows += [(7, " ".join(b)), (7, near(b))]  # near copies under one id
    rows += [(3, " ".join(c)), (9, " ".join(c)), (9, " ".join(d)), (12, near(d))]  # 9 goes as a copy of 3, and stays as the least of d
    rows += [(None, " ".join(e)), (20, near(e))] + [(None, None), (None, ""), (None, ""), (30, ""), (30, ""), (31, "one two")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long").repartition(3)
    kept = near_dups.keep(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect() if r.text), key=str)
    one_a = [t for i, t in got if i is None]
    assert len(one_a) == 1 and one_a[0] in (" ".join(a), near(a))
    assert [i for i, t in got if t in (" ".join(b), near(b))] == [7]
    rest = [(i, t) for i, t in got if i not in (None, 7)]
    assert sorted(rest) == sorted([(3, " ".join(c)), (9, " ".join(d)), (20, near(e)), (31, "one two")])
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id = 30 or doc_id is null and coalesce(text, '') = ''").fillna({"doc_id": -1, "text": "-"}).collect()) == [(-1, ""), (-1, ""), (-1, "-"), (30, "")]


def test_pairs_at_the_threshold_of_op10_meet():
    """20,000 pairs of exactly 0.85: with 8 halves 20 of these met in no table."""
    rng, h = np.random.default_rng(5), near_dups.HALVES
    for _ in range(20_000):
        x = rng.integers(0, 2**63, 100, dtype=np.uint64)
        same = near_dups.half_keys(x[:92]) == near_dups.half_keys(np.r_[x[:85], x[92:]])
        assert same[:h].any() and same[h:].any()


def test_learning_counts_all_nodes_of_a_text(spark):
    words = " and so on with many other words between them "
    text = words.join(f"n{i:03}" for i in range(100)) + words + words.join(["jane.doe@z.org"] * 21)
    field = pii.learn(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert abs(field.skip[0, 0] - np.log(21)) < 1e-9  # 20 skip edges agree, all after the 64th node
