"""Near copies by wide SimHash codes and verified links, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import common, minhash, near_copies, simhash, verified_links
from cadenza.llm.minhash import hasher


def _components(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def _jaccard_links(texts, similarity=0.8):
    """All pairs of texts at the similarity, through an inverted list of shingles."""
    sets = [frozenset(hasher().shingles(t).tolist()) for t in texts]
    holders, links = {}, set()
    for i, s in enumerate(sets):
        met = set()
        for x in s:
            met.update(holders.get(x, ()))
            holders.setdefault(x, []).append(i)
        if not s:
            met = {j for j in range(i) if not sets[j]}
        links.update((j, i) for j in met if not s or len(s & sets[j]) >= similarity * len(s | sets[j]))
    return links


def test_spanning_pairs_against_brute_force():
    """Sets of families of all likenesses, in two pieces and in one: the links connect what all links at 0.8 connect."""
    rng = np.random.default_rng(2)
    sets = []
    for family in range(20):
        base = rng.integers(0, 1 << 60, 120)
        for _ in range(15):
            own = base.copy()
            own[rng.random(120) < rng.uniform(0, 0.25)] = rng.integers(0, 1 << 60)
            sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 60, rng.integers(0, 8))])))
    codes = np.array([near_copies.wide_fingerprint(s.astype(np.uint64)) for s in sets])
    flat, ends = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    n, group = len(sets), rng.integers(0, 200, len(sets))
    like = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    joined = [(a, b) for a in range(n) for b in range(a) if group[a] == group[b]]
    for side in (np.arange(n), rng.integers(0, 2, n)):
        want = _components([(a, b) for a in range(n) for b in range(a) if side[a] != side[b] and like(a, b)] + joined, range(n))
        got = list(verified_links.spanning_pairs(codes, flat, ends, group, side, near_copies.hamming, near_copies.RADIUS, 0.8))
        assert _components(got + joined, range(n)) == want and all(like(a, b) for a, b in got)
        assert len(got) == len(set(_components(joined, range(n)).values())) - len(set(want.values()))


def _family(rng, size, words=300, edits=14):
    """Texts each edited from the one before: neighbours are near copies, distant members are not."""
    text = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [" ".join(text)]
    for k in range(size - 1):
        text = list(text)
        for _ in range(edits // 2):
            text[rng.randrange(words)] = f"new{k}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("classes", ["simhash", "minhash"])
def test_chains_and_families_against_brute_force(spark, classes, monkeypatch):
    """Chains x-y-z whose ends are no near copies, and a family in one bucket dealt in pieces, end in the components of all links."""
    monkeypatch.setattr(verified_links, "PIECE_SHINGLES", 3000)
    rng = random.Random(4)
    texts = [t for _ in range(12) for t in _family(rng, 12)]
    base = texts[0].split()
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(300), 9):
            words[k] = f"x{i}-{k}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = _components(_jaccard_links(texts), range(len(texts)))
    if classes == "minhash":
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
        assert got == want
    else:
        assert sorted(r["doc_id"] for r in near_copies.keep_first(docs).collect()) == sorted(set(want.values()))


def test_rounds_do_not_grow_with_a_bucket(spark, monkeypatch):
    """A thousand equal texts and three hundred edits of them: one round of pairs, one pair a member."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [" ".join(base)] * 1000
    for i in range(300):
        words = list(base)
        words[rng.randrange(300)] = f"x{i}"
        texts.append(" ".join(words))
    rounds = []
    plain = verified_links.confirmed
    monkeypatch.setattr(verified_links, "confirmed", lambda pairs, *rest: rounds.append(pairs.count()) or plain(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = minhash.near_duplicates(docs).collect()
    assert rounds == [300]
    assert {r["class_id"] for r in got} == {0}


def test_simhash_links_need_no_band(spark, monkeypatch):
    """Where no two texts share a band, those within 4 of 64 bits still meet, in vantage-point shards."""
    monkeypatch.setattr(near_copies, "band_keys", lambda signature, bands, width: F.array("rep"))
    rng = random.Random(6)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts.append(" ".join(words))
        for _ in range(2):
            words[rng.randrange(400)] = "changed"
            texts.append(" ".join(words))
    codes = [simhash.fingerprint(t) for t in texts]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if (codes[i] ^ codes[j]).bit_count() <= simhash.RADIUS}
    want = _components(near & _jaccard_links(texts), range(len(texts)))
    assert len(set(want.values())) < 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_first(docs).collect()) == sorted(set(want.values()))


def test_only_texts_in_shared_buckets_are_cut_again(spark):
    texts = [f"text {i} of its own words {i * i}" for i in range(200)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    reps = [verified_links.rep_of(hasher().shingles(t)) for t in texts]
    needed = docs.select(verified_links.text_name().alias("name"), "text").where(F.col("text").isin(texts[7], texts[9]))
    needed = needed.select(F.when(F.col("text") == texts[7], reps[7]).otherwise(reps[9]).alias("rep"), "name")
    cut = spark.sparkContext.accumulator(0)

    def shingles(text):
        cut.add(1)
        return hasher().shingles(text)

    sets = verified_links.sets_of(docs, needed, shingles, near_copies.wide_fingerprint)
    assert {r["rep"] for r in sets.collect()} == {reps[7], reps[9]} and cut.value == 2


def test_filter_keeps_rows_that_meet_nothing_out_of_the_shuffle(spark):
    names = spark.range(-500, 500).select((F.col("id") * 7_919_000_003).alias("name"))
    rows = spark.range(-4000, 4000).select(F.when(F.col("id") != 3, F.col("id") * 7_919_000_003).alias("key"), F.col("id").alias("a.b"))
    got = common.may_meet(rows, F.col("key"), names)
    assert got.columns == ["key", "a.b", "_may"]
    may = {r["a.b"] for r in got.where("_may").collect()}
    assert may >= set(range(-500, 500)) - {3} and 3 not in may and len(may) < 1050
    assert common.may_meet(rows, F.col("key"), names.limit(0)).where("_may").count() == 0


def test_every_group_of_the_corpus_keeps_one(documents):
    """Over the test corpus: every brute-force group keeps a document, and nothing goes that is not in a group with a kept one."""
    rows = [(r["doc_id"], r["text"] or "") for r in documents.select("doc_id", "text").collect()]
    texts = [t for _, t in rows]
    root = _components(_jaccard_links(texts), range(len(texts)))
    kept = {r["doc_id"] for r in near_copies.keep_first(documents).collect()}
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(root[i], []).append(doc_id)
    assert all(kept & set(g) for g in groups.values())
    many = [g for g in groups.values() if len(g) > 1]
    extra = sum(len(kept & set(g)) - 1 for g in many)
    assert extra <= 0.02 * sum(len(g) - 1 for g in many)


def test_edited_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i in range(30):
        words = texts[i].split()
        for _ in range(3):
            words[rng.randrange(300)] = "changed"
        rows.append((100 + i, " ".join(words)))
    sets = [set(hasher().shingles(t).tolist()) for _, t in rows]
    assert all(len(sets[i] & sets[60 + i]) / len(sets[i] | sets[60 + i]) >= 0.8 for i in range(30))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_first(docs).collect()) == list(range(60))


def test_odd_rows(odd, empty, clashing):
    kept = near_copies.keep_first(clashing(odd))
    assert "a b.c" in kept.columns and kept.schema == clashing(odd).schema
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    # 2, 3 and 4 hold no word and form one group.
    assert 2 in ids and 3 not in ids and 4 not in ids and len(ids) == len(set(ids)) and None in ids
    assert near_copies.keep_first(empty).count() == 0


@pytest.mark.parametrize("keep_first", [near_copies.keep_first, simhash.keep_first])
def test_every_group_keeps_a_row_of_its_own(spark, keep_first):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(6)]
    # Four groups without ids, one with a repeated row; id 5 stands for a text that group 4 need not keep and for all of group 5.
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0]), (3, texts[4]), (5, texts[4]), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [(r["doc_id"], r["text"]) for r in keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, t) for t in texts[:4]] + [(3, texts[4]), (5, texts[5])], key=str)
