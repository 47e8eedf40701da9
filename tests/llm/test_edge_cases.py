"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

from cadenza.llm import minhash, mixing, pseudo_likelihood, quality, sentencepiece_codec, sharding, simhash, tiff, toxicity, url_filter
from cadenza.llm.entry import PIECE_MODEL

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def few_labels(spark):
    rows = [(1, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None), (5, 1, 0), (7, 0, 0)]
    return spark.createDataFrame(rows, LABELS)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


OPERATORS = {
    "toxicity": lambda d, l: toxicity.held_out_scores(d, l),
    "drop_toxic": lambda d, l: toxicity.drop_toxic(d, l, threshold=1.1),
    "sharding": lambda d, l: sharding.shard_documents(d),
    "tiff": lambda d, l: tiff.media_digest(d),
    "lm": lambda d, l: pseudo_likelihood.score_documents(d),
    "minhash": lambda d, l: minhash.fingerprint_digest(d),
    "near_duplicates": lambda d, l: minhash.near_duplicates(d),
    "quality": lambda d, l: quality.quality_table(d, l),
    "keep_good": lambda d, l: quality.keep_good(d, l, threshold=0.0),
    "sentencepiece": lambda d, l: sentencepiece_codec.token_digest(d, PIECE_MODEL),
    "encode": lambda d, l: sentencepiece_codec.encode_documents(d, PIECE_MODEL),
    "simhash": lambda d, l: simhash.components(d),
    "mixing": lambda d, l: mixing.mixture(d, l),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, odd, few_labels, clashing):
    rows = OPERATORS[name](clashing(odd), few_labels).collect()
    assert len(rows) == 10
    same = [r for r in rows if r["doc_id"] == 1]
    assert len(same) == 2
    if name not in ("sharding", "minhash"):
        assert same[0] == same[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows_and_no_labels(name, empty, no_labels, odd):
    assert OPERATORS[name](empty, no_labels).collect() == []
    if name in ("toxicity", "quality", "mixing"):
        assert OPERATORS[name](odd, no_labels).count() == 10


def test_keep_first_of_odd_rows(odd, clashing):
    kept = simhash.keep_first(clashing(odd)).collect()
    # The repeated row once; of the empty texts 2, 3 and 4 the first.
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept)
    assert ids == [(False, 1), (False, 2), (False, 5), (False, 6), (False, 7), (True, 0)]
    assert "a b.c" in kept[0].asDict()


def test_mix_keeps_columns(odd, no_labels, clashing):
    assert mixing.mix(clashing(odd), no_labels).columns == clashing(odd).columns


def test_passages_of_odd_rows(odd, few_labels):
    model = toxicity.fit(odd, few_labels)
    assert toxicity.passages(odd, model).columns == ["doc_id", "first_token", "end_token", "passage", "score", "e_value"]


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, "x"), (2, "no scheme", "y"), (3, "HTTP://A.Example.ORG/es/x?q#f", "z"), (3, "HTTP://A.Example.ORG/es/x?q#f", "z"), (None, "x://example.org?es/", None), (5, "a://notorg/", "")],
        "page_id bigint, url string, bound string")
    labels = spark.createDataFrame([(None, None, None), (1, 1, 0)], LABELS)
    rows = url_filter.filter_urls(pages, url_filter.page_outcomes(pages, labels)).collect()
    assert len(rows) == 6
    by = {(r["page_id"], r["host"]): r for r in rows}
    assert by[1, ""]["verdict"] == by[2, ""]["verdict"] == "allow"
    assert by[3, "a.example.org"]["rule"] == "example.org/es/" and by[3, "a.example.org"]["verdict"] == "block"
    assert by[None, "example.org"]["path"] == "" and by[None, "example.org"]["rule"] is None
    assert by[5, "notorg"]["rule"] is None
    assert url_filter.filter_urls(pages.limit(0), url_filter.page_outcomes(pages.limit(0), labels)).collect() == []
