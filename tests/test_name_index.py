"""Trigram search equals the scan: fixed terms, odd names, and any expression over a small alphabet."""
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelab.operators.name_index import build_index, grams_of, literal_parts, search_by_index
from pricelab.operators.search import search_products
from pricelab.session import scratch_path

NAMES = ["Red Ring", "red  ring", "BLUE ring (v1.5)", "a+b=c ring", "", "ri", "Straße RING", "İstanbul ring", "ring}x", "bolt [new]", None,
         "ab\\Qcd", "small widget", "SMALL WIDGET", "Ωmega ring", "rring", "x" * 400 + "ring"]
TERMS = ["ring", "RING", "r.ng", "^red", "ring$", "ri", "(red|blue) ring", "red|blue", "r?ing", "ring*", "rin+g", "rin{0,2}g", "[rb]ing", "[^x]ing",
         "\\(v1\\.5\\)", "\\bring\\b", "small.*widget", "stra(ß|ss)e", "(?i)ring", "ring\\}", "Ωmega", "\\QRing\\E", "(ring)+x?", "İstanbul", "", "."]


@pytest.fixture(scope="module")
def indexed(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "id long, productDisplayName string")
    return df, build_index(df, scratch_path(spark, "t-index"))


@pytest.mark.parametrize("term", TERMS)
def test_equals_the_scan(indexed, term):
    df, index = indexed
    assert sorted(r.id for r in search_by_index(df, index, term).collect()) == sorted(r.id for r in search_products(df, term).collect())


@pytest.mark.parametrize("term", ["g (v1.5)", "a+b=c", "[new]", "ring}", "\\Qcd"])
def test_literal_terms(indexed, term):
    df, index = indexed
    want = sorted(r.id for r in search_products(df, term, literal=True).collect())
    assert want and sorted(r.id for r in search_by_index(df, index, term, literal=True).collect()) == want
    assert grams_of(term, literal=True)


@settings(max_examples=400, deadline=None)
@given(st.text("abc.*+?|()[]^${}\\1d", max_size=12), st.text("abcABC.", max_size=14))
def test_every_match_has_all_parts(term, name):
    try:
        found = re.search(term, name, re.IGNORECASE | re.ASCII)
    except (re.error, OverflowError):
        return
    if found:
        assert all(p in name.lower() for p in literal_parts(term))


def test_index_reads_only_its_grams(spark, indexed):
    df, index = indexed
    plan = search_by_index(df, index, "widget")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(gram", plan)
