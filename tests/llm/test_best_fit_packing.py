import zlib
from collections import defaultdict

import numpy as np
import odd
import pytest
from tokenizers import Tokenizer

from panelforge.llm import best_fit_packing as packing
from panelforge.llm.tables import vocabulary


def wanted_pieces(rows, size):
    library, out = Tokenizer.from_file(vocabulary()), []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), size)):
            own = np.array(ids[start : start + size], "<u4")
            out.append((i, k, start, len(own), zlib.crc32(own.tobytes())))
    return odd.ordered(out)


def check_places(rows, size):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(bins)


@pytest.mark.parametrize("which", ["odd", "corpus"])
def test_pieces_and_places(docs, small, which):
    df, rows = (docs, odd.texts()) if which == "odd" else small
    got = packing.pack(df, 512).collect()
    assert odd.ordered(tuple(r)[:5] for r in got) == wanted_pieces(rows, 512)
    lengths = np.array([r["length"] for r in got])
    n = check_places(got, 512)
    assert packing.lower_bound(lengths, 512) <= n <= packing.lower_bound(lengths, 512) * 1.01 + 1


def test_empty_table(no_docs):
    assert packing.pack(no_docs).collect() == []


def test_partitions_exchange_pieces(spark):
    """Small partitions pack badly on their own; together they come close to the bound."""
    draw = np.random.default_rng(1)
    lengths = draw.choice([26, 34, 41, 52, 60], 3000)
    rows = [(i, 0, 0, int(n), 7) for i, n in enumerate(lengths)]
    cut = spark.createDataFrame(rows, packing.schema(**packing.PIECE))
    packed = packing.pack_pieces(cut, 100, 100)
    got = packed.collect()
    assert odd.ordered(tuple(r)[:5] for r in got) == odd.ordered(rows)
    check_places(got, 100)
    # Some sequences are of the second round or a later one.
    assert max(r["sequence_id"] for r in got) >= 30 * packing.IDS_PER_PARTITION
    ids = {r["sequence_id"] for r in got}
    bound = packing.lower_bound(lengths, 100)
    row = packing.overview(packed, 100).first()
    assert row["sequences"] == len(ids) and row["bound"] == bound
    assert bound <= row["sequences"] <= 1.02 * bound + 1


def test_one_partition_is_certified_or_tried_again(spark):
    """Also a single partition goes on until it meets its bound or a round saves nothing."""
    for lengths, size, certified in (([50] * 40, 100, True), ([34] * 3 + [33] * 3 + [67], 100, False)):
        rows = [(i, 0, 0, n, 7) for i, n in enumerate(lengths)]
        cut = spark.createDataFrame(rows, packing.schema(**packing.PIECE))
        made = packing.pack_pieces(cut, size).collect()
        assert len(made) == len(rows)
        n = check_places(made, size)
        met = n == packing.lower_bound(np.array(lengths), size)
        assert {r["certified"] for r in made} == {met} and (met or not certified)


def test_rounds_go_on_beyond_a_few(spark):
    """Tiny partitions: many rounds, all pieces kept once, sequences numbered apart."""
    draw = np.random.default_rng(3)
    lengths = draw.integers(20, 45, 4000)
    rows = [(i, 0, 0, int(n), 7) for i, n in enumerate(lengths)]
    cut = spark.createDataFrame(rows, packing.schema(**packing.PIECE))
    got = packing.pack_pieces(cut, 100, 500).collect()
    assert odd.ordered(tuple(r)[:5] for r in got) == odd.ordered(rows)
    n = check_places(got, 100)
    assert n <= 1.01 * len(packing.best_fit(lengths, 100)[2])


def test_repeated_rows_of_one_document(spark):
    rows = [(1, "alpha beta gamma")] * 500
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    assert len(got) == 500
    assert check_places(got, 16) == 125


def test_lower_bound_is_below_the_best_packing():
    draw = np.random.default_rng(2)
    for _ in range(200):
        bins = draw.integers(1, 5)
        lengths = []
        for _ in range(bins):
            cuts = np.sort(draw.choice(np.arange(1, 60), draw.integers(0, 4), replace=False))
            lengths += np.diff([0, *cuts, 60]).tolist()
        assert packing.lower_bound(np.array(lengths), 60) <= bins
    assert packing.lower_bound(np.array([31, 31, 31]), 60) == 3
