"""Verification of near copies on whole hashes."""

from gleaner.llm.jaccard import near_copy_components
from gleaner.llm.shingles import shingle_sets


def test_shingles_that_share_40_bits_are_different(spark):
    # The last five words of the texts hash to the same upper 40 bits: 25 of 35 shingles are common,
    # which would be 26 of 34 if these bits were all that is compared.
    texts = [" ".join([*(f"c{i}" for i in range(29)), *(f"k{i}" for i in range(a, a + 5))]) for a in (2755643, 3599242)]
    x, y = (set(s.tolist()) for s in shingle_sets(texts))
    assert (len(x & y), len(x | y)) == (25, 35)
    assert len({s >> 24 for s in x} & {s >> 24 for s in y}) == 26
    got = near_copy_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 1}
