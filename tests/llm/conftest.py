from __future__ import annotations

import pytest
from clashes import with_clashes

LONG = "word " * 40_000 + "end"
#: A row of each odd kind: nulls, empty and blank texts, a very long one, signs outside ASCII, repeated rows.
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "naïve 😀 日本語 ▁ a\u0000b"), (6, "the same row here twice now"),
    (6, "the same row here twice now"), (None, "no key at all for this row"), (7, "the same row here twice now"), (8, "x"),
]


@pytest.fixture
def odd(spark):
    return with_clashes(spark, ODD, "doc_id bigint, text string")


@pytest.fixture
def nothing(spark):
    return with_clashes(spark, [], "doc_id bigint, text string")
