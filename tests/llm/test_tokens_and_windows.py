"""Problems 6 and 7: exact ids against the reference library; whole, disjoint and full windows."""

import random

import pytest
from tokenizers import Tokenizer

from recallgrid.llm.bpe import DEFAULT_RANKS, encoder, token_ids
from recallgrid.llm.packing import best_fit, windows

WORDS = ["a", "the", "ing", " ", "  ", "\n", "\r\n", "'s", "'LL", "1", "²", "é", "ß", "漢", "ー", "👩‍👩‍👧", "​", "\x1c", "　", "<|endoftext|>", "_", "..", "ไทย", "हि", "\x00", "𝒳"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(DEFAULT_RANKS.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def test_exact_ids(reference):
    r = random.Random(4)
    texts = ["".join(r.choice(WORDS) for _ in range(r.randint(0, 50))) for _ in range(3000)] + ["a" * 20_000, "ab" * 3000, " " * 3000, "漢" * 2000]
    mine = encoder(DEFAULT_RANKS)
    for text, want in zip(texts, reference.encode_batch(texts, add_special_tokens=False)):
        assert mine.encode(text) == want.ids


def test_null_and_empty_texts_have_empty_lists(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hi", "x"), (3, "hi", "x"), (None, "hi", "x")], "doc_id bigint, text string, ids string")
    assert sorted(((r.doc_id or 0), len(r.ids)) for r in token_ids(df).collect()) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert token_ids(df.limit(0)).count() == 0


def test_windows(spark):
    r = random.Random(6)
    rows = [(i, " ".join("the" for _ in range(r.choice([0, 1, 3, 40, 120, 300, 700])))) for i in range(300)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as part", "2 as size").repartition(20)
    out = windows(df, capacity=256).collect()
    used, sizes, parts = {}, {}, {}
    for x in out:
        used[x.window_id] = used.get(x.window_id, 0) + x.n_tokens
        parts.setdefault(x.doc_id, []).append((x.start_token, x.end_token))
        assert x.end_token - x.start_token == x.n_tokens
    mine = encoder(DEFAULT_RANKS)
    for i, t in rows:
        sizes[i] = len(mine.encode(t or ""))
        spans = sorted(parts[i])
        assert spans[0][0] == 0 and spans[-1][1] == sizes[i] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) == max(1, -(-sizes[i] // 256))
    total = sum(sizes.values())
    assert max(used.values()) <= 256 and len(used) <= -(-total // 256) * 1.1 + 1
    assert windows(df.limit(0)).count() == 0


def test_best_fit():
    import numpy as np

    bins, fills = best_fit(np.array([6, 5, 5, 4, 10]), 10)
    assert sorted(fills.tolist()) == [10, 10, 10] and bins[0] == bins[3] and bins[1] == bins[2]
