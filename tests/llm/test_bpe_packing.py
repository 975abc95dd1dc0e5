import base64
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from arborsig.llm.bpe import DEFAULT_VOCABULARY, PATTERN, count_tokens, encode_ids, encoder
from arborsig.llm.packing import CAPACITY, Tournament, first_fit_decreasing, pack

TEXTS = [None, "", " ", "Hello  world\n\n<|endoftext|> naïve Привет 漢字 🎉 don't", "a" * 20_000, "ab" * 9_000, "\0  x", "x" * 300 + " " * 500, "１２３ DEADBEEF"]


def model():
    import tiktoken

    with open(DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ORACLE = model()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_any_text_encodes_as_the_public_encoder_does(text):
    assert list(encoder(DEFAULT_VOCABULARY).encode(text)) == ORACLE.encode_ordinary(text)


def test_tables(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 2), (None, "x", 3)], "doc_id bigint, text string, ids int")
    rows = encode_ids(df, "doc_id").collect()
    assert len(rows) == len(TEXTS) + 2
    got = {r["doc_id"]: list(r["ids"]) for r in rows}
    assert all(got[i] == (ORACLE.encode_ordinary(t) if t else []) for i, t in enumerate(TEXTS))
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, "doc_id").collect()} == {k: len(v) for k, v in got.items()}
    assert encode_ids(df.limit(0), "doc_id").count() == 0


def test_first_fit_by_tree_is_first_fit():
    r = random.Random(3)
    for _ in range(20):
        sizes = [r.randint(0, 60) for _ in range(r.randint(1, 80))]
        room, want = [60] * len(sizes), {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            j = next(j for j, x in enumerate(room) if x >= sizes[i])
            room[j] -= sizes[i]
            want[i] = j
        assert first_fit_decreasing(sizes, 60) == [want[i] for i in range(len(sizes))]
    assert first_fit_decreasing([]) == [] and Tournament(1, 5).place(5) == 0


def test_packing(spark):
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.gamma(2, 250, 3000)] + [0, None, -5, 2048, 2049, 10_000]
    df = spark.createDataFrame([(i, s, 0) for i, s in enumerate(sizes)] + [(1, sizes[1], 0)], "k bigint, n bigint, piece int")
    rows = pack(df, "k", "n", group_items=1000).collect()
    used = {}
    for r in rows:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["size"]
    assert max(used.values()) <= CAPACITY and sum(used.values()) == sum(max(0, s or 0) for s in sizes) + sizes[1]
    assert {r["k"] for r in rows} == set(range(len(sizes)))
    split = {r["k"] for r in rows if r["piece"]}
    assert split == {i for i, s in enumerate(sizes) if s and s > CAPACITY}
    assert sum(used.values()) / (CAPACITY * len(used)) > 0.97
    assert pack(df.limit(0), "k", "n").count() == 0
