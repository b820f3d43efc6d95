"""Token counts against the library itself."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickwise.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def strange(n, seed):
    rng = random.Random(seed)
    letters = [*"abcdestmrvl'''   \n\t\r\x0b\x1c\x1f\x85\xa09éß日本𝄞!?.,-<|>\u200b\u3000\u0301\ufeff", "<|endoftext|>", "'s", "'re", "'LL"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1000])
def test_chunk_maps_compose_to_the_library_count(library, chunk):
    counter = token_counts.load(PATH)
    for t, e in zip(x := strange(700, chunk), library.encode_batch(x, add_special_tokens=False), strict=True):
        maps = [token_counts.state_map(counter, t[i:i + chunk]) for i in range(0, max(len(t), 1), chunk)]
        assert token_counts.total(counter, maps) == len(e.ids), repr(t)


def test_compose_is_associative(library):
    counter = token_counts.load(PATH)
    for t in strange(300, 5):
        a, b, c = (token_counts.state_map(counter, x) for x in (t[:9], t[9:20], t[20:]))
        left = token_counts.compose(counter, token_counts.compose(counter, a, b), c)
        right = token_counts.compose(counter, a, token_counts.compose(counter, b, c))
        assert token_counts.total(counter, [left]) == token_counts.total(counter, [right])


def test_small_tables_change_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_MEMO", 5)
    monkeypatch.setattr(token_counts, "MAX_MOVES", 10)
    monkeypatch.setattr(token_counts, "MAX_FITS", 10)
    counter = token_counts.load(PATH)
    for t in ["hello there, hello world", "antidisestablishmentarianism " * 3]:
        assert token_counts.total(counter, [token_counts.state_map(counter, t)]) == len(library.encode(t).ids)


def test_table(spark, library):
    texts = [None, "", "x" * 3000, "word " * 20_000, " " * 5000, *strange(40, 1)]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, "null id", "z"), (4, "same", "z"), (4, "same", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = token_counts.token_counts(docs, PATH, chunk=1000).collect()
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0
