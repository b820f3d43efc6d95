"""Lattice encoding against the library's Viterbi on the same pieces, and round trips."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tests.llm.plain import best_segmentation
from tickwise.llm import sentencepiece_lattice as lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(2)
    some = [None, "", " ", "  two  spaces ", "line\nbreak\n\n", "tab\there", "日本語 𝄞 é", "a" * 2500, "x\0y", "Hello world",
            "word " * 300]
    for _ in range(60):
        some.append("".join(rng.choice("the quick étion ñ0.,\n ") for _ in range(rng.randint(0, 200))))
    return some


@pytest.fixture(scope="module")
def unigram():
    """The library with the same pieces and scores, set to segment by the best sum of scores."""
    with open(PATH, "rb") as f:
        data = f.read()
    at = 0
    while at < len(data):
        start = at
        tag, at = lattice._varint(data, at)
        size, at = lattice._varint(data, at)
        if tag >> 3 == 2:  # trainer settings: a later field 3 (model type) replaces an earlier one
            body = data[at:at + size] + bytes([3 << 3, 1])
            n, head = len(body), bytearray([tag])
            while n > 127:
                head.append(n & 127 | 128)
                n >>= 7
            head.append(n)
            data = data[:start] + bytes(head) + body + data[at + size:]
            break
        at += size
    return sentencepiece.SentencePieceProcessor(model_proto=data)


def test_matches_the_library(spark, unigram):
    pieces = lattice.model_pieces(PATH)
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "null id", "x"), (3, "same id", "x"), (3, "same id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = lattice.decode(lattice.encode(docs, pieces, bucket=3000), pieces).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text, []).append(r)
    for i, t, _ in rows:
        found = by_text[t or ""]
        assert any(r.doc_id == i for r in found)
        if t:
            scores = [sum(unigram.get_score(x) if not unigram.is_byte(x) else 0 for x in ids)
                      for ids in (found[0].ids, unigram.encode(t))]
            assert scores[0] >= scores[1] - 1e-3 and scores[0] == pytest.approx(scores[1], rel=1e-5), t
            assert len(unigram.decode(list(found[0].ids))) == len(t)
    table, longest, unknown = plain_table(pieces)
    known = {int(m[1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6 and (m := lattice.BYTE.match(p))}
    byte_ids = [known[b] for b in range(256)]
    for r in got:  # ids, not only sums: ties go to the longest last piece
        assert list(r.ids) == [i for w in lattice.words_of(r.text)
                               for i in spelt(best_segmentation(w, table, longest, unknown), byte_ids)]


def spelt(ids, byte_ids):
    return [j for i in ids for j in ([i] if i >= 0 else [byte_ids[b] for b in chr(-1 - i).encode()])]


def plain_table(pieces):
    table = {p: (i, s) for i, (p, s, kind) in enumerate(pieces) if kind == 1}
    return table, max(map(len, table)), min(s for _, s in table.values()) - 10.0


def test_words_are_cut_as_the_pattern_says():
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice("ab  \n\t▁é") for _ in range(rng.randint(0, 14)))
        for x in (t, t.replace("▁", "")):
            assert lattice.words_of(x) == (lattice.WORD.findall("▁" + x.replace(" ", "▁")) if x else [])


def test_long_words_are_not_cut(spark, unigram):
    pieces = lattice.model_pieces(PATH)
    rng = random.Random(4)
    long = [("thequickbrownfox" * 313)[:5000], "".join(rng.choice(("inter", "nation", "al", "ización", "語", "7")) for _ in range(1600)),
            "one two " + "".join(rng.choice("etaoinshrdlu") for _ in range(5000)) + " three\n" + " " * 2300 + "\nend"]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.decode(lattice.encode(docs, pieces, bucket=3000), pieces).collect()}

    def score(ids):
        return sum(unigram.get_score(x) if not unigram.is_byte(x) else 0 for x in ids)

    better = 0
    for i, t in enumerate(long):
        assert got[i].text == t
        # the library adds in 32 bits, which over so many pieces misses the best sum by a little
        mine, library = score(got[i].ids), score(unigram.encode(t))
        assert mine >= library and mine == pytest.approx(library, rel=1e-4)
        word = max(lattice.words_of(t), key=len)
        assert len(word) >= 5000
        table, longest, unknown = plain_table(pieces)
        parts = [best_segmentation(word[a:a + 1000], table, longest, unknown) for a in range(0, len(word), 1000)]
        better += sum(parts, []) != best_segmentation(word, table, longest, unknown)
    assert better >= 2  # a cut at every 1,000th character would have shown


def test_lattice_equals_plain_viterbi(spark):
    pieces = lattice.model_pieces(PATH)
    table, longest, unknown = plain_table(pieces)
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshr▁é語𝄞0.") for _ in range(n)) for n in (1, 2, 3, 7, 40, 255, 256, 257, 300, 3000)]
    words += ["a" * 200, "the" * 900, "▁" * 1200]
    rows = spark.createDataFrame([x for i, w in enumerate(words) for x in lattice.sliced(i, w, longest)],
                                 "place int, at int, own int, chars string").repartition(3)
    got = lattice.segment(rows, ["place"], pieces).collect()
    byte_ids = list(range(1000, 1256))
    assert len(got) == len(words)
    for r in got:
        assert lattice.read_back(list(r.back), words[r.place], byte_ids) == spelt(
            best_segmentation(words[r.place], table, longest, unknown), byte_ids)


def test_many_words_are_folded_at_once():
    """Ties, characters without a piece and words of very different lengths, edges in any order."""
    pieces = [("<unk>", 0.0, 2), ("a", -1.0, 1), ("b", -1.0, 1), ("ab", -2.0, 1), ("ba", -3.0, 1), ("aba", -3.0, 1), ("bb", -1.5, 1)]
    table, longest, unknown = plain_table(pieces)
    rng, byte_ids = random.Random(3), list(range(1000, 1256))
    words = ["".join(rng.choice("abab語") for _ in range(rng.choice((1, 2, 3, 5, 9, 40)))) for _ in range(300)] + ["ab" * 700, "語"]
    edges = [(w, end << 31 | k << 21 | (table[word[end - k:end]][0] + 1 if word[end - k:end] in table else 0))
             for w, word in enumerate(words) for end in range(1, len(word) + 1) for k in range(1, min(end, longest) + 1)
             if k == 1 or word[end - k:end] in table]
    rng.shuffle(edges)
    place, e = (np.array(x, np.int64) for x in zip(*edges, strict=True))
    bounds, back = lattice.best_backs(place, e, lattice.code_scores(pieces), len(words))
    sizes, ids = lattice.read_all(bounds, back, words, byte_ids)
    ends = np.cumsum(sizes)
    for w, word in enumerate(words):
        plain = spelt(best_segmentation(word, table, longest, unknown), byte_ids)
        assert ids[ends[w] - sizes[w]:ends[w]].tolist() == plain
        assert lattice.read_back(back[bounds[w]:bounds[w + 1]].tolist(), word, byte_ids) == plain


def test_edges_are_not_collected_into_rows(spark):
    """Edges go to the fold as they are: no aggregation sorts and merges a list of them per word."""
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    plan = lattice.encode(docs, lattice.model_pieces(PATH))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lattice.encode(docs, lattice.model_pieces(PATH)).count() == 0
