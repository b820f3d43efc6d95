"""Every stage of the pipeline against a plain recomputation from the rows of its predecessor."""

import pytest
import sentencepiece  # noqa: F401 - the model file's library must be there

import corpus_pipeline
from tests.llm.plain import components_of, removed_text, template_windows
from tickwise.llm import sentencepiece_lattice, toxicity
from tickwise.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows before the first and after each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((d := stage(spark, docs, SF)).collect(), d.schema)
        out.append(docs.collect())
    return out


def test_toxic_documents_go(spark, steps):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert sorted(map(tuple, steps[1])) == sorted(tuple(r) for r in steps[0] if r.doc_id not in toxic)
    assert toxic


def test_one_of_each_group_stays(steps):
    groups = components_of([(r.doc_id, r.text) for r in steps[1]], 3, 2)
    assert sorted(map(tuple, steps[2])) == sorted(tuple(r) for r in steps[1] if groups[r.doc_id] == r.doc_id)
    assert len(steps[2]) < len(steps[1])


def test_repeats_go(steps):
    want = removed_text({r.doc_id: r.text for r in steps[2]}, 400)
    assert {r.doc_id: r.text for r in steps[3]} == want
    assert all(r.n_chars == len(r.text) for r in steps[3])
    assert {(r.doc_id, r.lang, r.source) for r in steps[3]} == {(r.doc_id, r.lang, r.source) for r in steps[2]}


def test_contaminated_documents_go(spark, steps):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    asked = {w for r in items for w in template_windows(r.text, 8, 4)}
    clean = [r for r in steps[3] if not asked & set(template_windows(r.text, 8, 4))]
    assert sorted(map(tuple, steps[4])) == sorted(map(tuple, clean))


def test_ids_decode_to_the_text(spark, steps):
    pieces = sentencepiece_lattice.model_pieces(tokenizer("piece_bpe_32k.model"))
    ids = spark.createDataFrame([(r.doc_id, r.ids) for r in steps[5]], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sentencepiece_lattice.decode(ids, pieces).collect()} == {
        r.doc_id: r.text for r in steps[4]}
    assert all(r.n_tokens == len(r.ids) for r in steps[5])


def test_run_is_registered(spark, steps):
    import __spark_entry__
    got = __spark_entry__.queries()["pipeline"](spark, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((r.doc_id, r.n_tokens) for r in steps[5])


def test_stages_take_any_rows(spark, tmp_path):
    """Null texts and ids, repeated rows, extra columns with clashing names, and an empty table."""
    words = "all the quiet people of this small town were walking slowly along their river under some very old trees "
    rows = [(1, words, "en", "s", 5, "a"), (2, None, "en", None, None, "b"), (None, "no id here", None, "s", 3, "c"),
            (3, "", "en", "s", 0, "d"), (4, words + "twice", "en", "s", 9, "e"), (4, words + "twice", "en", "s", 9, "e"),
            (5, "long " * 30_000, "en", "s", 1, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mark string")
    spark.createDataFrame([(1, 0), (4, 0), (9, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "What is the name of the longest river of this large country?"), (2, None)],
                          "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        step, n = table, table.count()
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, step, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == docs.columns, name
                step = spark.createDataFrame(got.collect(), docs.schema)
                assert step.count() <= n
            else:
                assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() == step.count()
    assert step.count() == 0


def test_encode_holds_smaller_buckets_and_gives_the_same_ids(spark, monkeypatch):
    """The last stage's tasks hold half of what the operator's do by default; the ids do not depend on it."""
    from tickwise.llm import sentencepiece_lattice as L
    seen, plain = [], L.encode

    def kept(docs, pieces, **options):
        seen.append(options.get("bucket", L.BUCKET))
        return plain(docs, pieces, **options)
    monkeypatch.setattr(L, "encode", kept)
    docs = spark.createDataFrame([(1, "some words, some words"), (2, None), (2, None), (None, "other words\nand more")],
                                 "doc_id long, text string")
    whole = sorted(map(str, corpus_pipeline.encode(spark, docs, "").collect()))
    monkeypatch.setattr(corpus_pipeline, "ENCODE_BUCKET", 10)
    assert sorted(map(str, corpus_pipeline.encode(spark, docs, "").collect())) == whole and len(whole) == 4
    assert seen[0] <= L.BUCKET // 2 and seen[1] == 10
