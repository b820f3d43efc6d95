"""Template decontamination against plain windows, and re-parameterised questions."""

from tests.llm.plain import template_windows
from tickwise.llm import decontam

SF = "/root/testdata/sf0.001"
ITEMS = [(1, "Yesterday the farmer Tom sold 15 apples for 30 dollars to his friend Ann. How many apples did Tom sell?"),
         (2, "the river runs from the north to the south over nine long miles of stone"), (3, None), (4, "too short"),
         (5, "Why do the small birds Sing?"), (6, "the river runs from the north to the south over nine long miles of sand")]


def flags(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    return {r.doc_id: r for r in decontam.decontaminate(docs, bench, **options).collect()}


def test_reparameterised_questions_are_caught(spark):
    got = flags(spark, [
        "Some words. " + ITEMS[0][1] + " More words.",
        "Yesterday the farmer Bob sold 7 apples for 14 dollars to his friend Eve. How many apples did Bob sell?",
        # one value for two different slots of the item
        "Yesterday the farmer Bob sold 7 apples for 7 dollars to his friend Bob.",
        "a text that has nothing to do with any of these questions at all", None, "", "why do the small birds sing",
        "the river runs from the north to the south over nine long miles of clay", "too short"])
    assert got[0].contaminated and got[0].item_id == 1 and got[0].n_changed == 0
    assert got[1].contaminated and got[1].item_id == 1 and got[1].n_changed >= 4
    assert not got[3].contaminated and not got[4].contaminated and not got[5].contaminated
    assert got[8].item_id == 4  # a short item counts as a sentence of its own
    assert not got[6].contaminated  # its last word is a name in the item
    assert got[7].contaminated and got[7].item_id == 2


def test_inconsistent_slots_are_let_go(spark):
    item = "her 12 coins and his 12 coins lie there"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("12", "3")), (2, "her 3 coins and his 4 coins lie there"),
                                  (3, "her 12 coins and his 4 coins lie there")], "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontam.decontaminate(docs, bench, width=8, min_words=4).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_a_conflict_costs_its_own_windows_only(spark):
    item = "the man paid 12 coins on monday while her only son lost 15 coins at noon"
    twice = "our aunt Ann came by on monday with two very large cakes and our aunt Ann left again on sunday"
    bench = spark.createDataFrame([(1, item), (2, twice)], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, item.replace("15", "12")), (2, item.replace("12", "7").replace("15", "7")),
        (3, twice.replace("Ann left", "Eve left")),
        (4, twice.replace("Ann came", "Bob came").replace("Ann left", "Eve left"))], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(docs, bench, width=6, min_words=4).collect()}
    assert [got[i].contaminated for i in (1, 2, 3, 4)] == [True] * 4
    assert got[1].n_windows == got[2].n_windows == 11 and (got[1].n_changed, got[2].n_changed) == (1, 2)
    # one of two occurrences edited: the windows over it conflict, the others hold
    assert 0 < got[3].n_windows < 13 and got[3].n_changed == 0
    assert 0 < got[4].n_windows < got[3].n_windows and got[4].n_changed == 0


def test_values_may_coincide_inside_a_window(spark):
    bench = spark.createDataFrame([(1, "she gave 15 apples for 30 dollars"), (2, "he gave 15 apples for 15 dollars")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, "she gave 7 apples for 7 dollars"), (2, "he gave 7 apples for 9 dollars")],
                                 "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontam.decontaminate(docs, bench, min_words=3).collect()}
    assert got == {1: True, 2: False}


def test_copies_of_items_with_few_plain_words_are_found(spark):
    texts = ["What is 12 times 7?", "Who wrote Hamlet?", "Which Famous Author Wrote The Play Called Hamlet Prince Of Denmark",
             "WHO WROTE THE OLD PLAY ABOUT A DANISH PRINCE?", "Yesterday her brother sold fifteen apples", "?!", None]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"we then asked {t} and left") for i, t in enumerate(texts[:5])]
                                 + [(i + 10, f"Well: {t}\nand left") for i, t in enumerate(texts[:5])]
                                 + [(20, "What is 13 times 7?"), (21, "So who wrote Macbeth?"), (22, "?!"), (23, None)],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    for i in range(5):
        assert got[i].item_id == (None if i == 1 else i)  # three words inside a sentence do not count
        assert got[i + 10].item_id == i and got[i + 10].n_changed == got[i].n_changed == 0
    assert got[20].item_id == 0 and got[20].n_changed == 1
    assert not any(got[i].contaminated for i in (21, 22, 23))
    assert decontam.without_windows(bench) == 2


def test_short_items_count_as_sentences_only(spark):
    bench = spark.createDataFrame([(1, "What is 12 times 7?"), (2, "the"), (3, "12"), (4, "Who wrote Hamlet?")],
                                  "item_id long, text string")
    texts = ["What is 13 times 8?", "We saw the river.", "Hm. What is 3 times 3! Well", "and what is 13 times 8 then?",
             "Go on. The. End", "1. 13. 14", "12", "Who wrote Macbeth?", "Who wrote Macbeth and Hamlet?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.item_id for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {0: 1, 1: None, 2: 1, 3: None, 4: 2, 5: None, 6: 3, 7: 4, 8: None}


def test_a_benchmark_of_one_template_is_met_in_linear_size(spark):
    items = [(i, f"what is the sum of {i % 100 + 2} and {i // 100 + 2}") for i in range(10_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"Then what is the sum of {7 * i + 2} and {5 * i + 2}") for i in range(2000)]
                                 + [(5000, "what is the difference of 4 and 5")], "doc_id long, text string")
    by_pattern, by_values = decontam.speakers(decontam.windows(
        bench.select("item_id", "text"), ["item_id"], 8, 4))
    assert by_pattern.groupBy("hash", "template").count().agg({"count": "max"}).first()[0] == 2
    assert by_values.count() == 10_000
    got = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    assert all(got[i].contaminated for i in range(2000)) and not got[5000].contaminated
    assert got[3].n_changed == 0 and got[1999].n_changed > 0


def test_matches_plain_windows_on_the_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    asked = {w for r in bench.collect() for w in template_windows(r.text, 8, 4)}
    want = {r.doc_id for r in docs.collect() if asked & set(template_windows(r.text, 8, 4))}
    got = decontam.decontaminate(docs, bench).collect()
    assert {r.doc_id for r in got if r.contaminated} == want and len(got) == docs.count()
    blocks = decontam.matches(docs, bench, block=50).select("doc_id").distinct().collect()
    assert {r.doc_id for r in blocks} == want


def test_drop_keeps_all_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEMS[1][1], "a"), (None, ITEMS[1][1], "b"), (2, "clean", "c"), (2, "clean", "c")],
                                 "doc_id long, text string, bad_id string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [tuple(r) for r in decontam.drop_contaminated(docs, bench).collect()] == [(2, "clean", "c")] * 2
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == 4
    assert decontam.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
