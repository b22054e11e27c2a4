"""Cases of the second round of advice, in which an operator did less than the whole job."""

from pyspark.sql import functions as F

from offerlens.llm import decontaminate, licenses, linededup, neighbours

# ------------------------------------------------------------------ benchmark


def flagged(spark, documents, items, texts):
    """The item found in each text, None if clean."""
    bench = spark.createDataFrame(list(enumerate(items, 1)), "item_id bigint, text string")
    got = {r["doc_id"]: r["item_id"] for r in decontaminate.flag(documents(list(enumerate(texts))), bench).collect()}
    return [got[k] for k in range(len(texts))]


def test_all_items_of_a_shared_window_are_tried(spark, documents):
    first = "Tom has 3 red apples in his old wooden basket and Ann has 3 green pears"
    second = first.replace("3 green", "5 green")
    assert flagged(spark, documents, [first, second, second], [second, first, second.replace("5", "9")]) == [2, 1, 2]


def test_two_values_of_the_item_may_become_one(spark, documents):
    item = "Bring 3 red apples and 5 green pears to the old house"
    assert flagged(spark, documents, [item], [item.replace("3", "4").replace("5", "4")]) == [1]


def test_a_contradiction_spoils_only_its_run_of_windows(spark, documents):
    head, tail = "Take 5 red stones and 5 blue stones to the river", "then walk along the narrow path until you see the white church"
    text = f"{head} and rest before the long evening comes {tail}"
    other = f"{head.replace('5 red', '8 red')} or sleep under every tall oak {tail}"
    assert flagged(spark, documents, [text], [other.replace("or sleep under every tall oak", "or sleep after a long night here")]) == [1]


def test_case_and_sentence_starts_do_not_hide_copies(spark, documents):
    france, peru = "What is the capital of France and which river runs through it", "What is the capital of Peru"
    tom = "Tom has 5 apples. Tom buys 7 more. Tom eats 3 of them."
    texts = [france.lower(), france.upper(), f"please answer {peru}", f"please answer {peru.replace('Peru', 'Chile')}", tom.replace("Tom", "Ann").replace("7", "9"), "the capital of trade is credit"]
    assert flagged(spark, documents, [france, peru, tom], texts) == [1, 1, 2, 2, 3, None]


def test_items_of_few_literal_words_and_short_items_are_found_word_for_word(spark, documents):
    dense, names, short = "Calculate 15 + 27 - 9 * 3 and 14 - 8", "Visit Rome Paris Oslo", "Too short"
    texts = [f"Now: {dense}.", dense.replace("27", "28"), "we visit rome paris oslo today", "It is too short now", "too long or short"]
    assert flagged(spark, documents, [dense, names, short, "", "?"], texts) == [1, None, 2, 3, None]


# ------------------------------------------------------------------ licences


def test_notices_inside_lines_and_comment_blocks(spark, documents):
    mit = licenses.TEMPLATES["MIT-permission"].split()
    block = "\n".join(["# Copyright (c) 2020 ACME and all of its many contributors", "#", *(f"# {' '.join(mit[k : k + 9])}" for k in range(0, len(mit), 9)), "#", *["# The above notice and this note shall be part of every copy of it"] * 6])
    inline = "Copyright (c) 2020 ACME. Released under the MIT License. See file."
    own = "Released under the MIT License."
    rows = [(1, inline), (2, block), (3, block.replace("# ", " * ")), (4, f"{own}\nwords\n{inline}"), (5, f"some more words that stand above the notice\n{own}"), (6, "A license of the city to sell the fish"), (None, inline), (None, inline)]
    got = sorted((str(r["doc_id"]), r["license"], r["n_notices"]) for r in licenses.scan(documents(rows)).collect())
    assert got == [("1", "MIT", 1), ("2", "MIT-permission", 1), ("3", "MIT-permission", 1), ("4", "MIT", 1), ("5", "MIT", 1), ("6", None, 0), ("None", "MIT", 1), ("None", "MIT", 1)]


# ------------------------------------------------------------------ lines


def test_exact_repeats_of_short_lines_can_go(spark, documents):
    docs = documents([(1, "Read more\n\n  \nabc"), (2, "Read more\nRead mora\n\n  \nxyz")])
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.dedup_lines(docs, exact_chars=1).collect()}
    assert got == {1: ("Read more\n\n  \nabc", 0), 2: ("Read mora\n\n  \nxyz", 1)}
    assert linededup.dedup_lines(docs).filter("n_removed > 0").count() == 0


# ------------------------------------------------------------------ neighbours


def test_vectors_of_every_length_are_answered(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0]), (100, [1.0, 0.0, 0.0]), (101, [1.0, 0.0, 2.0]), (200, [5.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 1, 1.0), (0, 2, 2, 2.0), (100, 1, 101, 2.0)]
