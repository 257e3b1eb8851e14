"""Decontamination of items that are mostly numbers, names and units, or short, and of copies with one slot that differs."""

from chanspark.llm import templates

HEAVY = "Add 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg 9 kg 10 kg 11 kg and 12 kg"
SHORT = "What is 12 times 7 plus 5"
MIXED = "Please tell us now how many apples 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg are"


def _found(spark, texts, items):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in templates.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_items_of_few_literals_are_found(spark):
    items = [(1, HEAVY), (2, SHORT), (3, "Take 5 kg"), (4, "42"), (5, MIXED)]
    docs = [(i, f"before. {t} after") for i, t in items]
    docs += [(11, "before. " + HEAVY.replace("3", "30").replace("8", "80").replace("11", "21")), (12, SHORT.replace("12", "13")), (13, "Take 6 kg")]
    docs += [(15, MIXED.replace("3", "13").replace("5", "15").replace("7", "17"))]
    assert _found(spark, docs, items) == {(i, i) for i, _ in items} | {(15, 5)}


LONG = "Then Peter gave 2 of the blue boats to the other children at the shore and they sailed 2 of them over the lake until the wind fell late in the evening"


def test_one_slot_that_differs_takes_no_equal_windows_away(spark):
    texts = [(1, LONG.replace("2", "3", 1)), (2, LONG.replace("2", "3", 1).replace("2", "5")), (3, LONG.replace("2", "3", 1).replace("2", "5").replace("shore", "beach").replace("lake", "sea").replace("late", "soon"))]
    assert _found(spark, texts, [(1, LONG)]) == {(1, 1), (2, 1)}


def test_rows_of_one_document_have_their_own_slots(spark):
    item = "Lena buys 7 red apples and then she gives 7 red apples to her small brother who eats 7 red apples after lunch today"
    assert _found(spark, [(1, item.replace("7", "9")), (1, item.replace("7", "4"))], [(1, item)]) == {(1, 1)}


PEOPLE = "Maria has twelve apples in her basket. Anna gives her five pears and 3 kg of plums. Peter takes half of them home after 2 hours on the road to town"
OTHERS = PEOPLE.replace("Maria", "Laura").replace("Anna", "Ruth").replace("Peter", "Paul")
VALUES = PEOPLE.replace("twelve", "twenty").replace("five", "nine").replace("3 kg", "8 pounds").replace("2 hours", "45 minutes")
OTHER_ITEM = "Twelve children walk along the river until the evening and then they count four boats near the bridge before going home"


def test_names_at_the_start_of_sentences_number_words_and_units(spark):
    items = [(1, PEOPLE), (2, OTHER_ITEM)]
    docs = [(1, PEOPLE), (2, "Before. " + OTHERS), (3, VALUES), (4, OTHER_ITEM.replace("Twelve", "Eighteen").replace("four", "eleven")), (5, OTHER_ITEM.replace("Twelve", "18").replace("four", "11"))]
    docs += [(6, "Nothing here has any of the apples, pears or plums that someone gives to someone else in another town after some hours"), (7, PEOPLE.lower())]
    found = _found(spark, docs, items)
    assert {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)} <= found <= {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (7, 1)}


def test_verbatim_copies_of_short_items(spark):
    items = [(1, "add 3 to it"), (2, "compute 12 plus 34 minus 5 times 6 over 7 plus 8 minus 9"), (3, "add them to it"), (4, "Paris"), (5, "...")]
    docs = [(i, f"please {t} again") for i, t in items] + [(10, "please add 4 to it again"), (11, None), (12, "")]
    assert _found(spark, docs, items) == {(i, i) for i in (1, 2, 3, 4)}


def test_rows_that_share_an_id_are_judged_alone(spark):
    words = PEOPLE.split(" ")
    first, second = " ".join(words[:14]), " ".join(words[14:])
    assert _found(spark, [(1, first + " x x x"), (1, "y y y " + second)], [(1, " ".join(words[4:20]))]) == set()
    assert _found(spark, [(None, PEOPLE), (2, PEOPLE), (2, PEOPLE)], [(1, PEOPLE), (1, PEOPLE), (None, PEOPLE)]) == {(None, 1), (2, 1), (None, None), (2, None)}


def test_many_windows_are_joined_by_exchange(spark, monkeypatch):
    monkeypatch.setattr(templates, "BROADCAST_WINDOWS", 0)
    test_names_at_the_start_of_sentences_number_words_and_units(spark)
    test_items_of_few_literals_are_found(spark)


def test_sql_of_short_and_repeated_items(spark, tmp_path):
    from oracle import differences

    items = [(1, HEAVY), (2, SHORT), (3, "Take 5 kg"), (4, "42"), (5, MIXED), (6, LONG), (7, PEOPLE), (8, OTHER_ITEM), (8, "Paris"), (9, ""), (10, None)]
    docs = [(i, f"before. {t} after") for i, t in items] + [(20, OTHERS), (21, VALUES), (22, LONG.replace("2", "3", 1)), (22, LONG.replace("2", "5")), (23, HEAVY.replace("3", "30")), (24, None), (25, "")]
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    query = lambda s, d: templates.matches(s.read.parquet(f"{d}/documents.parquet"), s.read.parquet(f"{d}/benchmark.parquet"))
    assert query(spark, str(tmp_path)).count() > 10
    assert differences(spark, "op5", query, templates.ORACLE_MATCHES, str(tmp_path)) is None
