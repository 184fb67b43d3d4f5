"""Labels mean the same on both sides of the bound on dictionary rows."""

from corpusloom.operators import classify


def test_whole_words_on_both_sides(spark, monkeypatch):
    chunks = spark.createDataFrame(
        [(1, "n", "", ["d"], "concatenate things"), (2, "n", "", ["d"], "a cat sat")],
        "id int, name string, documentation string, decorators array<string>, content string",
    )
    words = spark.createDataFrame([("a", "cat", 1), ("b", "things", 2)], "category string, keyword string, ord int")

    def labels(whole):
        rows = classify.label_domains(chunks, words, key="id", whole_word=whole).collect()
        return {r["id"]: [x["category"] for x in r["labels"]] for r in rows}

    few = labels(True), labels(False)
    monkeypatch.setattr(classify, "DICTIONARY_ROWS", 0)
    assert (labels(True), labels(False)) == few
    assert few[0] == {1: ["b"], 2: ["a"]} and few[1] == {1: ["a", "b"], 2: ["a"]}
