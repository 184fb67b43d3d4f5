"""Vectors kept by content: what the model is asked, and what documents get."""

import os

from corpusloom.operators import embeddings as E
from corpusloom.session import scratch_path


def model(folder, bad="\0"):
    """Length and number of blanks; every text that is asked is noted in a file of ``folder``."""

    def load():
        def encode(texts):
            if any(bad in t for t in texts):
                raise RuntimeError("bad text")
            with open(os.path.join(folder, str(os.getpid())), "a") as f:
                f.writelines(f"{len(texts)} {t}\n" for t in texts)
            return [[len(t), t.count(" ")] for t in texts]

        return encode

    return load


def asked(folder):
    lines = [line for name in os.listdir(folder) for line in open(os.path.join(folder, name)).read().splitlines()]
    return sorted(line.split(" ", 1)[1] for line in lines), max([int(line.split(" ", 1)[0]) for line in lines], default=0)


def test_only_new_texts_reach_the_model(spark, tmp_path):
    path, kinds = scratch_path(spark, "vectors"), "doc_id string, text string"
    one = [(f"d{i}", f"text {i % 7}") for i in range(100)] + [("e", ""), ("n", None)]
    made = E.embed_by_content(spark.createDataFrame(one, kinds), "doc_id", "text", path, model(tmp_path), 2)
    assert {r["doc_id"]: r["embedding"] for r in made.collect()} == {
        i: [float(len(t or "")), float((t or "").count(" "))] for i, t in one
    }
    texts, most = asked(tmp_path)
    assert texts == sorted({t for _, t in one if t}) and most <= E.BATCH
    # renamed, copied and changed documents; one text is new
    two = [(f"x{i}", t) for i, (_, t) in enumerate(one)] + [("new", "another text")]
    made = E.embed_by_content(spark.createDataFrame(two, kinds), "doc_id", "text", path, model(tmp_path), 2)
    assert made.count() == len(two) and made.where("doc_id = 'new'").first()["embedding"] == [12.0, 1.0]
    assert asked(tmp_path)[0] == sorted([*texts, "another text"])
    E.forget(spark.createDataFrame([("a", "text 1")], kinds), "text", path)
    assert E.known_vectors(spark, path).count() == 1


def test_a_failed_text_has_zeros_and_is_asked_again(spark, tmp_path):
    path, kinds = scratch_path(spark, "vectors"), "doc_id bigint, text string"
    rows = [(i, f"t {i}" + (" BAD" if i == 5 else "")) for i in range(40)]
    df = spark.createDataFrame(rows, kinds).coalesce(1)
    got = {r[0]: r[1] for r in E.embed_by_content(df, "doc_id", "text", path, model(tmp_path, "BAD"), 2).collect()}
    assert got == {i: [0.0, 0.0] if i == 5 else [float(len(t)), 1.0] for i, t in rows}
    before = len(asked(tmp_path)[0])
    again = E.embed_by_content(df, "doc_id", "text", path, model(tmp_path), 2)
    assert again.where("doc_id = 5").first()["embedding"] == [7.0, 2.0] and len(asked(tmp_path)[0]) == before + 1


def test_a_run_that_was_lost_does_not_count(spark, tmp_path):
    path = scratch_path(spark, "vectors")
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    spark.createDataFrame([("x", [9.0, 9.0])], "digest string, embedding array<float>").write.parquet(f"{path}/vectors/rlost")
    assert E.known_vectors(spark, path) is None
    assert E.embed_by_content(df, "doc_id", "text", path, model(tmp_path), 2).first()["embedding"] == [3.0, 1.0]
    empty = E.embed_by_content(df.limit(0), "doc_id", "text", path, model(tmp_path), 2)
    assert empty.count() == 0 and E.known_vectors(spark, path).count() == 1
