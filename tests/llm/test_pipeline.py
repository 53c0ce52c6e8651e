import hashlib

import corpus_pipeline as c
import __spark_entry__ as entry

ITEM = "On the third day the copper kettle sang louder than the old harbour bell and nobody in the village slept"
CLEAN = [
    "The committee met in the early afternoon and agreed to repair the old bridge before the winter storms arrive.",
    "A small bakery at the corner sells warm bread, and its owner greets every visitor by name each morning.",
    "Rivers carry sand from the mountains to the sea. Over many years they build wide plains along the coast.",
]


def tables(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(CLEAN)]
    rows += [(10, CLEAN[0].upper().lower(), "en", "s", 1), (11, CLEAN[1].replace("A small", "a SMALL"), "en", "s", 1), (12, CLEAN[2], "en", "s", 1), (12, CLEAN[2], "en", "s", 1)]
    rows += [(20, f"Some words came first here. {ITEM}. Some more words came after it.", "en", "s", 1)]
    rows += [(30 + i, " ".join(f"{w}%%%" for w in CLEAN[i % 3].split()) + f" {i}%%%", "en", "s", 1) for i in range(4)]
    rows += [(40, "", "en", "s", 0), (41, None, None, None, None), (None, "An unnumbered text about a quiet garden with pears, apples and a stone wall.", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows


def test_each_stage_and_the_whole(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for i, (name, apply) in enumerate(c.STAGES):
        out = apply(spark, docs, str(tmp_path))
        if i < len(c.STAGES) - 1:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left.append(sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str))
    assert left[0] == sorted([0, 1, 2, 10, 11, 12, 12, 20, None], key=str)
    assert left[1] == left[2] == sorted([10, 11, 12, 20, None], key=str)
    assert left[3] == left[4] == sorted([10, 11, 12, None], key=str)
    whole = c.run(spark, str(tmp_path)).collect()
    text_of = {r[0]: r[1] for r in rows}
    assert sorted((r.doc_id for r in whole), key=str) == left[4]
    assert all(r.decoded_sha256 == hashlib.sha256(text_of[r.doc_id].encode()).hexdigest() and len(r.ids) == r.n_tokens for r in whole)


def test_empty_table(spark, tmp_path, data_dir):
    spark.read.parquet(f"{data_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{data_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert c.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
