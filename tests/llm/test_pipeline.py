"""The corpus pipeline, stage by stage, on documents that are made here."""

import importlib
import random

import corpus_pipeline
from strandflow.llm.decontamination import WINDOW

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(lang: str, seed: int, n: int = 80) -> str:
    r = random.Random(f"{lang}{seed}")
    ends = {"en": ["tion", "ing", "the", "ness", "ward"], "de": ["ung", "keit", "sch", "lich", "und"], "fr": ["eux", "oir", "que", "ment", "elle"]}[lang]
    return " ".join(r.choice("abdegklmnoprst") + r.choice("aeiou") + r.choice("lmnrst") + r.choice("aeiou") + r.choice(ends) for _ in range(n))


def made(spark, folder) -> str:
    docs = [(i, prose(lang, i), lang, "abc"[i % 3], 0) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    bench = [(k, prose("en", 900 + k, 30)) for k in range(3)]
    docs += [(200, docs[7][1], "de", "a", 0), (201, docs[8][1] + " und", "fr", "b", 0), (202, prose("en", 300) + " " + " ".join(bench[1][1].split()[:WINDOW]), "en", "a", 0), (203, None, None, "a", 0), (204, "12 34 ...", None, None, 0)]
    sf = str(folder)
    spark.createDataFrame(docs, DOCS).coalesce(2).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def test_stages(spark, tmp_path):
    sf = made(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{sf}/{name}.parquet"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    known, alone, clean, mixed = kept
    assert {203, 204}.isdisjoint(known) and len(set(range(120)) - set(known)) <= 3
    assert {200, 201}.isdisjoint(alone) and {7, 8} <= set(alone) and set(known) - set(alone) == {200, 201}
    assert 202 not in clean and set(alone) - set(clean) == {202}
    assert set(mixed) <= set(clean)
    out = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in out.collect()) == mixed


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 10
    assert set(entry.oracle_sql()) <= set(names)
