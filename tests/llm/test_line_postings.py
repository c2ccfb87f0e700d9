"""What line dedup writes on its way."""

from pyspark.sql import functions as F

from paramloom.llm import lines


def test_postings_are_written_a_row_a_set(spark, monkeypatch):
    texts = ["\n".join(" ".join(f"w{d}x{n}x{k}" for k in range(30)) for n in range(4)) for d in range(5)]
    docs = spark.createDataFrame([(d, t) for d, t in enumerate(texts)], "doc_id long, text string")
    written = {}
    plain = lines.materialize

    def seen(df, label, **options):
        table = plain(df, label, **options)
        written.setdefault(label, (table.count(), options))
        return table

    monkeypatch.setattr(lines, "materialize", seen)
    assert lines.line_dedup(docs).agg(F.sum("removed")).first()[0] == 0
    assert written["lines"][0] == written["postings"][0] == 20  # seven postings a set are not rows on disk
    assert written["lines"][1] == written["postings"][1] == lines.HASHES
