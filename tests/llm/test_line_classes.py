"""Line dedup: tokens stand in classes of rarity, and no row carries the words of a whole line."""

from paramloom.llm import lines


def test_classes_are_in_the_order_of_counts_and_small():
    counts = [0, 1, 2, 3, 7, 8, 100, 109, 200, 1 << 20, (1 << 31) - 1, 1 << 40]
    classes = [lines._class(n) for n in counts]
    assert classes == sorted(classes) and len(set(classes[:10])) == 10
    assert all(-128 <= c < 128 for c in classes)  # numbers of which the JVM keeps one object each


def test_words_are_not_carried_beside_their_hashes(spark, monkeypatch):
    seen = []
    kept = lines.materialize

    def spy(df, label, **options):
        if label == "lines":
            seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, label, **options)

    monkeypatch.setattr(lines, "materialize", spy)
    docs = spark.createDataFrame([(1, "Ab cd  ef\nzz"), (2, "ef ab CD ab\nab cd eg"), (3, "one two three four five six seven eight nine\n\tzz "), (4, "nine one two three four five six seven eight\nown")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(docs).collect()}
    assert got == {1: "Ab cd  ef\nzz", 2: "ab cd eg", 3: "one two three four five six seven eight nine", 4: "own"}
    assert seen and " AS w#" not in seen[0]
