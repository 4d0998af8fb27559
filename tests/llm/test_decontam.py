from helpers import awkward_texts, contaminated, documents

from barlake.llm import decontam as D

ITEMS = [(1, "The quick Brown fox jumps over the lazy dog near the old river bank"), (2, "short item"), (3, None), (4, ""), (5, "... !!"), (1, "another text of the same id with more than ten words in it, truly"),
         (10, "word0x0 word1x1 word2x2 word3x3 word4x4 word5x5 word6x6 word7x7 word8x8 word9x9 word10x10"), (None, "item without any id")]
ROWS = [*awkward_texts(), (20, "x the quick-brown FOX, jumps over the lazy dog near y"), (21, "jumps over the lazy dog near the old river"), (22, "A Short item; short item"), (23, "item without any id")]


def test_hits_match_brute_force(spark):
    docs = documents(spark, [(i, t, 1) for i, t in ROWS], "doc_id long, text string, n_hit int")
    items = documents(spark, ITEMS, "item_id long, text string")
    want = contaminated(ROWS, ITEMS, 10)
    for part_bytes in (1 << 20, 40):                                # one broadcast, and one for every few items
        got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in D.scan(docs, items, part_bytes=part_bytes).collect()]
        assert got == [(i, *w) for (i, _), w in zip(ROWS, want)]
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for (i, _), w in zip(ROWS, want) if not w[1])


def test_spans_are_cut(spark):
    docs = documents(spark, [(1, "Öl short item, end"), (2, "clean"), (3, None)])
    got = {r.doc_id: r.text for r in D.decontaminate(docs, documents(spark, ITEMS, "item_id long, text string"), mode="spans").collect()}
    assert got == {1: "Öl , end", 2: "clean", 3: None}


def test_empty_tables(spark):
    items, none = documents(spark, ITEMS, "item_id long, text string"), documents(spark, [], "item_id long, text string")
    assert D.scan(documents(spark, []), items).collect() == []
    assert {r.n_hit for r in D.scan(documents(spark, ROWS), none).collect()} == {0}


def test_an_index_is_a_few_times_its_text():
    import random

    from barlake.llm.decontam import _Index
    rng = random.Random(2)
    items = [(str(i), " ".join(f"w{rng.randrange(10_000)}" for _ in range(400))) for i in range(1000)]
    size = sum(len(t) for _, t in items)
    assert _Index(items, 10).nbytes() < 6 * size


def test_short_items_and_shared_windows(spark):
    items = [("a", "one two three"), ("b", "One, two three"), ("c", "x " * 40), ("d", " ".join(f"w{i}" for i in range(12))), ("e", " ".join(f"w{i}" for i in range(1, 13))), ("f", "solo"), ("g", None), ("h", "?!")]
    rows = [(1, "zero one two three four"), (2, "one two"), (3, "x x x x x x x x x x x"), (4, " ".join(f"W{i}" for i in range(13))), (5, "so solo so"), (6, "one two. three one")]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id string, text string")
    for size in (1 << 20, 30):                                                       # one part, many parts
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in D.scan(docs, bench, part_bytes=size).collect()}
        assert got == {i: x for (i, _), x in zip(rows, contaminated(rows, items, 10))}
