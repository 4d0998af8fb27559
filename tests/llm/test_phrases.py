import random
from collections import Counter

from helpers import awkward_texts, documents, without_repeats

from barlake.llm import phrases as P


def _passages(seed=11):
    """Documents that share passages of all lengths, some shorter than a window, some spanning each other."""
    rng = random.Random(seed)
    pool = [" ".join(f"p{rng.randrange(60)}" for _ in range(n)) for n in (5, 12, 13, 14, 20, 45)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(rng.choice(pool) if rng.random() < 0.6 else " ".join(f"f{rng.randrange(10_000)}" for _ in range(rng.randrange(1, 25))))
        rows.append((rng.randrange(1 << 40), "\n".join(parts)))
    return rows


def _digest(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_removal_matches_brute_force(spark):
    rows = _passages()
    for shard_docs in (7, 512):
        assert _digest(P.remove_repeats(documents(spark, rows), shard_docs=shard_docs)) == without_repeats(rows, 13)
    assert _digest(P.remove_repeats(documents(spark, rows), window=4, anchor=4, shard_docs=9)) == without_repeats(rows, 4)


def test_kept_text_and_spans(spark):
    passage = " ".join(f"s{i}" for i in range(15))
    rows = [(1, f"a b {passage} c"), (2, f"x {passage}\ny")]
    got = {r.doc_id: r for r in P.remove_repeats(documents(spark, rows)).collect()}
    assert got[1].kept == rows[0][1] and got[1].removed == []
    assert got[2].kept == "x y" and [tuple(s) for s in got[2].removed] == [(1, 16)]


def test_awkward_rows(spark):
    rows = awkward_texts()
    docs = documents(spark, [(i, t, 0) for i, t in rows], "doc_id long, text string, shard int")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in P.remove_repeats(docs).collect()]
    want = without_repeats([(i, t) for i, t in dict(x for x in rows if x[0] is not None).items()], 13)
    assert sorted(x for x in got if x[0] is not None) == sorted((i, *want[i]) for i, _ in rows if i is not None)
    assert [x[1:3] for x in got if x[0] is None] == [(60, 0)]
    assert P.remove_repeats(documents(spark, [])).collect() == []


def test_repeated_rows_and_ids_with_two_texts(spark, monkeypatch, tmp_path):
    """A shard holds equal rows once, and only the text that is a copy is removed, whatever the number of shards."""
    folder, stream = str(tmp_path), P._stream

    def noted(docs, passages, window, with_text):
        from uuid import uuid4
        open(f"{folder}/{docs.num_rows}-{uuid4().hex}", "w").close()
        return stream(docs, passages, window, with_text)

    monkeypatch.setattr(P, "_stream", noted)
    monkeypatch.setattr(P, "REPEATS", 50)
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    rows = [(1, one), (2, one), (2, two), *[(3, one)] * 120, *[(None, None)] * 70, *[(None, one)] * 60, (4, two + " " + one)]
    for shard_docs in (2, 512):
        got = P.remove_repeats(documents(spark, rows).repartition(3), shard_docs=shard_docs).collect()
        found = Counter((r.doc_id, r.n_words, r.n_removed) for r in got)
        assert found == {(1, 20, 0): 1, (2, 20, 20): 1, (2, 20, 0): 1, (3, 20, 20): 120, (None, 0, 0): 70, (None, 20, 0): 60, (4, 40, 40): 1}
    assert max(int(f.name.split("-")[0]) for f in tmp_path.iterdir()) <= 7


def test_documents_are_dealt_out_once(spark, monkeypatch, tmp_path):
    """All steps share one exchange of the texts, so the shuffled texts are on disk once."""
    folder, fewer = str(tmp_path), P._fewer

    def noted(batches):
        from uuid import uuid4
        open(f"{folder}/{uuid4().hex}", "w").close()
        return fewer(batches)

    monkeypatch.setattr(P, "_fewer", noted)
    rows = _passages()
    assert _digest(P.remove_repeats(documents(spark, rows).repartition(3), shard_docs=16)) == without_repeats(rows, 13)
    assert len(list(tmp_path.iterdir())) == 3
