import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from barlake.llm import divergence as D
from helpers import LOWER

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, part string, value int"


def _brute(rows, min_docs, ranks):
    """Dense columns, no runs; rows of (text, lang, source)."""
    groups, having = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(found)
        having[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in having[lang].items() if n >= min_docs]
        sources = [s for g, s in groups if g == lang]

        def shares(count):
            total, v = sum(count[t] for t in kept), len(kept)
            return [1 + 10 ** 9 * (count[t] + 5) // (total + 5 * v) for t in kept]

        of = {s: shares(groups[lang, s]) for s in sources}
        whole = shares(sum((groups[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(i, sum(abs(p - q) for p, q in zip(of[s], of[i]))) for i in sources if i != s]
            terms = [(t, p - q) for t, p, q in zip(kept, of[s], whole) if groups[lang, s][t] and p > q]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items)]
    return sorted(out)


def _corpus():
    rng = np.random.default_rng(5)
    vocab = [f"{a}{b}" for a in ("wort", "слово", "Mot", "word", "ωrd", "x") for b in ("a", "bé", "cc", "d", "Éa", "zz", "q")]
    rows = []
    for i in range(400):
        source = f"s{int(rng.integers(0, 9)) if i % 3 else 0}"                       # a third of the rows in one source
        words = rng.choice(vocab, int(rng.integers(0, 25)), p=np.array([1 / (k + 1) for k in range(len(vocab))]) / sum(1 / (k + 1) for k in range(len(vocab))))
        rows.append((" 1,".join(words), ("en", "de", None)[i % 3 if i % 7 else 0], source))
    rows += [(None, "en", "only null"), ("", "fr", "a"), ("bonjour", "fr", None), ("--- 123", "fr", "c"), (" ".join(["wordd", "lang"] * 30_000), "en", "s1"), ("x" * 50_000, "en", "s1")]
    return rows + rows[:40]


@pytest.mark.parametrize("block,sources,table", [(8192, 64, 300_000), (3, 2, 5)])
def test_matches_brute_force(spark, monkeypatch, block, sources, table):
    for name, value in (("BLOCK", block), ("SOURCES", sources), ("TABLE_TERMS", table), ("SLICE_BYTES", 1000)):
        monkeypatch.setattr(D, name, value)
    rows = _corpus()
    docs = spark.createDataFrame([(i, *r, "own", 1) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    got = D.audit(docs, min_docs=12, term_ranks=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == _brute(rows, 12, 4)


def test_no_rows_no_terms_one_source(spark):
    assert D.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, "a b", "en", "s", "", 1)], SCHEMA)
    assert D.audit(one).collect() == []
    two = spark.createDataFrame([(1, "a b", "en", "s", "", 1), (1, None, "en", None, "", 1)], SCHEMA)
    assert sorted(map(tuple, D.audit(two).collect())) == [("en", "", "pair", "s", 0, 1), ("en", "s", "pair", "", 0, 1)]


def test_runs_of_a_column_are_as_few_as_its_counts_change(spark):
    rows = [(i, "both both first", "en", s, "", 1) for i, s in enumerate("aabb")] + [(9, " ".join(f"rare{chr(97 + k)}" for k in range(20)), "en", "c", "", 1)]
    words = D.vocabulary(spark.createDataFrame(rows, SCHEMA), min_docs=1)
    runs = D.run_columns(words).where("source = 'c'").collect()
    assert sum(len(r["ends"]) for r in runs) <= 3                                    # twenty equal terms are one run


def test_common_runs():
    a = np.array([3, 10]), np.array([5, 7])
    b = np.array([4, 6, 10]), np.array([1, 9, 7])
    assert D.intersect((a[0], b[0]), (a[1], b[1])) == 3 * 4 + 1 * 6 + 2 * 2 + 0


def test_counts_beyond_32_bits_stay_exact(spark):
    words = spark.createDataFrame([("en", "w", [("a", 3_000_000_000_000), ("b", 1)]), ("en", "x", [("b", 7)])], "lang string, term string, profile array<struct<source string, n long>>")
    groups = spark.createDataFrame([("en", "a", 3_000_000_000_000, 3_000_000_000_008, 2), ("en", "b", 8, 3_000_000_000_008, 2)], "lang string, source string, total long, lang_total long, v long")

    def p(n, total):
        return 1 + 10 ** 9 * (n + 5) // (total + 10)

    want = abs(p(3 * 10 ** 12, 3 * 10 ** 12) - p(1, 8)) + abs(p(0, 3 * 10 ** 12) - p(7, 8))
    assert {(r["source"], r["item"]): r["value"] for r in D._pairs(words, groups).collect()} == {("a", "b"): want, ("b", "a"): want}
