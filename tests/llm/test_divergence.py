import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tidewright.llm import divergence
from tidewright.llm.divergence import source_divergence, term_counts

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute(rows, least=10, ranks=10):
    """Every (lang, source, part, item, value, rank) of rows (lang, source, text), term by term."""
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    df, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in rows:
        groups[lang].add(source)
        df.update((lang, t) for t in set(terms))
    kept = {key for key, n in df.items() if n >= least}
    for lang, source, terms in rows:
        counts[lang, source].update(t for t in terms if (lang, t) in kept)
    out = []
    for lang, sources in groups.items():
        terms = sorted(t for own, t in kept if own == lang)
        whole = sum((counts[lang, s] for s in sources), Counter())
        share = lambda c, t: 1 + 1000000000 * (c[t] + 2) // (sum(c.values()) + 2 * len(terms))  # noqa: B023, E731
        apart = lambda p, q: (p - q) * (p - q) // (p + q)
        for s in sources:
            pairs = [(sum(apart(share(counts[lang, s], t), share(counts[lang, o], t)) for t in terms), o) for o in sources - {s}]
            own = [(apart(share(counts[lang, s], t), share(whole, t)), t) for t in terms if counts[lang, s][t] > 0 and share(counts[lang, s], t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", own)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < ranks]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def made(n=400, seed=5):
    rng = np.random.default_rng(seed)
    words = [*"the The OF and élan Straße 日本 x y z".split(), *(f"word{chr(97 + i)}" for i in range(26))]
    out = []
    for _ in range(n):
        source = f"s{min(int(rng.zipf(1.5)), 5)}"
        text = " ".join(rng.choice(words, int(rng.integers(0, 30)), p=(w := 1 / np.arange(1, len(words) + 1)) / w.sum()))
        out.append((str(rng.choice(["en", "de", "rare"], p=[0.7, 0.28, 0.02])), source, text + rng.choice(["", "-9it's_", "\n\x7f"])))
    return out


def test_equals_brute_force(spark):
    rows = made() + [("one", "only", "word " * 30), ("none", "a", ""), ("none", "b", None), (None, None, "null null"), ("", "x", "null"), ("a\0b", "s\0", "word " * 12), ("a\0b", "t", "word " * 11 + "other")] + [("a\0b", "t", "word")] * 9 + [("a", "t", "bword b word")] * 11 + [(None, "s1", "null NULL")] * 10
    docs = spark.createDataFrame([(i, t, lang, s, "extra") for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, value string")
    found = rows_of(source_divergence(docs.repartition(7)))
    assert found == brute(rows)
    assert ("none", "a", "pair", "b", 0, 1) in found and not any(r[0] == "one" and r[2] == "pair" for r in found)


def test_a_term_in_many_ranges_of_one_source(spark):
    """A third of all terms are one word of one source; its run is in every task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("en", "hot", "the the THE")] * 300 + [("en", f"s{i % 3}", "the rest is rest") for i in range(60)]
        docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").repartition(40)
        kept = {r.term: (r.df, dict(zip(r.sources, r.counts))) for r in term_counts(docs).collect()}
        assert kept["the"] == (360, {"hot": 900, "s0": 20, "s1": 20, "s2": 20}) and kept["rest"] == (60, {"s0": 40, "s1": 40, "s2": 40})
        assert rows_of(source_divergence(docs)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_more_sources_than_are_held_as_pairs():
    language = divergence._Language("en", ["a", "b", "c"], np.array([5, 5, 5]), 2, True)
    dense = divergence._Language("en", ["a", "b", "c"], np.array([5, 5, 5]), 2, True)
    language.dense, language.pairs = False, None
    terms, sources, counts = pa.array(["x", "y"]), pa.array([["a"], ["b", "c"]]), pa.array([[3], [1, 4]])
    sums = []
    for one in (language, dense):
        total = Counter()
        for batch in [*one.terms(terms, sources, counts, 10), *one.end()]:
            for r in batch.to_pylist():
                total[r["source"], r["part"], r["item"]] += r["value"]
        sums.append(total)
    assert sums[0] == sums[1] and len(sums[0]) == 5


def test_shares_are_exact_for_large_counts():
    counts, total, v = [0, 7, 8_999_999_999_999_999], 9_000_000_000_000_006, 3
    wanted = [1 + 10**9 * (c + 2) // (total + 2 * v) for c in counts]
    assert divergence._shares(np.array(counts), np.array(total), v).tolist() == wanted
    assert divergence._shares(np.array([4]), np.array(4), 1).tolist() == [1 + 10**9]


def test_repeated_rows_ids_and_long_texts(spark):
    long = "alpha beta " * 40_000
    rows = [("en", "a", long)] * 3 + [("en", "b", "alpha " * 3)] * 8
    docs = spark.createDataFrame([(None if i % 2 else 1, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    assert rows_of(source_divergence(docs)) == brute(rows)


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], "doc_id long, lang string, source string, text string")).count() == 0
