"""Near-dedup, substring dedup, decontamination, sketches against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from starweave.llm import components, phrases, simhash, sketches, suffixes
from tests.llm import helpers as H

ROWS = H.corpus()


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 9), st.integers(1, 4))
@settings(max_examples=40, deadline=None)
def test_trees_find_all_within_the_radius(values, radius, shards):
    near = sorted(set(values) | {v ^ (1 << (v % 64)) for v in values[::2]})
    keys = np.array(near, np.uint64)[:, None]
    shard = np.arange(len(keys)) % shards
    forest = simhash.grow(keys, shard)
    got = {(int(a), int(b)) for q, n in simhash.search(forest, keys, shard, radius) for a, b in zip(q, n)}
    assert got == {
        (i, j) for i in range(len(near)) for j in range(len(near))
        if shard[i] == shard[j] and bin(near[i] ^ near[j]).count("1") <= radius
    }


def test_near_duplicates_equal_brute_force(spark):
    got = {r["id"]: (r["f0"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(H.frame(spark, ROWS)).collect()}
    prints = [H.fingerprint(t) for _, t in ROWS]
    expected = H.classes([d for d, _ in ROWS], prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    assert got == {d: (p, c) for (d, _), p, c in zip(ROWS, prints, expected)}


def test_hot_shards_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 5)
    draw = np.random.default_rng(4)
    base = int(draw.integers(0, 2**62))
    values = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in draw.integers(0, 62, (60, 2))} | {int(x) for x in draw.integers(0, 2**62, 20)}
    values = sorted(values)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "node long, f0 long")
    found = components.components(simhash.fingerprint_links(frame)).collect()
    got = {r["node"]: r["component"] for r in found}
    expected = H.classes(list(range(len(values))), values, lambda a, b: bin(a ^ b).count("1") <= 3)
    assert [got.get(i, i) for i in range(len(values))] == expected


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 3), (None, 4)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 60)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_keeps_clean_documents(spark):
    draw = np.random.default_rng(2)
    text = lambda n: " ".join(f"word{x}" for x in draw.integers(0, 5000, n))
    clean = [(i, text(200)) for i in range(40)]
    copies = [(100 + i, clean[i][1]) for i in range(10)]
    near = []
    for i in range(10, 30):
        parts = clean[i][1].split(" ")
        for at in (20, 90, 160)[: 1 + i % 3]:
            parts[at] = "other"
        near.append((100 + i, " ".join(parts)))
    kept = simhash.one_of_each(H.frame(spark, clean + copies + near + [(None, clean[0][1])]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == list(range(40))
    assert kept.where("doc_id is null").count() == 1


def _shingles(text, size=5):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_are_alike_on_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLOT_ROWS", 3)
    draw = np.random.default_rng(6)
    words = lambda n: [f"word{x}" for x in draw.integers(0, 100_000, n)]
    line = "this line of seven words comes again\n"
    rows = [(i, line * 50 + " ".join(words(100))) for i in range(4)]  # alike by repeats only
    body = " ".join(words(300))
    rows += [(10, f"{line}{body}"), (11, f"{line * 30}{body}")]  # the same shingles, other counts
    chain = words(300)  # each text is like the one before, the last unlike the first
    for i in range(60):
        rows.append((20 + i, " ".join(chain)))
        chain = chain[4:] + words(4)
    rows += [(100, ""), (101, " "), (102, "few words"), (103, "FEW  words")]
    kept = {r["doc_id"] for r in simhash.one_of_each(H.frame(spark, rows)).collect()}
    sets = {d: _shingles(t) for d, t in rows}
    expected = []
    for d in sorted(sets):
        if not any(_jaccard(sets[d], sets[k]) >= 0.8 for k in expected):
            expected.append(d)
    assert kept == set(expected) and {0, 1, 2, 3, 10, 100, 102} <= kept and len([d for d in kept if 20 <= d < 80]) > 3


@pytest.mark.parametrize("seed", [1, 2])
def test_cut_repeats_equals_brute_force(spark, seed):
    rows = H.corpus(seed)
    got = sorted((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in phrases.cut_repeats(H.frame(spark, rows)).collect())
    assert got == H.cut(rows)
    assert sum(r[2] for r in got) > 100


def test_cut_repeats_within_one_document_is_no_repeat(spark):
    line = " ".join(f"w{i}" for i in range(20))
    rows = [(5, f"{line} {line}"), (9, line), (9, f"x {line}")]
    got = {(r["id"], r["n_removed"]) for r in phrases.cut_repeats(H.frame(spark, rows)).collect()}
    assert got == {(5, 0), (9, 20)}


def _items():
    texts = [t for _, t in ROWS]
    return [(1, texts[0].upper()), (2, "None of these words stand in any of the documents here at all"), (3, "changed"),
            (4, " ".join(texts[2].split(" ")[3:15])), (10, texts[2]), (11, None), (12, "")]


def _matches(spark, window=10, limit=None):
    docs, bench = H.frame(spark, ROWS), spark.createDataFrame(_items(), "item_id long, text string")
    out = suffixes.verbatim_matches(docs, bench).withColumn("hit", suffixes.covered(suffixes.F.col("matches")))
    return sorted((r["doc_id"], r["n_words"], r["hit"], sorted({m["item_id"] for m in r["matches"]})) for r in out.collect())


def test_matches_equal_brute_force(spark, monkeypatch):
    expected = H.leaks(ROWS, [(i, t) for i, t in _items()])
    assert _matches(spark) == expected
    assert sum(bool(r[3]) for r in expected) > 3
    monkeypatch.setattr(suffixes, "BENCHMARK_BYTES", 300)  # several passes
    assert _matches(spark) == expected


def test_longest_match_and_its_place(spark):
    item = " ".join(f"t{i}" for i in range(14))
    docs = H.frame(spark, [(1, "a b " + " ".join(f"t{i}" for i in range(2, 14)) + " c"), (2, item + " " + item)])
    rows = {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in
            suffixes.verbatim_matches(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert rows == {1: [("7", 2, 2, 12)], 2: [("7", 0, 0, 14), ("7", 0, 14, 14)]}


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_suffix_array_is_sorted(words, depth):
    words = np.array(words + [0], np.int64)
    order = suffixes.suffix_array(words, suffixes._packed(words, 2, 3), 3, depth)
    assert sorted(order) == [i for i, w in enumerate(words) if w]
    up_to_gap = lambda i: list(words[i : i + depth])
    keys = [up_to_gap(i) for i in order]
    assert all(a <= b or len(a) != len(b) for a, b in zip(keys, keys[1:]))


def test_fingerprints_with_edit_equal_brute_force(spark):
    rows = sorted(H.corpus(3, 40)) + [(2000, "same line.\n" * 40 + "x."), (2001, "same line.\n" * 37)]
    got = {r["id"]: r for r in sketches.fingerprints_with_edit(H.frame(spark, rows).repartition(5)).collect()}
    for i, (d, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(text), H.sha(edited))
        assert got[d]["near_edited"] == pytest.approx(H.likeness(text, edited))
        assert got[d]["near_next"] == pytest.approx(H.likeness(text, after))
    assert got[1000]["fingerprint"] == got[1004]["fingerprint"] != got[2000]["fingerprint"]


def test_sentences_of_one_line_are_compared_one_by_one(spark):
    short, line = "One thing is said. Another follows it. A third one ends here.", [f"Sentence number {i} stands here." for i in range(60)]
    rows = [(1, short), (2, " ".join(line)), (3, " ".join(["Put in front."] + line))]
    got = {r["id"]: r for r in sketches.fingerprints_with_edit(H.frame(spark, rows)).collect()}
    assert got[1]["near_edited"] == pytest.approx(4 / 6)  # the edit cuts the last sentence only
    assert got[2]["near_next"] == pytest.approx(120 / 121)  # one sentence put in moves no other


def test_larger_sketches_take_over(spark):
    from pyspark.sql import functions as F

    frame = spark.range(1).select(
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("a"), i.cast("string"))), "\n").alias("a"),
        F.array_join(F.transform(F.sequence(F.lit(200), F.lit(600)), lambda i: F.concat(F.lit("a"), i.cast("string"))), "\n").alias("b"),
    )
    keys = frame.select(sketches.paragraph_digests(F.col("a")).alias("a"), sketches.paragraph_digests(F.col("b")).alias("b"))
    small = keys.select("a", "b", sketches.sketch(F.col("a")).alias("x"), sketches.sketch(F.col("b")).alias("y"))
    row = small.select(
        sketches.peel(sketches.subtract(F.col("x"), F.col("y")), sketches.BASE_SLOTS, 0).alias("small"),
        sketches.differing(*[F.col(c) for c in "abxy"]).alias("n"),
    ).first()
    assert not row["small"]["done"] and row["n"] == 199 + 300


MARKS = [
    (1, "!!!!"), (2, ""), (3, "?! abc"), (4, "abc"), (5, "One thing. Another. A third."), (6, "One thing.Another! A third?  And more.\n...\n. . ."),
    (7, " ".join(f"Sentence {i} of a long line." for i in range(90))), (8, " ".join(f"Sentence {i} of a long line." for i in range(70, 190)) + "!!"),
    (9, "no mark at all\nsecond line\n\nsecond line"), (10, None), (11, "é. ü! " * 30),
]


def check_marks(spark):
    got = {r["id"]: r for r in sketches.fingerprints_with_edit(H.frame(spark, MARKS)).collect()}
    texts = [t or "" for _, t in MARKS]
    for i, (d, _) in enumerate(MARKS):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert got[d]["near_edited"] == pytest.approx(H.likeness(text, edited)), d
        assert got[d]["near_next"] == pytest.approx(H.likeness(text, after)), d
    assert got[1]["fingerprint"] != got[2]["fingerprint"] == got[10]["fingerprint"] and got[3]["fingerprint"] != got[4]["fingerprint"]


def test_marks_alone_and_in_front_count(spark):
    check_marks(spark)


def test_sketches_that_all_fail_end_in_an_exact_answer(spark, monkeypatch):
    monkeypatch.setattr(sketches, "ROUNDS", dict.fromkeys(sketches.ROUNDS, 1))
    monkeypatch.setattr(sketches, "GROUP_KEYS", 60)
    check_marks(spark)
