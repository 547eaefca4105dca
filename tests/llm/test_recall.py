"""How many planted near copies the pipeline's fingerprints link."""

import random

from starweave.llm import simhash
from tests.llm import helpers as H

PAIRS = 600


def _jaccard(a, b, size=5):
    first, second = ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (a.split(), b.split()))
    return len(first & second) / len(first | second)


def planted(seed=11, pairs=PAIRS):
    """Texts of 150 to 500 random words and a copy each with single words replaced, at a similarity of 0.80 to 0.85."""
    r, out = random.Random(seed), []
    while len(out) < pairs:
        k = r.randint(3, 8)
        words = [f"w{r.randrange(10**6)}" for _ in range(4 + r.randint(46 * k, 61 * k))]
        places = sorted(r.sample(range(4, len(words) - 4), k))
        if any(b - a < 5 for a, b in zip(places, places[1:])):
            continue
        other = list(words)
        for place in places:
            other[place] = f"x{r.randrange(10**6)}"
        pair = (" ".join(words), " ".join(other))
        if 0.8 <= _jaccard(*pair) <= 0.85:
            out.append(pair)
    return out


def test_recall_near_the_threshold(spark):
    found = planted()
    rows = [(2 * i + side, text) for i, pair in enumerate(found) for side, text in enumerate(pair)]
    got = simhash.near_duplicates(H.frame(spark, rows), "doc_id", "text", simhash.similar_plan())
    part = {r["id"]: r["component_id"] for r in got.select("id", "component_id").collect()}
    linked = [part[2 * i] == part[2 * i + 1] for i in range(PAIRS)]
    print("linked", sum(linked), "of", PAIRS)
    assert sum(linked) >= 0.96 * PAIRS
    # no text is linked to a stranger
    assert all(part[i] // 2 == i // 2 for i in part)
    gone = {2 * i + 1 for i in range(PAIRS) if linked[i]}
    kept = {r["doc_id"] for r in simhash.one_of_each(H.frame(spark, rows)).select("doc_id").collect()}
    assert kept == set(range(2 * PAIRS)) - gone
