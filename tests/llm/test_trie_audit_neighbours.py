"""Prefix trie, filter audit and nearest neighbours against brute force; odd input for each."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from starweave.llm import audit, neighbours, oracles, prefixes, queries

CONV = "conv_id long, turn long, role string, text string"


def conversations(seed=3, n=60):
    """Shared first turns, whole copies, prefixes of each other, long ones, nulls and ties."""
    draw = random.Random(seed)
    rows, told = [], {}
    for c in range(n):
        if c % 4 == 1:
            turns = told[draw.choice(list(told))]
        elif c % 4 == 2:
            turns = told[draw.choice(list(told))][: draw.randint(0, 9)] + [("user", f"more {draw.randint(0, 3)}")]
        else:
            turns = [("system", "common")] * (c % 2) + [(draw.choice(["user", "assistant"]), f"é{draw.randint(0, 5)}") for _ in range(draw.randint(1, 12))]
        if c == 40:
            turns = turns + [("user", str(i)) for i in range(60)]
        told[c] = turns
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    rows += [(200, None, None, None), (200, 1, "user", "second"), (201, 5, "b", "x"), (201, 5, "a", "x"), (None, 0, "user", "no id"), (-3, 0, "user", "é1"), (204, 0, "", "")]
    return rows


def turn_key(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute_trie(rows):
    said = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append(((turn is not None, turn or 0), turn_key(role, text), (role or "", text or "")))
    said = {c: [x[2] for x in sorted(v)] for c, v in said.items()}
    nodes = collections.defaultdict(list)
    rebuilt = {}
    for c, turns in said.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        rebuilt[c] = tuple(said.get(base, [])[:h] + turns[h:])
        for d in range(len(rebuilt[c]) + 1):
            nodes[rebuilt[c][:d]].append(c)
    kids = collections.Counter(p[:-1] for p in nodes if p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(members) if rebuilt[c] == p)
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], sum(not kids[q] for q in below),
            sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie_query(spark, rows, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda s, d, name: s.createDataFrame(rows, CONV))
    got = queries.conversation_trie(spark, "")
    return sorted((tuple(r) for r in got.collect()), key=str), got.columns


@pytest.mark.parametrize("block,fan", [(16_384, 64), (5, 2), (1, 3)])
def test_trie_equals_brute_force_however_it_is_cut(spark, monkeypatch, block, fan):
    monkeypatch.setattr(prefixes, "BLOCK_ROWS", block)
    monkeypatch.setattr(prefixes, "FAN_IN", fan)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, columns = trie_query(spark, conversations(), monkeypatch)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got == brute_trie(conversations())


def test_trie_of_nothing_and_of_one_turnless_conversation(spark, monkeypatch):
    assert trie_query(spark, [], monkeypatch)[0] == []
    assert trie_query(spark, [(None, 1, "a", "b")], monkeypatch)[0] == []
    one = prefixes.prefix_trie(spark.createDataFrame([(7, [])], "conv_id long, turns array<string>")).collect()
    assert [tuple(r) for r in one] == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]


def test_trie_takes_other_columns(spark):
    rows = spark.createDataFrame([(1, 0, "u", "a", "k", 5)], CONV + ", key string, part int")
    assert prefixes.prefix_trie(prefixes.turn_sequences(rows)).count() == 2


def test_radix_nodes_grow_and_keep_their_order():
    draw = random.Random(1)
    tree, keys = prefixes.Radix(b""), sorted({bytes([a, b, draw.randrange(3)]) for a in range(256) for b in range(0, 256, 51)})
    for i, key in enumerate(keys):
        tree.insert(key, i)
    assert tree.layout == 256 and {k.layout for k in tree.children()} <= {4, 16}

    def walk(node, above):
        here = above + node.path
        if node.value is not None:
            yield here, node.value
        for byte, kid in [(b, node.find(b)) for b in range(256)]:
            if kid is not None:
                yield from walk(kid, here + bytes([byte]))

    assert list(walk(tree, b"")) == [(k, i) for i, k in enumerate(keys)]
    layouts = [prefixes.Radix(b"") for _ in range(4)]
    for node, n in zip(layouts, (4, 16, 48, 49)):
        for b in draw.sample(range(256), n):
            node.add(b, prefixes.Radix(bytes([b])))
        assert [k.path[0] for k in node.children()] == sorted(k.path[0] for k in node.children())
    assert [n.layout for n in layouts] == [4, 16, 48, 256]


# --- filter audit

DOCS = "doc_id long, text string, source string, mask int, h string, segment long"


def documents():
    draw = random.Random(5)
    rows = []
    for i in range(80):
        words = [draw.choice(["Alpha", "beta", "γάμμα", "delta", "ROOT"] + [f"w{j}" for j in range(draw.choice([5, 400]))]) for _ in range(draw.choice([3, 199, 200, 260]))]
        text = draw.choice([" ", "\n", " \t "]).join(words) + draw.choice(["", "", "$", "|"])
        rows.append((i, text if i % 6 else rows[draw.randrange(len(rows))][1] if rows else "x", draw.choice(["a", "b", None])))
    rows += [(90, None, "a"), (91, "", "b"), (92, "", None), (None, rows[3][1], "a"), (93, rows[3][1], "a"), (93, rows[3][1], "a"), (94, "Ü" * 300, "c"), (95, "word " * 250, "c"), (96, " \n ", "c")]
    return rows


def labels():
    return [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 80, 2)] + [(4, None, None), (4, 1, 0), (None, 1, 1), (500, 1, 1)]


def fails(rows):
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    for d, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        yield d, source or "", "".join(letter for letter, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            re.search(r"[#$%&*|]", text) is not None, d is not None and least[text] < d,
        )) if bad)


def brute_audit(rows, marks):
    good = {d for d, q, _ in marks if q == 1 and d is not None}
    toxic = {d for d, _, t in marks if t == 1 and d is not None}
    found, parts = list(fails(rows)), {}
    for d, part, failed in found:
        parts.setdefault(part, []).append((d, failed))
    out = []
    for part, held in parts.items():
        removed = collections.Counter()
        lines = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = held
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                stay = [x for x in left if f not in x[1]]
                removed[f] += len(gone)
                lines.append([part, order, step, len(stay), len(gone), sum(f in x[1] for x in held) - len(gone), sum(x[1] == f for x in held),
                              sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f])
                left = stay
        out += [tuple(line[:-1] + [removed[line[-1]]]) for line in lines]
    return sorted(out)


@pytest.mark.parametrize("cells,sent", [(32, 32 << 20), (1, 32 << 20), (32, 0)])
def test_audit_equals_running_every_order(spark, monkeypatch, cells, sent):
    """Also with a sketch too small to clear anything much, and with one that is joined."""
    monkeypatch.setattr(audit, "CELLS", cells)
    monkeypatch.setattr(audit, "BROADCAST_BYTES", sent)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in documents()], DOCS)
    got = audit.filter_audit(docs, spark.createDataFrame(labels(), "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(documents(), labels())


def test_audit_of_no_documents(spark):
    none = spark.createDataFrame([], DOCS)
    assert audit.filter_audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_sketch_clears_unique_texts_and_no_repeated_one(spark):
    rows = [(i, i) for i in range(5000)] + [(i, i % 40) for i in range(5000, 5100)]
    hashed = spark.createDataFrame(rows, "id long, n long").select("id", "n", F.xxhash64("n").alias("h"))
    segments = 5100 * audit.CELLS // audit.SEGMENT
    left = audit.may_repeat(hashed, audit.repeat_sketch(hashed, segments), segments)
    kept = {r["n"] for r in left.collect()}
    assert set(range(40)) <= kept and len(kept) < 40 + 5000 * 0.02


def test_queries_equal_their_sql_on_odd_rows(spark, monkeypatch):
    con = duckdb.connect()
    tables = {
        "documents": spark.createDataFrame([(*r, 1, "x", 2) for r in documents()], DOCS),
        "labels": spark.createDataFrame(labels(), "doc_id long, quality int, toxic int"),
        "conversations": spark.createDataFrame(conversations(), CONV),
    }
    monkeypatch.setattr(queries, "table", lambda s, d, name: tables[name])
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    for name in ("op11_conversation_trie", "op12_filter_audit"):
        got = queries.queries()[name](spark, "")
        expected = con.execute(oracles.ORACLES[name])
        assert [d[0] for d in expected.description] == got.columns
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected.fetchall())), name


# --- nearest neighbours

VECTORS = "vec_id long, embedding array<float>, query int, score string"


def vectors(n=900, size=24, seed=2):
    draw = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=size)], 0, "") for i in range(n)]
    for i in range(0, 300, 3):  # a third are copies of one vector, some of these are queries
        rows[i] = (i, rows[1][1], 0, "")
    rows[600] = (600, [3.0 * x for x in rows[601][1]], 0, "")
    rows += [(5000, None, 0, ""), (5100, [], 0, ""), (5200, [0.0] * size, 0, ""), (5300, [float("nan")] + [1.0] * (size - 1), 0, ""),
             (5400, [None] + [1.0] * (size - 1), 0, ""), (5500, [float("inf")] * size, 0, ""), (None, [1.0] * size, 0, ""),
             (5600, [1.0, 2.0, 3.0], 0, ""), (5601, [1.0, 2.0, 4.0], 0, ""), rows[50], rows[600]]
    return rows


def nearest(rows, k=10):
    held = {}
    for d, v, *_ in rows:
        if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            held[d] = np.array(v, np.float32).astype(float)
    out = {}
    for q, x in held.items():
        if q % 100 == 0:
            found = sorted((float(np.sqrt(((x - y) ** 2).sum())), d) for d, y in held.items() if d != q and len(y) == len(x))
            out[q] = found[:k]
    return out


def answers(frame):
    got = collections.defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    return got


def ask(spark, rows, **options):
    frame = spark.createDataFrame(rows, VECTORS)
    return neighbours.nearest_neighbours(frame, frame.where(F.col("vec_id") % 100 == 0), **options)


def test_neighbours_found_are_the_nearest_and_scores_exact(spark):
    expected, found = nearest(vectors()), ask(spark, vectors())
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = answers(found)
    assert set(got) == set(expected)
    hits = sum(len({d for _, d in got[q]} & {d for _, d in expected[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    place = {r[0]: np.array(r[1], np.float32).astype(float) for r in vectors()[:900]}
    for q, near in got.items():
        assert near == sorted(near) and len(near) == len(expected[q])
        if q < 900:
            assert [s for s, _ in near] == pytest.approx([np.linalg.norm(place[q] - place[d]) for _, d in near], rel=1e-12, abs=0)
    copies = [q for q in got if q < 300 and q % 3 == 0]
    assert copies and all(got[q] == expected[q] for q in copies)  # ties to the smaller ids, exactly
    assert got[5600] == [(1.0, 5601)]


def test_every_candidate_of_a_small_table_is_found(spark):
    rows = vectors()[300:309]
    rows[0] = (300, *rows[0][1:])
    expected = nearest(rows)
    got = answers(ask(spark, rows))
    assert {q: [d for _, d in v] for q, v in got.items()} == {q: [d for _, d in v] for q, v in expected.items()}
    assert ask(spark, []).count() == 0


def test_queries_that_meet_too_few_are_compared_with_all(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "probes_needed", lambda *a: 1)
    monkeypatch.setattr(neighbours, "BUCKET", 1)
    monkeypatch.setattr(neighbours, "TABLES", 1)
    monkeypatch.setattr(neighbours.Hashes.__init__, "__defaults__", (1, 1, 7))
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 600)  # and in several blocks
    rows = vectors()[300:]
    expected, got = nearest(rows), answers(ask(spark, rows))
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in expected.items()}


def test_hashes_are_nearest_axes_of_rotations():
    draw = np.random.default_rng(3)
    hashes = neighbours.Hashes(20, 50_000, tables=2, bucket=16)
    x = neighbours._unit(draw.normal(size=(50, 20)))
    assert hashes.axes == [32, 32, 1][: len(hashes.axes)] or np.prod([2 * a for a in hashes.axes]) == hashes.codes
    for t in range(2):
        turned = hashes._turned(x, t, 0)
        full = np.zeros((50, 32))
        full[:, :20] = x
        dense = np.array([[(-1) ** bin(i & j).count("1") for j in range(32)] for i in range(32)]) / np.sqrt(32)
        for signs in hashes.signs[t, 0]:
            full = (full * signs) @ dense
        assert np.allclose(turned, full[:, : hashes.axes[0]])
        probes = hashes.probes(x, t, 40)
        assert (probes[:, 0] == hashes.buckets(x, t)).all()
        assert all(len(set(p)) == 40 for p in probes.tolist())
    assert np.allclose(neighbours._distances(np.array([[1e200, 0.0]]), np.array([[-1e200, 0.0]])), 2e200)
