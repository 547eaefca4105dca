"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs become 64-bit digests; every digest is added to three
cells that hold a count and the exclusive or of the digests; a digest's last
24 bits check its first 40, which tells a single digest from several.
Sketches of two versions are subtracted cell by cell: what both have
cancels, and peeling cells with a single digest recovers the rest.  If a
sketch is too small for the difference, larger ones are tried.  All of it
is column expressions: nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from starweave.llm.common import staged

#: Slots of each of the three tables: of the published sketch, then of ever larger ones.
BASE_SLOTS, LARGER_SLOTS = 8, (6, 24, 128)
#: Digests of both versions in one group of a larger sketch, on average; rounds of peeling, by size.
GROUP_KEYS, ROUNDS = 5, {8: 8, 6: 5, 24: 10, 128: 20}
#: Paragraphs are lines, and sentences within them.
PARAGRAPH = r"[^.!?\n]*+[.!?]++|[^.!?\n]++"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


_CHECK_BITS = 24
_CHECK_MASK = (1 << _CHECK_BITS) - 1


def _check(k: Column) -> Column:
    return F.xxhash64(F.shiftrightunsigned(k, _CHECK_BITS)).bitwiseAND(_long(_CHECK_MASK))


def _digest(*parts: Column) -> Column:
    """40 bits of a hash, then 24 bits that check them."""
    return _let(F.xxhash64(*parts).bitwiseAND(_long(~_CHECK_MASK)), lambda x: x.bitwiseOR(_check(x)))


def paragraph_digests(text: Column) -> Column:
    """Digests of the paragraphs, without space around them.

    The n-th copy of a paragraph has a digest of its own, so that numbers of
    copies count.  Blank paragraphs are left out; null is the empty text.
    """
    lines = F.filter(
        F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0)), lambda x: F.trim(x)),
        lambda x: x != "",
    )
    ordered = F.sort_array(F.transform(lines, lambda x: F.xxhash64(F.lit("paragraph"), x)))

    def numbered(all_: Column) -> Column:
        # how many equal neighbours stand before each place: found by steps of falling powers of two
        steps = F.transform(F.sequence(F.lit(20), F.lit(0)), lambda e: F.pow(F.lit(2), e).cast("int"))

        def copies(x: Column, i: Column) -> Column:
            return F.aggregate(
                F.filter(steps, lambda s: s <= i), F.lit(0),
                lambda n, s: n + F.when((i - n - s >= 0) & (F.get(all_, i - n - s) == x), s).otherwise(0),
            )

        # only a place whose neighbour is equal is looked at more closely
        return F.transform(all_, lambda x, i: _digest(
            x, F.when((i > 0) & (F.get(all_, i - 1) == x), copies(x, i)).otherwise(F.lit(0))
        ))

    return _let(ordered, numbered)


def _placed(keys: Column, slots: int, level: int) -> Column:
    """Each digest with its slot in the three tables."""
    def place(k: Column) -> Column:
        return _let(F.xxhash64(k, F.lit(level)), lambda x: F.struct(
            k.alias("k"),
            *[F.pmod(F.shiftrightunsigned(x, 10 * j), _long(slots)).cast("int").alias(f"s{j}") for j in range(3)],
        ))

    return F.transform(keys, place)


def _cell(n: Column, k: Column) -> Column:
    return F.struct(n.alias("n"), k.alias("k"))


def _changed(cell: Column, items: Column, sign) -> Column:
    """The cell after adding (sign 1) or taking away (sign of each item) the items."""
    return F.aggregate(items, cell, lambda a, x: _cell(
        a["n"] + sign(x), a["k"].bitwiseXOR(x["k"])
    ))


def sketch(keys: Column, slots: int = BASE_SLOTS, level: int = 0) -> Column:
    """Cells of three tables, one after the other."""
    zero = _cell(_long(0), _long(0))

    def cells(placed: Column, j: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: _changed(
            zero, F.filter(placed, lambda x: x[f"s{j}"] == i), lambda x: _long(1)
        ))

    return _let(_placed(keys, slots, level), lambda placed: F.concat(*[cells(placed, j) for j in range(3)]))


def signed_sketch(a: Column, b: Column, slots: int, level: int) -> Column:
    """The difference of the sketches of ``a`` and ``b``, made at once: digests of ``b`` are taken away."""
    zero = _cell(_long(0), _long(0))

    def placed(keys: Column, sign: int) -> Column:
        return F.transform(_placed(keys, slots, level), lambda x: F.struct(
            x["k"].alias("k"), *[x[f"s{j}"].alias(f"s{j}") for j in range(3)], _long(sign).alias("n")
        ))

    def cells(both: Column, j: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: _changed(
            zero, F.filter(both, lambda x: x[f"s{j}"] == i), lambda x: x["n"]
        ))

    return _let(F.concat(placed(a, 1), placed(b, -1)), lambda both: F.concat(*[cells(both, j) for j in range(3)]))


def subtract(a: Column, b: Column) -> Column:
    """Cell by cell difference of two sketches of equal size."""
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"])))


def peel(cells: Column, slots: int, level: int) -> Column:
    """``done, found``: the digests that differ, each with its sign, and whether nothing is left over."""
    none = F.expr("cast(array() as array<struct<k: bigint, n: bigint>>)")

    def pure(state: Column) -> Column:
        single = F.filter(state, lambda c: (F.abs(c["n"]) == 1) & (_check(c["k"]) == c["k"].bitwiseAND(_long(_CHECK_MASK))))
        return F.array_distinct(F.transform(single, lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n"))))

    def without(state: Column, found: Column) -> Column:
        def place(y: Column) -> Column:
            return _let(F.xxhash64(y["k"], F.lit(level)), lambda x: F.struct(
                y["k"].alias("k"), y["n"].alias("n"),
                *[(F.pmod(F.shiftrightunsigned(x, 10 * j), _long(slots)).cast("int") + j * slots).alias(f"s{j}") for j in range(3)],
            ))

        return _let(F.transform(found, place), lambda placed: F.transform(state, lambda c, i: F.when(c["k"] == 0, c).otherwise(
            _changed(c, F.filter(placed, lambda y: (y["s0"] == i) | (y["s1"] == i) | (y["s2"] == i)), lambda y: -y["n"])
        )))

    def step(state: Column, _: Column) -> Column:
        def taken(found: Column) -> Column:
            return F.when(F.size(found) == 0, F.struct(
                state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("over")
            )).otherwise(F.struct(
                without(state["cells"], found).alias("cells"), F.concat(state["found"], found).alias("found"), F.lit(False).alias("over"),
            ))

        # rounds behind one that finds nothing cost nothing
        return F.when(state["over"], state).otherwise(_let(pure(state["cells"]), taken))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS[slots])), F.struct(cells.alias("cells"), none.alias("found"), F.lit(False).alias("over")), step,
        lambda s: F.struct(F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0)).alias("done"), s["found"].alias("found")),
    )


def _count(found: Column) -> Column:
    """Recovered digests; one that was taken for single wrongly is found again with the other sign, and both fall out."""
    return (2 * F.size(F.array_distinct(F.transform(found, lambda y: y["k"]))) - F.size(found)).cast("long")


def _differing(a: Column, b: Column, slots: int, level: int, larger: tuple[int, ...]) -> Column:
    """How many digests differ, by sketches of this size or, where peeling fails, of the next.

    If the largest fails too, the digests themselves are compared.
    """
    def judged(result: Column) -> Column:
        if larger:
            other = _differing(a, b, larger[0], level + 1, larger[1:])
        else:
            other = (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).cast("long")
        return F.when(result["done"], _count(result["found"])).otherwise(other)

    return _let(peel(signed_sketch(a, b, slots, level), slots, level), judged)


def differing(a: Column, b: Column, base_a: Column, base_b: Column) -> Column:
    """Digests that only one version has: from the published sketches, or from larger ones in groups.

    A larger sketch deals the digests into groups by ranges of their values
    and peels each group on its own; only groups that fail are tried again.
    A group is a slice of the sorted digests; all bounds are bisected first.
    """
    def bounds(keys: Column, groups: Column) -> Column:
        """How many sorted digests lie before each group, and all of them behind the last."""
        steps = F.transform(F.sequence(F.floor(F.log2(F.size(keys) + F.lit(0.5))).cast("int"), F.lit(0), F.lit(-1)), lambda e: F.pow(F.lit(2), e).cast("int"))

        def below(g: Column, steps: Column, n: Column) -> Column:
            return _let((g / n - 0.5) * 2.0**64, lambda bound: F.aggregate(steps, F.lit(0), lambda at, s: F.when(
                (at + s <= F.size(keys)) & (F.get(keys, at + s - 1).cast("double") < bound), at + s
            ).otherwise(at)))

        inner = _let(steps, lambda steps_: F.transform(F.sequence(_long(0), groups - 1), lambda g: below(g, steps_, groups)))
        found = F.when(F.size(keys) == 0, F.array_repeat(F.lit(0), groups.cast("int"))).otherwise(inner)
        return F.concat(found, F.array(F.size(keys)))

    def grouped(a_: Column, b_: Column) -> Column:
        groups = F.greatest(_long(1), F.ceil((F.size(a_) + F.size(b_)) / GROUP_KEYS))

        def one(g: Column, at: Column) -> Column:
            def mine(keys: Column, side: str) -> Column:
                return _let(F.get(at[side], g.cast("int")), lambda first: F.slice(keys, first + 1, F.get(at[side], g.cast("int") + 1) - first))

            return _let(F.struct(mine(a_, "a").alias("a"), mine(b_, "b").alias("b")), lambda p: F.when(
                F.size(p["a"]) + F.size(p["b"]) == 0, _long(0)
            ).otherwise(_differing(p["a"], p["b"], LARGER_SLOTS[0], 1, LARGER_SLOTS[1:])))

        return _let(F.struct(groups.alias("n"), bounds(a_, groups).alias("a"), bounds(b_, groups).alias("b")), lambda at: F.aggregate(
            F.transform(F.sequence(_long(0), at["n"] - 1), lambda g: one(g, at)), _long(0), lambda s, x: s + x
        ))

    return _let(peel(subtract(base_a, base_b), BASE_SLOTS, 0), lambda r: F.when(
        r["done"], _count(r["found"])
    ).otherwise(_let(F.struct(F.sort_array(a).alias("a"), F.sort_array(b).alias("b")), lambda p: grouped(p["a"], p["b"]))))


def likeness(a: Column, b: Column, base_a: Column, base_b: Column) -> Column:
    """Share of the paragraphs that both have, of both versions' (0 to 1); two empty texts are alike."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(1.0 - differing(a, b, base_a, base_b) / total)


def as_text(cells: Column) -> Column:
    """A sketch as text: count and digests of each cell."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["n"].cast("string"), F.hex(c["k"]))), " ")


#: Stands for a null id: such documents come after all others.
LAST_ID = (1 << 63) - 1


def next_documents(keys: DataFrame) -> DataFrame:
    """``id, twin, next_id, next_twin`` of distinct ``id, twin`` rows: the next in order, after the last the first.

    Rows are dealt out by ranges of the id; only the first row of each range
    is carried over to the range before it, so no task holds the order of all.
    """
    order = [F.col("id"), F.col("twin")]
    dealt = staged(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    own = F.struct("id", "twin")
    inside = dealt.withColumn("next", F.lead(own).over(Window.partitionBy("part").orderBy(*order)))
    by_part = Window.orderBy("part")
    heads = (
        dealt.groupBy("part").agg(F.min(own).alias("head"))
        .select("part", F.lead("head").over(by_part).alias("after"), F.first("head").over(by_part).alias("start"))
    )
    return inside.join(heads, "part").withColumn("next", F.coalesce("next", "after", "start")).select(
        "id", "twin", F.col("next.id").alias("next_id"), F.col("next.twin").alias("next_twin")
    )


def fingerprints_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's sketch, that of an edited version, and how alike they and the next text are.

    The edited text has its last quarter of code points replaced by as many
    of the next document's first ones (or all there are).  Returns ``id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``, a row for each row of ``docs``; rows that repeat id and
    text count as one in the order of documents.  Null texts are empty; a
    null id comes last in order and back as null.  Texts are shuffled once;
    the next text's first part and digests follow in a second, smaller shuffle.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), text.alias("text")
    ).withColumn("twin", F.xxhash64("text"))
    sizes = staged(
        rows.select("id", "twin", F.floor(F.char_length("text") / 4).cast("int").alias("quarter")).distinct(), "sizes"
    )
    asked = (
        next_documents(sizes.select("id", "twin")).join(sizes, ["id", "twin"])
        .select(F.col("next_id").alias("id"), F.col("next_twin").alias("twin"), "quarter", F.struct("id", "twin").alias("asker"))
    )
    dealt = rows.repartition(parts, "id", "twin")
    given = (
        dealt.join(asked, ["id", "twin"])
        .select("asker", F.expr("substring(text, 1, quarter)").alias("part"), paragraph_digests(F.col("text")).alias("next_keys"))
        .groupBy(F.col("asker.id").alias("id"), F.col("asker.twin").alias("twin"))
        .agg(F.first("part").alias("part"), F.first("next_keys").alias("next_keys"))
    )
    n = F.char_length("text")
    return (
        dealt.join(given, ["id", "twin"])
        .select(
            "id", n.cast("long").alias("n_chars"), "next_keys", paragraph_digests(F.col("text")).alias("keys"),
            F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int")), "part").alias("edited"),
        )
        .select(
            "id", "n_chars", "keys", "next_keys", paragraph_digests(F.col("edited")).alias("edited_keys"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        )
        .withColumns({name: sketch(F.col(keys)) for name, keys in (("base", "keys"), ("edited_base", "edited_keys"), ("next_base", "next_keys"))})
        .select(
            F.when(F.col("id") != LAST_ID, F.col("id")).alias("id"), "n_chars", "edited_sha256",
            as_text(F.col("base")).alias("fingerprint"), as_text(F.col("edited_base")).alias("edited_fingerprint"),
            likeness(F.col("keys"), F.col("edited_keys"), F.col("base"), F.col("edited_base")).alias("near_edited"),
            likeness(F.col("keys"), F.col("next_keys"), F.col("base"), F.col("next_base")).alias("near_next"),
        )
    )
