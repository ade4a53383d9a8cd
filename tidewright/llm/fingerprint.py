"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame operations only.

A paragraph is a line; longer ones are cut every ``LONGEST`` code points. A text's
set of paragraph digests goes into a sketch of three subtables with ``SLOTS`` cells
each; a cell holds how many digests fell into it, their xor and the xor of their
check hashes. The difference of two sketches is a sketch of the digests that are in
one text only; peeling cells that hold one digest recovers them. Where that fails,
both sets are dealt to as many sketches as their sizes ask for and peeled again,
each that fails with four times the cells, up to ``LARGER[-1]`` slots. If d digests
differ, the likeness is 1 - d / (size + size), and 1 for two empty texts. Should the
last retry fail (two digests of twelve then share three cells of 256), that sketch's
digests are compared themselves. A text of n paragraphs takes time n to the power 1.5.

The next document comes from a window in each of many id ranges, with the range's
last row joined to the first of the next range; no task holds all rows.

Null text is empty. Ids of any type that Spark orders are taken. A null id comes before the others. Rows of one id follow each
other by their text's hash; equal rows stand next to each other. A table of one row
is its own next; an empty table has no rows. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType

LONGEST = 200
SLOTS = 8
LARGER = (16, 64, 256)
EXPECTED = 12
ROUNDS = 12
PER_RANGE = 4000
CUTS = 1 << 14
SAMPLED = 20
PARTS = 64  # a power of two
PARAGRAPH = rf"[^\n]{{1,{LONGEST}}}\n?|\n"
_CELL = "array<struct<c: int, k: bigint, h: bigint>>"


def _with(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used (inside lambdas, too)."""
    return F.element_at(F.transform(F.array(value), then), 1)


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))


def _placed(key: Column, slots: int, *more: Column) -> Column:
    """struct(k, h, s0, s1, s2, ...): a digest, its check hash and its place in each subtable."""
    places = [F.pmod(F.call_function("shiftright", key, F.lit(t * 13)), F.lit(slots)).cast("int").alias(f"s{t}") for t in range(3)]
    return F.struct(key.alias("k"), _check(key).alias("h"), *places, *more)


def _by_cell(placed: Column, slots: int, make) -> Column:
    """``make`` of the digests in each cell and of the cell's number, subtable after subtable."""

    def table(t: int) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(slots - 1))
        return F.transform(numbers, lambda i: _with(F.filter(placed, lambda p: p[f"s{t}"] == i), lambda own: make(own, i + t * slots)))

    return F.concat(*map(table, range(3)))


def sketch(keys: Column, slots: int = SLOTS) -> Column:
    zero = F.lit(0).cast("long")

    def cell(own: Column, _: Column) -> Column:
        return F.struct(
            F.size(own).alias("c"),
            F.aggregate(own, zero, lambda a, p: a.bitwiseXOR(p["k"])).alias("k"),
            F.aggregate(own, zero, lambda a, p: a.bitwiseXOR(p["h"])).alias("h"),
        )

    return _with(F.transform(keys, lambda k: _placed(k, slots)), lambda placed: _by_cell(placed, slots, cell).cast(_CELL))


def subtract(a: Column, b: Column) -> Column:
    cell = lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h"))
    return F.zip_with(a, b, cell).cast(_CELL)


def peel(difference: Column, slots: int = SLOTS) -> Column:
    """struct(found, left): digests recovered, and at most how many more there are (0: all were recovered)."""
    state = F.struct(difference.alias("cells"), F.lit(0).alias("found"), F.lit(True).alias("live"))

    def step(s: Column, _: Column) -> Column:
        pure = F.filter(s["cells"], lambda x: (F.abs(x["c"]) == 1) & (_check(x["k"]) == x["h"]))
        pure = F.array_distinct(F.transform(pure, lambda x: F.struct(x["c"].alias("c"), x["k"].alias("k"))))
        hit = F.transform(pure, lambda p: _placed(p["k"], slots, p["c"].alias("c")))

        def grown(keys: Column) -> Column:
            def without(own: Column, i: Column) -> Column:
                return F.aggregate(
                    own,
                    F.get(s["cells"], i),
                    lambda a, p: F.struct((a["c"] - p["c"]).alias("c"), a["k"].bitwiseXOR(p["k"]).alias("k"), a["h"].bitwiseXOR(p["h"]).alias("h")),
                )

            cells = _by_cell(keys, slots, without).cast(_CELL)
            done = F.struct(s["cells"].alias("cells"), s["found"].alias("found"), F.lit(False).alias("live"))
            more = F.struct(cells.alias("cells"), (s["found"] + F.size(keys)).alias("found"), F.lit(True).alias("live"))
            return F.when(F.size(keys) == 0, done).otherwise(more)

        return F.when(s["live"], _with(hit, grown)).otherwise(s)

    def result(s: Column) -> Column:
        full = F.filter(s["cells"], lambda x: (x["c"] != 0) | (x["k"] != 0) | (x["h"] != 0))
        return F.struct(s["found"].alias("found"), F.size(full).alias("left"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, step, result)


def _hand(keys: Column, seed: int, many: Column) -> Column:
    """The keys in ``many`` lists, by a hash."""
    return F.transform(F.sequence(F.lit(0), many - 1), lambda n: F.filter(keys, lambda k: F.pmod(F.xxhash64(k, F.lit(seed)), many) == n))


def _differing(pair: Column) -> Column:
    """How many digests are in one of the lists a and b only: by sketches, larger on failure, at last by the digests themselves."""

    def attempt(slots: int) -> Column:
        return peel(subtract(sketch(pair["a"], slots), sketch(pair["b"], slots)), slots)

    def unless(found: Column, other: Column) -> Column:
        return _with(found, lambda f: F.when(f["left"] == 0, f).otherwise(other))

    exactly = F.size(F.array_except(pair["a"], pair["b"])) + F.size(F.array_except(pair["b"], pair["a"]))
    found = attempt(LARGER[0])
    for slots in LARGER[1:]:
        found = unless(found, attempt(slots))
    return unless(found, F.struct(exactly.alias("found"), F.lit(0).alias("left")))["found"]


def _dealt(a: Column, b: Column, sketches: Column) -> Column:
    """How many digests differ, from the two sets dealt to at least so many sketches by a hash of the digests; each fails and grows by itself.

    The digests go to the square root of so many piles and each pile to as many
    sketches: a digest is looked at twice that root's times, not once a sketch.
    """

    def deal(pair: Column, seed: int, many: Column) -> Column:
        return F.arrays_zip(_hand(pair["a"], seed, many).alias("a"), _hand(pair["b"], seed, many).alias("b"))

    def found(many: Column) -> Column:
        both = F.struct(a.alias("a"), b.alias("b"))
        piles = F.when(many == 1, F.array(both)).otherwise(deal(both, 2, many))
        width = F.ceil(sketches / many).cast("int")
        return F.flatten(F.transform(piles, lambda pile: F.transform(deal(pile, 1, width), lambda pair: _with(pair, _differing))))

    many = F.greatest(F.lit(1), F.ceil(F.sqrt(sketches / 8)).cast("int"))
    return F.aggregate(_with(many, found), F.lit(0), lambda s, x: s + x)


def likeness(frame: DataFrame, name: str, a: str, b: str, a_keys: str, b_keys: str) -> DataFrame:
    """``frame`` with the likeness of two sketches; the key columns are for larger sketches on failure."""
    total = F.size(a_keys) + F.size(b_keys)
    found = frame.withColumn("_peeled", peel(subtract(F.col(a), F.col(b))))
    again = _dealt(F.col(a_keys), F.col(b_keys), F.ceil(total / EXPECTED))
    differ = F.when(F.col("_peeled.left") == 0, F.col("_peeled.found")).otherwise(again)
    return found.withColumn(name, F.when(total == 0, F.lit(1.0)).otherwise(1 - differ / total)).drop("_peeled")


def shown(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda x: F.concat(F.hex(x["c"]), F.lit("."), F.hex(x["k"]), F.lit("."), F.hex(x["h"]))), " ")


def _ranges(docs: DataFrame) -> Column:
    """The number of a row's range in the order of ids, then of the texts' hashes.

    The cuts are quantiles of the ids: eight for each task, so that tasks even out, and one for every
    ``PER_RANGE`` rows, ``CUTS`` at most. Rows without an id, and those of an id that is two quantiles
    or more, are parted by their texts' hashes into ``PARTS`` ranges of their own. Ids that are no
    numbers are cut at places of a sorted sample, of ``SAMPLED`` ids for each cut.
    """
    spark = docs.sparkSession
    rows = docs.count()
    many = max(2, min(CUTS, max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // PER_RANGE)))
    if isinstance(docs.schema["doc_id"].dataType, (IntegralType, FractionalType)):
        cuts = docs.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)], 20 * many)).first()[0] or []
    else:
        held = docs.where("doc_id is not null").sample(min(1.0, SAMPLED * many / max(rows, 1)), seed=7).orderBy("doc_id")
        ids = [r[0] for r in held.collect()]  # about SAMPLED * many
        cuts = [ids[i * len(ids) // many] for i in range(1, many)] if ids else []
    hot = [c for c, n in Counter(cuts).items() if n > 1]
    cuts = list(dict.fromkeys(cuts))
    part = F.call_function("shiftright", F.col("seen"), F.lit(64 - PARTS.bit_length() + 1)) + PARTS // 2
    if not cuts:
        return part.cast("int")
    wide = 128
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    which = F.size(F.filter(F.lit([g[0] for g in groups]), lambda c: F.col("doc_id") >= c))
    nested = F.array(*[F.lit(g) for g in groups])
    inside = F.size(F.filter(F.get(nested, which - 1), lambda c: F.col("doc_id") >= c))
    at = F.when(which == 0, 0).otherwise((which - 1) * wide + inside)  # a cut's own id comes first in its range
    is_hot = F.array_contains(F.lit(hot), F.col("doc_id")) if hot else F.lit(False)
    number = (at * 2 + F.when(is_hot, 1).otherwise(2)) * PARTS + F.when(is_hot, part).otherwise(0)
    return F.when(F.col("doc_id").isNull(), part).otherwise(number).cast("int")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("seen"))
    rows = rows.withColumn("range", _ranges(rows.select("doc_id")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("seen")]
    window = Window.partitionBy("range").orderBy(*order)
    follow = rows.withColumn("next_text", F.lead("text").over(window)).withColumn("keys", digests(F.col("text")))
    follow = follow.withColumn("next_keys", F.lead("keys").over(window))

    # the first row of each range, by a small table of (range, id, hash), for the last row of the range before it
    firsts = rows.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "seen")).alias("first"))
    ring = Window.orderBy("range")  # over one row for each range
    before = F.coalesce(F.lag("range").over(ring), F.max("range").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select(F.col("first.doc_id").alias("first_id"), F.col("first.seen").alias("first_seen"), before.alias("before"))
    head = rows["doc_id"].eqNullSafe(firsts["first_id"]) & (rows["seen"] == firsts["first_seen"])
    heads = rows.join(F.broadcast(firsts), head).groupBy("before").agg(F.first("text").alias("head_text"))
    heads = heads.withColumn("head_keys", digests(F.col("head_text")))
    joined = follow.join(heads.hint("merge"), follow["range"] == heads["before"], "left")

    joined = joined.select(
        "doc_id",
        "text",
        "keys",
        F.char_length("text").alias("n"),
        F.coalesce("next_text", "head_text").alias("next_text"),
        F.coalesce("next_keys", "head_keys").alias("next_keys"),
    )
    quarter = F.floor(F.col("n") / 4).cast("int")
    edited = joined.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - quarter), F.substring("next_text", F.lit(1), quarter)))
    hashed = edited.select("doc_id", "n", F.sha2("edited", 256).alias("edited_sha256"), "keys", digests(F.col("edited")).alias("edited_keys"), "next_keys")
    for part in ("keys", "edited_keys", "next_keys"):
        hashed = hashed.withColumn(part.replace("keys", "cells"), sketch(F.col(part)))
    near = likeness(hashed, "near_edited", "cells", "edited_cells", "keys", "edited_keys")
    near = likeness(near, "near_next", "cells", "next_cells", "keys", "next_keys")
    return near.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        shown(F.col("cells")).alias("fingerprint"),
        shown(F.col("edited_cells")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
