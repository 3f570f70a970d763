"""SimHash fingerprints and the search for near ones, in DataFrame functions only.

A text's terms are its words. Every occurrence of a term votes on each of the 64
bits of its hash with a weight, its length up to twelve letters; so function
words count less. A bit of the fingerprint is set where the weight for it exceeds
the weight against it.

Near fingerprints are found through permuted tables: the 64 bits are cut into
three blocks, and two fingerprints within ``RADIUS`` bits differ by at most a
third of that in some block. Each table holds one block of every fingerprint; a
query probes it with all values of its own block that are so near. A query has
some 700 probes, each of which meets one in two million fingerprints by chance.

Defined results: a null, empty or blank text has no terms and the fingerprint
of 64 zero bits. A tied vote leaves the bit zero. Rows equal in id and text are
one row of the result. A null id sorts behind all others. Columns other than
the named ones are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.session import cut_lineage

BITS = 64
HALF = BITS // 2
MAX_WEIGHT = 12
PAIR_MASK = (1 << HALF) | 1  # one bit of the lower and one of the upper half
RADIUS = 8  # bits; README has the share of texts with a Jaccard similarity of 0.75 that lie within it
TABLES = 3


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")  # one plain character: no regular expression runs


def terms(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys``, hash ``h`` and weight ``w``: one row for each occurrence of a term, all inside generated code."""
    each = rows.select(*keys, F.explode_outer(words(text)).alias("t"))
    weight = F.when(F.length("t") > MAX_WEIGHT, F.lit(MAX_WEIGHT)).otherwise(F.length("t"))
    return each.select(*keys, F.xxhash64("t").alias("h"), F.coalesce(weight, F.lit(0)).cast("long").alias("w"))


def votes(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys`` and ``fingerprint`` (bigint) of every group of rows with equal keys.

    The votes of a group are 32 sums of two packed counters each, added up
    where the rows are read; one row for each group and task is shuffled.
    """
    sums = [
        F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(PAIR_MASK)) * F.col("w")).alias(f"v{k}") for k in range(HALF)]
    added = terms(rows, keys, text).groupBy(*keys).agg(F.sum("w").alias("total"), *sums)
    low = F.lit((1 << HALF) - 1)
    mark = F.lit(0).cast("long")
    for k in range(HALF):
        for votes_for, bit in ((F.col(f"v{k}").bitwiseAND(low), k), (F.shiftright(f"v{k}", HALF), k + HALF)):
            mark = mark.bitwiseOR(F.when(votes_for * 2 > F.col("total"), F.lit(_signed(1 << bit))).otherwise(F.lit(0)))
    return added.select(*keys, mark.alias("fingerprint"))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def blocks(n: int = TABLES) -> list[tuple[int, int]]:
    """First bit and number of bits of each block."""
    edges = [BITS * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def flips(bits: int, most: int) -> list[int]:
    """All values with at most ``most`` of the lowest ``bits`` bits set."""
    return [sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(range(bits), k)]


def near(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, query, distance): all pairs within ``radius`` bits, with the other columns of ``queries``.

    ``prints`` and ``queries`` hold distinct values (columns ``fingerprint`` and
    ``query``). A pair is kept only in the first table that it meets in, so no
    pairs are made distinct later.
    """
    more = [c for c in queries.columns if c != "query"]
    most = radius // TABLES
    cut = blocks()

    def block(c: Column, k: int) -> Column:
        first, bits = cut[k]
        return F.shiftrightunsigned(c, first).bitwiseAND(F.lit((1 << bits) - 1))

    def tables(df: DataFrame, values) -> DataFrame:
        cells = F.flatten(F.array(*[values(k) for k in range(TABLES)]))
        return df.select(*df.columns, F.inline(cells).alias("t", "block"))

    def cell(k: int, value: Column) -> Column:
        return F.struct(F.lit(k).alias("t"), value.alias("block"))

    def probed(k: int) -> Column:
        own = block(F.col("query"), k)
        return F.transform(F.lit(flips(cut[k][1], most)), lambda flip: cell(k, own.bitwiseXOR(flip.cast("long"))))

    held = tables(prints.select("fingerprint"), lambda k: F.array(cell(k, block(F.col("fingerprint"), k))))
    probes = tables(queries, probed)
    xor = F.col("fingerprint").bitwiseXOR(F.col("query"))
    first = F.coalesce(*[F.when(F.bit_count(block(xor, k)) <= most, F.lit(k)) for k in range(TABLES)])
    met = held.join(probes.hint("merge"), ["t", "block"])  # probes are many for each query: Spark would take them for few
    return met.filter((F.bit_count(xor) <= radius) & (first == F.col("t"))).select(
        "fingerprint", "query", F.bit_count(xor).alias("distance"), *more)


def following(rows: DataFrame, key: str) -> DataFrame:
    """(key, next): the next smaller key, after the smallest the largest. Null keys are left out.

    Keys are range-partitioned once and written; neighbours inside a partition
    come from a window over its keys, and the partitions' edges are one row each.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = cut_lineage(
        rows.select(F.col(key).alias("k")).dropna().distinct()
        .repartitionByRange(parts, F.col("k").desc()).withColumn("part", F.spark_partition_id()))
    order = Window.orderBy("part")
    edge = ids.groupBy("part").agg(F.max("k").alias("top")).select(
        "part", F.lead("top").over(order).alias("below"), F.first("top").over(order).alias("start"))
    inside = Window.partitionBy("part").orderBy(F.col("k").desc())
    return ids.select("part", "k", F.lead("k").over(inside).alias("n")).join(F.broadcast(edge), "part").select(
        F.col("k").alias(key), F.coalesce("n", "below", "start").alias("next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited versions.

    The edited text is the text with its last third replaced by as many
    characters from the start of the next document. Of several texts under the
    next id the smallest beginning counts; a null id has no next document. The
    texts are shuffled once by id: that exchange serves the rows that give
    their beginning away as well as the rows that receive one.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = base.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    order = following(base, "doc_id")
    needs = order.join(sizes, "doc_id").select(
        F.col("next").alias("doc_id"), F.col("doc_id").alias("asker"), F.floor(F.col("n") / 3).cast("int").alias("need"))
    heads = base.join(needs, "doc_id").groupBy(F.col("asker").alias("doc_id")).agg(
        F.min(F.expr("left(text, need)")).alias("head"))
    tail = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(
        F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"),
        F.coalesce(F.substring("head", F.lit(1), tail), F.lit("")))
    # Both joins are inner ones over the same exchange; rows without an id are few or none and need no shuffle.
    with_head = base.join(heads, "doc_id").select("doc_id", "text", "head").unionByName(
        base.filter(F.col("doc_id").isNull()).withColumn("head", F.lit("")))
    both = with_head.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("text_hash"),
        "text", edited.alias("edited"))
    keys = ["doc_id", "n_chars", "text_hash", "edited_hash"]
    sides = F.explode(F.array(
        F.struct(F.lit(False).alias("is_edited"), F.col("text")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text"))))
    each = votes(
        both.select("doc_id", "n_chars", "text_hash", F.unhex(F.sha2("edited", 256)).alias("edited_hash"), sides.alias("s"))
        .select(*keys, "s.is_edited", "s.text"),
        [*keys, "is_edited"], F.col("text"))
    one = cut_lineage(each.groupBy(*keys).agg(
        F.max(F.when(~F.col("is_edited"), F.col("fingerprint"))).alias("print"),
        F.max(F.when(F.col("is_edited"), F.col("fingerprint"))).alias("edited_print")))
    # Of repeated ids the row that gives the beginning is not known here; the smallest print stands for the id.
    nexts = order.join(
        one.groupBy(F.col("doc_id").alias("next")).agg(F.min("print").alias("next_print")), "next").drop("next")
    return one.join(nexts, "doc_id", "left").select(
        "doc_id", "n_chars", F.lower(F.hex("edited_hash")).alias("edited_sha256"),
        F.col("print"), "edited_print", likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.coalesce("next_print", F.lit(0))).alias("near_next"))


def with_near_queries(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds ``near_queries`` and ``nearest_query``: how many of the query rows
    (ids divisible by 100) lie within ``radius`` bits, itself included, and the
    smallest such id. Equal fingerprints are searched once."""
    asked = prints.filter(F.col("doc_id") % 100 == 0).groupBy(F.col("print").alias("query")).agg(
        F.count("*").alias("n"), F.min("doc_id").alias("q"))
    known = prints.select(F.col("print").alias("fingerprint")).distinct()
    found = near(known, asked, radius).groupBy(F.col("fingerprint").alias("print")).agg(
        F.sum("n").alias("near_queries"), F.min("q").alias("nearest_query"))
    return prints.join(found, "print", "left").fillna(0, ["near_queries"])
