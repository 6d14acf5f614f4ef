"""Shards along a Hilbert curve over several metadata dimensions, so that files can be pruned by any of them.

Columns only: no Python runs on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import only, written

SHARDS, BITS = 24, 5
# Rows of a cell that are ranked together; a cell with more is ranked in parts.
PART_ROWS = 1024


def size_class(size: Column, bits: int = BITS) -> Column:
    """Sizes on a logarithmic scale, four classes per factor of ten."""
    return F.least(F.floor(F.log10(F.greatest(size, F.lit(1))) * 4), F.lit((1 << bits) - 1)).cast("int")


def name_class(name: Column, bits: int = BITS) -> Column:
    """Names by hash: rows of one name share a class, so a file can be skipped for a name it does not hold. Null is 0."""
    return F.coalesce(F.pmod(F.xxhash64(name), F.lit(1 << bits)).cast("int"), F.lit(0))


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Place of a cell along the Hilbert curve through a grid of ``2**bits`` cells per axis.

    Axes become the curve's transposed digits by undoing its reflections and exchanges from the top bit down, then by a
    Gray code; the digits' bits, interleaved, are the place.
    """
    n = len(axes)

    def put(x: Column, at: int | Column, value: Column) -> Column:
        return F.transform(x, lambda v, k: F.when(k == at, value).otherwise(v))

    def turn(x: Column, step: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), F.lit(bits - 1) - F.floor(step / n).cast("int"))
        k = (step % n).cast("int")
        first, own, low = F.get(x, F.lit(0)), F.get(x, k), bit - 1
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        inverted = put(x, 0, first.bitwiseXOR(low))
        exchanged = F.transform(x, lambda v, j: F.when(((j == 0) | (j == k)) & (k != 0), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(own.bitwiseAND(bit) != 0, inverted).otherwise(exchanged)

    start = F.array(*(a.cast("int") for a in axes))
    turned = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * n - 1)), start, turn) if bits > 1 else start

    def gray(x: Column, k: Column) -> Column:
        return put(x, k, F.get(x, k).bitwiseXOR(F.get(x, k - 1)))

    coded = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), turned, gray) if n > 1 else turned

    def flips(t: Column, q: Column, last: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), q)
        return F.when(last.bitwiseAND(bit) != 0, t.bitwiseXOR(bit - 1)).otherwise(t)

    def finish(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        t = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)), F.lit(0), lambda t, q: flips(t, q, last)) if bits > 1 else F.lit(0)
        return F.transform(x, lambda v: v.bitwiseXOR(t))

    digits = F.element_at(F.transform(F.array(coded), finish), 1)

    def weave(place: Column, step: Column) -> Column:
        shift = F.lit(bits - 1) - F.floor(step / n).cast("int")
        bit = F.call_function("shiftright", F.get(digits_of(place), (step % n).cast("int")), shift).bitwiseAND(F.lit(1))
        return F.struct(digits_of(place).alias("digits"), (place["at"] * 2 + bit).alias("at"))

    def digits_of(acc: Column) -> Column:
        return acc["digits"]

    begin = F.struct(digits.alias("digits"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits * n - 1)), begin, weave, lambda acc: acc["at"])


def curve_order(df: DataFrame, axes: list[Column], order: list[str], total: int, bits: int = BITS, copies: str | None = None) -> DataFrame:
    """Add ``cell``, the place on the curve, and ``place``, the exact rank of a row by cell, then by the hash and the values of
    ``order``.

    Rows are ranked within parts of cells; a part's first rank is the number of rows before it. Only the counts of parts
    meet: those of one cell in one task, and one count per cell in the last. With ``copies``, a column that says how many rows share
    the first column of ``order``, such rows lie side by side, and a group larger than a part is ranked in parts of its own.
    """
    parts = max(1, -(-total // PART_ROWS))
    cut = df.withColumn("cell", hilbert_index(axes, bits)).withColumn("__part", F.pmod(F.xxhash64(*(order[:1] if copies else order)), F.lit(parts)))
    large = F.col(copies) > PART_ROWS if copies else F.lit(False)
    cut = cut.withColumns({
        "__group": F.when(large, F.xxhash64(order[0])).otherwise(F.lit(0)),
        "__piece": F.when(large, F.pmod(F.xxhash64(*order), F.ceil(F.col(copies) / PART_ROWS) if copies else F.lit(1))).otherwise(F.lit(0)).cast("long"),
    })
    inside = ["__part", "__group", "__piece"]
    keys = ["cell", *inside]
    counts = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("cell").orderBy(*inside).rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("__inner", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy("cell").agg(F.sum("__n").alias("__size"))
    cells = cells.select("cell", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__outer"))
    first = within.join(cells, "cell").select(*keys, (F.col("__inner") + F.col("__outer")).alias("__first"))
    ranked = cut.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.join(first, keys).withColumn("place", F.col("__first") + F.col("__rank") - 1).drop(*inside, "__rank", "__first")


def cut_runs(df: DataFrame, total: int, shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` and ``slot``: runs of the curve whose row counts differ by one at most, the larger ones first."""
    size, larger = divmod(total, shards)
    split = larger * (size + 1)
    place, one = F.col("place"), F.lit(max(1, size))
    head = place < split
    shard = F.when(head, F.floor(place / F.lit(size + 1))).otherwise(F.floor((place - split) / one) + larger)
    slot = F.when(head, place % (size + 1)).otherwise((place - split) % one)
    return df.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")})


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = ("source", "lang"), shards: int = SHARDS, bits: int = BITS
) -> DataFrame:
    """Shard and slot of every document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, cell``.

    The curve runs over the classes of the columns ``names`` and of the size, so a shard holds few names and sizes and
    its files' minima and maxima rule it out for others. Law ``rows``: shards are runs of the curve with row counts at
    most one apart, whatever the skew; a hot name fills several shards. Equal texts take the least of their names for their
    cell and lie side by side on the curve, so a group of them is in one shard unless a run ends within it. Texts are read once, for
    size and checksums, which are written; they do not travel.

    A null text has no bytes and the checksum of an empty one, and counts as one; nulls in ``names`` are a class of their own;
    repeated rows get a slot each; an empty table gives an empty result; other columns are not carried along.
    """
    own = {f"__name{k}": f"{c}:string" for k, c in enumerate(names)}
    text = F.coalesce(F.col("text"), F.lit(""))
    read = only(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string", **own).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).cast("long").alias("text_crc32"),
        F.unhex(F.md5(text)).alias("text_key"), *own,
    )
    rows = written(read, "shard-rows")
    total = rows.count()
    # Of a group the least name that is not null, so that rows of one text agree.
    least = [F.min(c).alias(f"{c}_least") for c in own]
    groups = rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), *least).filter("copies > 1")
    rows = rows.join(groups, "text_key", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    agreed = [F.when(F.col("copies") > 1, F.col(f"{c}_least")).otherwise(F.col(c)) for c in own]
    axes = [*(name_class(c, bits) for c in agreed), size_class(F.col("size"), bits)]
    placed = curve_order(rows, axes, ["text_key", "doc_id", "size", "text_crc32"], total, bits, "copies")
    return cut_runs(placed, total, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell"
    )


def write_shards(
    docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 100_000
) -> None:
    """Write documents as shards, sorted by slot in files of bounded size: ``path/shard=n/part-*``.

    ``placed`` comes from :func:`shard_documents` over the same documents. Rows meet by id, size and checksum; rows that have
    all of them in common, or no id, are paired off one to one, so every row is written once. A column ``shard`` of the input
    gives way to the folder's.
    """
    files = max(1, -(-placed.count() // rows_per_file))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.struct(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).cast("long").alias("crc")
    )
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"]
    rows = docs.select(F.struct(*kept).alias("row"), key.alias("key"))
    spots = placed.select(F.struct("doc_id", "size", F.col("text_crc32").alias("crc")).alias("key"), "shard", "slot")

    def numbered(df: DataFrame, by: Column) -> DataFrame:
        return df.withColumn("no", F.row_number().over(Window.partitionBy("key").orderBy(by)))

    left, right = numbered(rows, F.xxhash64("row")), numbered(spots, F.col("slot") + F.col("shard") * F.lit(1 << 40))
    met = left.join(right, (left["key"].eqNullSafe(right["key"])) & (left["no"] == right["no"])).select("row", "shard", "slot")
    ordered = met.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select("row.*", "shard").write.partitionBy("shard").mode("overwrite").parquet(path)
