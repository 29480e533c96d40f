"""Quality filters, label codes and stratified splits.

The draw needs no shuffle of whole rows. Every row gets a hash of its key; inside each
stratum the rows with the smallest hashes go to the first split, the next ones to the
second. Keys and strata are written as a narrow table. Hashes are even, so the place of the
hash that ends a split is known up to a few times the root of the split's size: one aggregate
per stratum counts the hashes below that stretch and keeps the ones in it, both combined before
the shuffle, and the end is read from the kept ones. The last pass compares every row's hash
with the ends of its stratum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qagrade.functions import vocab as V
from qagrade.operators.index import row_index
from qagrade.sources.scratch import pin, scoped, unpin

#: Hash digits that tell a row's place among those of its stratum.
_DIGITS = 13
#: Half a stretch in roots of the rank looked for; 8 are missed once in 10^15 draws.
_ROOTS = 8.0


def has_context() -> Column:
    return F.col("context").isNotNull()


def has_min_context(min_len: int = V.MIN_CONTEXT_CHARS) -> Column:
    """Context longer than ``min_len`` code points."""
    return F.length("context") > min_len


def has_relevance() -> Column:
    return F.col("relevance").isNotNull()


def has_answer() -> Column:
    """An answer is there; an empty one passes."""
    return F.col("answer").isNotNull()


def quality_filter(df: DataFrame, min_len: int = V.MIN_CONTEXT_CHARS) -> DataFrame:
    return df.filter(has_context() & has_min_context(min_len) & has_relevance() & has_answer())


def class_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """The distinct labels of ``col`` with their codes 0..k-1 in sorted order, stored."""
    return pin(row_index(df.select(col).filter(F.col(col).isNotNull()).distinct(), [col], out), "class-codes")


@scoped
def class_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Code the labels of ``col`` as 0..k-1 in sorted order; NULL stays NULL.

    The codes are a stored table, whatever their number, and are joined by their size: names
    are read from :func:`class_codes`. Columns keep their order, ``out`` comes last.
    """
    columns = [c for c in df.columns if c != out]
    return df.select(*columns).join(class_codes(df, col, out), col, "left").select(*columns, out)


def stratum_quota(
    counts: DataFrame, total: int | Column, stratum: str = "relevance", n: str = "n", out: str = "quota"
) -> DataFrame:
    """Split ``total`` rows over the strata in proportion to their sizes ``n``.

    Largest remainder in whole numbers: everyone gets the rounded-down share, what is left
    goes to the largest remainders, equal ones in label order. ``counts`` has one row per
    class; these rows, and no others, are ranked in one place.
    """
    total = F.lit(total).cast("decimal(18,0)") if isinstance(total, int) else total.cast("decimal(18,0)")
    every = Window.partitionBy()
    counts = counts.drop(out)
    shared = counts.withColumns({"_wanted": F.col(n).cast("decimal(19,0)") * total, "_whole": F.sum(F.col(n).cast("decimal(19,0)")).over(every)})
    shared = shared.withColumn("_whole", F.nullif(F.col("_whole"), F.lit(0)).cast("decimal(19,0)"))
    shared = shared.withColumns({"_share": F.expr("CAST(_wanted div _whole AS BIGINT)"), "_rest": F.expr("_wanted % _whole")})
    spare = total - F.sum("_share").over(every)
    place = F.row_number().over(Window.orderBy(F.col("_rest").desc(), F.col(stratum)))
    quota = F.col("_share") + F.when(place <= spare, 1).otherwise(0)
    return shared.select(*counts.columns, F.coalesce(quota, F.lit(0)).cast("bigint").alias(out))


def _draw_key(key: str, seed: int) -> Column:
    """What orders the rows of a stratum: a hash of seed and key, then the key."""
    return F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("hash"), F.col(key).alias("key"))


def _quotas(strata: DataFrame, stratum: str, sizes: Mapping[str, int], n: str) -> DataFrame:
    """Add to each stratum the rank at which each split ends, as ``_end_<name>``; later splits draw
    from what earlier ones leave."""
    end, columns = F.lit(0).cast("bigint"), strata.columns
    rows = strata.withColumn("_left", F.col(n))
    for name, size in sizes.items():
        rows = stratum_quota(rows, size, stratum, "_left", "_quota")
        rows = rows.withColumn(f"_end_{name}", end + F.col("_quota")).withColumn("_left", F.col("_left") - F.col("_quota"))
        end = F.col(f"_end_{name}")
    return rows.select(*columns, *[f"_end_{name}" for name in sizes])


def _ends(rows: DataFrame, stratum: str, names: Sequence[str], key: str, seed: int, n: str, roots: float) -> DataFrame:
    """One row per stratum with, per split, the draw key of its last row, as ``_last_<name>``.

    ``rows`` has the key, the stratum, its size ``n`` and the ends of its splits. The hash of rank
    ``end`` lies near the share ``end / n`` of all hashes; those within ``roots`` roots are kept.
    An end that is not among them is NULL although it is not 0: the caller looks further.
    """
    draw = _draw_key(key, seed)
    place = F.conv(F.left(draw["hash"], F.lit(_DIGITS)), 16, 10).cast("bigint") / F.lit(float(16**_DIGITS))
    rows = rows.withColumns({"_draw": draw, "_place": place})
    found, last = [], []
    for name in names:
        end, n_rows = F.col(f"_end_{name}"), F.col(n)
        width = F.lit(roots) * (F.sqrt(end) + F.lit(roots))
        low, high = (end - width) / n_rows, (end + width) / n_rows
        near = F.col("_place").between(low, high) & (end > 0)
        found.append(F.count_if((F.col("_place") < low) & (end > 0)).alias(f"_below_{name}"))
        found.append(F.array_sort(F.collect_list(F.when(near, F.col("_draw")))).alias(f"_near_{name}"))
        # positions before the kept ones give NULL, as those behind them do
        at = (F.col(f"_end_{name}") - F.col(f"_below_{name}") - 1).cast("int")
        last.append(F.when(at >= 0, F.get(F.col(f"_near_{name}"), at)).alias(f"_last_{name}"))
    kept = [n, *[f"_end_{name}" for name in names]]
    rows = rows.groupBy(stratum).agg(*[F.first(c).alias(c) for c in kept], *found)
    return rows.select(stratum, *kept, *last)


def _missed(names: Sequence[str]) -> Column:
    return sum((((F.col(f"_end_{x}") > 0) & F.col(f"_last_{x}").isNull()).cast("int") for x in names), F.lit(0))


def _checked(ends: DataFrame, total: int, n: str) -> None:
    """An error when there are too few rows for the draw or a class has a single one."""
    rows, least = ends.agg(F.sum(n), F.min(F.when(F.col(n) > 0, F.col(n)))).first()
    if (rows or 0) < total:
        raise ValueError(f"cannot draw {total} rows from {rows or 0}")
    if least is not None and least < 2:
        raise ValueError("a stratum has fewer than 2 rows")


def _split_ends(
    df: DataFrame, key: str, stratum: str, sizes: Mapping[str, int], seed: int, halves: tuple[str, Mapping[str, int], int] | None = None
) -> DataFrame:
    """One row per stratum with the last draw key of each split, stored.

    ``halves`` names a split that is drawn again, into which sizes and by which seed. Its strata
    are as large as the first draw makes them, so they need no count of their own.
    """
    rows = df.select(key, stratum).filter(F.col(stratum).isNotNull())
    keys = pin(rows, "draw-keys")
    roots = _ROOTS
    while True:
        quotas = _quotas(keys.groupBy(stratum).agg(F.count("*").alias("n")), stratum, sizes, "n")
        # strata are joined by their size: one row per class
        ends = pin(_ends(keys.join(quotas, stratum), stratum, list(sizes), key, seed, "n", roots), "split-ends")
        if roots == _ROOTS:
            _checked(ends, sum(sizes.values()), "n")
        names = list(sizes)
        if halves:
            again, parts, next_seed = halves
            first, names = ends, [*sizes, *parts]
            # ranks of the split begin where those of the splits before it end
            before = F.lit(0).cast("bigint") if names[0] == again else F.col(f"_end_{names[names.index(again) - 1]}")
            strata = _quotas(first.withColumn("_m", F.col(f"_end_{again}") - before), stratum, parts, "_m")
            held = _placed(keys.join(strata, stratum), key, list(sizes), seed, "_first").filter(F.col("_first") == again)
            second = _ends(held, stratum, list(parts), key, next_seed, "_m", roots)
            ends = pin(first.join(second.withColumnRenamed(stratum, "_stratum"), F.col(stratum) == F.col("_stratum"), "left").drop("_stratum"), "split-ends")
            unpin(first)
        misses = ends.agg(F.sum(_missed(names)), F.min(F.when(F.col("_m") > 0, F.col("_m"))) if halves else F.lit(None)).first()
        if halves and misses[1] is not None and misses[1] < 2:
            raise ValueError("a stratum has fewer than 2 rows")
        if not misses[0]:
            return ends.select(stratum, *[c for c in ends.columns if c.startswith(("_end_", "_last_"))])
        unpin(ends)
        roots *= 8  # beyond the root of a stratum's size all its hashes are kept


def _placed(df: DataFrame, key: str, names: Sequence[str], seed: int, out: str) -> DataFrame:
    """Add to ``df`` the split each row falls in by the ends of a draw, which stand in its row."""
    split = F.lit(None).cast("string")
    for name in reversed(names):
        split = F.when(_draw_key(key, seed) <= F.col(f"_last_{name}"), name).otherwise(split)
    return df.withColumn(out, split)


def _joined(df: DataFrame, ends: DataFrame, stratum: str, out: str) -> DataFrame:
    """Rows with the ends of their stratum.

    The ends are a pinned table of one row per class: Spark broadcasts it when its size
    allows, and otherwise shuffles two plain inputs, of which it splits hot partitions.
    """
    return df.drop(out).join(ends, stratum)


@scoped
def stratified_split(
    df: DataFrame, key: str, stratum: str, sizes: Mapping[str, int], seed: int = 0, out: str = "split"
) -> DataFrame:
    """Draw disjoint splits of the given sizes, each in proportion to the strata.

    ``sizes`` maps split names to row counts, in the order in which they are drawn; quotas
    follow :func:`stratum_quota`, those of a later split on what the earlier ones left. The
    result has the drawn rows only, with the split name in ``out``. ``key`` is unique; the
    same seed draws the same rows whatever the partitioning. Rows without a stratum are
    not drawn.
    """
    ends = _split_ends(df, key, stratum, sizes, seed)
    placed = _placed(_joined(df, ends, stratum, out), key, list(sizes), seed, out)
    return placed.filter(F.col(out).isNotNull()).select(*[c for c in df.columns if c != out], out)


@scoped
def split_holdout(
    drawn: DataFrame,
    key: str,
    stratum: str,
    sizes: Mapping[str, int],
    seed: int = 1,
    heldout: str = "heldout",
    out: str = "split",
) -> DataFrame:
    """Split the held-out rows of a first draw again, with another seed.

    Rows of the other splits keep their split; nothing is united.
    """
    ends = _split_ends(drawn.filter(F.col(out) == heldout), key, stratum, sizes, seed)
    second = _placed(drawn.join(ends, stratum, "left"), key, list(sizes), seed, "_second")
    split = F.when(F.col(out) == heldout, F.col("_second")).otherwise(F.col(out))
    return second.withColumn(out, split).filter(F.col(out).isNotNull()).select(drawn.columns)


@scoped
def assemble_splits(
    df: DataFrame,
    key: str,
    stratum: str = "relevance",
    train: int = V.TRAIN_ROWS,
    heldout: int = V.HELDOUT_ROWS,
    seed: int = 0,
) -> DataFrame:
    """One table of the splits train, test and validation; the last two halve the held-out rows.

    The draw is stratified on ``stratum`` itself, whose sorted order is that of its codes. Both
    draws work on stored keys and strata and end up in one row per class, so the texts are read
    once, by the last pass, and are not moved.
    """
    sizes = {"train": train, "heldout": heldout}
    halves = {"test": heldout - heldout // 2, "validation": heldout // 2}
    ends = _split_ends(df, key, stratum, sizes, seed, ("heldout", halves, seed + 1))
    rows = _joined(df, ends, stratum, "split")
    rows = _placed(rows, key, list(sizes), seed, "_first")
    rows = _placed(rows, key, list(halves), seed + 1, "_second")
    split = F.when(F.col("_first") == "heldout", F.col("_second")).otherwise(F.col("_first"))
    rows = rows.withColumn("split", split).filter(F.col("split").isNotNull())
    return rows.select(*[c for c in df.columns if c != "split"], "split")


def split_overlap(df: DataFrame, content: Sequence[str] = ("instruction", "context")) -> DataFrame:
    """Contents that stand in more than one split: their hash, rows, and the splits in order.

    Hashes of the content are combined before the shuffle, so texts are not moved.
    """
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in content]
    hashed = df.select(F.md5(F.concat_ws("|", *parts)).alias("content"), "split")
    splits = F.concat_ws(",", F.array_sort(F.collect_set("split")))
    found = hashed.groupBy("content").agg(F.count("*").alias("n"), splits.alias("splits"))
    return found.filter(F.col("splits").contains(","))


def split_balance(df: DataFrame, stratum: str = "relevance") -> DataFrame:
    """Rows per split and stratum and the stratum's share of the split."""
    counts = df.groupBy("split", stratum).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("split"))
    return counts.withColumn("share", F.col("n") / whole)
