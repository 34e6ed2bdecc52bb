"""Tables with a whole panel of traces in each row: a catalog of what they hold, and the frames of one row.

A row is known by (Fish, Trace, fluo_type); fluo_type is compared without case. Lookups filter by Fish and Trace, which reach the Parquet scan, so
only row groups that can hold the row are read, and only the nested column is unnested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of such a table.
KEY = ("Fish", "Trace", "fluo_type")
REQUIRED = (*KEY, "fluo", "n_cells")


def _checked(table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    if missing := [c for c in columns if c not in table.columns]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return table


def nested_catalog(table: DataFrame) -> DataFrame:
    """Fish, Trace, modality (fluo_type in lower case) and n_cells of each panel, once each, in order; of several n_cells of a panel the smallest."""
    rows = _checked(table, REQUIRED).select("Fish", "Trace", F.lower("fluo_type").alias("modality"), "n_cells")
    return rows.groupBy("Fish", "Trace", "modality").agg(F.min("n_cells").alias("n_cells")).orderBy("Fish", "Trace", "modality")


def _is(fish: object, trace: object, modality: str) -> Column:
    return (F.col("Fish") == F.lit(fish)) & (F.col("Trace") == F.lit(trace)) & (F.lower("fluo_type") == modality.lower())


def nested_frames(table: DataFrame, fish: object, trace: object, modality: str) -> DataFrame:
    """time_index and x of one row's fluo (an array for each cell of its values in time). Several rows of a key: the one with the smallest hash of its
    traces. A key that the table lacks raises with those that it has.
    """
    row = _checked(table, (*KEY, "fluo")).filter(_is(fish, trace, modality)).select("fluo")
    row = row.orderBy(F.xxhash64("fluo")).limit(1)
    if row.isEmpty():
        known = [f"({r['Fish']}, {r['Trace']}, {r['m']})" for r in table.select("Fish", "Trace", F.lower("fluo_type").alias("m")).distinct().orderBy("Fish", "Trace", "m").limit(50).collect()]
        raise KeyError(f"no row of ({fish}, {trace}, {modality.lower()}); there are {', '.join(known) or 'none'}")
    # cells may not differ in length: zipping would fill the shorter with nulls
    same = F.size(F.array_distinct(F.transform("fluo", lambda c: F.size(c)))) <= 1
    sound = row.select(F.when(same, F.col("fluo")).otherwise(F.raise_error(F.lit("cells of one row differ in length"))).alias("fluo"))
    times = F.posexplode(F.sequence(F.lit(0), F.size(F.get("fluo", F.lit(0))) - 1)).alias("time_index", "_t")
    return sound.filter(F.size(F.get("fluo", F.lit(0))) > 0).select("fluo", times).select("time_index", F.transform("fluo", lambda c: F.get(c, F.col("_t")).cast("double")).alias("x"))


def split_point(table: DataFrame, fish: object, trace: object, column: str = "mid") -> int:
    """The cell at which one side of the panel ends; raises where it is missing or differs between the panel's rows."""
    found = _checked(table, ("Fish", "Trace", column)).filter((F.col("Fish") == F.lit(fish)) & (F.col("Trace") == F.lit(trace)) & F.col(column).isNotNull()).select(F.col(column).cast("int").alias("m")).distinct().limit(2).collect()
    if len(found) != 1:
        raise KeyError(f"{'several values of' if found else 'no'} {column} for ({fish}, {trace})")
    return found[0]["m"]
