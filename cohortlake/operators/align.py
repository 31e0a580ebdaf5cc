"""Alignment: rows by identifier, the first row of each, and inner joins of several owners' tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.policy import Refused
from . import ranges


def valid_id(x: Column) -> Column:
    return x.isNotNull() & (F.trim(x.cast("string")) != "")


def select_rows(df: DataFrame, id_col: str, order: list[str], missing: str = "id_only") -> DataFrame:
    """The first row of every valid identifier by ``order``; with ``complete_cases`` of the rows without nulls.

    The first row is an aggregate (``min`` of a struct), not a window, so rows
    are combined before the exchange and no identifier is sorted.
    """
    d = df.where(valid_id(F.col(id_col)))
    if missing == "complete_cases":
        d = d.dropna()
    rest = [c for c in df.columns if c not in (id_col, *order)]
    first = d.groupBy(id_col).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return first.select(*[F.col(c) if c == id_col else F.col(f"_r.{c}").alias(c) for c in df.columns])


def analysis_rows(df: DataFrame, id_col: str, na_action: str = "na.omit") -> DataFrame:
    """Rows for an analysis: without nulls, all or refused if there are nulls, or with valid identifiers; identifiers must be unique."""
    if na_action == "na.omit":
        d = df.dropna()
    elif na_action == "none":
        d = df
    elif na_action == "na.fail":
        if not df.subtract(df.dropna()).isEmpty():
            raise Refused("values are missing")
        d = df
    else:
        raise ValueError(na_action)
    d = d.where(valid_id(F.col(id_col)))
    if not d.groupBy(id_col).count().where("count > 1").isEmpty():
        raise Refused("identifiers repeat")
    return d


def matched_ids(tables: list[DataFrame], ids: list[str]) -> DataFrame:
    """Identifiers that all tables have, as ``id``: each table is reduced to distinct ids before it is exchanged."""
    keys = [t.where(valid_id(F.col(c))).select(F.col(c).alias("id")).distinct() for t, c in zip(tables, ids, strict=True)]
    out = keys[0]
    for k in keys[1:]:
        out = out.join(k, "id", "left_semi")
    return out


def align(tables: list[DataFrame], ids: list[str], orders: list[list[str]], names: list[str], missing: str = "id_only") -> DataFrame:
    """One row for each identifier that all tables have: the first row of each table, columns prefixed by its name."""
    parts = []
    for t, c, o, n in zip(tables, ids, orders, names, strict=True):
        rows = select_rows(t, c, o, missing)
        parts.append(rows.select(F.col(c).alias("id"), *[F.col(x).alias(f"{n}_{x}") for x in t.columns if x != c]))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "id")
    return out


def row_positions(df: DataFrame, order: list[str], name: str = "row_pos", parts: int = 200) -> DataFrame:
    """Number rows from 0 in ``order``: ranges are sorted apart and start where the range before ends."""
    return ranges.numbered(df, order, name, parts)


def align_to(reference: DataFrame, id_col: str, order: list[str], others: dict[str, tuple[DataFrame, str, list[str]]], name: str = "reference", missing: str = "id_only", parts: int = 200) -> DataFrame:
    """:func:`align` with ``row_pos``: the rows of the reference table in its own order, numbered from 0 over the matched ones.

    Every other table gives one row for each identifier; if one gave more, the
    query would fail (``one row for each identifier``).
    """
    tables, ids, orders = [reference], [id_col], [order]
    for table, own_id, own_order in others.values():
        tables.append(table)
        ids.append(own_id)
        orders.append(own_order)
    joined = align(tables, ids, orders, [name, *others], missing)
    return row_positions(joined, [f"{name}_{c}" for c in order if c != id_col] + ["id"], parts=parts)


def manifest(aligned: DataFrame, id_col: str = "id", position: str = "row_pos", key: str = "") -> DataFrame:
    """One row that binds the aligned rows and their order: ``n_rows``, and ``order_hash`` of all (position, identifier).

    A sum of keyed hashes, so rows combine before the exchange, in whole
    numbers of 128 bits; a lost, added or moved row changes it.
    """
    h = F.sha2(F.concat_ws("|", F.lit(key), F.col(position).cast("string"), F.octet_length(F.col(id_col).cast("string")).cast("string"), F.col(id_col).cast("string")), 256)
    low, high = (F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(38,0)") for a in (1, 13))
    got = aligned.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(low), F.lit(0)).alias("a"), F.coalesce(F.sum(high), F.lit(0)).alias("b"), F.coalesce(F.max(position), F.lit(-1)).alias("last"))
    return got.select("n_rows", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"), F.col("last").cast("string")).alias("order_hash"))


def check_manifest(aligned: DataFrame, expected: DataFrame, id_col: str = "id", position: str = "row_pos", key: str = "") -> None:
    """Refuse an aligned table that lost, gained or moved rows since its manifest."""
    if manifest(aligned, id_col, position, key).first() != expected.select("n_rows", "order_hash").first():
        raise Refused("the aligned table has changed")


def check_consistent(left: DataFrame, right: DataFrame, key: str = "") -> None:
    """Refuse two owners' aligned tables that are not of one alignment."""
    check_manifest(left, manifest(right, key=key), key=key)


@dataclass(frozen=True)
class Offer:
    """What a peer declares before an alignment."""

    peer: str
    rows: int


def contract(offers: list[Offer]) -> tuple[str, int]:
    """The reference peer (the first by name) and the capacity (the most rows any peer offers)."""
    if not offers or len({o.peer for o in offers}) != len(offers) or any(o.rows < 0 for o in offers):
        raise ValueError("offers must be of different peers, with rows from 0")
    return min(o.peer for o in offers), max(o.rows for o in offers)


def shuffled(df: DataFrame, id_col: str, seed: str, name: str = "row_pos", parts: int = 200) -> DataFrame:
    """Rows numbered in the order of a keyed hash of their identifier: a permutation that anyone with the key can repeat."""
    d = df.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")), 256))
    return ranges.numbered(d, ["_h", id_col], name, parts).drop("_h")


def packed_selection(rows: DataFrame, capacity: int, position: str = "row_pos") -> DataFrame:
    """Positions as one bit vector of fixed length ``capacity`` (binary, the first position in the lowest bit): ``bits, n_set``.

    Its size is that of the capacity, whatever is selected; bytes are summed
    from at most eight positions each, then put in order by chunks of 4,096.
    """
    n_bytes = -(-capacity // 8)
    d = rows.select(F.col(position).cast("long").alias("p")).distinct()
    chunks = d.groupBy(F.floor(F.col("p") / 8).alias("at")).agg(F.sum(F.pow(F.lit(2), F.col("p") % 8)).cast("int").alias("byte"), F.count(F.lit(1)).alias("n"))
    spark = rows.sparkSession
    whole = spark.range(n_bytes).withColumnRenamed("id", "at").join(chunks, "at", "left")
    lines = whole.groupBy(F.floor(F.col("at") / 4096).alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.lpad(F.hex(F.coalesce("byte", F.lit(0))), 2, "0").alias("h")))), lambda x: x.h), "").alias("h"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return lines.agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "h"))), lambda x: x.h), "")).alias("bits"), F.sum("n").alias("n_set"))


def gather(df: DataFrame, order: DataFrame, position: str = "row_pos") -> DataFrame:
    """Rows at the positions of ``order`` (``target, source``), as column ``target``."""
    return order.join(df.withColumnRenamed(position, "source"), "source").drop("source")
