"""Shards by a weighted hash tree: region, then rack, then shard.

At each level a row goes to the child with the largest draw, ln(u) / weight with u a hash of the row's key and the child's
name, so children get rows in proportion to their weights. A change of weights in one subtree changes only the draws on the way to
it: rows move into or out of that subtree, and nothing moves between others. A new shard joins as a region of its own,
so every row that moves goes to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots are counted in parts of a shard, so that no task numbers a whole shard.
PARTS = 512


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def topology(shards: int, base: int, per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """``base`` shards in racks and regions of the given sizes; each further one is a region of its own."""
    return [
        Shard(f"region{k // (per_rack * racks)}", f"rack{k // per_rack}", k) if k < base else Shard(f"added{k}", f"added{k}", k)
        for k in range(shards)
    ]


def _draw(key: Column, name: str, weight: float) -> Column:
    """Larger is better; u lies strictly between 0 and 1."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double") + 0.5) / float(2**53)
    return F.log(u) / F.lit(float(weight))


def _pick(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the largest draw; equal draws go to the child listed later."""
    if len(children) == 1:
        return children[0][2]
    drawn = [F.struct(_draw(key, name, weight).alias("draw"), F.lit(k).alias("k")) for k, (name, weight, _) in enumerate(children)]
    best = F.greatest(*drawn)["k"]
    out = children[-1][2]
    for k, (_, _, value) in list(enumerate(children))[:-1]:
        out = F.when(best == k, value).otherwise(out)
    return out


def shard_of(key: Column, shards: list[Shard]) -> Column:
    """The shard number of a key. A null key is a key like any other. Shards of weight 0 get nothing."""
    tree: dict[str, dict[str, list[Shard]]] = {}
    for s in shards:
        if s.weight > 0:
            tree.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    if not tree:
        raise ValueError("no shard has a weight")
    key = F.coalesce(key.cast("string"), F.lit("\0"))
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, leaves in racks.items():
            numbers = [(f"{region}/{rack}/{s.number}", s.weight, F.lit(s.number)) for s in leaves]
            inner.append((f"{region}/{rack}", sum(s.weight for s in leaves), _pick(key, numbers)))
        regions.append((region, sum(w for _, w, _ in inner), _pick(key, inner)))
    return _pick(key, regions)


def with_shard(df: DataFrame, key: Column, shards: list[Shard], name: str) -> DataFrame:
    """``df`` with the shard number of each row: as ``shard_of``, with a column for each level, so that each draw is made once."""
    tree: dict[str, dict[str, list[Shard]]] = {}
    for s in shards:
        if s.weight > 0:
            tree.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    if not tree:
        raise ValueError("no shard has a weight")
    key = F.coalesce(key.cast("string"), F.lit("\0"))

    def best(children: list[tuple[str, float]]) -> Column:
        if len(children) == 1:
            return F.lit(0)
        return F.greatest(*[F.struct(_draw(key, child, weight).alias("draw"), F.lit(k).alias("k")) for k, (child, weight) in enumerate(children)])["k"]

    def within(at: str, choices: list[Column]) -> Column:
        out = choices[-1]
        for k, choice in list(enumerate(choices))[:-1]:
            out = F.when(F.col(at) == k, choice).otherwise(out)
        return out

    def weight(leaves: list[Shard]) -> float:
        return sum(s.weight for s in leaves)

    regions = [(region, sum(weight(leaves) for leaves in racks.values())) for region, racks in tree.items()]
    rack_of = [best([(f"{region}/{rack}", weight(leaves)) for rack, leaves in racks.items()]) for region, racks in tree.items()]
    # Racks are numbered throughout, so that the last level looks at one number.
    begins, leaves_of = [], []
    for region, racks in tree.items():
        begins.append(len(leaves_of))
        leaves_of.extend((f"{region}/{rack}", leaves) for rack, leaves in racks.items())
    numbers = [F.element_at(F.array(*[F.lit(s.number) for s in leaves]), best([(f"{path}/{s.number}", s.weight) for s in leaves]) + 1) for path, leaves in leaves_of]
    return (
        df.withColumn("_region", best(regions))
        .withColumn("_rack", within("_region", [choice + begin for choice, begin in zip(rack_of, begins)]))
        .withColumn(name, within("_rack", numbers).cast("int"))
        .drop("_region", "_rack")
    )


def with_slots(df: DataFrame, shard: str = "shard", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A gapless ``slot`` from 0 within each shard.

    Rows are numbered within parts of a shard chosen by a hash of the ordering columns; a small table of counts says where each part
    begins. Rows equal in ``order`` are in the same part, in any order among themselves.
    """
    from pyspark.sql import Window

    parted = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int"))
    counts = parted.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    within = Window.partitionBy(shard, "_part").orderBy(*order)
    numbered = parted.withColumn("_row", F.row_number().over(within))
    return numbered.join(begins, [shard, "_part"]).withColumn("slot", (F.col("_begin") + F.col("_row") - 1).cast("long")).drop("_part", "_row", "_begin")


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", base: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row, under the law ``key``.

    The id and the number of shards alone decide: rows with one id share a shard, equal texts with different ids do not.
    ``size`` is the bytes of the text plus 8; a null text counts as empty. ``grown_shard`` is the shard with one more of
    them. ``base`` is the number of shards that there were at first (24, or all if they are fewer), which form the tree; each later
    one is a region of its own, so rows that move when one is added all go to it. Give the same ``base`` as shards are added. A null id is an id like any other; repeated rows get slots of their own; other columns are left out; an
    empty table gives an empty one.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.col("doc_id")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    ).select(
        "*",
        F.lit("key").alias("law"),
    )
    base = min(24, shards) if base is None else min(base, shards)
    rows = with_shard(rows, key, topology(shards, base), "shard")
    rows = with_shard(rows, key, topology(shards + 1, base), "grown_shard")
    return with_slots(rows, order=("doc_id", "text_crc32", "size")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
