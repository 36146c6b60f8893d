"""Sharding by balanced label propagation, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.runtime import stage

SHARDS = 40
#: Bytes that a row takes in a shard besides its text.
ROW_BYTES = 16
#: Ranks are counted in so many buckets first, so that no task sorts a whole shard.
_BUCKETS = 256
_ALL_MEMBERS = ("cast(null as bigint) as lo", "cast(null as bigint) as hi")
_PIECE = {"part": "bigint", "shard": "int", "lo": "bigint", "hi": "bigint"}


def _ranked(df: DataFrame, group: str, order: list[Column], size: Column | None = None) -> DataFrame:
    """``df`` with ``rank``: how much of its group (rows, or the sum of ``size``) comes before each row.

    Rows are dealt into hashed buckets; the sizes of the buckets before come from a small table of sums.
    With ``size`` rows of more binary digits come first, in buckets of their own.
    """
    bucket = F.pmod(F.xxhash64(*order), F.lit(_BUCKETS)).cast("int")
    if size is not None:
        bucket -= F.length(F.bin(size)) * _BUCKETS
    size = F.lit(1) if size is None else size
    bucketed = df.withColumn("bucket", bucket).withColumn("weight", size)
    sums = bucketed.groupBy(group, "bucket").agg(F.sum("weight").alias("weight"))
    ahead = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(group, "bucket", F.coalesce(F.sum("weight").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy(group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = bucketed.withColumn("inside", F.coalesce(F.sum("weight").over(inside), F.lit(0)))
    return numbered.join(before, [group, "bucket"]).withColumn("rank", F.col("before") + F.col("inside")).drop(
        "bucket", "weight", "before", "inside"
    )


def _wishes(open_: DataFrame, room: Column) -> DataFrame:
    """Where each part wants to meet: of the shards its members are in, the one with most of them that
    has room for the whole part; equal counts are told apart by hash. ``n`` is the size of the part."""
    weight = F.struct("n", F.xxhash64("part", "start").alias("tie"), F.col("start").alias("target"))
    best = open_.where(F.col("total") <= room).groupBy("part").agg(F.max(weight).alias("best"), F.first("total").alias("n"))
    return best.select("part", "best.target", "n")


def _by_shard(values: dict[int, int], shard: Column) -> Column:
    """The value of a shard out of a list with one entry per shard."""
    return F.get(F.array(*[F.lit(values.get(s, 0)).cast("long") for s in range(SHARDS)]), shard)


def _laid(open_: DataFrame, room: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Lay unsettled parts end to end, large ones first, into the room of all shards, the greatest first.

    Parts within one shard's room settle there (part, target). At most one part is cut at each edge between
    shards; each of these few goes to the least room that holds it, or is spread over the greatest rooms.
    They come as pieces: part, shard and the ranks of members from ``lo`` to below ``hi``.
    """
    parts = open_.groupBy("part").agg(F.first("total").alias("n")).withColumn("line", F.lit(0))
    parts = stage(_ranked(parts, "line", [F.col("part")], F.col("n")), "line")
    shards = sorted(room, key=lambda s: (-room[s], s))
    edges = F.array(*[F.lit(e).cast("long") for e in accumulate(room[s] for s in shards)])
    spot = lambda at: F.size(F.filter(edges, lambda e: e <= at))
    parts = parts.select("part", "n", spot(F.col("rank")).alias("first"), spot(F.col("rank") + F.col("n") - 1).alias("last"))
    target = F.get(F.array(*map(F.lit, shards)), F.col("first")).alias("target")
    whole = parts.where("first = last").select("part", target, "n")
    left = dict(room)
    for row in whole.groupBy("target").agg(F.sum("n").alias("n")).collect():  # one per shard
        left[row.target] -= row.n
    pieces = []
    for row in sorted(parts.where("first < last").collect(), key=lambda r: (-r.n, r.part)):  # fewer than shards
        lo = 0
        while lo < row.n:
            holding = [s for s in left if left[s] >= row.n - lo]
            s = min(holding, key=left.get) if holding else max(left, key=left.get)
            hi = min(row.n, lo + left[s])
            pieces.append((row.part, s, lo, hi))
            left[s] -= hi - lo
            lo = hi
    made = [F.struct(*[F.lit(v).cast(t).alias(k) for (k, t), v in zip(_PIECE.items(), piece)]) for piece in pieces]
    made = F.array(*made) if made else F.array().cast("array<struct<%s>>" % ",".join(map(":".join, _PIECE.items())))
    return whole.select("part", "target"), open_.sparkSession.range(1).select(F.inline(made))


def propagate(linked: DataFrame, quota: dict[int, int]) -> DataFrame:
    """Bring the linked rows of each part into one shard, within ``quota`` rows per shard.

    ``linked`` has part (rows with equal part are neighbours), shard (where they start) and n (how many);
    the quotas together hold them all. Members of a part that sit in one shard move together, so the state
    is one row per part and start. In a round every part that is not settled proposes the shard where most
    of its members are and the whole part fits. Proposals are taken, large parts first, up to the room their
    target has, and a part whose proposal is taken is settled there. Only settled parts take room: the
    others will leave theirs. Each target takes at least its first proposal; rounds end when no part has
    such a shard. What is not settled then takes the room that is left in any shard (``_laid``), so that
    fewer parts than there are shards can stay cut.

    Returns part, start and shard of whole parts, with null ``lo`` and ``hi``; of the few others part, shard
    and the ranks of members (from ``lo`` to below ``hi``) that go there, with null start.
    """
    cells = linked.withColumnRenamed("shard", "start")
    totals = cells.groupBy("part").agg(F.sum("n").alias("total"))
    cells = stage(cells.join(totals, "part"), "labels")
    open_, room, settled = cells, dict(quota), []
    while True:
        wishes = stage(_wishes(open_, _by_shard(room, F.col("start"))), "wishes")
        if wishes.isEmpty():
            break
        queued = _ranked(wishes, "target", [F.col("part")], F.col("n"))
        fits = F.col("rank") + F.col("n") <= _by_shard(room, F.col("target"))
        taken = stage(queued.where(fits).select("part", "target", "n"), "settled")
        settled.append(taken.select("part", "target"))
        for row in taken.groupBy("target").agg(F.sum("n").alias("n")).collect():  # one per shard
            room[row.target] -= row.n
        open_ = stage(open_.join(taken.select("part"), "part", "left_anti"), "open")
    pieces = None
    if not open_.isEmpty():
        whole, pieces = _laid(open_, room)
        settled.append(whole)
    if not settled:
        return cells.selectExpr("part", "start", "start as shard", *_ALL_MEMBERS)
    moved = cells.join(reduce(DataFrame.union, settled), "part")
    moved = moved.selectExpr("part", "start", "target as shard", *_ALL_MEMBERS)
    return moved if pieces is None else moved.unionByName(pieces, allowMissingColumns=True)


def shard_documents(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Put rows into SHARDS shards of equal row counts, rows with equal texts together where they fit.

    Law ``rows``: shard counts differ by one at most. Links: rows with equal texts (null equals null) are
    neighbours, through their text's digest, so no pairs are made. A group larger than half a shard is cut
    into parts of about that size first. Linked rows start in hashed shards and move by label propagation
    under each shard's quota; parts that find no room at a neighbour's take any that is left, and fewer than
    SHARDS of them are cut for it. Rows without links then fill the rest, so that sizes come out exact.

    Returns doc_id, size (bytes of the text and 16), text_crc32, law, shard, slot (gapless in the shard),
    grown_shard (null: only keyed laws have one). Null ids, repeated rows and empty texts are rows like any
    other; a null text has size 16 and checksum 0; fewer rows than shards leave shards empty; an empty table
    gives no rows; other columns are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.when(F.col(text).isNull(), "null").otherwise(F.md5(whole.cast("binary"))).alias("group"),
        F.monotonically_increasing_id().alias("row"),  # fixed once written; tells repeated rows apart
    )
    rows = stage(rows, "rows")
    total = rows.count()
    quota = {s: total // SHARDS + (s < total % SHARDS) for s in range(SHARDS)}

    # Groups of two rows and more, and in how many parts a large one is cut.
    most = max(1, total // SHARDS // 2)
    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = stage(groups.withColumn("parts", F.ceil(F.col("members") / most).cast("int")), "groups")
    spot = F.xxhash64("doc_id", "group", "row")
    joined = rows.join(groups, "group", "left")
    part = F.when(F.col("parts").isNotNull(), F.xxhash64("group", F.pmod(spot, F.col("parts"))))
    start = F.when(F.col("parts").isNotNull(), F.pmod(F.shiftright(spot, 20), F.lit(SHARDS)).cast("int"))
    dealt = stage(joined.select("doc_id", "size", "text_crc32", "group", "row", part.alias("part"), start.alias("start")), "dealt")

    linked = dealt.where("part is not null").groupBy("part", F.col("start").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    labels = stage(propagate(linked, quota), "ends")
    whole = labels.where("lo is null").select("part", "start", F.col("shard").alias("want"))
    pieces = labels.where("lo is not null").select("part", F.col("shard").alias("want"), "lo", "hi")
    placed = dealt.join(whole, ["part", "start"], "left")
    if not pieces.isEmpty():  # fewer than two per shard
        cut = F.broadcast(pieces.select("part").distinct())
        within = _ranked(dealt.join(cut, "part", "left_semi"), "part", [F.col("doc_id"), F.col("row")])
        within = within.join(F.broadcast(pieces), "part").where("rank >= lo and rank < hi")
        placed = placed.join(cut, "part", "left_anti").unionByName(within.drop("rank", "lo", "hi"))
    placed = placed.withColumn("want", F.coalesce("want", F.lit(-1)))
    placed = stage(_ranked(placed, "want", [F.col("group"), F.col("doc_id"), F.col("row")]), "placed")

    # Exact sizes: what a shard has beyond its quota, and all free rows, fill the room of the others in turn.
    counts = {r.want: r.n for r in placed.groupBy("want").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per shard
    held = {s: min(counts.get(s, 0), quota[s]) for s in range(SHARDS)}
    spare, overflow, filled, ends = counts.get(-1, 0), {}, 0, {}
    for s in range(SHARDS):
        overflow[s] = spare
        spare += counts.get(s, 0) - held[s]
        filled += quota[s] - held[s]
        ends[s] = filled
    stays = (F.col("want") >= 0) & (F.col("rank") < _by_shard(quota, F.col("want")))
    turn = F.when(F.col("want") < 0, F.col("rank")).otherwise(
        F.col("rank") - _by_shard(quota, F.col("want")) + _by_shard(overflow, F.col("want"))
    )
    seat = reduce(lambda n, s: n + F.when(F.col("turn") >= ends[s], 1).otherwise(0), range(SHARDS), F.lit(0))
    out = placed.withColumn("turn", turn).withColumn("shard", F.when(stays, F.col("want")).otherwise(seat))
    taken = {s: held[s] - (ends[s - 1] if s else 0) for s in range(SHARDS)}
    slot = F.when(stays, F.col("rank")).otherwise(F.col("turn") + _by_shard(taken, F.col("shard")))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
