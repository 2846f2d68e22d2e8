"""Conversation prefix trie: which conversations begin alike, as a burst trie.

A conversation is first rebuilt: `shared` turns of its neighbour's start, then its
own (rebuilt() below). A turn is known by the 128-bit digest of its role and text.
Every sequence of first turns is a node of the trie.

1. Turns are numbered along the whole table by ranges: one long conversation is
   spread over tasks, and one row a range passes the driver. Rebuilt turns are kept in
   segments of SEGMENT.
2. All conversations start in one container under the root. A container of more than
   `container` turns and conversations is burst by the next turn id: its conversations
   go to containers under the next head. Where all go the same way for a while (their
   least and greatest segments agree), that way is passed in one round. Heads are
   digests of the way to them, so that no conversation is told its head; a container
   that holds a thousandth of all conversations or more is joined by broadcast (there
   are at most a thousand of them), all others by a shuffle.
3. A container with one conversation is a chain; its nodes come from its segments.
   The others are dealt over shards, sorted by what is left of their conversations, and
   swept into nodes: what two neighbours share is their common way.
4. Leaves and saved tokens of burst heads are summed from the last round to the first.
5. The conversations that end at a burst head are sorted over all tasks and hashed in
   pieces: SHA-256 goes through one list in order, so one task reads a list's pieces.

Turns come in order of turn (null first); those of one number by the digest of role
and text, repeated rows one after the other. Null role and text are empty. Rows without a
conv_id belong to no conversation. A conversation without a rebuilt turn ends at the
root. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, shuffle_width

SEGMENT = 64
CONTAINER = 4_096
#: A container with this share of all conversations is hot.
HOT = 1_000
#: Parts into which the turns of a long conversation are dealt where they meet its row.
SALTS = 16
EVERY, MOST_SHARED = 5, 8
NOBODY = sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [x.split()[0] for x in NODE.split(", ")]


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, at (from 1, in the order of its turns), id and size (bytes of the text) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    slim = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("id"), F.octet_length(text).cast("long").alias("size"))

    def run(batches):
        from pyspark import TaskContext

        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            begin = np.zeros(len(ids), np.int64)
            change = np.flatnonzero(np.diff(ids)) + 1
            begin[change] = change
            at = np.arange(len(ids)) - np.maximum.accumulate(begin) + 1
            if ids[0] == last:
                at[: change[0] if len(change) else len(ids)] += count
            last, count = ids[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(at), batch.column(1), batch.column(2)], ["conv_id", "part", "at", "id", "size"])

    spark = turns.sparkSession
    order = ["conv_id", "turn", "id"]
    dealt = slim.withColumn("u", F.monotonically_increasing_id()).repartitionByRange(shuffle_width(spark), *order, "u").sortWithinPartitions(*order)
    rows = saved(dealt.select("conv_id", "id", "size").mapInArrow(run, "conv_id long, part int, at long, id binary, size long"), "trie-turns")
    # a row for each range: does its first conversation go on from the range before?
    edges, before, bases = rows.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b"), F.max(F.struct("conv_id", "at"))["at"].alias("n")).orderBy("part").collect(), None, []
    for e in edges:
        base = before[1] if before and before[0] == e.a else 0
        if base:
            bases.append((e.part, e.a, base))
        before = (e.b, e.n + (base if e.a == e.b else 0))
    if not bases:
        return rows.drop("part")
    more = spark.createDataFrame(bases, "part int, conv_id long, base long")
    return rows.join(F.broadcast(more), ["part", "conv_id"], "left").select("conv_id", (F.col("at") + F.coalesce("base", F.lit(0))).alias("at"), "id", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) of every conversation, and its rebuilt turns in segments: conv_id, seg, ids, sizes.

    The first h turns of the conversation conv_id - conv_id % 5, fewer if it has not as
    many, then its own after its first h; h = crc32(conv_id) % 9.
    """
    rows = numbered(turns)
    own, shared = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).alias("h")
    starts = rows.where((F.col("at") <= MOST_SHARED) & (own % EVERY == 0)).groupBy(own.alias("from")).agg(F.array_sort(F.collect_list(F.struct("at", "id", "size"))).alias("start"))
    every = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select("*", shared, (own - own % EVERY).alias("from"))
    convs = every.join(starts, "from", "left").withColumn("start", F.expr("slice(coalesce(start, array()), 1, cast(h AS int))"))
    convs = saved(convs.select("conv_id", "h", F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("rest"), "start", F.size("start").cast("long").alias("m")), "trie-conversations")
    salts = F.explode(F.expr(f"sequence(0, cast(least({SALTS - 1}, rest div {SEGMENT}) AS int))")).alias("salt")
    place = (F.col("at") - shared).alias("place")
    mine = rows.select("conv_id", place, "id", "size").where("place > 0").withColumn("salt", F.expr(f"cast(((place - 1) div {SEGMENT}) % {SALTS} AS int)"))
    later = mine.join(convs.where("rest > 0").select("conv_id", "m", salts), ["conv_id", "salt"]).select("conv_id", (F.col("place") + F.col("m")).alias("depth"), "id", "size")
    first = convs.select("conv_id", F.posexplode("start").alias("i", "t")).select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "t.id", "t.size")
    seg = F.expr(f"(depth - 1) div {SEGMENT}").alias("seg")
    packs = first.unionByName(later).groupBy("conv_id", seg).agg(F.array_sort(F.collect_list(F.struct("depth", "id", "size"))).alias("t"))
    return convs.select("conv_id", (F.col("m") + F.col("rest")).alias("n")), saved(packs.select("conv_id", "seg", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes")), "trie-segments")


def meet(members: DataFrame, heads: DataFrame, total: int) -> DataFrame:
    """members joined with heads (which have n_convs) on head."""
    hot = heads.where(F.col("n_convs") * HOT >= total)
    rest = members.join(F.broadcast(hot.select("head")), "head", "left_anti")
    return members.join(F.broadcast(hot), "head").unionByName(rest.join(heads.where(F.col("n_convs") * HOT < total).hint("merge"), "head"))


def sweep(members: list[tuple[list, list, int]], depth: int, size: int) -> tuple[list[tuple], tuple]:
    """Nodes of a container: members are (ids, sizes, conv_id) from its head on, which stands at this depth.

    Gives the rows of the nodes below the head and that of the head itself; a row:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends.
    """
    members = sorted(members, key=lambda m: (m[0], m[2]))
    done: list[tuple] = []
    # open nodes from the head down: [size, conversations that end here, rows of children, n, least]
    way: list[list] = [[size, [], [], 0, None]]

    def close() -> tuple:
        bytes_, ends, kids, n, least = way.pop()
        place = depth + len(way)
        for k in kids:
            done.append((k[0], k[1], least, *k[3:]))
        return (least, place, None, n, len(kids), sum(k[5] for k in kids) or 1, (n - 1) * bytes_ + sum(k[6] for k in kids), ends)

    def fold() -> None:
        row = close()
        up = way[-1]
        up[2].append(row)
        up[3] += row[3]
        up[4] = row[0] if up[4] is None else min(up[4], row[0])

    before: list = []
    for ids, sizes, conv in members:
        common = 0
        for a, b in zip(before, ids):
            if a != b:
                break
            common += 1
        while len(way) > common + 1:
            fold()
        for s in sizes[common:]:
            way.append([s, [], [], 0, None])
        end = way[-1]
        end[1].append(conv)
        end[3] += 1
        end[4] = conv if end[4] is None else min(end[4], conv)
        before = ids
    while len(way) > 1:
        fold()
    head = close()
    return done, head


def said(convs: list[int]) -> str:
    return sha256(",".join(map(str, sorted(convs))).encode()).hexdigest() if convs else NOBODY


def swept(members: DataFrame) -> DataFrame:
    """Nodes of whole containers; members: head, parent, parent_conv, round, conv_id, pos, size, seg, ids, sizes, a row for each segment (seg null: ended at the head). `head` is null but for the heads' own rows."""

    def run(batches):
        held: list[list] = []  # the open container's conversations: ids, sizes, conv_id
        about, out = None, []

        def close():
            head, parent, parent_conv, round_, pos, size = about
            rows, top = sweep([tuple(h) for h in held], pos, size)
            out.extend((None, None, None, *r[:-1], said(r[-1])) for r in rows)
            out.append((head, parent, round_, *top[:2], parent_conv, *top[3:-1], said(top[-1])))

        def batch_of(rows):
            kinds = [pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 7, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["head", "parent", "round", *COLUMNS])

        for batch in batches:
            for head, parent, parent_conv, round_, conv, pos, size, seg, ids, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                if about is not None and about[0] != head:
                    close()
                    held = []
                about = (head, parent, parent_conv, round_, pos, size)
                if not held or held[-1][2] != conv:
                    held.append([[], [], conv])
                if seg is not None:
                    skip = max(0, pos - seg * SEGMENT)
                    held[-1][0] += ids[skip:]
                    held[-1][1] += sizes[skip:]
            while len(out) >= 4_000:
                yield batch_of(out[:4_000])
                del out[:4_000]
        if about is not None:
            close()
        for a in range(0, len(out), 4_000):
            yield batch_of(out[a : a + 4_000])

    columns = ["head", "parent", "parent_conv", "round", "conv_id", "pos", "size", "seg", "ids", "sizes"]
    dealt = members.select(*columns).repartition(shuffle_width(members.sparkSession), "head").sortWithinPartitions("head", "conv_id", "seg")
    return dealt.mapInArrow(run, f"head binary, parent binary, round int, {NODE}")


def digests(ended: DataFrame, piece: int = 4_096) -> DataFrame:
    """head, ends_sha256 of (head, conv_id) rows: the numbers in rising order, joined by commas."""

    def pieces(batches):
        for batch in batches:
            heads, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            a = 0
            while a < len(heads):
                b = a + 1
                while b < min(len(heads), a + piece) and heads[b] == heads[a]:
                    b += 1
                yield pa.RecordBatch.from_arrays([pa.array([heads[a]], pa.binary()), pa.array([convs[a]], pa.int64()), pa.array([",".join(map(str, convs[a:b]))])], ["head", "first", "said"])
                a = b

    def fold(batches):
        head, made = None, None
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h == head:
                    made.update(b"," + text.encode())
                    continue
                if head is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([head], pa.binary()), pa.array([made.hexdigest()])], ["head", "ends_sha256"])
                head, made = h, sha256(text.encode())
        if head is not None:
            yield pa.RecordBatch.from_arrays([pa.array([head], pa.binary()), pa.array([made.hexdigest()])], ["head", "ends_sha256"])

    width = shuffle_width(ended.sparkSession)
    cut = ended.select("head", "conv_id").repartitionByRange(width, "head", "conv_id").sortWithinPartitions("head", "conv_id").mapInArrow(pieces, "head binary, first long, said string")
    return cut.repartition(width, "head").sortWithinPartitions("head", "first").select("head", "said").mapInArrow(fold, "head binary, ends_sha256 string")


def _child(head: str, turn: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.col(head), turn)))


def prefix_trie(turns: DataFrame, container: int = CONTAINER) -> DataFrame:
    """A row for each node; turns: conv_id, turn, role, text."""
    convs, segs = rebuilt(turns)
    root = F.unhex(F.md5(F.lit("")))
    state = saved(
        convs.select("conv_id", "n", F.lit(0).cast("long").alias("pos"), root.alias("head"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("parent_conv"), F.lit(0).alias("round")),
        "trie-state",
    )
    total, settled, bursts, ended = state.count(), [], [], []
    for step in range(2**31):
        heads = state.groupBy("head").agg(
            F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("n") - F.col("pos")).alias("left"), F.min("pos").alias("pos"),
            F.min("size").alias("size"), F.min("parent").alias("parent"), F.min("parent_conv").alias("parent_conv"),
        )
        heads = saved(heads.withColumn("burst", (F.col("n_convs") > 1) & (F.col("n_convs") + F.col("left") > container)), "trie-heads")
        big = heads.where("burst")
        still = heads.where("NOT burst").select("head", (F.col("n_convs") == 1).alias("alone"))
        # the conversations of hot containers, which burst, need not be sorted to tell that
        hot = big.where(F.col("n_convs") * HOT >= total).select("head")
        settled.append(saved(state.join(F.broadcast(hot), "head", "left_anti").join(still.hint("merge"), "head"), "trie-settled"))
        if big.isEmpty():
            break
        # what comes next, up to the end of the segment
        members = meet(state.select("conv_id", "n", "pos", "head"), big.select("head", "n_convs"), total).withColumn("seg", F.expr(f"pos div {SEGMENT}"))
        ahead = members.join(segs, ["conv_id", "seg"], "left").select("conv_id", "n", "pos", "head", "n_convs", *[F.expr(f"slice(coalesce({c}, array()), cast(pos % {SEGMENT} AS int) + 1, {SEGMENT})").alias(c) for c in ("ids", "sizes")])
        ahead = saved(ahead, "trie-ahead")
        same = F.zip_with("lo", F.col("hi.ids"), lambda a, b: a.eqNullSafe(b))
        ways = ahead.groupBy("head").agg(F.min("ids").alias("lo"), F.max(F.struct("ids", "sizes")).alias("hi"))
        differ = F.array_position(same, False).cast("int")
        ways = ways.join(big, "head").withColumn("common", F.least(F.when(differ == 0, F.size("lo")).otherwise(differ - 1), F.lit(SEGMENT - 1) - (F.col("pos") % SEGMENT).cast("int")))
        ways = saved(ways.select("head", "parent", "parent_conv", F.col("least").alias("conv_id"), F.col("pos").alias("depth"), "n_convs", "common", F.concat(F.array("size"), F.slice("hi.sizes", F.lit(1), F.col("common"))).alias("sizes")), "trie-ways")
        bursts.append(ways)
        gone = meet(ahead.drop("n_convs"), ways.select("head", "n_convs", "common", F.col("conv_id").alias("parent_conv")), total)
        over = F.size("ids") == F.col("common")
        ended.append(saved(gone.where(over).select("head", "conv_id"), "trie-ended"))
        turn = F.get("ids", F.col("common"))
        state = saved(
            gone.where(~over).select("conv_id", "n", (F.col("pos") + F.col("common") + 1).alias("pos"), _child("head", turn).alias("head"), F.get("sizes", F.col("common")).alias("size"), F.col("head").alias("parent"), "parent_conv", F.lit(step + 1).alias("round")),
            "trie-state",
        )
    settled = reduce(DataFrame.unionByName, settled)
    # containers of several conversations
    shared = settled.where("NOT alone").withColumnRenamed("conv_id", "c")
    parts = shared.join(segs, (F.col("c") == F.col("conv_id")) & (F.col("seg") >= F.expr(f"pos div {SEGMENT}")) & (F.col("pos") < F.col("n")), "left").drop("conv_id").withColumnRenamed("c", "conv_id")
    nodes = saved(swept(parts), "trie-nodes")
    # conversations that share nothing below their head
    alone = settled.where("alone")
    last = F.sha2(F.col("conv_id").cast("string"), 256)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def chain(depth: str, parent: Column) -> list[Column]:
        at_end = F.col(depth) == F.col("n")
        return [F.col("conv_id"), F.col(depth).alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(at_end, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(at_end, last).otherwise(F.lit(NOBODY)).alias("ends_sha256")]

    tops = alone.select(*chain("pos", F.col("parent_conv")))
    salts = F.explode(F.expr(f"sequence(0, cast(least({SALTS - 1}, (n - 1) div {SEGMENT}) AS int))")).alias("salt")
    lone = segs.select("conv_id", "seg", F.size("ids").alias("held"), F.expr(f"cast(seg % {SALTS} AS int)").alias("salt")).join(alone.where("pos < n").select("conv_id", "n", "pos", salts), ["conv_id", "salt"])
    lone = lone.select("conv_id", "n", "pos", F.explode(F.expr(f"sequence(seg * {SEGMENT} + 1, seg * {SEGMENT} + held)")).alias("place")).where("place > pos")
    made = [nodes.select(*COLUMNS), tops, lone.select(*chain("place", F.col("conv_id")))]
    # burst heads, from the last round to the first
    below = nodes.where("head IS NOT NULL").select("parent", "round", "n_leaves", "saved_tokens").unionByName(alone.select("parent", "round", one.alias("n_leaves"), none.alias("saved_tokens")))
    if bursts:
        below = saved(below, "trie-below")
        ends = saved(digests(reduce(DataFrame.unionByName, ended)), "trie-ends")
    totals = None
    for step in range(len(bursts) - 1, -1, -1):
        kids = below.where(F.col("round") == step + 1).drop("round")
        kids = kids if totals is None else kids.unionByName(totals)
        sums = kids.groupBy(F.col("parent").alias("head")).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        full = bursts[step].join(sums, "head", "left").join(ends, "head", "left")
        full = full.select("*", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.posexplode("sizes").alias("i", "s"))
        rest = F.aggregate(F.slice("sizes", F.col("i") + 1, F.size("sizes")), F.lit(0).cast("long"), lambda a, x: a + x)
        tail = F.col("i") == F.col("common")
        full = saved(
            full.select(
                "head", "parent", "i", "conv_id", (F.col("depth") + F.col("i")).alias("depth"), F.when(F.col("i") == 0, F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
                F.when(tail, F.coalesce("kids", none)).otherwise(one).alias("n_children"), "n_leaves", (F.coalesce("saved", none) + (F.col("n_convs") - 1) * rest).alias("saved_tokens"),
                F.when(tail, F.coalesce("ends_sha256", F.lit(NOBODY))).otherwise(F.lit(NOBODY)).alias("ends_sha256"),
            ),
            "trie-bursts",
        )
        totals = full.where("i = 0").select("parent", "n_leaves", "saved_tokens")
        made.append(full.select(*COLUMNS))
    return reduce(DataFrame.unionByName, made)
