"""Conversation structure repair: cheapest edits that give the roles a proper order.

Turns of a conversation are taken by turn (nulls first); ties go by role, then text (by the
first ``HEAD`` characters of each, then by their digest), then place in the input. A turn's first fault counts: blank (only white space), duplicate (role
and text seen earlier in the conversation) or truncated (its last visible character is not
``.``, ``!`` or ``?``). Blank and duplicate turns must be deleted. The edits (Delete 3,
Insert an empty turn 2, Keep 0, Rerole to user or assistant 2; a truncated turn that stays
1 more) must give role initials ``(s?(ua)+)?``; of the cheapest edit strings the least in
ASCII is taken (``lattice``: an auction for shortest paths whose prices expose the optimal
arcs).

Scale: turns are ranked by one range sort in which a long conversation is spread over many
tasks, and cut into blocks of at most ``BLOCK`` turns, one sign a turn. A conversation
inside one block is solved on its own (equal sign strings once a task). For one that spans
several, each block gives its 4 x 4 table of costs from entry to exit state, the tables are
chained per conversation (16 numbers for ``BLOCK`` turns), and with the exit prices every
block is traced from each entry state on its own. Only the digest of the repaired text,
which SHA-256 defines over one stream, reads a conversation in order in one task, as a
stream and without holding it.

Cases: null roles and texts count as one space; a null ``conv_id`` is a conversation of its
own; roles count by their first character, other initials than ``s``, ``u``, ``a`` can only
be reroled or deleted; repeated rows are duplicates; a conversation that loses all turns
has an empty audit; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medoidlab.llm.common import ranked, stored, table
from medoidlab.llm.lattice import END, SIGNS, UNREACHED, Block, transfer

#: Turns a block; the most that one lattice holds.
BLOCK = 4096
#: Sign strings of whole conversations that a task remembers.
KNOWN = 50_000

#: Characters of a role or text that take part in the order: what is sampled for a range
#: sort must be bounded, however long the texts.
HEAD = 64

WHITE = " \t\n\x0b\f\r"


def _key(conv_id: Column) -> Column:
    """A text for every conversation, the null one too."""
    return F.when(conv_id.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def in_order(turns: DataFrame) -> DataFrame:
    """``key, conv_id, turn, role, text, digest, rank``: the turns in order, ranks without gaps."""
    spaced = turns.select(
        _key(F.col("conv_id")).alias("key"),
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("place"),
    )
    both = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    spaced = spaced.withColumns(
        {"digest": F.sha2(both, 256), "role_head": F.left("role", F.lit(HEAD)), "text_head": F.left("text", F.lit(HEAD))}
    )
    keys = ["key", F.col("turn").asc_nulls_first(), "role_head", "text_head", "digest", "place"]
    return ranked(spaced, keys, "turns-in-order", "rank").drop("place", "role_head", "text_head")


def _sign(first: Column) -> Column:
    seen = F.rtrim(F.col("text"), F.lit(WHITE))
    status = (
        F.when(seen == "", 2).when(~first, 3).when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    )
    place = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.left("role", F.lit(1))), F.lit(0)), F.lit(4)) - 1
    place = F.when(F.length("role") == 0, F.lit(3)).otherwise(place)
    return F.substr(F.lit(SIGNS), (4 * status + place + 1).cast("int"), F.lit(1))


def blocks(rows: DataFrame) -> DataFrame:
    """``key, block, first, signs``: the signs of the turns of ``in_order``, block by block;
    ``first`` is the rank of a block's first turn."""
    firsts = (
        rows.groupBy("key", "digest")
        .agg(F.min("rank").alias("rank"))
        .select("rank", F.lit(True).alias("first_seen"))
    )
    signed = rows.join(firsts, "rank", "left").select(
        "key", "rank", _sign(F.coalesce(F.col("first_seen"), F.lit(False))).alias("sign")
    )
    listed = F.array_sort(F.collect_list(F.struct("rank", "sign")))
    return (
        signed.groupBy("key", F.expr(f"rank div {BLOCK}").alias("block"))
        .agg(F.min("rank").alias("first"), listed.alias("signs"))
        .withColumn("signs", F.array_join(F.transform("signs", lambda s: s["sign"]), ""))
    )


def _solve_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple] = {}
    for batch in batches:
        costs, edits = [], []
        for signs in batch.column("signs").to_pylist():
            if signs not in known:
                if len(known) >= KNOWN:
                    known.clear()
                known[signs] = Block(signs).edits()[:2]
            cost, turns = known[signs]
            costs.append(cost)
            edits.append(turns)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                batch.column("block"),
                batch.column("first"),
                batch.column("signs"),
                pa.array(costs, pa.int64()),
                pa.array(edits, pa.list_(pa.string())),
            ],
            ["key", "block", "first", "signs", "cost", "edits"],
        )


SOLVED = "key string, block bigint, first bigint, signs string, cost bigint, edits array<string>"


TABLES = "struct<through:array<bigint>,last:array<bigint>>"
TRACES = "array<struct<cost:bigint,edits:array<string>,state:int>>"


def _tables(signs: pd.Series) -> pd.DataFrame:
    """A block's costs by entry and exit state, and by entry state if it is the last."""
    through = [[-1 if c is UNREACHED else c for row in transfer(s) for c in row] for s in signs]
    return pd.DataFrame({"through": through, "last": [Block(s).entry for s in signs]})


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """The price of each exit state of a conversation's blocks, from the last to the first."""
    rows = rows.sort_values("block")
    exits: list = [None] * len(rows)
    price = list(rows["last"].iloc[-1])
    for i in range(len(rows) - 2, -1, -1):
        exits[i] = price
        t = rows["through"].iloc[i]
        price = [min(t[4 * q + r] + price[r] for r in range(4) if t[4 * q + r] >= 0) for q in range(4)]
    return pd.DataFrame({"key": rows["key"], "block": rows["block"], "exits": exits})


def _traces(signs: pd.Series, exits: pd.Series) -> pd.Series:
    """A block's edits from each of the four entry states."""
    out = []
    for s, e in zip(signs, exits):
        block = Block(s) if e is None else Block(s, [int(x) for x in e], False)
        out.append([dict(zip(("cost", "edits", "state"), block.edits(q))) for q in range(4)])
    return pd.Series(out)


def _enter(rows: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of a conversation is entered, and the whole cost."""
    rows = rows.sort_values("block")
    state, states = 0, []
    for after in rows["after"]:
        states.append(state)
        state = after[state]
    cost = [int(rows["cost"].iloc[0])] + [0] * (len(rows) - 1)
    return pd.DataFrame({"key": rows["key"], "block": rows["block"], "entry": states, "cost": cost})


def solved(pieces: DataFrame) -> DataFrame:
    """``pieces`` of :func:`blocks` with ``cost`` (of the whole conversation, on one block)
    and ``edits``, the turns' edits (see ``lattice.Block.edits``)."""
    count = pieces.groupBy("key").agg(F.count("*").alias("n_blocks")).where("n_blocks > 1").select("key")
    many = stored(pieces.join(count, "key", "left_semi"), "long-conversations")
    whole = pieces.join(many.select("key").distinct(), "key", "left_anti")
    tables = many.withColumn("t", F.pandas_udf(_tables, TABLES)("signs")).select("key", "block", "t.*")
    exits = tables.groupBy("key").applyInPandas(_chain, "key string, block bigint, exits array<bigint>")
    trace = F.pandas_udf(_traces, TRACES)
    traced = stored(many.join(exits, ["key", "block"]).withColumn("t", trace("signs", "exits")), "long-traces")
    entries = (
        traced.select("key", "block", F.col("t.state").alias("after"), F.col("t")[0]["cost"].alias("cost"))
        .groupBy("key")
        .applyInPandas(_enter, "key string, block bigint, entry int, cost bigint")
    )
    chosen = traced.join(entries, ["key", "block"]).select(
        "key", "block", "first", "signs", "cost", F.col("t")[F.col("entry")]["edits"].alias("edits")
    )
    return whole.mapInArrow(_solve_whole, SOLVED).unionByName(chosen)


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: ``key, rank, place`` (order), ``role, text, edit``."""
    each = edits.select("key", "first", F.posexplode("edits").alias("at", "edit")).select(
        (F.col("first") + F.col("at")).alias("rank"), "edit"
    )
    signs = F.split(F.col("edit"), "")
    out = rows.join(each, "rank").select("key", "rank", "role", "text", F.posexplode(signs).alias("place", "edit"))
    role = (
        F.when(F.col("edit").isin("u", "U"), F.lit("user"))
        .when(F.col("edit").isin("a", "A"), F.lit("assistant"))
        .otherwise(F.col("role"))
    )
    label = F.when(F.col("edit").isin("u", "a"), "I").when(F.col("edit") == "K", "K").otherwise("R")
    return out.where("edit in ('u', 'a', 'K', 'U', 'A')").select(
        "key",
        "rank",
        "place",
        role.alias("role"),
        F.when(label == "I", F.lit("")).otherwise(F.col("text")).alias("text"),
        label.alias("edit"),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's lines, which arrive in order, joined by line feeds."""
    key = running = None
    for batch in batches:
        keys, digests = [], []
        for k, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist()):
            if k != key:
                if running is not None:
                    keys.append(key)
                    digests.append(running.hexdigest())
                key, running = k, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], ["key", "sha256"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], ["key", "sha256"])


def digests(lines: DataFrame) -> DataFrame:
    """``key, sha256`` of ``role:text`` of the repaired turns, joined by line feeds."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = F.concat("role", F.lit(":"), "text").alias("line")
    ordered = lines.repartition(n, "key").sortWithinPartitions("key", "rank", "place").select("key", line)
    return ordered.mapInArrow(_digests, "key string, sha256 string")


def _count(name: str, signs: str) -> Column:
    kept = F.regexp_replace("signs", f"[^{signs}]", "")
    return F.sum(F.length(kept)).cast("long").alias(name)


def faults(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit."""
    turns = rows.groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    initials = F.translate("signs", SIGNS, "suax" * 4)
    ends = edits.withColumn("initials", initials).withColumn("size", F.length("signs"))
    # A legal neighbour pair is su, ua or au; pairs inside a block are counted in its string,
    # the pair across two blocks where they meet.
    pairs = F.transform(
        F.sequence(F.lit(1), F.col("size")), lambda i: F.substr(F.col("initials"), i, F.lit(2))
    )
    inside = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au")))
    label = F.translate(F.array_join("edits", ""), "uaUA", "IIRR")
    ends = ends.select(
        "key",
        "block",
        "signs",
        "cost",
        inside.alias("inside"),
        label.alias("labels"),
        F.left("initials", F.lit(1)).alias("head"),
        F.right("initials", F.lit(1)).alias("tail"),
    )
    joined = F.array_sort(F.collect_list(F.struct("block", "head", "tail", "labels")))
    at = F.col("blocks")
    across = F.size(
        F.filter(
            F.transform(
                F.sequence(F.lit(2), F.greatest(F.size(at), F.lit(2))),
                lambda i: F.concat(F.get(at, i - 2)["tail"], F.get(at, i - 1)["head"]),
            ),
            lambda p: ~p.isin("su", "ua", "au"),
        )
    )
    return (
        ends.groupBy("key")
        .agg(
            _count("blank", "ijkl"),
            _count("duplicate", "mnop"),
            _count("truncated", "efgh"),
            F.sum("inside").alias("inside"),
            F.sum("cost").alias("cost"),
            joined.alias("blocks"),
        )
        .select(
            "key",
            "blank",
            "duplicate",
            "truncated",
            (F.col("inside") + across).cast("long").alias("illegal"),
            "cost",
            F.array_join(F.transform("blocks", lambda b: b["labels"]), "").alias("audit"),
        )
        .join(turns, "key")
    )


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``turns`` (conv_id, turn, role, text) -> (rows in order, edits by block, repaired turns)."""
    rows = in_order(turns)
    edits = stored(solved(stored(blocks(rows), "conversation-blocks")), "conversation-edits")
    return rows, edits, repaired_turns(rows, edits)


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage: dropped, emptied, unpunctuated, repeated or reroled turns."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    kind = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1])) % 20
    rows = turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit(""))
        .when(kind == 2, F.translate(text, ".!?", ""))
        .otherwise(text)
        .alias("text"),
        kind.alias("kind"),
    ).where("kind <> 0")
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rows, edits, fixed = repair(damaged(turns))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        turns.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
        .join(faults(rows, edits), "key", "left")
        .join(digests(fixed), "key", "left")
        .select(
            "conv_id",
            *[F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n) for n in numbers],
            F.coalesce(F.col("audit"), F.lit("")).alias("audit"),
            F.coalesce(F.col("sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
        )
    )
