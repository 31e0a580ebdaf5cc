"""Quotation linking: messages, what they quote, and conversations in reply order.

Lines that start with ``>`` marks are quotations, nested as deep as the marks.
Lines of one level that follow one another are one passage, however they are
wrapped. A passage is normalised to its words and hashed by shingles of five
words (a shorter one as a whole); what messages say themselves is hashed alike.
The original of a passage is the message of the conversation in which most of
its shingles stand first, if that is half of them at least. A message replies
to the original of the passage that it quotes most at the lowest level found,
and deeper passages confirm it if their originals are that message's own parent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ranges
from ._common import by_text, cut, schema, sieve, sifted

ADDED = ("body", "n_quoted", "n_passages", "n_linked", "n_confirmed", "parent_turn", "root_turn", "depth")
WIDTH = 5
_MARKS = re.compile(r"\s{0,3}((?:>\s?)+)")
_INTRODUCTION = re.compile(r"^(on .{3,200} wrote|.{1,80} (?:wrote|said|writes)|-+ ?original message ?-+)\s*:?\s*$", re.IGNORECASE)
_WORDS = re.compile(r"\w+")


def parse(text: str) -> list[tuple[int, str]]:
    """(level, words) of every line: level 0 for own words, otherwise the number of quotation marks before it."""
    out = []
    for line in text.splitlines():
        if m := _MARKS.match(line):
            out.append((m[1].count(">"), line[m.end() :].strip()))
        else:
            out.append((0, line.rstrip()))
    return out


def body(lines: list[tuple[int, str]]) -> str:
    """Own words: without quotations and the lines that introduce them; runs of empty lines become one."""
    kept: list[str] = []
    for i, (level, line) in enumerate(lines):
        introduces = not level and _INTRODUCTION.match(line) and any(n for n, _ in lines[i + 1 : i + 3])
        if level or introduces or not line and (not kept or not kept[-1]):
            continue
        kept.append(line)
    return "\n".join(kept).strip("\n")


def _hash(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)


def _words(line: str) -> list[str]:
    return _WORDS.findall(line.lower())


def shingles(words: list[str]) -> set[int]:
    """Hashes of all runs of ``WIDTH`` words; fewer words are one."""
    return {_hash(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))} if words else set()


def runs(lines: list[tuple[int, str]]) -> list[tuple[int, list[list[str]]]]:
    """(level, words of each line that has any) of lines of one level that follow one another."""
    out: list[tuple[int, list[list[str]]]] = []
    for level, line in lines:
        if not out or out[-1][0] != level:
            out.append((level, []))
        if words := _words(line):
            out[-1][1].append(words)
    return [(level, own) for level, own in out if own]


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, set[int], set[int]]]:
    """Level, shingles and lines of every quoted passage."""
    return [(level, shingles([w for x in own for w in x]), {_hash(x) for x in own}) for level, own in runs(lines) if level]


def said(lines: list[tuple[int, str]]) -> set[int]:
    """Hashes of a message's own words: of their shingles, and of lines shorter than one, which may be quoted alone."""
    out: set[int] = set()
    for level, own in runs(lines):
        if not level:
            out |= shingles([w for x in own for w in x]) | {_hash(x) for x in own if len(x) < WIDTH}
    return out


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text_col: str = "text") -> DataFrame:
    """Messages with their place in the conversation, in reply order, without quotations.

    Adds ``body``, ``n_quoted`` (distinct quoted lines), ``n_passages`` (quoted
    passages), ``n_linked`` (quoted lines of passages with an original),
    ``n_confirmed`` (deeper passages whose original is the parent's parent),
    ``parent_turn`` (the message replied to; null if none is quoted),
    ``root_turn`` (the first message of the thread) and ``depth``. Ordering a
    conversation by ``root_turn, turn`` gives every message after the one it
    answers. Ties between originals go to the later message.

    Input columns of the added names are replaced, others stay, whatever their
    names. Null and empty texts say and quote nothing; very long ones are read
    whole. Rows of a null conversation or turn are kept without links. Rows
    that repeat a turn count as one message when linking, and each gets the
    links. An empty table gives no rows. Shingles are pre-aggregated to their
    first message, so words that a third of all messages share are one row on
    that side of the join; only conversations with quotations are hashed.
    """
    extra = [c for c in messages.columns if c not in (conv, turn, text_col, *ADDED)]
    names = {c: f"_x{i}" for i, c in enumerate(extra)}
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hashes", pa.list_(pa.int64())), ("lines", pa.list_(pa.int64()))]))

    def run(texts: list[str], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parsed = [parse(t) for t in texts]
        quoted = [[{"level": level, "hashes": sorted(own), "lines": sorted(each)} for level, own, each in passages(p)] for p in parsed]
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([body(p) for p in parsed], pa.string()), pa.array(quoted, kind)], [*part.schema.names[:-1], "_body", "_quoted"])

    def own(texts: list[str], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([sorted(said(parse(t))) for t in texts], pa.list_(pa.int64()))], ["_conv", "_turn", "_said"])

    source = messages.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), *[F.col(c).alias(n) for c, n in names.items()], F.col(text_col).cast("string").alias("_text"))
    shape = schema(source, *source.columns[:-1], _body="string", _quoted="array<struct<level:int,hashes:array<bigint>,lines:array<bigint>>>")
    parsed = cut(source.mapInArrow(by_text("_text", run, 2 << 20), shape))
    known = F.col("_conv").isNotNull() & F.col("_turn").isNotNull()
    quotes = parsed.where(known & (F.size("_quoted") > 0)).select("_conv", "_turn", F.posexplode("_quoted").alias("_at", "q"))
    quotes = cut(quotes.select("_conv", "_turn", "_at", "q.level", "q.hashes", "q.lines").dropDuplicates(["_conv", "_turn", "level", "hashes"]))

    spoken = sifted(source.where(known).select("_conv", "_turn", "_text"), "_conv", sieve(quotes.select("_conv").distinct(), "_conv", 1 << 22))
    hashed = spoken.mapInArrow(by_text("_text", own, 2 << 20), schema(spoken, "_conv", "_turn", _said="array<bigint>"))
    first = hashed.select("_conv", "_turn", F.explode("_said").alias("hash")).groupBy("_conv", "hash").agg(F.min("_turn").alias("_from"))
    found = quotes.select("_conv", "_turn", "_at", "level", F.size("hashes").alias("n"), F.explode("hashes").alias("hash")).join(first, ["_conv", "hash"]).where("_from < _turn")
    votes = found.groupBy("_conv", "_turn", "_at", "level", "n", "_from").agg(F.count(F.lit(1)).alias("held"))
    best = votes.groupBy("_conv", "_turn", "_at", "level", "n").agg(F.max(F.struct("held", "_from")).alias("best")).where(F.col("best.held") * 2 >= F.col("n"))
    linked = cut(best.join(quotes.select("_conv", "_turn", "_at", "lines"), ["_conv", "_turn", "_at"]).select("_conv", "_turn", "level", F.col("best.held").alias("held"), F.col("best._from").alias("_from"), "lines"))
    chosen = linked.groupBy("_conv", "_turn").agg(F.max(F.struct(-F.col("level"), "held", "_from")).getField("_from").alias("parent_turn"), F.min("level").alias("_least"), F.size(F.array_distinct(F.flatten(F.collect_list("lines")))).cast("long").alias("n_linked"))
    place = _roots(cut(chosen))
    above = place.select("_conv", F.col("_turn").alias("parent_turn"), F.col("parent_turn").alias("_above"))
    deeper = linked.join(place.select("_conv", "_turn", "parent_turn", "_least").join(above, ["_conv", "parent_turn"]), ["_conv", "_turn"]).where((F.col("level") == F.col("_least") + 1) & (F.col("_from") == F.col("_above")))
    place = place.join(deeper.groupBy("_conv", "_turn").agg(F.count(F.lit(1)).alias("n_confirmed")), ["_conv", "_turn"], "left")
    out = parsed.join(place, ["_conv", "_turn"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("_conv").alias(conv),
        F.col("_turn").alias(turn),
        *[F.col(n).alias(c) for c, n in names.items()],
        F.col("_body").alias("body"),
        F.size(F.array_distinct(F.flatten("_quoted.lines"))).cast("long").alias("n_quoted"),
        F.size("_quoted").cast("long").alias("n_passages"),
        F.coalesce("n_linked", zero).alias("n_linked"),
        F.coalesce("n_confirmed", zero).alias("n_confirmed"),
        "parent_turn",
        F.coalesce("root_turn", "_turn").alias("root_turn"),
        F.coalesce("depth", zero).alias("depth"),
    )


def _roots(replies: DataFrame) -> DataFrame:
    """``root_turn`` and ``depth`` of every reply by pointer doubling: as many rounds as the logarithm of the longest chain."""
    d = replies.withColumn("root_turn", F.col("parent_turn")).withColumn("depth", F.lit(1).cast("long"))
    while True:
        up = d.select("_conv", F.col("_turn").alias("root_turn"), F.col("root_turn").alias("_next"), F.col("depth").alias("_more"))
        d = cut(d.join(up, ["_conv", "root_turn"], "left").select(*replies.columns, F.coalesce("_next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_next").isNotNull().alias("_moved")))
        if d.where("_moved").isEmpty():
            return d.drop("_moved")
        d = d.drop("_moved")


def conversations(linked: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: int = 64) -> DataFrame:
    """Number the messages of :func:`link` in reply order: adds ``position``, from 0 without gaps in each conversation.

    All messages are numbered over ranges of conversation, thread and turn, and
    a conversation's first number is taken off, so a conversation or thread of
    any length, and all rows without a conversation, are spread over tasks.
    ``role`` orders rows that repeat a turn, if there is such a column.
    """
    renamed = linked.withColumnsRenamed({c: f"_y{i}" for i, c in enumerate(linked.columns)})
    at = {c: f"_y{i}" for i, c in enumerate(linked.columns)}
    order = [at[conv], at["root_turn"], at[turn]]
    d, _ = ranges.ranged(cut(renamed), order, parts)
    ties = [at[c] for c in (role, "body") if c in at]
    d = d.withColumn("_at", F.row_number().over(Window.partitionBy(ranges.PART).orderBy(*order, *ties)))
    d = d.join(ranges.starts(d, F.count(F.lit(1)), "_start"), ranges.PART).withColumn("_no", F.col("_start") + F.col("_at"))
    firsts = d.groupBy(F.col(at[conv]).alias("_of")).agg(F.min("_no").alias("_first"))
    d = d.join(firsts, F.col(at[conv]).eqNullSafe(F.col("_of")))
    return d.select(*[F.col(n).alias(c) for c, n in at.items() if c != "position"], (F.col("_no") - F.col("_first")).cast("long").alias("position"))
