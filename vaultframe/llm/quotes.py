"""Quotation linking for chats, in DataFrame functions only.

Lines begin with quote marks ("> > text" is level 2). Runs of one level are passages; their
normalised lines and passages are hashed and joined to the first message of the
conversation that says them itself. A message replies to the earlier message that it
quotes most, or to the one before it; what it quotes is cut from its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: A line that introduces a quotation, in the languages of the tables.
INTRO = r"^(on .{1,200} wrote|am .{1,200} schrieb.{0,100}|le .{1,200} a écrit|el .{1,200} escribió) ?:$"
#: Normalised lines shorter than this are too common to link by.
LEAST_CHARS = 12
#: Turns that are looked at together to find the turn before one.
BUCKET = 64


def _normal(x: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds ``lines`` (level, body, line), ``own_text`` and ``max_level``.

    Level 0 lines are the message's own; an introduction of a quotation isn't, if the
    message has quotes at all. Null text gives an empty own text.
    """
    prefix = lambda x: F.regexp_extract(x, r"^((?:[ \t]*>)*)", 1)
    line = lambda x: F.struct((F.length(prefix(x)) - F.length(F.replace(prefix(x), F.lit(">"), F.lit("")))).alias("level"), F.trim(F.substring(x, F.length(prefix(x)) + 1, F.length(x))).alias("body"), x.alias("line"))
    out = messages.withColumn("lines", F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1), line))
    out = out.withColumn("max_level", F.array_max(F.transform("lines", lambda x: x["level"])))
    own = F.filter("lines", lambda x: (x["level"] == 0) & ((F.col("max_level") == 0) | ~F.lower(F.trim(x["line"])).rlike(INTRO)))
    return out.withColumn("own_text", F.trim(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), F.lit(" \t\n\r")))


def _passages(lines: F.Column, level: F.Column) -> F.Column:
    """Runs of lines of this level without blank ones, as texts."""
    joined = F.array_join(F.transform(lines, lambda x: F.when((x["level"] == level) & (x["body"] != ""), x["body"]).otherwise(F.lit("\u0001"))), "\n")
    return F.filter(F.transform(F.split(joined, "\u0001", -1), lambda p: F.trim(p, F.lit(" \n"))), lambda p: p != "")


def _units(passages: F.Column) -> F.Column:
    """Hashes of the passages and of their lines."""
    every = F.flatten(F.transform(passages, lambda p: F.concat(F.array(p), F.split(p, "\n", -1))))
    long = F.filter(F.transform(every, _normal), lambda u: F.length(u) >= LEAST_CHARS)
    return F.transform(F.array_distinct(long), lambda u: F.md5(u.cast("binary")))


def linked(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, reply_to, linked, quote_levels``, one row for each row.

    ``text`` is the message's own; ``reply_to`` the turn that it answers, null for the first
    of a conversation; ``linked`` whether a quotation says so. Of turns quoted by equally
    many units at level 1 the latest counts; deeper levels serve if level 1 links nowhere.
    Rows of one conv_id and turn are parts of one message and share reply_to. Rows without
    conv_id or turn reply to nothing. A quoted text that several turns say belongs to the
    first. Sort by conv_id, reply_to (nulls first) and turn for the reply order: a message
    stands after the one it answers, and all answers to a message stand together.
    """
    rows = parsed(messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"))
    keyed = rows.where("conv_id is not null and turn is not null")
    levels = F.filter(F.array_distinct(F.transform("lines", lambda x: x["level"])), lambda v: v > 0)
    quoted = keyed.where("max_level > 0").select("conv_id", "turn", "lines", F.explode(levels).alias("level")).select("conv_id", "turn", "level", F.explode(_units(_passages(F.col("lines"), F.col("level")))).alias("unit")).distinct()
    said = keyed.select("conv_id", F.col("turn").alias("origin"), F.explode(_units(_passages(F.col("lines"), F.lit(0)))).alias("unit"))
    origins = said.join(quoted.select("conv_id", "unit").distinct(), ["conv_id", "unit"], "left_semi").groupBy("conv_id", "unit").agg(F.min("origin").alias("origin"))
    votes = quoted.join(origins, ["conv_id", "unit"]).where("origin < turn").groupBy("conv_id", "turn", "level", "origin").agg(F.count(F.lit(1)).alias("n"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "n", "origin")).alias("best")).select("conv_id", "turn", F.col("best.origin").alias("parent"))

    turns = keyed.select("conv_id", "turn").distinct().withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    tops = turns.groupBy("conv_id", "bucket").agg(F.max("turn").alias("top"))
    earlier = tops.select("conv_id", "bucket", F.lag("top").over(W.partitionBy("conv_id").orderBy("bucket")).alias("earlier"))
    near = turns.withColumn("near", F.lag("turn").over(W.partitionBy("conv_id", "bucket").orderBy("turn")))
    before = near.join(earlier, ["conv_id", "bucket"]).select("conv_id", "turn", F.coalesce("near", "earlier").alias("before"))
    replies = before.join(parents, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("parent", "before").alias("reply_to"), F.col("parent").isNotNull().alias("linked"))
    out = rows.select("conv_id", "turn", "role", F.col("own_text").alias("text"), F.col("max_level").alias("quote_levels")).join(replies, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", "reply_to", F.coalesce("linked", F.lit(False)).alias("linked"), "quote_levels")


def ordered(messages: DataFrame) -> DataFrame:
    """The linked messages, sorted as conversations in reply order."""
    return linked(messages).orderBy("conv_id", F.col("reply_to").asc_nulls_first(), "turn")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over all conversations."""
    return ordered(table(spark, sf_dir, "conversations"))


ORACLE = r"""
with m as (select conv_id, turn, role, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {'line': x, 'prefix': regexp_extract(x, '^((?:[ \t]*>)*)', 1)}) as ls from conversations),
p as (select conv_id, turn, role, list_transform(ls, lambda x: {'level': length(x.prefix) - length(replace(x.prefix, '>', '')), 'body': trim(substr(x.line, length(x.prefix) + 1), ' '), 'line': x.line}) as lines from m),
o as (select *, list_max(list_transform(lines, lambda x: x.level)) as max_level from p),
t as (select *, trim(array_to_string(list_transform(list_filter(lines, lambda x: x.level = 0 and (max_level = 0 or not regexp_matches(lower(trim(x.line, ' ')), '^(on .{1,200} wrote|am .{1,200} schrieb.{0,100}|le .{1,200} a écrit|el .{1,200} escribió) ?:$'))), lambda x: x.line), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) as own_text from o),
lv as (select conv_id, turn, lines, max_level, unnest(list_distinct(list_transform(lines, lambda x: x.level))) as level from t),
ps as (select conv_id, turn, level, unnest(list_filter(list_transform(string_split(array_to_string(list_transform(lines, lambda x: case when x.level = level and x.body <> '' then x.body else chr(1) end), chr(10)), chr(1)), lambda q: trim(q, ' ' || chr(10))), lambda q: q <> '')) as passage from lv),
us as (select distinct conv_id, turn, level, md5(u) as unit from (select conv_id, turn, level, trim(regexp_replace(lower(unnest(list_concat([passage], string_split(passage, chr(10))))), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') as u from ps) where length(u) >= 12),
og as (select conv_id, unit, min(turn) as origin from us where level = 0 group by all),
vt as (select q.conv_id, q.turn, q.level, og.origin, count(*) as n from us q join og using (conv_id, unit) where q.level > 0 and og.origin < q.turn group by all),
pa as (select conv_id, turn, arg_max(origin, {'a': -level, 'b': n, 'c': origin}) as parent from vt group by all),
bf as (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as before from (select distinct conv_id, turn from t))
select t.conv_id, t.turn, t.role, t.own_text as text, coalesce(pa.parent, bf.before) as reply_to, pa.parent is not null as linked, cast(t.max_level as int) as quote_levels
from t left join bf using (conv_id, turn) left join pa using (conv_id, turn)
"""
