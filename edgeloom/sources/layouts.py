"""Raw edge lists by the layout of their columns, as rows (seq, u, v, t, label, msg, w) in the file's order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import log2_weight, pad_code, parse_epoch
from ..operators.splits import first_seen_ids
from .files import READERS, encode_names, lines


def _number(i: int) -> Column:
    return F.get("fields", F.lit(i)).try_cast("double")


def _text(i: int) -> Column:
    return F.coalesce(F.get("fields", F.lit(i)), F.lit(""))


@dataclass(frozen=True)
class Layout:
    """Places of the columns, how ids are given, and what the message and the weight are.

    Names get dense ids by first appearance: in one space, a row's source before its destination, or with an
    ``offset`` in two, where sources begin at it.
    """

    weight: Column
    message: Column
    offset: int | None = None
    time: int = 0
    source: int = 1
    destination: int = 2


def layouts() -> dict[str, Layout]:
    """The known layouts.  The offsets leave room for the destinations of the public data sets of that kind."""
    share = _number(3) / 5000.0
    return {
        "trade": Layout(_number(3), F.array(_number(3))),  # year, source, destination, weight
        "token": Layout(_number(3), F.array(_number(3), _number(4)), offset=1001),  # time, user, token, value, is sender
        "subreddit": Layout(_number(4), F.array(_number(4)), offset=2221),  # time, user, topic, words, score
        "datetime": Layout(_number(3), F.array(_number(3)), offset=514),  # time, user, genre, weight
        "comment": Layout(_number(4), F.array(share, share)),  # time, user, topic, words, score
        "coin": Layout(log2_weight(_number(3)), F.array(F.lit(0.0))),  # time, source, destination, weight
        "flight": Layout(F.lit(1.0), F.transform(F.concat(pad_code(_text(3)), pad_code(_text(4))), lambda x: x.cast("double"))),  # day, source, destination, call sign, type
    }


def read_layout(spark: SparkSession, path: str, kind: str, offset: int | None = None) -> DataFrame:
    """A CSV with a header line, by a layout of ``layouts()``; ``offset`` overrides the layout's own.

    Times are seconds or yyyy-MM-dd dates (UTC).  Rows without a time, source or destination are left out.
    More destinations than the offset leaves room for are an error.
    """
    layout = layouts()[kind]
    room = layout.offset if offset is None else offset
    rows = lines(spark, path).select("pos", _text(layout.source).alias("u"), _text(layout.destination).alias("v"), F.coalesce(_number(layout.time), parse_epoch(_text(layout.time)).cast("double")).alias("t"), F.lit(0.0).alias("label"), layout.message.alias("msg"), layout.weight.alias("w"))
    rows = rows.filter("t is not null and u <> '' and v <> ''")
    if room is None:
        out = encode_names(rows, "pos", ["u", "v"])
    else:
        out = rows
        for side, start in (("u", room), ("v", 0)):
            ids = first_seen_ids(rows, "pos", [side])
            out = out.withColumn("raw", F.col(side)).drop(side).join(ids, "raw").withColumn(side, F.col("id") + start).drop("raw", "id")
        fits = F.col("v") < room
        out = out.withColumn("v", F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit(f"more than {room} destinations")).cast("long")))
    return out.select(F.col("pos").alias("seq"), "u", "v", "t", "label", "msg", "w")


READERS |= {kind: (lambda spark, path, kind=kind: read_layout(spark, path, kind)) for kind in ("trade", "token", "subreddit", "datetime", "comment", "coin", "flight")}
