"""File activity timelines from body rows: filter, unpivot, group, attribute join, order and rendering.

A body row is (row_no, md5, file, inode, mode, uid, gid, size, atime, mtime, ctime, crtime) with epoch seconds.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

FLAGS = "macb"
#: Fixed value: bits below the number of a partition in monotonically_increasing_id().
PLACE_BITS = 33
#: Fixed value: the first line of the CSV layout.
CSV_HEADER = "Date,Size,Type,Mode,UID,GID,Meta,File Name"


def sane(body: DataFrame, start: int = 0) -> DataFrame:
    """Rows whose numbers are numbers, with a time other than 0, and one not before start."""
    times = ["atime", "mtime", "ctime", "crtime"]
    some = F.lit(False)
    late = F.lit(False)
    for t in times:
        some, late = some | (F.col(t) != 0), late | (F.col(t) >= start)
    for c in ("inode", "uid", "gid", "size", *times):
        body = body.filter(F.col(c).isNotNull())
    return body.filter(some & late)


def events(body: DataFrame, start: int = 0, stop: int = 0) -> DataFrame:
    """(ts, inode, file, macb): one row for each time of a file, with the letters of the times it is.

    Times before start, at or after stop (0: none), or negative are left out. The unpivot is a projection
    and the letters are bits of a number, so partial aggregation, by hashes, goes before the shuffle.
    """
    return _grouped(sane(body, start), start, stop)


def _grouped(rows: DataFrame, start: int, stop: int, *carried: str) -> DataFrame:
    """events() of sane rows; carried columns are the same in all rows of a file."""
    stack = F.explode(F.array(*[F.struct(F.col(t).cast("long").alias("ts"), F.lit(1 << FLAGS.index(k)).alias("k")) for t, k in (("mtime", "m"), ("atime", "a"), ("ctime", "c"), ("crtime", "b"))])).alias("e")
    rows = rows.select(F.col("inode").cast("string").alias("inode"), "file", *carried, stack).select("e.ts", "e.k", "inode", "file", *carried).filter((F.col("ts") >= max(0, start)) & (F.lit(stop == 0) | (F.col("ts") < stop)))
    shown = F.concat(*[F.when(F.col("k").bitwiseAND(1 << n) != 0, F.lit(k)).otherwise(F.lit(".")) for n, k in enumerate(FLAGS)])
    return rows.groupBy("ts", "inode", "file").agg(F.bit_or("k").alias("k"), *[F.first(c).alias(c) for c in carried]).select("ts", "inode", "file", shown.alias("macb"), *carried)


def _attributes() -> Column:
    return F.struct("mode", F.col("uid").cast("string").alias("uid"), F.col("gid").cast("string").alias("gid"), "size")


def attributes(body: DataFrame, users: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(file, mode, uid, gid, size) of each file name: the last row with the name wins.

    users and groups (id, names) replace ids by names, white space by slashes; other ids stay.
    """
    last = sane(body).groupBy("file").agg(F.max_by(_attributes(), "row_no").alias("x")).select("file", "x.*")
    return _named(last, users, groups).select("file", "mode", "uid", "gid", "size")


def _named(rows: DataFrame, users: DataFrame | None, groups: DataFrame | None) -> DataFrame:
    for column, names in (("uid", users), ("gid", groups)):
        if names is not None:
            own = names.select(F.col("id").cast("string").alias(column), F.regexp_replace("names", r"\s", "/").alias("names")).dropDuplicates([column])
            rows = rows.join(own, column, "left").withColumn(column, F.coalesce("names", column)).drop("names")
    return rows


def names_by_id(lines: DataFrame) -> DataFrame:
    """(id, names) of passwd or group lines (value, row_no): `name:x:id:...`; lines with + in front are left out."""
    parts = F.split("value", ":")
    rows = lines.filter(~F.col("value").startswith("+")).select(F.try_element_at(parts, F.lit(3)).alias("id"), parts[0].alias("name"), "row_no").filter("id is not null")
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "name"))), lambda x: x["name"]), " ").alias("names"))


def zone(name: str) -> str:
    """The name of a time zone, or ValueError if it isn't one."""
    import zoneinfo

    try:
        zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError) as e:
        raise ValueError(f"invalid timezone: {name}") from e
    return name


def date_text(ts: Column, style: str = "unix", tz: str = "UTC") -> Column:
    """`Mon Jan 01 2024 00:00:00` (unix), with a month number (numeric) or `2024-01-01T00:00:00Z` (iso), in a time
    zone; the session's own is UTC. Time 0 is a row of zeros."""
    #: How the layouts write dates, and time 0.
    pattern, zero = {"unix": ("EEE MMM dd yyyy HH:mm:ss", "Xxx Xxx 00 0000 00:00:00"), "numeric": ("EEE MM dd yyyy HH:mm:ss", "Xxx Xxx 00 0000 00:00:00"), "iso": ("yyyy-MM-dd'T'HH:mm:ss'Z'", "0000-00-00T00:00:00Z")}[style]
    at = F.timestamp_seconds(ts)
    return F.when(ts == 0, F.lit(zero)).otherwise(F.date_format(at if tz == "UTC" else F.from_utc_timestamp(at, zone(tz)), pattern))


def timeline(body: DataFrame, start: int = 0, stop: int = 0, users: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Events with their file's attributes: those of the last row with the file's name.

    One shuffle by file serves both: a window adds the last attributes to each body row, and the events of a file
    are grouped where it already is."""
    rows = sane(body).withColumn("x", F.max_by(_attributes(), "row_no").over(Window.partitionBy("file")))
    return _named(_grouped(sane(rows, start), start, stop, "x").select("ts", "inode", "file", "macb", "x.*"), users, groups)


def ordered(rows: DataFrame) -> DataFrame:
    """A timeline in the order in which it is printed: by time, then the inode as text, then the name."""
    return rows.orderBy("ts", F.col("inode").cast("string"), "file")


def placed(rows: DataFrame) -> DataFrame:
    """A timeline with `place`, each row's number from 1 in ordered(); no task sees more than its part of the order.

    The sorted parts are written once, each row with its part and its number there, so that counting the parts and
    reading them see the same ones; what comes before each part is all that the driver holds."""
    at = "at" if "at" not in rows.columns else "_at"
    parts = stored(ordered(rows).withColumn(at, F.monotonically_increasing_id()), "ordered")
    part = F.shiftright(at, PLACE_BITS)
    counts = {r.part: r.n for r in parts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(k, 0)
    first = F.element_at(F.from_json(F.lit(json.dumps(before)), "array<bigint>"), (part + 1).cast("int"))
    return parts.select((first + F.col(at).bitwiseAND((1 << PLACE_BITS) - 1) + 1).alias("place"), *rows.columns)


def csv_lines(rows: DataFrame, style: str = "unix", tz: str = "UTC") -> DataFrame:
    """(ts, inode, file, line) in the CSV layout; quotes in file names are doubled."""
    line = F.concat_ws(",", date_text(F.col("ts"), style, tz), F.col("size").cast("string"), "macb", "mode", "uid", "gid", "inode", F.concat(F.lit('"'), F.replace("file", F.lit('"'), F.lit('""')), F.lit('"')))
    return rows.select("ts", "inode", "file", line.alias("line"))


def aligned_lines(rows: DataFrame, style: str = "unix") -> DataFrame:
    """(ts, inode, file, line) in the aligned layout: a date shows once, at the first row that has it.

    Rows with equal dates are rows with equal times, so the window goes by time and no task orders the
    whole timeline; orderBy("ts", "inode", "file") prints it.
    """
    date = date_text(F.col("ts"), style)
    first = F.row_number().over(Window.partitionBy("ts").orderBy("inode", "file")) == 1
    shown = F.when(first, date).otherwise(F.lit(" " * (20 if style == "iso" else 24)))
    line = F.format_string("%s %8s %3s %s %-8s %-8s %-8s %s", shown, F.col("size").cast("string"), "macb", "mode", "uid", "gid", "inode", "file")
    return rows.select("ts", "inode", "file", line.alias("line"))


def counts(rows: DataFrame, unit: str = "day") -> DataFrame:
    """(period, n) of events by day or hour; the period whose first event is at time 0 has no row."""
    at = F.date_trunc(unit, F.timestamp_seconds("ts"))
    return rows.groupBy(at.alias("period")).agg(F.count("*").alias("n"), F.min("ts").alias("first")).filter("first > 0").select("period", "n")


def index_lines(rows: DataFrame, unit: str = "day") -> DataFrame:
    """(period, line) of an index of the timeline: `Mon Jan 01 2024: 12`, by hour with the time."""
    pattern = {"day": "EEE MMM dd yyyy", "hour": "EEE MMM dd yyyy HH:mm:ss"}[unit]
    return counts(rows, unit).select("period", F.concat(F.date_format("period", pattern), F.lit(": "), F.col("n").cast("string")).alias("line"))


def iso_range(text: str) -> tuple[int, int]:
    """(start, stop) in epoch seconds of `date` or `date..date`, UTC; stop 0 is open. Others raise ValueError."""
    import datetime
    import re

    def parse(one: str) -> int:
        if not re.fullmatch(r"\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d)?", one):
            raise ValueError(f"Invalid Date: {one}")
        return int(datetime.datetime.fromisoformat(one).replace(tzinfo=datetime.UTC).timestamp())

    first, dots, last = text.partition("..")
    return parse(first), parse(last) if dots and last else 0
