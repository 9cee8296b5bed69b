"""Delimited text as the loaders read it: any of several separators, quotes, backslash escapes.

Unlike the strict loader of ``operators.reject``, quotes and escapes may occur anywhere in a field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Fields that a task splits at once.
FIELDS_AT_ONCE = 2_000_000


def _split(text: str, separators: str) -> list[str]:
    """The pieces of a text without quotes and escapes."""
    if len(separators) == 1:
        return text.split(separators)
    return re.split("[" + re.escape(separators) + "]", text) if separators else [text]


def _head(line: str, separators: str) -> tuple[list[str], str | None]:
    """The fields up to the last quote or escape of a line, and the plain text after the separator that ends them (None without one)."""
    last = max(line.rfind('"'), line.rfind("\\"))
    out, field, quoted, at = [], [], False, 0
    while at <= last:
        c = line[at]
        if c == "\\":
            at += 1
            if at >= len(line):
                raise ValueError("a line ends within an escape")
            field.append("\n" if line[at] == "n" else line[at])
        elif c == '"':
            quoted = not quoted
        elif c in separators and not quoted:
            out.append("".join(field))
            field = []
        else:
            field.append(c)
        at += 1
    end = min((e for c in separators if (e := line.find(c, at)) >= 0), default=-1) if not quoted else -1
    field.append(line[at:end] if end >= 0 else line[at:])
    out.append("".join(field))
    return out, line[end + 1 :] if end >= 0 else None


def tokenize(line: str, separators: str = ",", trim: bool = True) -> list[str]:
    """Fields of a line. A backslash takes the next of ``n``, a quote, a separator or a backslash literally."""
    out, rest = _head(line, separators)
    if rest is not None:
        out += _split(rest, separators)
    return [f.strip() for f in out] if trim else out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` (from 1) and ``line`` of text files, CR at line ends removed: the files of a folder by name, each in its order.

    Numbers come from one count per input split and no global sort; a file whose lines
    must be read as one unit isn't needed.
    """
    text = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    placed = text.select("line", "file", "start", F.monotonically_increasing_id().alias("at"))
    splits = placed.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).collect()  # one row per input split
    before, offsets = 0, []
    for split in sorted(splits, key=lambda r: (r["file"], r["start"])):
        offsets.append((split["file"], split["start"], before + 1 - split["first"]))
        before += split["n"]
    shifts = spark.createDataFrame(offsets, "file string, start bigint, shift bigint")
    return placed.join(F.broadcast(shifts), ["file", "start"]).select((F.col("at") + F.col("shift")).alias("line_no"), "line")


def header_of(lines: DataFrame, separators: str) -> list[str]:
    """Names of the 2nd to last column; the corner cell is optional, told by the width of line 2."""
    head = {r["line_no"]: r["line"] for r in lines.filter("line_no <= 2").collect()}
    if 1 not in head:
        raise ValueError("the file is empty")
    names = tokenize(head[1].removeprefix("﻿"), separators)
    width = len(tokenize(head[2], separators)) if 2 in head else len(names)
    if len(names) == width:
        return names[1:]
    if len(names) == width - 1:
        return names
    raise ValueError("the header doesn't fit the second line")


def _fields(lines: pa.Array, separators: str) -> tuple[np.ndarray, pa.Array]:
    """Bounds of the fields of each line, and all fields. What follows the last quote or escape of a line is split as columns."""
    odd = np.nonzero(pc.match_substring_regex(lines, r'["\\]').to_numpy(zero_copy_only=False))[0]
    any_of = "[" + "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in separators) + "]"
    heads = [_head(line, separators) for line in lines.take(pa.array(odd)).to_pylist()]
    if len(odd):
        is_odd = np.zeros(len(lines), bool)
        is_odd[odd] = True
        lines = pc.replace_with_mask(lines, pa.array(is_odd), pa.array([rest for _, rest in heads], lines.type))
    plain = pc.split_pattern(lines, separators) if len(separators) == 1 else pc.split_pattern_regex(lines, any_of)
    flat = pc.utf8_trim_whitespace(plain.flatten())
    if not len(odd):
        return plain.offsets.to_numpy() - plain.offsets[0].as_py(), flat
    after = pc.fill_null(pc.list_value_length(plain), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ahead = np.zeros(len(lines), np.int64)
    ahead[odd] = [len(fields) for fields, _ in heads]
    bounds = np.concatenate([[0], np.cumsum(ahead + after)])
    # fields of heads stand after all split ones
    place = np.arange(bounds[-1]) - np.repeat(np.cumsum(ahead), ahead + after)
    of_heads = np.repeat(bounds[:-1] - (np.cumsum(ahead) - ahead), ahead) + np.arange(ahead.sum())
    place[of_heads] = len(flat) + np.arange(ahead.sum())
    flat = pa.concat_arrays([flat, pc.utf8_trim_whitespace(pa.array([x for fields, _ in heads for x in fields], flat.type))])
    return bounds, flat.take(pa.array(place))


def long_rows(lines: DataFrame, separators: str, width: int, without: tuple[str, ...] = (), within: range | None = None) -> DataFrame:
    """``line_no, name, position, text`` of every field after the first but those ``without``, at the positions ``within`` if given; a line of another width fails."""

    def parse(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            step = max(1, FIELDS_AT_ONCE // (width + 1))
            for at in range(0, frame.num_rows, step):
                part = frame.slice(at, step)
                numbers, texts = part.column(0).to_numpy(), part.column(1)
                bounds, fields = _fields(texts, separators)
                bad = np.nonzero((np.diff(bounds) != width + 1) | pc.equal(texts, "").to_numpy(zero_copy_only=False))[0]
                if len(bad):
                    raise ValueError(f"line {numbers[bad[0]]} has {bounds[bad[0] + 1] - bounds[bad[0]]} fields instead of {width + 1}")
                index = np.arange(len(fields))
                rest = index % (width + 1) > 0
                if without:
                    gone = pc.is_in(fields, pa.array(without, fields.type)).to_numpy(zero_copy_only=False)
                    if within is not None:
                        position = index % (width + 1) - 1
                        gone &= (position >= within.start) & (position < within.stop)
                    rest &= ~gone
                rest = index[rest]
                row = rest // (width + 1)
                names = fields.take(pa.array(row * (width + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(numbers[row]), names.cast(pa.string()), pa.array((rest % (width + 1) - 1).astype(np.int32)), fields.take(pa.array(rest)).cast(pa.string())], ["line_no", "name", "position", "text"])

    return lines.filter("line_no > 1").mapInArrow(parse, "line_no bigint, name string, position int, text string")


def row_names(lines: DataFrame, separators: str) -> DataFrame:
    """``line_no, name``: the first field of every line after the header."""

    def parse(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            names = [_first(line, separators) for line in frame.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(names, pa.string())], ["line_no", "name"])

    return lines.filter("line_no > 1").mapInArrow(parse, "line_no bigint, name string")


def _first(line: str, separators: str) -> str:
    """The first field; a separator before any quote or escape ends it, whatever follows."""
    end = min((at for c in separators if (at := line.find(c)) >= 0), default=len(line))
    field, quoted, at = [], False, 0
    if not any(c in line[:end] for c in '"\\'):
        return line[:end].strip()
    while at < len(line) and (quoted or line[at] not in separators):
        if line[at] == "\\":
            at += 1
            if at >= len(line):
                raise ValueError("a line ends within an escape")
            field.append("\n" if line[at] == "n" else line[at])
        elif line[at] == '"':
            quoted = not quoted
        else:
            field.append(line[at])
        at += 1
    return "".join(field).strip()


def open_table(spark: SparkSession, path: str, separators: str = ",") -> tuple[DataFrame, list[str]]:
    """The numbered lines of a table file, and its column names."""
    lines = numbered_lines(spark, path)
    return lines, header_of(lines, separators)


def read_long(spark: SparkSession, path: str, separators: str = ",") -> tuple[DataFrame, list[str]]:
    """The cells of a table file in long form, and its column names."""
    lines, names = open_table(spark, path, separators)
    return long_rows(lines, separators, len(names)), names
