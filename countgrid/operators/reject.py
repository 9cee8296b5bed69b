"""Loading delimited lines: valid ones as typed rows, the others with a reason.

Lines of one file are parsed in blocks on a columnar path (Arrow kernels over the
whole block). A block on which a check of that path fails is halved, again and again,
until its bad lines stand alone; whether a half fails too is read off the running count
of the lines that the check flagged, so that no half is parsed for it. Only the isolated
lines are read by the strict parser, which names the reasons; the others rejoin, and
go on along the columnar path.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countgrid.functions.values import DATE_PATTERN, DECIMAL_PATTERN, FALSE_WORDS, INTEGER_PATTERN, MISSING, TRUE_WORDS, field_key
from countgrid.session import spread

BLOCK_LINES = 2048
#: Bytes of lines held to parse lines of one layout together.
HELD_BYTES = 32_000_000
#: Where a check can't flag lines, a failing block of at most so many goes to the strict parser.
LEAF_LINES = 32
_MARK = "\x1f"

PARSED = (
    "line_id bigint, file_id int, line_no int, file_kind string, reason string, name string, "
    "counts array<double>, fields array<string>, field_names array<string>, field_types array<string>"
)


class Failed(Exception):
    """The columnar path can't vouch for every line of a block: not for those of ``flags``, or it can't tell which."""

    def __init__(self, flags: np.ndarray | None = None):
        self.flags = flags


def _require(good: pa.Array | np.ndarray) -> None:
    """Failed with the lines for which ``good`` is false or null."""
    bad = ~(good if isinstance(good, np.ndarray) else pc.fill_null(good, False).to_numpy(zero_copy_only=False))
    if bad.any():
        raise Failed(bad)


# --- the strict parser -------------------------------------------------------


def split_strict(line: str, separators: str) -> list[str] | None:
    """The fields of one line without outer blanks, or None where the quoting is broken."""
    blanks = "".join(b for b in " \t" if b not in separators)
    fields, at, n = [], 0, len(line)
    while True:
        start = at
        while at < n and line[at] in blanks:
            at += 1
        if at < n and line[at] == '"':
            at += 1
            text = []
            while at < n and line[at] != '"':
                if line[at] == "\\":
                    at += 1
                    if at >= n or line[at] not in '"\\':
                        return None
                text.append(line[at])
                at += 1
            if at >= n:
                return None
            at += 1
            while at < n and line[at] in blanks:
                at += 1
            if at < n and line[at] not in separators:
                return None
            fields.append("".join(text).strip(" \t"))
        else:
            at = start
            while at < n and line[at] not in separators:
                if line[at] in '"\\':
                    return None
                at += 1
            fields.append(line[start:at].strip(" \t"))
        if at >= n:
            return fields
        at += 1


def is_missing(text: str) -> bool:
    return text == "" or text.lower() in MISSING


def readable(text: str, value_type: str) -> bool:
    if value_type == "integer":
        return re.fullmatch(INTEGER_PATTERN, text) is not None
    if value_type == "decimal":
        return re.fullmatch(DECIMAL_PATTERN, text) is not None
    if value_type == "boolean":
        return text.lower() in TRUE_WORDS + FALSE_WORDS
    if value_type == "date":
        if re.fullmatch(DATE_PATTERN, text) is None:
            return False
        try:
            dt.date(*map(int, text.split("-")))
        except ValueError:
            return False
    return True


def diagnose(line: str, kind: str, separators: str, n_fields: int, types: list[str]) -> tuple[str | None, list[str]]:
    """The first reason that applies to a line without its line end, and its fields."""
    fields = split_strict(line, separators)
    if fields is None:
        return "quoting", []
    if len(fields) != n_fields:
        return "column_count", fields
    if fields[0] == "":
        return "value", fields
    for k, text in enumerate(fields[1:]):
        if kind == "ExpressionMatrix":
            if not readable(text, "decimal") or float(text) < 0:
                return "value", fields
        elif not is_missing(text) and not readable(text, types[k] if k < len(types) else "string"):
            return "value", fields
    return None, fields


# --- the columnar path -------------------------------------------------------


@lru_cache(maxsize=64)
def _patterns(separators: str) -> tuple[str, str]:
    """What a line with sound quoting looks like, and one field of a line that ends with a separator."""
    any_of = "[" + "".join("\\" + c if not c.isalnum() and c not in "\t " else c for c in separators) + "]"
    plain = "[^\"\\\\" + any_of[1:-1] + "]*"
    blanks = "".join(b for b in " \t" if b not in separators)
    pad = f"[{blanks}]*" if blanks else ""
    quoted = rf'{pad}"((?:[^"\\]|\\["\\])*)"{pad}'
    field = f"(?:{quoted}|({plain}))"
    return rf"^{field}(?:{any_of}{field})*$", f"{field}{any_of}"


def split_block(lines: pa.Array, separators: str, n_fields: int) -> list[pa.Array]:
    """One array per column, or Failed if any line isn't sound."""
    sound, one = _patterns(separators)
    _require(pc.invert(pc.match_substring(lines, _MARK)))
    special = pc.any(pc.match_substring_regex(lines, r'["\\]')).as_py()
    if special:
        _require(pc.match_substring_regex(lines, sound))
        closed = pc.binary_join_element_wise(lines, separators[0], "")
        parts = pc.split_pattern(pc.replace_substring_regex(closed, one, rf"\1\2{_MARK}"), _MARK)
        extra = 1
    elif len(separators) == 1:
        parts, extra = pc.split_pattern(lines, separators), 0
    else:
        parts, extra = pc.split_pattern_regex(lines, "[" + "".join("\\" + c if not c.isalnum() and c not in "\t " else c for c in separators) + "]"), 0
    _require(pc.equal(pc.list_value_length(parts), n_fields + extra))
    flat = pc.utf8_trim(pc.list_flatten(parts), " \t")
    if special:
        flat = pc.replace_substring_regex(flat, r'\\(["\\])', r"\1")
    rows = len(lines)
    at = np.arange(rows) * (n_fields + extra)
    return [flat.take(pa.array(at + k)) for k in range(n_fields)]


def readable_values(values: pa.Array, value_type: str) -> np.ndarray:
    """Which values are missing or readable as the type."""
    if value_type not in ("integer", "decimal", "boolean", "date") or not len(values):
        return np.ones(len(values), bool)
    low = pc.utf8_lower(values)
    good = pc.is_in(low, pa.array(("", *MISSING)))
    if value_type == "boolean":
        good = pc.or_(good, pc.is_in(low, pa.array(TRUE_WORDS + FALSE_WORDS)))
    else:
        pattern = {"integer": INTEGER_PATTERN, "decimal": DECIMAL_PATTERN, "date": DATE_PATTERN}[value_type]
        shaped = pc.match_substring_regex(values, rf"\A(?:{pattern})\z")
        if value_type == "date":
            shaped = pc.and_(shaped, pc.invert(pc.starts_with(values, "0000")))
            try:
                values.filter(shaped).cast(pa.date32())
            except pa.ArrowInvalid:  # some day doesn't exist
                days = [readable(t, "date") for t in values.filter(shaped).to_pylist()]
                flags = shaped.to_numpy(zero_copy_only=False).copy()
                flags[flags] = days
                shaped = pa.array(flags)
        good = pc.or_(good, shaped)
    return good.to_numpy(zero_copy_only=False)


def parse_block(lines: pa.Array, kind: str, separators: str, n_fields: int, types: list[str] | np.ndarray) -> tuple[list[pa.Array], np.ndarray | None]:
    """Columns of text and, for count files, the matrix of numbers; Failed if any line is bad.

    ``types`` are those of the fields after the first: of all lines, or a row for each line.
    """
    columns = split_block(lines, separators, n_fields)
    good = pc.not_equal(columns[0], "").to_numpy(zero_copy_only=False)
    if n_fields == 1:
        _require(good)
        return columns, np.zeros((len(lines), 0)) if kind == "ExpressionMatrix" else None
    texts = pa.concat_arrays(columns[1:])
    if kind == "ExpressionMatrix":
        shaped = pc.match_substring_regex(texts, rf"\A(?:{DECIMAL_PATTERN})\z").to_numpy(zero_copy_only=False)
        _require(good & shaped.reshape(n_fields - 1, -1).all(axis=0))
        try:
            numbers = pc.replace_substring_regex(texts, r"^\+", "").cast(pa.float64()).to_numpy().reshape(n_fields - 1, -1)
        except pa.ArrowInvalid:
            raise Failed from None
        _require((numbers >= 0).all(axis=0))
        return columns, numbers.T
    if isinstance(types, list):
        types = np.broadcast_to(np.array((types + ["string"] * n_fields)[: n_fields - 1], object), (len(lines), n_fields - 1))
    kinds, fine = types.T.ravel(), np.ones(len(texts), bool)
    for value_type in ("integer", "decimal", "boolean", "date"):
        own = np.nonzero(kinds == value_type)[0]
        if len(own):
            fine[own] = readable_values(texts.take(pa.array(own)), value_type)
    _require(good & fine.reshape(n_fields - 1, -1).all(axis=0))
    return columns, None


# --- both together -----------------------------------------------------------


def _isolated(running: np.ndarray, low: int, high: int) -> Iterator[int]:
    """The flagged lines of a block, by halving the parts that hold any. ``running`` counts the flags before each line."""
    if running[high] == running[low]:
        return
    if high - low == 1:
        yield low
        return
    middle = (low + high) // 2
    yield from _isolated(running, low, middle)
    yield from _isolated(running, middle, high)


def _solve(lines: pa.Array, at: np.ndarray, info: tuple, good, strict) -> None:
    """Hands the lines ``at`` to ``good`` in bulk, but those that a check flags to ``strict``."""
    kind, separators, n_fields, types = info
    part = lines.take(pa.array(at))
    try:
        good(at, *parse_block(part, kind, separators, n_fields, types[at]))
    except Failed as failed:
        if failed.flags is not None:
            running = np.concatenate([[0], np.cumsum(failed.flags)])
            bad = np.fromiter(_isolated(running, 0, len(at)), np.int64)
            others = np.delete(at, bad)
        elif len(at) <= LEAF_LINES:
            bad, others = np.arange(len(at)), at[:0]
        else:
            for half in np.array_split(at, 2):
                _solve(lines, half, info, good, strict)
            return
        for k, line in zip(bad.tolist(), part.take(pa.array(bad)).to_pylist()):
            strict(int(at[k]), *diagnose(line, kind, separators, n_fields, types[at[k]].tolist()))
        if len(others):
            _solve(lines, others, info, good, strict)


_PASSED = ("line_id", "file_id", "line_no", "file_kind", "field_names", "field_types")
_SCHEMA = pa.schema([("line_id", pa.int64()), ("file_id", pa.int32()), ("line_no", pa.int32()), ("file_kind", pa.string()), ("reason", pa.string()), ("name", pa.string()), ("counts", pa.list_(pa.float64())), ("fields", pa.list_(pa.string())), ("field_names", pa.list_(pa.string())), ("field_types", pa.list_(pa.string()))])


def _rows(table: pa.Table, **made: pa.Array) -> pa.Table:
    """Rows of the result: columns passed on from ``table``, those ``made``, and nulls."""
    n = table.num_rows
    columns = {c: table[c] for c in _PASSED} | made
    return pa.table([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _lists(values: pa.Array, rows: int, width: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), values)


def _parse_run(table: pa.Table) -> pa.Table:
    """Parses lines of one layout. Good blocks stay columns all the way; only diagnosed lines become Python values."""
    kind, separators, n_fields = (table[c][0].as_py() for c in ("file_kind", "separator_chars", "n_fields"))
    if kind is None or not separators or n_fields is None:
        return _rows(table, reason=pa.array(["unknown_file"] * table.num_rows), field_names=pa.nulls(table.num_rows), field_types=pa.nulls(table.num_rows))
    lines = pc.replace_substring_regex(pc.fill_null(table["raw_line"].combine_chunks(), ""), r"\r\z", "")
    is_matrix = kind == "ExpressionMatrix"
    # Count lines have no types.
    types = _line_types(table, 0 if is_matrix else n_fields - 1)
    table = table.set_column(table.schema.get_field_index("field_types"), "field_types", pa.nulls(table.num_rows, pa.list_(pa.string()))) if is_matrix else table
    parts, odd = [], []

    def good(at: np.ndarray, columns: list[pa.Array], matrix: np.ndarray | None) -> None:
        n, width = len(columns[0]), len(columns) - 1
        if is_matrix:
            made = {"counts": _lists(pa.array(np.ascontiguousarray(matrix).ravel()), n, width)}
        else:
            by_column = pa.concat_arrays([pa.array([], columns[0].type), *columns[1:]])
            by_row = np.arange(n * width).reshape(width, n).T.ravel() if width else np.zeros(0, np.int64)
            made = {"fields": _lists(by_column.take(pa.array(by_row)), n, width)}
        parts.append(_rows(table.take(pa.array(at)), name=columns[0], **made))

    def strict(at: int, reason: str | None, fields: list[str]) -> None:
        odd.append((at, reason, fields))

    # Lines with quotes or backslashes need the costlier split.
    special = pc.match_substring_regex(lines, r'["\\]').to_numpy(zero_copy_only=False)
    for at in (np.nonzero(~special)[0], np.nonzero(special)[0]):
        if len(at):
            _solve(lines, at, (kind, separators, n_fields, types), good, strict)
    if odd:
        at, reasons, fields = zip(*odd)
        fine = [r is None for r in reasons]  # a good line beside bad ones, or one that holds the mark of the columnar path
        names = pa.array([f[0] if ok else None for ok, f in zip(fine, fields)], pa.string())
        rest = [f[1:] if ok else None for ok, f in zip(fine, fields)]
        made = {"counts": pa.array([None if f is None else [float(x) for x in f] for f in rest], pa.list_(pa.float64()))} if is_matrix else {"fields": pa.array(rest, pa.list_(pa.string()))}
        own = table.take(pa.array(at))
        shown = {c: pc.if_else(pa.array(fine), own[c].combine_chunks(), pa.scalar(None, own[c].type)) for c in ("field_names", "field_types")}
        parts.append(_rows(own, reason=pa.array(reasons, pa.string()), name=names, **made, **shown))
    return pa.concat_tables(parts)


def _line_types(table: pa.Table, width: int) -> np.ndarray:
    """The value types of each line's fields after the first, ``string`` where the file names none."""
    files, first, back = np.unique(table["file_id"].to_numpy(), return_index=True, return_inverse=True)
    known = [(table["field_types"][int(i)].as_py() or []) if width else [] for i in first]
    return np.array([(t + ["string"] * width)[:width] for t in known], object).reshape(len(files), width)[back]


_LAYOUT = ("file_kind", "separator_chars", "n_fields")


def _parse(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of files of one layout are parsed together; of those, as many as a few batches bring are held."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        codes = np.zeros(table.num_rows, np.int64)
        for c in _LAYOUT:
            column = table[c].combine_chunks().dictionary_encode()
            codes = codes * (len(column.dictionary) + 1) + pc.fill_null(column.indices, len(column.dictionary)).to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        borders = np.concatenate([[0], np.nonzero(np.diff(codes[order]))[0] + 1, [len(order)]])
        for low, high in zip(borders[:-1].tolist(), borders[1:].tolist()):
            for at in range(low, high, BLOCK_LINES):
                yield from _parse_run(table.take(pa.array(order[at : min(at + BLOCK_LINES, high)])).combine_chunks()).combine_chunks().to_batches()

    for frame in frames:
        held.append(frame)
        size += frame.nbytes
        if size > HELD_BYTES:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def file_layouts(lines: DataFrame, files: DataFrame, types: dict[str, str]) -> DataFrame:
    """Each file with the names and value types of its fields after the first, from its header line."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            out = {"file_id": [], "field_names": [], "field_types": []}
            for file_id, line, separators, n in zip(*[frame.column(c).to_pylist() for c in ("file_id", "header", "separator_chars", "n_fields")]):
                bare = (line or "").removeprefix("﻿").removesuffix("\r")
                names = split_strict(bare, separators) if separators else None
                if names is None:
                    names = re.split("[" + re.escape(separators or ",") + "]", bare)
                names = names[1:] if n is not None and len(names) >= n else names
                out["file_id"].append(file_id)
                out["field_names"].append(names)
                out["field_types"].append([types.get(x.strip(" \t").lower(), "string") for x in names])
            yield pa.RecordBatch.from_pydict(out, pa.schema([("file_id", pa.int32()), ("field_names", pa.list_(pa.string())), ("field_types", pa.list_(pa.string()))]))

    known = files.groupBy("file_id").agg(F.max(F.struct("file_kind", "separator_chars", "n_fields")).alias("f")).select("file_id", "f.*")
    headers = lines.filter("line_no = 1").groupBy("file_id").agg(F.min("raw_line").alias("header"))
    named = headers.join(known, "file_id").select("file_id", "header", "separator_chars", "n_fields").mapInArrow(read, "file_id int, field_names array<string>, field_types array<string>")
    return known.join(named, "file_id", "left")


def parse_lines(lines: DataFrame, files: DataFrame, types: dict[str, str]) -> DataFrame:
    """Every line but the headers, once per ``line_id``: typed where valid, with the reason where not.

    ``lines``: ``line_id, file_id, line_no, raw_line``. ``files``: ``file_id, file_kind``
    (``MetaData`` or ``ExpressionMatrix``), ``separator_chars, n_fields``. ``types`` gives
    the value types of named meta data fields. In the result ``reason`` is null for valid
    lines; those have ``name`` (the first field) and either ``counts`` or ``fields`` with
    ``field_names`` and ``field_types``.

    Defined results for odd input: a null line is a blank line; lines of files that
    aren't listed, or listed without kind, separators or width, fail as
    ``unknown_file``; fields of files without a header line are strings; a line sent
    again under its id counts once (of differing ones the smallest); rows with a null
    line or file id are left out, as is line number 1 of each file; further columns are
    ignored; empty tables give an empty result.
    """
    own = F.struct("file_id", "line_no", "raw_line")
    once = lines.filter("line_id IS NOT NULL AND file_id IS NOT NULL").groupBy("line_id").agg(F.min(own).alias("l")).select("line_id", "l.*")
    body = once.filter("line_no IS NULL OR line_no != 1")
    joined = body.join(file_layouts(lines, files, types), "file_id", "left")
    # A large file spreads over its blocks of lines.
    block = F.floor(F.coalesce("line_no", F.lit(0)) / BLOCK_LINES)
    placed = spread(joined.withColumn("block", block), "file_id", "block").sortWithinPartitions("file_id", "line_no")
    return placed.select("line_id", "file_id", "line_no", "file_kind", "separator_chars", "n_fields", "field_names", "field_types", "raw_line").mapInArrow(_parse, PARSED)


def typed_meta(parsed: DataFrame) -> DataFrame:
    """The valid meta data lines as one row per cell and field, with one column per type."""
    from countgrid.functions.values import typed

    rows = parsed.filter("reason IS NULL AND fields IS NOT NULL").select("file_id", "line_id", F.col("name").alias("cell_name"), F.explode(F.arrays_zip("field_names", "field_types", "fields")).alias("f"))
    rows = rows.select("file_id", "line_id", "cell_name", field_key(F.col("f.field_names")).alias("field"), F.col("f.field_types").alias("value_type"), F.col("f.fields").alias("text"))
    of = lambda kind: F.when(F.col("value_type") == kind, typed(F.col("text"), kind)).alias(f"{kind}_value")
    return rows.select("file_id", "line_id", "cell_name", "field", "value_type", *[of(kind) for kind in ("string", "integer", "decimal", "boolean", "date")])


def count_rows(parsed: DataFrame) -> DataFrame:
    """The valid lines of count files as one row per gene and cell with a count above zero."""
    rows = parsed.filter("reason IS NULL AND counts IS NOT NULL").select("file_id", "line_id", F.col("name").alias("gene_name"), F.explode(F.arrays_zip("field_names", "counts")).alias("c"))
    return rows.select("file_id", "line_id", "gene_name", F.col("c.field_names").alias("cell_name"), F.col("c.counts").alias("count")).filter("count > 0")
