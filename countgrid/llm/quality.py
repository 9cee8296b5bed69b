"""Per-document text quality statistics and fixed-threshold rules with reasons.

Texts come in as Arrow batches. Lines are split once; every line statistic is an
array operation over the bytes of all lines of a batch (lookup tables summed
between line borders) or one vectorised regular expression, and lines are then
summed up per document. No Python code runs per line, word or character, and
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countgrid.llm.words import batches, joined, word_hash, words_of

# The eight words of the published stop-word rule.
RULE_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")
# Common function words of English, German, French and Spanish, for the share of common words.
COMMON_WORDS = (
    "the be to of and that have with a in is it for as was on are this by at from or an not but "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an "
    "le la les de des et est en un une du que qui dans pour sur pas au par plus "
    "el los las y es en un una que se del por con para al lo como más"
).split()

#: Thresholds of the published rules for web text (J. Rae et al., "Scaling Language
#: Models", 2021, appendix A) and, last, of the layouts asked for here.
RULES = {
    "words_min": 50,
    "words_max": 100_000,
    "mean_word_min": 3.0,
    "mean_word_max": 10.0,
    "symbol_ratio_max": 0.1,
    "bullet_lines_max": 0.9,
    "ellipsis_lines_max": 0.3,
    "alpha_words_min": 0.8,
    "common_words_min": 2,
    "layout_lines_min": 0.7,
}

SCHEMA = (
    "doc_id bigint, words bigint, mean_word_length double, lines bigint, symbol_share double, symbol_word_ratio double, punctuation_line_share double, "
    "bullet_line_share double, ellipsis_line_share double, alpha_word_share double, common_word_share double, common_words bigint, "
    "list_share double, table_share double, junk_share double, layout string, reasons array<string>"
)

# What some exports put before lines of text or output, and the forms of lines.
_EXPORT_PREFIX = r"^(?:#> ?|# )"
_BULLET = r"^(?:[-*+•–—·‣⁃◦▪▫■□●○☐☑☒✓✔→»>]|\(?[0-9]{1,3}[.):]|\(?[A-Za-z][.)]|\(?[ivxIVX]{1,4}[.)]|\[[ xX]\])(?:[ \t]+\[[ xX]\])?[ \t]+\S"
_CELL = r"[^\s|,;&\t=(){}\[\]'\"<>]*(?: [^\s|,;&\t=(){}\[\]'\"<>]+){0,2}"
# Table rows by the sign that sets their columns; rows of one table agree in the number of these signs.
_TABLES = (
    ("|", r"^\|.*\|$"),
    ("+", r"^\+[-=+]+\+$"),
    ("&", rf"^{_CELL}(?: *& *{_CELL})+ *\\\\$"),
    ("\t", rf"^{_CELL}(?:\t *{_CELL})+$"),
    (";", rf"^{_CELL}(?:; *{_CELL})+$"),
    (",", rf"^{_CELL}(?:, *{_CELL}){{2,}}$"),
)
_ALIGNED = r"^[^\s=(){}\[\]'\"<>]+(?: {2,}[^\s=(){}\[\]'\"<>]+)+$"
#: Columns in which neighbouring aligned rows may differ: values may be missing, and headers lack some.
_ALIGNED_SLACK = 2
#: Letters of a lone token in small letters from which it is no word.
LONG_WORD = 12
_HEX_DUMP = r"^(?:0x)?[0-9a-fA-F]{4,16}:?(?:\s+[0-9a-fA-F]{2,8}){4,}"
_ENCODED = r"^\S*[A-Za-z0-9+/=_\\%-]{32,}\S*$"
_FENCE = r"^`{3}"
_SENTENCE_END = r"[.!?…:;\"'»”。！？]$"


class _Classes:
    """What each byte of UTF-8 counts as, so that each character counts once.

    Continuation bytes count as nothing. Of the lead bytes, C2 begins the Latin-1
    signs and E2 the general punctuation, arrows, shapes and other signs; the
    others begin letters of other scripts.
    """

    def __init__(self) -> None:
        code = np.arange(256)
        self.ascii_letter = ((code >= 97) & (code <= 122)) | ((code >= 65) & (code <= 90))
        sign = (code == 0xC2) | (code == 0xE2)
        other = (code >= 0xC3) & ~sign
        self.letter = self.ascii_letter | other
        self.digit = (code >= 48) & (code <= 57)
        self.space = np.isin(code, [9, 10, 11, 12, 13, 32])
        self.symbol = ((code > 32) & (code < 127) & ~self.letter & ~self.digit) | sign
        self.vowel = np.isin(code, [ord(c) for c in "aeiouyAEIOUY"]) | other
        self.capital = (code >= 65) & (code <= 90)
        # lead byte of the Latin-1 signs, of which text read in a wrong encoding is full
        self.latin_sign = code == 0xC2


_CLASS = _Classes()


class Lines(NamedTuple):
    text: pa.Array  # stripped and without export prefix, only those that aren't blank
    raw: pa.Array  # stripped
    owner: np.ndarray


def lines_of(texts: pa.Array) -> Lines:
    """The lines that aren't blank, with the index of their text; CR, LF and CRLF end lines."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.replace_substring(pc.replace_substring(texts, "\r\n", "\n"), "\r", "\n")
    parts = pc.split_pattern(texts, "\n")
    owner = pc.list_parent_indices(parts).to_numpy()
    raw = pc.utf8_trim_whitespace(pc.list_flatten(parts).cast(pa.large_string()))
    full = pc.greater(pc.binary_length(raw), 0)
    raw = raw.filter(full)
    owner = owner[full.to_numpy(zero_copy_only=False)]
    bare = pc.utf8_trim_whitespace(pc.replace_substring_regex(raw, _EXPORT_PREFIX, ""))
    return Lines(bare, raw, owner)


def _matches(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


class ByteCounts:
    """Counts of byte classes per string of an array without nulls."""

    def __init__(self, strings: pa.Array):
        self.data = np.frombuffer(joined(strings), np.uint8)
        _, offsets, _ = strings.buffers()
        spots = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
        self.spots = spots - spots[0] if len(spots) else np.zeros(1, np.int64)

    def count(self, *tables: np.ndarray) -> list[np.ndarray]:
        """One array per class. Three counters share a word, as no string here has 2**21 bytes of one class; longer ones get a word each."""
        longest = int(np.diff(self.spots).max(initial=0))
        per_word = 3 if longest < 1 << 21 else 1
        out = []
        for first in range(0, len(tables), per_word):
            group = tables[first : first + per_word]
            table = sum(t.astype(np.uint64) << np.uint64(21 * k) for k, t in enumerate(group))
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(table[self.data], out=sums[1:])
            total = sums[self.spots[1:]] - sums[self.spots[:-1]]
            mask = np.uint64((1 << 21) - 1 if per_word > 1 else (1 << 63) - 1)
            out += [((total >> np.uint64(21 * k)) & mask).astype(np.int64) for k in range(len(group))]
        return out

    def distinct(self, rows: np.ndarray) -> np.ndarray:
        """How many distinct byte values (folded to 64) the given strings have."""
        bits = np.uint64(1) << (np.arange(256) % 64).astype(np.uint64)
        flags = bits[self.data]
        out = np.zeros(len(self.spots) - 1, np.int64)
        rows = rows[self.spots[rows + 1] > self.spots[rows]]
        if len(rows):
            pairs = np.stack([self.spots[rows], self.spots[rows + 1]], 1).ravel()
            flags = np.append(flags, np.uint64(0))
            out[rows] = np.bitwise_count(np.bitwise_or.reduceat(flags, pairs)[::2])
        return out


def _agrees(lines: Lines, rows: np.ndarray, columns: np.ndarray, slack: int = 0) -> np.ndarray:
    """Which of the ``rows`` have a row of about as many columns as the line before or after them in their text."""
    if len(rows) < 2:
        return np.zeros(len(rows), bool)
    pair = rows[1:] & rows[:-1] & (lines.owner[1:] == lines.owner[:-1]) & (np.abs(columns[1:] - columns[:-1]) <= slack)
    return np.concatenate([pair, [False]]) | np.concatenate([[False], pair])


def table_rows(lines: Lines) -> np.ndarray:
    """Lines whose columns, set by a sign or by alignment, agree with those of a line beside them."""
    text, out = lines.text, np.zeros(len(lines.text), bool)
    framed = _matches(text, _TABLES[0][1]) | _matches(text, _TABLES[1][1])
    for sign, pattern in _TABLES[2:]:
        rows = _matches(text, pattern)
        if rows.any():
            out |= _agrees(lines, rows, pc.count_substring(text, sign).to_numpy(zero_copy_only=False), 0 if sign == "," else 1)  # a last value may be missing
    rows = _matches(text, _ALIGNED)
    out |= _agrees(lines, rows, pc.count_substring_regex(text, r" {2,}").to_numpy(zero_copy_only=False), _ALIGNED_SLACK)
    return out | framed


def periodic(counts: ByteCounts, longest: int = 8) -> np.ndarray:
    """Strings that repeat a piece of at most ``longest`` bytes, nearly throughout."""
    data, spots = counts.data, counts.spots
    size = np.diff(spots)
    out = np.zeros(len(size), bool)
    for step in range(1, longest + 1):
        same = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data[step:] == data[:-step], out=same[1 : len(data) - step + 1]) if len(data) > step else None
        same[max(len(data) - step + 1, 0) :] = same[max(len(data) - step, 0)]
        pairs = np.maximum(size - step, 0)
        hits = same[spots[:-1] + pairs] - same[spots[:-1]]
        out |= (size >= 12) & (pairs >= 2 * step) & (hits >= 0.95 * pairs)
    return out


def classify_lines(lines: Lines) -> np.ndarray:
    """0 for running text, code and anything else, 1 for list entries, 2 for table rows, 3 for junk.

    Junk is told by classes of characters: more signs than letters and digits, signs of a wrong encoding,
    encoded or dumped bytes, letters almost without vowels, few distinct characters or a repeated piece,
    and lone tokens of letters that are longer than words or broken by quotes and brackets that don't close.
    """
    text = lines.text
    n = len(text)
    kind = np.zeros(n, np.int8)
    if not n:
        return kind
    size = pc.utf8_length(text).to_numpy(zero_copy_only=False)
    counts = ByteCounts(text)
    c = _CLASS
    letters, digits, symbols, spaces, ascii_letters, vowels, capitals, latin = counts.count(c.letter, c.digit, c.symbol, c.space, c.ascii_letter, c.vowel, c.capital, c.latin_sign)
    times = lambda sign: pc.count_substring(text, sign).to_numpy(zero_copy_only=False)
    is_list = _matches(text, _BULLET) & (size <= 80) & (letters >= 2)
    table = table_rows(lines)
    fence = _matches(text, _FENCE)
    body = letters + digits
    junk = (symbols > 2 * body) & (symbols >= 5)
    junk |= times("�") * 8 >= size
    junk |= (latin >= 3) & (latin * 6 >= size)
    junk |= _matches(text, _HEX_DUMP)
    junk |= (_matches(text, _ENCODED)) & (symbols <= 0.25 * size) & (size >= 40)
    junk |= (ascii_letters >= 6) & (vowels * 12 <= letters) & (digits <= letters)
    # lone tokens: letters alone, or with marks that code would close again
    lone = (spaces == 0) & (digits == 0) & (capitals == 0)
    brackets, quotes, stops = (times(s) for s in ("[", "'", ";"))
    closing = times("]")
    marks = brackets + closing + quotes + stops
    inner = _matches(text, r"[A-Za-z][;\]][A-Za-z]|[\[\];']{4}")
    junk |= lone & (letters >= 4) & (symbols == marks) & (marks > 0) & ((brackets != closing) | (quotes % 2 == 1) | inner)
    junk |= lone & (symbols == 0) & (letters >= LONG_WORD)
    long = np.nonzero(size >= 12)[0]
    junk |= (size >= 12) & (counts.distinct(long) <= 4) & (digits <= 0.5 * size)
    junk |= periodic(counts) & ~table
    grid = table & (_matches(text, r"^[|+][-=+:| ]+[|+]$"))
    kind[table] = 2
    kind[is_list] = 1
    kind[junk & ~grid & ~is_list] = 3
    kind[fence] = 0
    return kind


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def text_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: dict | None = None) -> DataFrame:
    """One row per input row: its statistics, its layout and the rules it fails.

    Words are runs of letters and digits; symbols are characters that are no
    letter, digit or white space; lines are those that aren't blank.
    ``symbol_word_ratio`` counts ``#`` and ellipses per word. ``layout`` is
    ``list``, ``table`` or ``junk`` where that sort of line reaches
    ``layout_lines_min`` of the lines, otherwise null. ``reasons`` names each rule
    that fails, in the order of ``RULES``; it is empty for text that passes.

    Defined results for odd input: null, empty and blank texts have counts and
    shares of 0, no layout and the one reason ``empty``; a null id stays null;
    repeated rows each give a row; other columns are ignored.
    """
    rules = RULES | (rules or {})
    common, ruled = (np.unique([word_hash(w) for w in words]) for words in (COMMON_WORDS, RULE_WORDS))

    def measure(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for first, texts in batches(frame.column(1)):
                yield _measure(frame.column(0).slice(first, len(texts)), texts, common, ruled, rules)

    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(measure, SCHEMA)


def _measure(ids: pa.Array, texts: pa.Array, common: np.ndarray, ruled: np.ndarray, rules: dict) -> pa.RecordBatch:
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    found = words_of(texts)
    words = np.diff(found.bounds)
    text_of_word = np.repeat(np.arange(n), words)
    per = lambda values: np.bincount(text_of_word, values, n)
    which = np.minimum(np.searchsorted(common, found.hashes), len(common) - 1)
    is_common = common[which] == found.hashes
    distinct_common = np.unique(text_of_word[is_common] * len(common) + which[is_common]) // len(common)
    is_ruled = np.isin(found.hashes, ruled)
    distinct_ruled = np.unique(np.stack([text_of_word[is_ruled].astype(np.uint64), found.hashes[is_ruled]], 1), axis=0)[:, 0].astype(np.int64)
    chars = ByteCounts(texts)
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    (symbols,) = chars.count(_CLASS.symbol)
    marks = pc.add(pc.count_substring(texts, "#"), pc.add(pc.count_substring(texts, "..."), pc.count_substring(texts, "…"))).to_numpy(zero_copy_only=False)
    # words without any letter: pure digit runs
    numbers = pc.count_substring_regex(texts, r"(?:^|[^\pL\pN])\pN+(?:[^\pL\pN]|$)").to_numpy(zero_copy_only=False)
    lines = lines_of(texts)
    kind = classify_lines(lines)
    of_line = lambda flag: np.bincount(lines.owner, flag, n) if len(lines.owner) else np.zeros(n)
    count = of_line(np.ones(len(kind)))
    punctuation = of_line(_matches(lines.raw, _SENTENCE_END))
    bullets = of_line(_matches(lines.text, _BULLET))
    ellipsis = of_line(_matches(lines.raw, r"(?:\.\.\.|…)$"))
    shares = [_share(of_line(kind == k), count) for k in (1, 2, 3)]
    stats = {
        "mean_word_length": _share(per(found.lengths), words),
        "symbol_share": _share(symbols, size),
        "symbol_word_ratio": _share(marks, words),
        "punctuation_line_share": _share(punctuation, count),
        "bullet_line_share": _share(bullets, count),
        "ellipsis_line_share": _share(ellipsis, count),
        "alpha_word_share": np.maximum(0.0, 1.0 - _share(numbers, words)) * (words > 0),
        "common_word_share": _share(per(is_common), words),
    }
    common_words = np.bincount(distinct_common, minlength=n)
    best = np.argmax(shares, axis=0)
    reach = np.max(shares, axis=0) >= rules["layout_lines_min"]
    layout = np.where(reach & (count > 0), np.array(["list", "table", "junk"], object)[best], None)
    fails = [
        ("words_min", words < rules["words_min"]),
        ("words_max", words > rules["words_max"]),
        ("mean_word_min", stats["mean_word_length"] < rules["mean_word_min"]),
        ("mean_word_max", stats["mean_word_length"] > rules["mean_word_max"]),
        ("symbol_ratio_max", stats["symbol_word_ratio"] > rules["symbol_ratio_max"]),
        ("bullet_lines_max", stats["bullet_line_share"] > rules["bullet_lines_max"]),
        ("ellipsis_lines_max", stats["ellipsis_line_share"] > rules["ellipsis_lines_max"]),
        ("alpha_words_min", stats["alpha_word_share"] < rules["alpha_words_min"]),
        ("common_words_min", np.bincount(distinct_ruled, minlength=n) < rules["common_words_min"]),
        *[(f"layout_{name}", layout == name) for name in ("list", "table", "junk")],
    ]
    names = np.array([name for name, _ in fails], object)
    failed = np.stack([f for _, f in fails], 1)
    reasons = [["empty"] if not lines_here else list(names[row]) for row, lines_here in zip(failed, count)]
    columns = [ids.cast(pa.int64()), words, stats["mean_word_length"], count.astype(np.int64), stats["symbol_share"], stats["symbol_word_ratio"], stats["punctuation_line_share"], stats["bullet_line_share"], stats["ellipsis_line_share"], stats["alpha_word_share"], stats["common_word_share"], common_words.astype(np.int64), *shares, pa.array(layout, pa.string()), pa.array(reasons, pa.list_(pa.string()))]
    fields = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], fields)
