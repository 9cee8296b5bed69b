"""Filling containers of a fixed capacity with texts by sum-of-squares packing.

Sizes are tokens of a public tokenizer. A text goes where the sum over all
residual gaps of the squared number of open containers with that gap becomes
smallest; gaps of which there are few stay few, and so are filled (J. Csirik et
al., "On the Sum-of-Squares Algorithm for Bin Packing", 2006). Spark packs equal
shares of the items independently; the containers of a share that are not nearly
full are then opened again and their items packed in fewer, larger shares.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countgrid.llm.words import batches
from countgrid.session import Scratch

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits texts before byte-pair merges of that vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of one share, which one task packs.
SHARE_ITEMS = 50_000
#: A container whose gap is above this part of the capacity is opened again for the next pass.
OPEN_GAP = 0.01
#: Each pass has this many times fewer shares than the one before, as far as items remain.
PASSES = 3


@lru_cache(maxsize=2)
def _encoding(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("countgrid", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """``doc_id, n_tokens`` of every row; special tokens in a text are ordinary text, a null text has 0."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path)
        for frame in frames:
            for first, texts in batches(frame.column(1)):
                sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(first, len(texts)), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    wanted = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return wanted.mapInArrow(count, "doc_id bigint, n_tokens bigint")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item (1 to ``capacity`` in size), in the order given."""
    open_with = np.zeros(capacity + 1, np.int64)  # containers by gap; gap 0 isn't counted
    stacks: dict[int, list[int]] = {}
    out = np.empty(len(sizes), np.int64)
    containers = 0
    for i, size in enumerate(sizes.tolist()):
        # Change of the sum by moving one container from gap g to gap g - size, halved and without constants:
        # N(g - size) - N(g) + 1; to gap 0, where nothing is counted, it is -N(g) + 1/2.
        before = open_with[size:]
        change = (open_with[: capacity + 1 - size] - before + 1).astype(np.float64)
        change[0] = 0.5 - before[0]
        change[before == 0] = np.inf
        fresh = 0.0 if size == capacity else open_with[capacity - size] + 0.5
        at = int(change.argmin())
        if change[at] <= fresh:
            gap = at + size
            number = stacks[gap].pop()
            open_with[gap] -= 1
        else:
            gap = capacity
            number = containers
            containers += 1
        out[i] = number
        gap -= size
        if gap:
            open_with[gap] += 1
            stacks.setdefault(gap, []).append(number)
    return out


def pack_texts(sizes: DataFrame, capacity: int, *, share_items: int = SHARE_ITEMS, passes: int = PASSES, open_gap: float = OPEN_GAP) -> DataFrame:
    """``sizes`` (``doc_id, n_tokens``) into containers: ``container, doc_id, piece, first_token, tokens``.

    A text larger than ``capacity`` is split into full pieces and a rest; others stay
    whole. Container ids are text, unique in the result. Within a share larger items
    come first. Defined results for odd input: texts without tokens take no room
    and have a null container; null ids are packed like others; repeated rows are
    packed each; an empty table gives an empty result; a capacity below 1 is an error.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    scratch = Scratch(sizes.sparkSession, "packing")
    n = F.coalesce("n_tokens", F.lit(0)).cast("bigint")
    last_piece = F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("int")
    cut = sizes.select("doc_id", F.explode(F.sequence(F.lit(0), last_piece)).alias("piece"), n.alias("n"))
    items = cut.select("doc_id", "piece", (F.col("piece") * F.lit(capacity)).cast("bigint").alias("first_token"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint").alias("tokens"))
    items = scratch.keep(items)
    full = items.filter(F.col("tokens") == capacity)
    empty = items.filter("tokens = 0").select(F.lit(None).cast("string").alias("container"), "doc_id", "piece", "first_token", "tokens")
    done = [empty, full.select(F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "piece", F.monotonically_increasing_id()).alias("container"), "doc_id", "piece", "first_token", "tokens")]
    todo = items.filter((F.col("tokens") > 0) & (F.col("tokens") < capacity))
    count = todo.count()
    shares = max(1, -(-count // share_items))
    for number in range(passes):
        last = number == passes - 1 or shares == 1
        packed = scratch.keep(_packed_shares(todo, shares, number, capacity, 1.0 if last else open_gap))
        done.append(packed.filter("container IS NOT NULL"))
        if last:
            break
        todo = packed.filter("container IS NULL").drop("container")
        left = todo.count()
        if not left:
            break
        shares = max(1, -(-left // share_items))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _packed_shares(items: DataFrame, shares: int, number: int, capacity: int, open_gap: float) -> DataFrame:
    """Packs each share; items of containers that stay too empty have no container yet."""

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        share = TaskContext.get().partitionId()
        table = pa.Table.from_batches([f for f in frames if f.num_rows] or [_EMPTY]).combine_chunks()
        if not table.num_rows:
            return
        table = table.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        tokens = table["tokens"].to_numpy()
        container = sum_of_squares(tokens, capacity)
        fill = np.bincount(container, tokens)
        closed = (capacity - fill <= open_gap * capacity)[container]
        names = pa.array(np.where(closed, np.char.add(f"{number}-{share}-", container.astype(str)).astype(object), None), pa.string())
        yield from pa.table({"container": names, **{c: table[c] for c in ("doc_id", "piece", "first_token", "tokens")}}).combine_chunks().to_batches()

    # Round robin gives equal shares whatever the ids are.
    spread = items.select("doc_id", "piece", "first_token", "tokens").repartition(shares)
    return spread.mapInArrow(pack, "container string, doc_id bigint, piece int, first_token bigint, tokens bigint")


_EMPTY = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], ["doc_id", "piece", "first_token", "tokens"])
