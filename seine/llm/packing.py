"""Filling containers of fixed capacity with texts measured in tokens: minimum bin slack.

Lengths are tokenised once and kept in the shared folder. Items are dealt to shards by hash; a shard is sized in containers (its
expected load is ``bins_per_shard`` full containers) and in items (``items_per_shard``, for many short items in large containers),
so the work of one task is bounded at any input size, and the number of shards follows the totals. In a shard, each container starts with the longest item left; a subset-sum bitset over the available
lengths, built in falling order, finds the fullest combination that fits the rest (stopping as soon as nothing is left over); the
combination is read back from the stored bitsets and removed. Only the last container of a shard is likely to have room left.

Defined behaviour: an item longer than the capacity is split into full pieces and a remainder, any other item is never split;
null and empty texts have no tokens and are listed without a container; repeated rows are separate items; empty tables give no
rows; extra columns are ignored. The whole text is tokenised.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.runtime import checkpoint, ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's publisher cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS_PER_SHARD = 512
#: Items that one shard is expected to hold at most, whatever their size.
ITEMS_PER_SHARD = 100_000
#: Container kinds are a configuration table; a longer list is refused.
MAX_KINDS = 1_000


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_column: str, text_column: str, tokenizer_path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(id, n_tokens): tokens of each text; the vocabulary (under 1 MB) travels as a broadcast."""
    ship(df.sparkSession)
    with open(tokenizer_path, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[id_column].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary.value, pattern).encode_ordinary
        for b in batches:
            n = [0 if t is None else len(encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(count, f"id {kind.simpleString()}, n_tokens bigint")


def fill(lengths: list[int], capacity: int) -> list[int]:
    """Container number of each item (lengths 1..capacity), by minimum bin slack."""
    waiting: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        waiting.setdefault(n, []).append(i)
    sizes = sorted(waiting)  # rising; taken from the end
    out = [0] * len(lengths)
    number = 0
    while sizes:
        taken = [sizes[-1]]
        room = capacity - sizes[-1]
        if room and sizes[0] <= room:
            taken += _fullest(sizes, waiting, room, sizes[-1])
        for n in taken:
            out[waiting[n].pop()] = number
        for n in set(taken):
            if not waiting[n]:
                del waiting[n]
                del sizes[bisect_left(sizes, n)]
        number += 1
    return out


def _fullest(sizes: list[int], waiting: dict[int, list[int]], room: int, reserved: int) -> list[int]:
    """Lengths whose sum is the largest that fits ``room``; one item of length ``reserved`` is already used."""
    within = (1 << (room + 1)) - 1
    reachable, steps = 1, []
    k = bisect_left(sizes, room + 1) - 1
    while k >= 0 and not reachable >> room:
        n = sizes[k]
        for _ in range(min(len(waiting[n]) - (n == reserved), room // n)):
            grown = (reachable | reachable << n) & within
            if grown == reachable:
                break
            steps.append((n, reachable))
            reachable = grown
            if reachable >> room:
                break
        k -= 1
    total = reachable.bit_length() - 1
    taken = []
    for n, before in reversed(steps):
        if not before >> total & 1:
            taken.append(n)
            total -= n
    return taken


def pack(lengths: DataFrame, containers: DataFrame, kind: str, capacity: str, bins_per_shard: int = BINS_PER_SHARD, items_per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """Assign (id, n_tokens) to containers of each kind.

    Columns: container_kind, capacity_tokens, container_id, id, piece, token_from, n_tokens.
    """
    id_type = lengths.schema["id"].dataType.simpleString()
    ship(lengths.sparkSession)
    held = checkpoint(lengths)
    wanted = containers.select(F.col(kind).alias("container_kind"), F.col(capacity).cast("int").alias("capacity_tokens")).where("capacity_tokens > 0").distinct().limit(MAX_KINDS + 1).collect()
    if len(wanted) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of container")
    total, filled = held.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count_if(F.col("n_tokens") > 0)).first()
    by_items = -(-filled // items_per_shard)
    # the short list of kinds is written into the plan, so every item meets every kind without a join
    kinds = [F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity_tokens"), F.lit(max(1, by_items, -(-total // (c * bins_per_shard)))).cast("int").alias("shards")) for k, c in wanted]
    none = F.array().cast("array<struct<container_kind:string,capacity_tokens:int,shards:int>>")
    items = held.select("id", F.col("n_tokens").alias("length"), F.inline(F.array(*kinds) if kinds else none))
    full = F.floor(F.col("length") / F.col("capacity_tokens")).cast("long")
    whole = items.where("length >= capacity_tokens").select(
        "container_kind", "capacity_tokens", "id", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece")
    )
    whole = whole.select(
        "container_kind", "capacity_tokens", F.concat(F.lit("whole:"), F.col("id").cast("string"), F.lit(":"), F.col("piece").cast("string")).alias("container_id"), "id", F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * F.col("capacity_tokens")).alias("token_from"), F.col("capacity_tokens").cast("long").alias("n_tokens"),
    )
    rest = items.select(
        "container_kind", "capacity_tokens", "id", F.when(F.col("length") >= F.col("capacity_tokens"), full).otherwise(0).cast("int").alias("piece"),
        (F.col("length") % F.col("capacity_tokens")).alias("n_tokens"), (full * F.col("capacity_tokens")).alias("token_from"), "length",
        F.pmod(F.xxhash64("id", "container_kind"), F.col("shards")).cast("int").alias("shard"),
    )
    columns = f"container_kind string, capacity_tokens int, container_id string, id {id_type}, piece int, token_from bigint, n_tokens bigint"

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "id", "piece"], kind="stable")
        bins = fill(frame["n_tokens"].tolist(), int(frame["capacity_tokens"].iloc[0]))
        at = f"{int(frame['shard'].iloc[0])}:"
        return frame.assign(container_id=[at + str(b) for b in bins])[[c.split()[0] for c in columns.split(", ")]]

    packed = rest.where("n_tokens > 0").drop("length").groupBy("container_kind", "capacity_tokens", "shard").applyInPandas(shard, columns)
    empty = items.where("length = 0").select("container_kind", "capacity_tokens", F.lit(None).cast("string").alias("container_id"), "id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("token_from"), F.lit(0).cast("long").alias("n_tokens"))
    return packed.unionByName(whole).unionByName(empty)


def use_of_space(packed: DataFrame) -> DataFrame:
    """Per kind: containers used, tokens held, the fewest containers that could hold them, and the share of space used."""
    held = packed.where("container_id IS NOT NULL").groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("items"))
    return held.groupBy("container_kind", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.sum("held").alias("n_tokens"), F.ceil(F.sum("held") / F.col("capacity_tokens")).alias("fewest"), F.max("held").alias("fullest"),
        F.round(F.sum("held") / (F.count("*") * F.col("capacity_tokens")), 6).alias("used"),
    )


def invariants(packed: DataFrame, lengths: DataFrame, spare: float = 0.01) -> DataFrame:
    """Per kind, what must hold of any assignment: items seen, containers over capacity, items split without need, items whose
    pieces do not make up the whole text once, and whether the containers are within ``spare`` (and one) of the fewest possible."""
    kinds = ["container_kind", "capacity_tokens"]
    bins = packed.where("container_id IS NOT NULL").groupBy(*kinds, "container_id").agg(F.sum("n_tokens").alias("held"))
    per_kind = bins.groupBy(*kinds).agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("n_over"), F.count("*").alias("bins"), F.sum("held").alias("tokens"))
    pieces = packed.groupBy(*kinds, "id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"), F.max(F.col("token_from") + F.col("n_tokens")).alias("reach"), F.countDistinct("token_from").alias("begins"))
    items = pieces.join(lengths.groupBy("id").agg(F.sum("n_tokens").alias("whole")), "id")
    per_item = items.groupBy(*kinds).agg(
        F.count("*").alias("n_items"),
        F.count_if((F.col("pieces") > 1) & (F.col("whole") <= F.col("capacity_tokens"))).alias("n_split_needlessly"),
        F.count_if((F.col("placed") != F.col("whole")) | (F.col("reach") != F.col("whole")) | (F.col("begins") != F.col("pieces"))).alias("n_incomplete"),
    )
    tight = F.col("bins") <= F.ceil(F.col("tokens") / F.col("capacity_tokens") * (1 + spare)) + 1
    return per_item.join(per_kind, kinds).select(*kinds, "n_items", "n_over", "n_split_needlessly", "n_incomplete", tight.alias("tight"))
