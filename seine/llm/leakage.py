"""Held-out passages inside a training corpus, found by spaced-seed hashing.

A document leaks an item if it holds at least ``min_words`` consecutive words of the item in order, of which at most one is
changed, missing or added. Whichever word that is, the unbroken words on one of its sides number at least
``(min_words - 1) / 2`` rounded up; a seed of that span therefore falls on unbroken words of every leak. The seed's mask
ignores the token in its middle, so it also hits across one substituted word.

Both sides are hashed in Arrow batches. A Bloom filter of the items' seeds, of bounded size whatever their number, is all that is
broadcast: one pass over the corpus keeps the stretches of words around windows that pass it, and nothing else leaves the stage.
Stretches are then joined to the items by seed as ordinary tables (seeds that very many stretches share are salted), and each
pair of stretch and item is compared whole: a dynamic programme over all alignments, many pairs at a time, gives the most
consecutive words of the item with at most one edit. Equal stretches and equal items are compared once. Neither documents nor
items pass through the driver, the corpus is read once and never shuffled, and no text is cut or skipped.

Words are what stands between blanks or line ends and has a letter or digit, without case, punctuation, mark-up, line prefixes
and differences of look-alike characters. They are compared as 64-bit hashes.

Defined behaviour: null or empty texts and items shorter than ``min_words`` words give no rows; there is one row per document id
and item id, so repeated rows change nothing; an empty table gives no rows; extra columns are ignored; ids may be of any type,
also null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seine.llm.glyphs import decompositions, look_alikes
from seine.runtime import broadcast_if_small, checkpoint, ship

MIN_WORDS = 18
#: Bits of the Bloom filter per seed of the items, and at most (8 MB): beyond, more windows pass it and the join sorts them out.
BITS_PER_SEED = 32
MOST_BITS = 1 << 26
#: Stretches from which on a seed is joined in salted parts, and the number of parts.
HOT_SEED = 20_000
SALTS = 64
#: Mark-up: a tag with its attributes, over any length and line ends.
_TAG = re.compile(r"""</?[A-Za-z][\w:.-]*+(?:\s++[\w:.@-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++))?+)*+\s*+/?+>""")
#: Documents are hashed together up to this many bytes of words.
_CHUNK_BYTES = 1 << 20
#: Cells of one step of the dynamic programme.
_CELLS = 1 << 17
_STRETCHES = pa.schema([("words", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64())), ("content", pa.string())])


def mask_for(min_words: int) -> str:
    """Span of the seed guaranteed by one edit, its middle ignored."""
    span = min_words // 2
    if span < 3:
        raise ValueError("min_words must be at least 6")
    return "1" * (span // 2) + "0" + "1" * (span - span // 2 - 1)


class _Letters(dict):
    """Character -> its lower-case consistent form; nothing for what is no letter, digit or mark. Filled as met."""

    def __init__(self, alike: dict[str, str]) -> None:
        super().__init__()
        self._apart, self._alike = decompositions(), alike

    def __missing__(self, code: int) -> str:
        parts = self._apart.get(chr(code), chr(code))
        out = ""
        for c in parts:
            c = self._alike.get(c, c)
            if c.isspace():
                out += " "
            elif c.isalnum() or unicodedata.category(c)[0] == "M":
                out += c.lower()
        self[code] = out
        return out


_ASCII_LOWER = bytes(ord(chr(i).lower()) if i < 128 else i for i in range(256))
_ASCII_DROP = bytes(i for i in range(128) if not chr(i).isalnum() and not chr(i).isspace())


def normalised(text: str, letters: _Letters) -> bytes:
    """The words of a text in their consistent form, between blanks."""
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        return unicodedata.normalize("NFD", text).translate(letters).encode("utf-8", "replace")
    return text.encode().translate(_ASCII_LOWER, _ASCII_DROP)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every word: a polynomial in its bytes, mixed; the same in every process."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    letter = buffer > 32
    edge = np.flatnonzero(np.diff(letter, prepend=False))
    begins, ends = edge[::2], edge[1::2]
    if not len(begins):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = ends - begins
    first = np.cumsum(sizes) - sizes
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), factor, np.uint64))
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        h = np.add.reduceat((buffer[letter].astype(np.uint64) + np.uint64(1)) * powers[place], first)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return h.view(np.int64), np.searchsorted(np.cumsum(lengths), begins, "right")


class Seeds:
    """The spaced seed of a shortest leak: hashes of the windows of a sequence of words."""

    def __init__(self, min_words: int) -> None:
        mask = mask_for(min_words)
        self.span = len(mask)
        self.offsets = [i for i, m in enumerate(mask) if m == "1"]
        self.factors = np.random.default_rng(min_words).integers(1 << 20, 1 << 62, self.span, dtype=np.int64) | 1

    def of(self, h: np.ndarray) -> np.ndarray:
        n = len(h) - self.span + 1
        if n <= 0:
            return np.empty(0, np.int64)
        with np.errstate(over="ignore"):
            out = np.zeros(n, np.int64)
            for o in self.offsets:
                out += h[o : o + n] * self.factors[o]
            out ^= out >> 29
        return out


def _lists(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One list ``values[begin:end]`` per row."""
    sizes = ends - begins
    at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values[at]))


def _content(words: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(words.tobytes())


def _kept(batches: Iterator[pa.RecordBatch], alike: dict[str, str], min_words: int, flush) -> Iterator[pa.RecordBatch]:
    """Calls ``flush(ids, hashes, owners)`` for chunks of whole texts with enough words."""
    letters = _Letters(alike)
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, text in enumerate(batch.column(1).to_pylist()):
            t = normalised(text, letters)
            if len(t) >= 2 * min_words - 3:  # that many words need as many letters and the blanks between
                ids.append(batch.column(0)[i])
                texts.append(t)
                size += len(t)
            if size >= _CHUNK_BYTES:
                yield from flush(ids, *hash_words(texts))
                ids, texts, size = [], [], 0
    if texts:
        yield from flush(ids, *hash_words(texts))


def _rows(id_type: pa.DataType, ids: list, name: str, columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], id_type), *columns], schema=pa.schema([(name, id_type), *_STRETCHES]))


def _items_in(batches: Iterator[pa.RecordBatch], alike: dict[str, str], min_words: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(item_id, words, seeds, content) of the items that are long enough."""
    seeds = Seeds(min_words)

    def flush(ids: list, h: np.ndarray, owner: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.searchsorted(owner, np.arange(len(ids)), "right")
        begins = np.r_[0, ends[:-1]]
        long = np.flatnonzero(ends - begins >= min_words)
        own = [h[b:e] for b, e in zip(begins[long].tolist(), ends[long].tolist())]
        sown = [pa.array(np.unique(seeds.of(w))) for w in own]
        columns = [_lists(h, begins[long], ends[long]), pa.array([s.to_pylist() for s in sown], pa.list_(pa.int64())), pa.array([_content(w) for w in own], pa.string())]
        yield _rows(id_type, [ids[k] for k in long.tolist()], "item_id", columns)

    yield from _kept(batches, alike, min_words, flush)


def _passing(seeds: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """Places of the seeds whose two bits are set in the filter's bytes."""
    bits = 8 * len(bloom)
    at = np.arange(len(seeds))
    for p in (seeds & (bits - 1), (seeds >> 32) & (bits - 1)):
        p = p[at]
        at = at[(bloom[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
    return at


def _stretches_in(batches: Iterator[pa.RecordBatch], alike: dict[str, str], bloom: np.ndarray, min_words: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(doc_id, words, seeds, content) of every stretch of words around windows that pass the filter.

    A stretch reaches beyond its outermost windows by more words than a leak may have outside of seeds, so the longest overlap
    with an item always lies in one stretch.
    """
    seeds = Seeds(min_words)
    around = min_words + 1

    def flush(ids: list, h: np.ndarray, owner: np.ndarray) -> Iterator[pa.RecordBatch]:
        s = seeds.of(h)
        at = _passing(s, bloom)
        at = at[owner[at] == owner[at + seeds.span - 1]]  # no window reaches into the next document
        if not len(at):
            return
        ends = np.searchsorted(owner, np.arange(len(ids)), "right")
        doc = owner[at]
        low = np.maximum(np.r_[0, ends][doc], at - around)
        high = np.minimum(ends[doc], at + seeds.span + around)
        opens = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (low[1:] > high[:-1])])
        closes = np.r_[opens[1:], len(at)] - 1
        begins, finals = low[opens], high[closes]
        columns = [_lists(h, begins, finals), _lists(s[at], opens, closes + 1), pa.array([_content(h[b:e]) for b, e in zip(begins.tolist(), finals.tolist())], pa.string())]
        yield _rows(id_type, [ids[k] for k in doc[opens].tolist()], "doc_id", columns)

    yield from _kept(batches, alike, min_words, flush)


def longest_overlaps(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """For each pair of word sequences: the most consecutive words of the item found in the text with at most one edit.

    Pairs are laid side by side and the texts are read word by word. For every word of the item two lengths are kept: of the
    alignment that ends there without an edit, and with one (a changed, missing or added word).
    """
    out = np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda k: (len(items[k]), len(texts[k])))
    i = 0
    while i < len(order):
        take, width = 1, len(items[order[i]])
        while i + take < len(order) and len(items[order[i + take]]) * (take + 1) <= _CELLS and len(items[order[i + take]]) <= 2 * width:
            take += 1
        some = order[i : i + take]
        i += take
        n, m = max(len(items[k]) for k in some), max(len(texts[k]) for k in some)
        a, inside, b, reads = np.zeros((take, n), np.int64), np.zeros((take, n), bool), np.zeros((take, m), np.int64), np.zeros((take, m), bool)
        for r, k in enumerate(some):
            a[r, : len(items[k])], inside[r, : len(items[k])] = items[k], True
            b[r, : len(texts[k])], reads[r, : len(texts[k])] = texts[k], True
        clean = np.zeros((take, n + 1), np.int32)  # one column before the item's first word
        edited = np.ones((take, n + 1), np.int32)  # before the text's first word the item's word may be the missing one
        edited[:, 0] = 0
        most = np.zeros((take, n), np.int32)
        for j in range(m):
            same = (a == b[:, j : j + 1]) & reads[:, j : j + 1]
            grown = clean[:, :-1] + 1
            now = np.where(same, grown, 0)
            with_edit = np.maximum(np.where(same, edited[:, :-1] + 1, grown), clean[:, 1:])  # same, changed; added
            clean = np.concatenate([np.zeros((take, 1), np.int32), now], axis=1)
            np.maximum(with_edit, clean[:, :-1] + 1, out=with_edit)  # missing
            edited = np.concatenate([np.zeros((take, 1), np.int32), with_edit], axis=1)
            np.maximum(most, with_edit, out=most)
        out[some] = np.where(inside, most, 0).max(axis=1)
    return out


def _compared(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [[x.values.to_numpy() for x in batch.column(c)] for c in ("item_words", "doc_words")]
        n = longest_overlaps(*sides)
        leak = pa.array(n >= min_words)
        yield pa.RecordBatch.from_arrays([batch.column("item").filter(leak), batch.column("stretch").filter(leak), pa.array(n, pa.int32()).filter(leak)], names=["item", "stretch", "words"])


def _filter_of(sown: DataFrame) -> np.ndarray:
    """Bloom filter of the seeds, as bytes: built by grouping the bits of each 32-bit word, so its size alone bounds what is collected."""
    count = sown.select("seed").distinct().count()
    bits = min(MOST_BITS, 1 << max(16, (count * BITS_PER_SEED - 1).bit_length()))
    places = sown.select(F.explode(F.array(F.col("seed").bitwiseAND(F.lit(bits - 1)), F.shiftright("seed", 32).bitwiseAND(F.lit(bits - 1)))).alias("p"))
    words = places.groupBy(F.shiftright("p", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 31 AS INT))")).alias("b")).toArrow()
    filled = np.zeros(bits // 32, "<u4")
    filled[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    return filled.view(np.uint8)


def _salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: int, salts: int) -> DataFrame:
    """Equi-join in which keys that more than ``hot`` rows of ``left`` share are dealt to ``salts`` parts."""
    heavy = left.groupBy(*keys).count().where(F.col("count") > hot).select(*keys, F.lit(True).alias("heavy"))
    spread = right.join(heavy, keys, "left").withColumn("salt", F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1))))).drop("heavy")
    dealt = left.join(heavy, keys, "left").withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("stretch"), F.lit(salts)).cast("int")).otherwise(F.lit(-1))).drop("heavy")
    return dealt.join(spread, [*keys, "salt"]).drop("salt")


def _shared_seeds(stretches: DataFrame, items: DataFrame, hot: int, salts: int) -> DataFrame:
    """Distinct (stretch, item) with a common seed.

    Seeds that stand in the same items are one group, named by two hashes of its items: a passage that many stretches and many items
    hold is met once for each group instead of once for each of its seeds.
    """
    group = ["g1", "g2", "n_items"]
    left = stretches.select(F.col("content").alias("stretch"), F.explode(F.array_distinct("seeds")).alias("seed"))
    sown = items.select(F.col("content").alias("item"), F.explode("seeds").alias("seed"))
    groups = sown.groupBy("seed").agg(F.bit_xor(F.xxhash64("item")).alias("g1"), F.bit_xor(F.xxhash64(F.lit("second"), F.col("item"))).alias("g2"), F.count("*").alias("n_items"))
    met = _salted_join(left, groups, ["seed"], hot, salts).select("stretch", *group).distinct()
    holders = sown.join(groups, "seed").select(*group, "item").distinct()
    return _salted_join(met, holders, group, hot, salts).select("stretch", "item").distinct()


def leaks(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = MIN_WORDS, hot: int = HOT_SEED, salts: int = SALTS) -> DataFrame:
    """(doc_id, item_id, words) for every document that holds ``min_words`` words of an item with at most one edit.

    ``words`` is the length of the longest such overlap in words of the item.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = corpus.sparkSession
    ship(spark)
    alike = look_alikes(spark)
    wanted = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    docs = corpus.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")

    def schema(name: str, of: T.DataType) -> T.StructType:
        numbers = T.ArrayType(T.LongType())
        return T.StructType([T.StructField(name, of), T.StructField("words", numbers), T.StructField("seeds", numbers), T.StructField("content", T.StringType())])

    item_type, doc_type = wanted.schema["item_id"].dataType, docs.schema["doc_id"].dataType
    item_arrow, doc_arrow = to_arrow_type(item_type), to_arrow_type(doc_type)
    listed = checkpoint(wanted.mapInArrow(lambda it: _items_in(it, alike, min_words, item_arrow), schema("item_id", item_type)))
    bloom = spark.sparkContext.broadcast(_filter_of(listed.select(F.explode("seeds").alias("seed"))))
    met = checkpoint(docs.mapInArrow(lambda it: _stretches_in(it, alike, bloom.value, min_words, doc_arrow), schema("doc_id", doc_type)))

    stretches, distinct_items = met.dropDuplicates(["content"]), listed.dropDuplicates(["content"])
    pairs = _shared_seeds(stretches, distinct_items, hot, salts)
    sides = pairs.join(stretches.select(F.col("content").alias("stretch"), F.col("words").alias("doc_words")), "stretch").join(
        broadcast_if_small(distinct_items.select(F.col("content").alias("item"), F.col("words").alias("item_words"))), "item"
    )
    compared = sides.select("item", "stretch", "item_words", "doc_words").mapInArrow(lambda it: _compared(it, min_words), "item string, stretch string, words int")
    return (
        compared.join(met.select("doc_id", F.col("content").alias("stretch")), "stretch")
        .join(listed.select("item_id", F.col("content").alias("item")), "item")
        .groupBy("doc_id", "item_id")
        .agg(F.max("words").alias("words"))
    )
