"""Same or nearly the same findings across splits, by a weighted cosine join.

Rows are brought to one spelling and copies collapsed to a class. A class is a vector of character trigrams of its two texts;
trigrams are hashed to a fixed number of terms, and a term's weight falls with the number of classes that hold it. Two texts
within the allowed typos share all but a bounded part of their weight: an edit touches at most three trigrams, so a partner's dot
product with ``x`` is at least ``|x|^2`` less the heaviest ``3 * typos`` squares of each text. That gives every vector its own
floor of the dot product, with no loss.

Inverted lists are kept per block (equal columns, equal digits, neighbouring lines and lengths) and term, training against
evaluation side: terms of no weight on the other side are left out (maximum-weight pruning), and a vector is entered only under its
heaviest terms until the norm of the rest is below its floor. The lists also hold the norm that remains after each term; from the
terms that two vectors share in the lists and what remains after the last of them a bound of their dot product is summed, and pairs
below either floor are dropped (residual-norm pruning). What is left gets its exact dot product, and pairs above both floors an exact
comparison of the texts. Class pairs are then expanded to rows and counted.

Vectors without a floor (texts of a few letters) could match without a common term: they also meet under the strings that are left
when as many letters as typos are allowed are deleted from the first text; two texts within that distance always share one.

Defined behaviour: rows with a null text, line or split (or a split that is on neither side) are in no pair; null in an equality
column equals nothing; repeated rows are separate rows; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.runtime import broadcast_if_small, checkpoint, ship

#: Checkout roots that may stand before a path, which then begins with a slash.
CHECKOUT_ROOTS = (r"^/+(?:workspace|workspaces|checkout|builds)/[^/]+/",)
TYPOS = 2
LINE_REACH = 3
#: Lines and characters per block; an evaluation row looks into each block within reach.
LINE_BLOCK = 16
SIZE_BLOCK = 16
#: Terms that trigrams are hashed to, a power of two; the table of their weights is the only one that passes the driver, and never longer.
TERMS = 1 << 18
#: Length up to which the first text of a vector without a floor is entered by deletions, and from which by its block alone.
_BY_DELETION, _BY_BLOCK = 18, 14
_GRAM = 3
_UNIT = 4096
# a term and its weight share 31 bits
_WEIGHT_BITS = 13
_WEIGHT_MASK = (1 << _WEIGHT_BITS) - 1
_CLASS = "n bigint, cid string, side int, line int, frame bigint, a string, b string"
_FULL = pa.schema(
    [("n", pa.int64()), ("cid", pa.string()), ("side", pa.int32()), ("line", pa.int32()), ("frame", pa.int64()), ("a", pa.string()), ("b", pa.string()), ("floor", pa.int64()), ("entered", pa.int32()), ("packed", pa.list_(pa.int32()))]
)
_LIST = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("side", pa.int32()), ("line", pa.int32()), ("la", pa.int32()), ("lb", pa.int32()), ("w", pa.int64()), ("rest", pa.int64()), ("floor", pa.int64())])


def _flat(text: Column, roots: tuple[str, ...]) -> Column:
    """Escapes opened, one separator, no blanks, lower case, no root."""
    opened = F.when(text.contains("%"), F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)).otherwise(text)
    flat = F.lower(F.translate(opened, "\\ \t\n\x0b\f\r", "/"))
    for root in roots:
        flat = F.regexp_replace(flat, root, "")
    return flat


def _straight(flat: Column) -> Column:
    """Without detours and outer slashes; only a text that has some is taken apart."""
    empty = F.array().cast("array<string>")

    def step(seen: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(seen) > 0)
        return F.when(part.isin("", "."), seen).when(up, F.slice(seen, 1, F.size(seen) - 1)).otherwise(F.concat(seen, F.array(part)))

    bent = F.concat(F.lit("/"), flat, F.lit("/"))
    return F.when(bent.contains("//") | bent.contains("/./") | bent.contains("/../"), F.array_join(F.aggregate(F.split(flat, "/"), empty, step), "/")).otherwise(flat)


def spelling(text: Column, roots: tuple[str, ...] = CHECKOUT_ROOTS) -> Column:
    """One spelling of a path or name: escapes opened, one separator, no blanks, lower case, no root, detours or outer slash."""
    return F.transform(F.array(_flat(text, roots)), _straight)[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads whole numbers over 64 bits, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, np.diff(group) != 0]) if len(group) else np.empty(0, np.int64)


def _before(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the earlier values of the same run of equal groups."""
    before = np.cumsum(values) - values
    starts = _starts(group)
    return before - np.repeat(before[starts], np.diff(np.r_[starts, len(group)]))


def _terms(batch: pa.RecordBatch, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every distinct term of both texts, in order; the lowest bit of a term names the text."""
    found, bits = [], terms.bit_length() - 1
    for number, column in enumerate(("a", "b")):
        marked = [f"^{t}$" if t else "" for t in batch.column(column).to_pylist()]
        letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(letters) < _GRAM:
            continue
        rows = np.repeat(np.arange(len(marked), dtype=np.int64), np.fromiter(map(len, marked), np.int64, len(marked)))
        # three code points of 21 bits make one number; grams across two texts are left out
        grams = (letters[:-2] << np.uint64(42)) | (letters[1:-1] << np.uint64(21)) | letters[2:]
        inside = rows[2:] == rows[:-2]
        hashed = (_mix(grams[inside]) & np.uint64(terms // 2 - 1)).view(np.int64)
        found.append((rows[:-2][inside] << bits) + hashed * 2 + number)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    flat = np.sort(np.concatenate(found))
    flat = flat[np.r_[True, flat[1:] != flat[:-1]]]
    return flat >> bits, flat & (terms - 1)


def _holders(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    """How many classes of the partition hold each term, and on which sides."""
    df, evaluation = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
    for batch in batches:
        rows, found = _terms(batch, terms)
        df += np.bincount(found, minlength=terms)
        evaluation += np.bincount(found[batch.column("side").to_numpy()[rows] == 1], minlength=terms)
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held, df[held], evaluation[held] < df[held], evaluation[held] > 0)], names=["term", "df", "train", "eval"])


def _vectors(batches: Iterator[pa.RecordBatch], squares: np.ndarray, met: np.ndarray, lost: int, terms: int) -> Iterator[pa.RecordBatch]:
    """Classes with their floor, their terms that the other side holds (heaviest first, weight in the low bits), and how many of them are entered."""
    bits = terms.bit_length() - 1
    for batch in batches:
        n = batch.num_rows
        rows, found = _terms(batch, terms)
        # one order of terms for all vectors: by weight, then by number
        order = np.sort((((rows << _WEIGHT_BITS) + (_UNIT - squares[found])) << bits) + found)
        found, order = order & (terms - 1), order >> bits
        rows, w = order >> _WEIGHT_BITS, _UNIT - (order & _WEIGHT_MASK)
        floor = np.bincount(rows, w, n).astype(np.int64)
        for number in (0, 1):
            r, x = rows[found & 1 == number], w[found & 1 == number]
            heavy = _before(r, np.ones(len(r), np.int64)) < lost
            floor -= np.bincount(r[heavy], x[heavy], n).astype(np.int64)
        shared = met[found]
        rows, found, w = rows[shared], found[shared], w[shared]
        reach = np.bincount(rows, w, n).astype(np.int64)
        entered = np.bincount(rows, _before(rows, w) <= (reach - floor)[rows], n).astype(np.int32)
        packed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=n))].astype(np.int32)), pa.array(((found << _WEIGHT_BITS) + w).astype(np.int32)))
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor), pa.array(entered), packed], schema=_FULL)
        yield out.filter(pa.array(reach >= floor))


def _blocks(side: np.ndarray, frame: np.ndarray, line: np.ndarray, la: np.ndarray, lb: np.ndarray, typos: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their block) for each way to look: a training row stands in one block, an evaluation row looks into all within reach."""
    ways = []
    for value, reach, width in ((line, LINE_REACH, LINE_BLOCK), (la, typos, SIZE_BLOCK), (lb, typos, SIZE_BLOCK)):
        low, high = (np.where(side == 1, value + d, value) // width for d in (-reach, reach))
        ways.append(((low, np.ones(len(side), bool)), (high, low != high)))
    out = []
    for some in product(*ways):
        rows = np.flatnonzero(np.logical_and.reduce([valid for _, valid in some]))
        block = frame[rows].view(np.uint64)
        for slot, _ in some:
            block = _mix(block ^ slot[rows].astype(np.int64).view(np.uint64))
        out.append((rows, block))
    return out


def _deletions(text: str, typos: int) -> set[str]:
    """What is left of a text when up to ``typos`` letters are deleted."""
    return {"".join(c for i, c in enumerate(text) if i not in gone) for k in range(typos + 1) for gone in combinations(range(len(text)), k)}


def _listed(batches: Iterator[pa.RecordBatch], typos: int) -> Iterator[pa.RecordBatch]:
    """Entries of the inverted lists: block and term in one number, the term's weight and the norm that remains after it."""
    for batch in batches:
        numbers = {c: batch.column(c).to_numpy() for c in ("n", "side", "line", "frame", "floor", "entered")}
        texts = {c: batch.column(c).to_pylist() for c in ("a", "b")}
        la, lb = (np.fromiter(map(len, texts[c]), np.int64, batch.num_rows) for c in ("a", "b"))
        packed = batch.column("packed")
        flat, sizes = packed.flatten().to_numpy(), np.diff(packed.offsets.to_numpy())
        rows = np.repeat(np.arange(batch.num_rows), sizes)
        w = (flat & _WEIGHT_MASK).astype(np.int64)
        rest = np.bincount(rows, w, batch.num_rows).astype(np.int64)[rows] - _before(rows, w) - w
        kept = _before(rows, np.ones(len(rows), np.int64)) < numbers["entered"][rows]
        rows, term, w, rest = rows[kept], (flat[kept] >> _WEIGHT_BITS).astype(np.uint64), w[kept], rest[kept]
        # vectors without a floor
        more: list[tuple[int, int]] = []
        for r in np.flatnonzero(numbers["floor"] <= 0).tolist():
            if la[r] <= _BY_DELETION:
                more += [(r, xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))) for t in _deletions(texts["a"][r], typos)]
            if la[r] > _BY_BLOCK:
                more.append((r, 0))
        if more:
            extra, keys = np.array([m[0] for m in more]), np.array([m[1] for m in more], np.uint64)
            rows, term = np.r_[rows, extra], np.r_[term, keys | np.uint64(1 << 63)]
            w, rest = np.r_[w, np.zeros(len(extra), np.int64)], np.r_[rest, np.full(len(extra), 1 << 60)]
        spread = _mix(term + np.uint64(1))
        at = np.argsort(rows, kind="stable")
        rows, spread, w, rest = rows[at], spread[at], w[at], rest[at]
        ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=batch.num_rows))]
        for some, block in _blocks(numbers["side"], numbers["frame"], numbers["line"], la, lb, typos):
            size = (ends[1:] - ends[:-1])[some]
            entry = np.repeat(ends[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            key = _mix(np.repeat(block, size) ^ spread[entry]).view(np.int64)
            r = rows[entry]
            columns = [key, numbers["n"][r], numbers["side"][r], numbers["line"][r], la[r].astype(np.int32), lb[r].astype(np.int32), w[entry], rest[entry], numbers["floor"][r]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_LIST)


def _weights(classes: DataFrame, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared weight, held on both sides) of every term; counted in each partition before the shuffle."""
    counted = classes.select("a", "b", "side").mapInArrow(lambda it: _holders(it, terms), "term bigint, df bigint, train boolean, eval boolean")
    table = counted.groupBy("term").agg(F.sum("df").alias("df"), (F.bool_or("train") & F.bool_or("eval")).alias("met")).toArrow()
    squares, met = np.ones(terms, np.int64), np.zeros(terms, bool)
    at = table["term"].to_numpy()
    squares[at] = np.maximum(1, np.ceil(_UNIT / (1 + np.log(table["df"].to_numpy())) ** 2)).astype(np.int64)
    met[at] = table["met"].to_numpy()
    return squares, met


def _weight(packed: Column) -> Column:
    return F.aggregate(packed, F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(F.lit(_WEIGHT_MASK)))


def class_pairs(classes: DataFrame, typos: int = TYPOS, terms: int = TERMS) -> DataFrame:
    """(tc, ec): class ids of the two sides whose texts are the same up to typos. ``classes`` must be stored, not computed."""
    spark = classes.sparkSession
    held = spark.sparkContext.broadcast(_weights(classes, terms))
    full = checkpoint(classes.mapInArrow(lambda it: _vectors(it, *held.value, _GRAM * typos, terms), f"{_CLASS}, floor bigint, entered int, packed array<int>"))
    lists = full.select("n", "side", "line", "frame", "a", "b", "floor", "entered", "packed").mapInArrow(lambda it: _listed(it, typos), "key bigint, n bigint, side int, line int, la int, lb int, w bigint, rest bigint, floor bigint")

    t, e = lists.where("side = 0").alias("t"), lists.where("side = 1").alias("e")
    close = (F.abs(F.col("t.line").cast("long") - F.col("e.line")) <= LINE_REACH) & (F.abs(F.col("t.la") - F.col("e.la")) <= typos) & (F.abs(F.col("t.lb") - F.col("e.lb")) <= typos)
    bound = F.sum("t.w") + F.least(F.min("t.rest"), F.min("e.rest"))
    met = t.join(e, (F.col("t.key") == F.col("e.key")) & close).groupBy(F.col("t.n").alias("tn"), F.col("e.n").alias("en"))
    # a term of the lists is counted once per pair: a training class stands in one block
    candidates = checkpoint(met.agg(bound.alias("bound"), F.max(F.greatest("t.floor", "e.floor")).alias("need")).where("bound >= need").select("tn", "en"))

    wanted = candidates.select(F.explode(F.array("tn", "en")).alias("n")).distinct()
    sides = checkpoint(full.join(broadcast_if_small(wanted), "n", "left_semi").select("n", "cid", "frame", "a", "b", "floor", "packed"))
    left, right = (sides.select(*[F.col(c).alias(f"{p}_{c}") for c in sides.columns]) for p in "te")
    scored = candidates.join(left, F.col("tn") == F.col("t_n")).join(right, (F.col("en") == F.col("e_n")) & (F.col("t_frame") == F.col("e_frame")))
    dot = _weight(F.array_intersect("t_packed", "e_packed"))
    near = (F.levenshtein("t_a", "e_a", typos) >= 0) & (F.levenshtein("t_b", "e_b", typos) >= 0)
    return scored.where((dot >= F.greatest("t_floor", "e_floor")) & near).select(F.col("t_cid").alias("tc"), F.col("e_cid").alias("ec"))


def spelled_rows(df: DataFrame, row_id: str, split: str, equal: list[str], first: str, second: str, line: str, train: tuple[str, ...], evaluation: tuple[str, ...]) -> DataFrame:
    """(row_id, side, line, a, b, frame, cid) of the rows that can be in a pair; equal ``cid`` means a copy on the same side."""
    side = F.when(F.col(split).isin(*evaluation), 1).when(F.col(split).isin(*train), 0)
    same = [f"eq{i}" for i in range(len(equal))]
    asked = [F.col(c).isNotNull() for c in (row_id, first, second, line, *equal)]
    wanted = df.where(side.isNotNull() & reduce(lambda x, y: x & y, asked))
    # a text is null in its spelling only if it was null before, so nothing has to be spelled to be left out; in two steps, each computed once
    flat = wanted.select(F.col(row_id).alias("row_id"), side.alias("side"), F.col(line).cast("int").alias("line"), *[F.col(c).cast("string").alias(s) for c, s in zip(equal, same)], _flat(F.col(first), CHECKOUT_ROOTS).alias("fa"), _flat(F.col(second), CHECKOUT_ROOTS).alias("fb"))
    rows = flat.select("row_id", "side", "line", *same, _straight(F.col("fa")).alias("a"), _straight(F.col("fb")).alias("b")).where("line IS NOT NULL")
    sized = [x for c in (*same, "a", "b") for x in (F.char_length(c).cast("string"), F.lit(":"), F.col(c))]
    frame = F.xxhash64(*same, _digits(F.col("a")), _digits(F.col("b")))
    return rows.select("row_id", "side", "line", "a", "b", frame.alias("frame"), F.md5(F.concat(F.col("side").cast("string"), F.lit(":"), F.col("line").cast("string"), F.lit(":"), *sized)).alias("cid"))


def cross_split_classes(
    df: DataFrame, row_id: str, split: str, equal: list[str], first: str, second: str, line: str, train: tuple[str, ...] = ("train",), evaluation: tuple[str, ...] = ("dev", "holdout"), typos: int = TYPOS, terms: int = TERMS
) -> tuple[DataFrame, DataFrame]:
    """Overlaps without expanding copies: (tc, ec) pairs of classes, and the membership (cid, row_id) of all rows."""
    ship(df.sparkSession)
    rows = checkpoint(spelled_rows(df, row_id, split, equal, first, second, line, train, evaluation))
    shared = rows.groupBy("frame").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo < hi").select("frame")
    classes = rows.join(shared, "frame", "left_semi").groupBy("cid").agg(*[F.first(c).alias(c) for c in ("side", "line", "frame", "a", "b")])
    classes = checkpoint(classes.select(F.monotonically_increasing_id().alias("n"), "cid", "side", "line", "frame", "a", "b"))
    return class_pairs(classes, typos, terms), rows.select("cid", "row_id")


def cross_split_pairs(df: DataFrame, *columns, **options) -> DataFrame:
    """(train_id, eval_id) for every pair across the splits whose texts are the same up to spelling and typos.

    Takes the arguments of :func:`cross_split_classes`.
    """
    matched, members = cross_split_classes(df, *columns, **options)
    matched = checkpoint(matched)
    found = broadcast_if_small(matched.select(F.explode(F.array("tc", "ec")).alias("cid")).distinct())
    members = members.join(found, "cid", "left_semi")
    return (
        matched.join(members.select(F.col("cid").alias("tc"), F.col("row_id").alias("train_id")), "tc")
        .join(members.select(F.col("cid").alias("ec"), F.col("row_id").alias("eval_id")), "ec")
        .select("train_id", "eval_id")
    )


def cross_split_links(df: DataFrame, *columns, **options) -> DataFrame:
    """(row_id, class_id, n_links) for every row that can be in a pair: its class is named by the least row id of its copies.

    ``n_links`` counts the rows of the other side it overlaps with; copies are not expanded into pairs.
    Takes the arguments of :func:`cross_split_classes`.
    """
    matched, members = cross_split_classes(df, *columns, **options)
    sizes = members.groupBy("cid").agg(F.count("*").alias("n"), F.min("row_id").alias("class_id"))
    both = matched.select(F.inline(F.array(F.struct(F.col("tc").alias("cid"), F.col("ec").alias("other")), F.struct(F.col("ec").alias("cid"), F.col("tc").alias("other")))))
    links = both.join(sizes.select(F.col("cid").alias("other"), "n"), "other").groupBy("cid").agg(F.sum("n").alias("n_links"))
    classes = sizes.join(links, "cid", "left").select("cid", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(classes, "cid").select("row_id", "class_id", "n_links")
