"""Benchmark items in documents, also with other numbers, names or units.

Texts become templates: words lose outer punctuation and case, numbers, names
and units after numbers become typed placeholders, whose values are kept as
slots. Which words are names cannot be told from one place alone, so there are
three templates: names are the words capitalised inside a sentence; these and
the capitalised words that open a sentence; or none, for texts in other case.
Windows of ``WIDTH`` template words with at least ``LITERALS`` plain words are
hashed and joined with the windows of the items; a window is found if one of
its templates is. Matches lie on diagonals (distance between document and item
place). On a diagonal every slot value of the item must stand for one value of
the document only. Where it stands for several, its own value counts; else for
a number or unit, which may mean two things, the most frequent one, and for a
name none; windows with other values are dropped. An item is found in a
document if the windows left on its diagonals cover ``PERCENT`` of the item's
windows, which are those of the first template. If all slots are equal it is a
verbatim copy, else a re-parameterised one.

Before the join a bitmap of the items' hashes (of fixed size, whatever the
benchmark) sorts out nearly all document windows where they are made; the join
itself is exact. The items are broadcast only if their measured size allows.

Cases: null or empty texts contain nothing; an item of fewer than ``WIDTH``
words or without such a window is never found, as it cannot be told from a
common phrase; items that repeat an id and its text are one, as are rows that
do; a null id of an item or a document is an id like others; without items
nothing is found; other columns are never read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.skew import join_bounded, materialize

from .blocks import LOWER, SMALL_BLOCK, blocks, mix, prefix_hashes, raw, span_hashes, text_array, word_spans

WIDTH, LITERALS, PERCENT = 5, 3, 80
#: Bits of the bitmap before the join.
BITS = 1 << 20
NUMBER, NAME, UNIT = (np.uint64(k) for k in mix(np.arange(3, dtype=np.uint64) + np.uint64(7)))

#: Units that follow a number.
UNITS = """
% percent mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres
kilometer kilometers kilometre kilometres g kg mg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes
pound pounds ounce ounces l ml liter liters litre litres gallon gallons s sec ms min h hr hrs second seconds
minute minutes hour hours day days week weeks month months year years euro euros dollar dollars cent cents
usd eur gbp mph kmh degrees celsius fahrenheit watt watts volt volts joule joules hz khz mhz ghz byte bytes kb mb gb tb
""".split()

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_ALNUM[37] = True  # a percent sign is a unit of its own
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 63]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    return span_hashes(prefix_hashes(data), np.concatenate([[0], end[:-1]]), end)


UNIT_HASHES = np.sort(_hash_words(UNITS))


def templates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hashes, value hash, text number) of every word; typed words share the template of their type.

    The three rows of the template hashes take as names the words capitalised
    inside a sentence, those and the capitalised ones that open it, and none.
    """
    data, at = raw(texts)
    start, end, owner = word_spans(data, at)
    inner = np.flatnonzero(_ALNUM[data])
    if not len(inner) or not len(start):
        return np.zeros((3, 0), np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lo, hi = np.searchsorted(inner, start), np.searchsorted(inner, end)
    real = hi > lo
    start, end, owner = inner[lo[real]], inner[hi[real] - 1] + 1, owner[real]
    value = span_hashes(prefix_hashes(LOWER[data]), start, end)
    counts = [
        np.concatenate([[0], np.cumsum(x)])
        for x in ((data >= 48) & (data < 58), (data == 44) | (data == 46), _STOP[data])
    ]
    digits, marks = (c[end] - c[start] for c in counts[:2])
    number = (digits > 0) & (digits + marks == end - start)
    first = np.ones(len(start), bool)
    if len(start):
        first[1:] = (owner[1:] != owner[:-1]) | (counts[2][start[1:]] > counts[2][end[:-1]])
    second = data[np.minimum(start + 1, len(data) - 1)]
    capital = (data[start] >= 65) & (data[start] < 91) & (end - start > 1) & (second >= 97)
    after = np.zeros(len(start), bool)
    after[1:] = number[:-1] & (owner[1:] == owner[:-1])
    k = np.minimum(np.searchsorted(UNIT_HASHES, value), len(UNIT_HASHES) - 1)
    unit = after & (UNIT_HASHES[k] == value)
    plain = np.where(number, NUMBER, np.where(unit, UNIT, value))
    kinds = [np.where(number | unit | ~named, plain, NAME) for named in (capital & ~first, capital)]
    return np.stack([*kinds, plain]), value, owner


def windows(texts: pa.Array, item: bool = False) -> tuple[np.ndarray, ...]:
    """(text number, place, window hash, template number, slot marks, word values) of all windows with enough literals.

    Slot marks and values have a column for each word of the window; the lowest
    bit of a value says whether it is a name. A window whose templates agree
    comes once, as the first of them. Windows of an ``item`` are those that the
    first template allows.
    """
    template, value, owner = templates(texts)
    n = len(value) - WIDTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none, np.zeros((0, WIDTH), bool), np.zeros((0, WIDTH), np.uint64)
    first = np.searchsorted(owner, owner)
    whole = owner[:n] == owner[WIDTH - 1 :]
    allowed, marks = [], []
    for kind in template:
        typed = (kind == NUMBER) | (kind == NAME) | (kind == UNIT)
        many = np.concatenate([[0], np.cumsum(typed)])
        allowed.append(whole & (many[WIDTH:] - many[:n] <= WIDTH - LITERALS))
        marks.append(typed)
    out = []
    for k, kind in enumerate(template):
        good = allowed[k] & allowed[0] if item else allowed[k].copy()
        for j in range(k):
            differ = np.concatenate([[0], np.cumsum(kind != template[j])])
            good &= ~allowed[j] | (differ[WIDTH:] > differ[:n])
        use = np.flatnonzero(good)
        h = np.zeros(len(use), np.uint64)
        for i in range(WIDTH):
            h = mix(h + kind[use + i] + np.uint64(i + 1))
        span = use[:, None] + np.arange(WIDTH)
        slot = value[span] & ~np.uint64(1) | (kind[span] == NAME).astype(np.uint64)
        out.append((owner[use], use - first[use], h, np.full(len(use), k), marks[k][span], slot))
    return tuple(np.concatenate(x) for x in zip(*out))


def window_rows(docs: DataFrame, keys: list[str], bitmap: np.ndarray | None = None) -> DataFrame:
    """``keys``, place, hash, template and slots (value at each typed word, by order) of the windows of ``docs``.

    With the ``bitmap`` of the items' hashes the windows are those of documents.
    """
    inner = docs.select(*keys, F.col("text").alias("text"))
    kinds = ", ".join(f"`{k}` {inner.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # every window has a row for each of its words, three times over
        for part in blocks(batches, SMALL_BLOCK):
            of, place, h, kind, typed, value = windows(text_array(part), item=bitmap is None)
            if bitmap is not None:
                hit = bitmap[(h & np.uint64(BITS - 1)).astype(np.int64)]
                of, place, h, kind, typed, value = (x[hit] for x in (of, place, h, kind, typed, value))
            cut = np.concatenate([[0], np.cumsum(typed.sum(1))]).astype(np.int32)
            slots = pa.ListArray.from_arrays(pa.array(cut), pa.array(value[typed].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(k).take(pa.array(of)) for k in range(len(keys))),
                    pa.array(place), pa.array(h.view(np.int64)), pa.array(kind), slots,
                ],
                [*keys, "place", "hash", "template", "slots"],
            )

    return inner.mapInArrow(run, f"{kinds}, place long, hash long, template long, slots array<long>")


def settled(hits: list[dict]) -> tuple[list[int], list[dict]]:
    """Places and distinct pairs of the windows of a diagonal that are left where each item value has one of the document."""
    count = Counter((x["theirs"], x["ours"]) for hit in hits for x in hit["pairs"])
    values = defaultdict(list)
    for theirs, ours in count:
        values[theirs].append(ours)
    chosen = {}
    for theirs, ours in values.items():
        if len(ours) == 1 or theirs in ours:
            chosen[theirs] = theirs if theirs in ours else ours[0]
        elif not theirs & 1:
            chosen[theirs] = min(ours, key=lambda x: (-count[theirs, x], x))
    left = [hit for hit in hits if all(chosen.get(x["theirs"]) == x["ours"] for x in hit["pairs"])]
    pairs = {(x["theirs"], x["ours"]) for hit in left for x in hit["pairs"]}
    return [hit["item_place"] for hit in left], [{"theirs": a, "ours": b} for a, b in pairs]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = pa.struct([("theirs", pa.int64()), ("ours", pa.int64())])
    for batch in batches:
        done = [settled(hits) for hits in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:-1],
                pa.array([x[0] for x in done], pa.list_(pa.int64())),
                pa.array([x[1] for x in done], pa.list_(pair)),
            ],
            [*batch.schema.names[:-1], "places", "pairs"],
        )


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, n_matched, n_slots, n_changed, kind) of every item found."""
    numbered = items.select("item_id", "text", F.xxhash64("text").alias("item_hash"))
    made = materialize(window_rows(numbered, ["item_id", "item_hash"]), "items")
    sizes = made.groupBy("item_id", "item_hash").agg(F.count_distinct("place").alias("n_windows"))
    sizes = sizes.withColumnsRenamed({"item_id": "_item_id", "item_hash": "_item_hash"})
    bitmap = np.zeros(BITS, bool)
    slots = made.select(F.col("hash").bitwiseAND(F.lit(BITS - 1)).alias("slot")).distinct().toPandas()["slot"]
    bitmap[slots.to_numpy(np.int64)] = True

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = window_rows(rows, ["doc_id", "text_hash"], bitmap)
    item_rows = made.withColumnsRenamed({"place": "item_place", "slots": "item_slots", "template": "item_template"}).distinct()
    matched = join_bounded(found.drop("template"), item_rows, ["hash"]).select(
        "doc_id", "text_hash", "item_id", "item_hash", "item_place", "item_template",
        (F.col("place") - F.col("item_place")).alias("diagonal"),
        F.arrays_zip(F.col("item_slots").alias("theirs"), F.col("slots").alias("ours")).alias("pairs"),
    )
    pair = ["doc_id", "text_hash", "item_id", "item_hash"]
    matched = materialize(matched, "matched")
    # of several templates that match, the first; the others have the same values there
    best = matched.groupBy(*pair, "diagonal", "item_place").agg(F.min(F.struct("item_template", "pairs")).alias("best"))
    hits = F.collect_list(F.struct("item_place", F.col("best.pairs").alias("pairs"))).alias("hits")
    on_diagonal = best.groupBy(*pair, "diagonal").agg(hits).drop("diagonal")
    types = ", ".join(f"{k} {matched.schema[k].dataType.simpleString()}" for k in pair)
    consistent = on_diagonal.mapInArrow(
        _settle, f"{types}, places array<long>, pairs array<struct<theirs: long, ours: long>>"
    )
    covered = (
        consistent.groupBy(*pair)
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_matched"),
            F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
        )
        .join(sizes, F.col("item_id").eqNullSafe(F.col("_item_id")) & (F.col("item_hash") == F.col("_item_hash")))
        .where(F.col("n_matched") * 100 >= PERCENT * F.col("n_windows"))
    )
    changed = F.size(F.filter("pairs", lambda x: x["theirs"] != x["ours"])).cast("long")
    return covered.select(
        "doc_id", "text_hash", "item_id", "n_windows", "n_matched",
        F.size("pairs").cast("long").alias("n_slots"),
        changed.alias("n_changed"),
        F.when(changed > 0, "reparameterised").otherwise("verbatim").alias("kind"),
    )
