"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document is the set of its distinct word shingles. SuperMinHash draws, for
every element, a random permutation of the signature's places: the ``j``-th
place of the permutation is offered the value ``j`` plus a random fraction, and
each place keeps its smallest offer. The offers are made one rank at a time to
all elements at once, and a document stops as soon as every place holds an
offer of the present rank, because later ranks can only be larger.

Documents with equal sets become one node before anything else. Nodes that
agree in a band of their signatures are candidates. A band bucket never emits
all its pairs: every member is first compared with the bucket's smallest node
only, the verified links are joined into components, and from then on only
pairs between different components are looked at. In a bucket that still has
more than ``MANY`` rows these pairs are found by an exact prefix filter on the
rarest shingles instead. All links are confirmed on full sets.

With 50 bands of 6 a pair at a similarity of exactly 0.8 shares no band with a
probability of 3e-7, pairs above it less.

Cases: null, empty and blank texts have no shingles and no links; texts shorter
than a shingle are one shingle of their own length; rows with the same id are
separate documents that share an id, which counts once in minima; null ids are
left out of minima, and a component of null ids alone has a null id; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geopanel.skew import join_bounded, materialize

from .blocks import LONG_TEXT, LOWER, SMALL_BLOCK, SPACE, blocks, mix, prefix_hashes, raw, span_hashes, text_array, word_spans
from .graph import components

BANDS, ROWS = 50, 6
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Rows of a bucket up to which pairs between its components are listed.
MANY = 32
#: Members that are compared with one copy of a leader's text.
SALT_ROWS = 256
_PLACES = [np.uint64(c) for c in mix(np.arange(11, 75, dtype=np.uint64))]
_LEVEL = np.uint64(50)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text: their hashes, sorted in each text, and where each text's begin."""
    data, at = raw(texts)
    if len(data) <= LONG_TEXT:
        return _sets(data, at, width)
    sets = [_long_set(data[a:b], width) for a, b in zip(at[:-1], at[1:])]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def _long_set(data: np.ndarray, width: int) -> np.ndarray:
    """The set of one text, a piece at a time; each piece begins with the last words of the one before."""
    found, rest = np.zeros(0, np.uint64), b""
    for first in range(0, len(data), LONG_TEXT):
        last = first + LONG_TEXT >= len(data)
        piece = np.frombuffer(rest + data[first : first + LONG_TEXT].tobytes(), np.uint8)
        blank = np.flatnonzero(SPACE[piece])
        # up to the last blank: a word may go on in the next piece
        whole = len(piece) if last else int(blank[-1]) if len(blank) else 0
        start, _, _ = word_spans(piece[:whole], np.array([0, whole]))
        if len(start) >= width or (last and not len(found)):
            found = np.union1d(found, _sets(piece[:whole], np.array([0, whole]), width)[0])
        kept = int(start[-(width - 1)]) if width > 1 and len(start) >= width - 1 else 0 if len(start) < width - 1 else whole
        rest = piece[kept:].tobytes()
    return found


def _sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(at) - 1
    data = LOWER[data]
    start, end, owner = word_spans(data, at)
    words = span_hashes(prefix_hashes(data), start, end)
    count = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    found, of = [], []
    for size in range(1, width + 1):
        # all windows of full width; of a shorter text the one window that it is
        if size == width:
            here = np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :]) if len(owner) >= width else []
        else:
            here = first[count == size]
        here = np.asarray(here, np.int64)
        h = np.full(len(here), size, np.uint64)
        for k in range(size):
            h += words[here + k] * (_PLACES[k] | np.uint64(1))
        found.append(mix(h))
        of.append(owner[here])
    h, of = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=n))])


def superminhash(elements: np.ndarray, at: np.ndarray, places: int) -> np.ndarray:
    """One signature a row; set ``i`` has the distinct hashes ``elements[at[i]:at[i + 1]]``."""
    n = len(at) - 1
    none = np.uint64(2**64 - 1)
    out = np.full(n * places, none, np.uint64)
    group = max(1, 2_000_000 // places)  # elements whose permutations are held together
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + group, "right")) - 1)
        x = elements[at[first] : at[last]]
        row = np.repeat(np.arange(first, last), np.diff(at[first : last + 1]))
        order = np.zeros((0, places), np.int16)
        for j in range(places):
            if not len(x):
                break
            draw = mix(x + np.uint64(int(_PLACES[0]) * (2 * j + 1) & 2**64 - 1))
            k = j + ((draw >> np.uint64(32)) % np.uint64(places - j)).astype(np.int64)
            one = np.arange(len(x))
            place = order[one, k] if j else k
            if j:
                order[one, k] = order[:, j]
            offer = (np.uint64(j) << _LEVEL) | (mix(draw) >> (np.uint64(64) - _LEVEL))
            np.minimum.at(out, row * places + place, offer)
            here = np.unique(row)
            full = out.reshape(n, places)[here].max(1) < (np.uint64(j + 1) << _LEVEL)
            keep = ~np.isin(row, here[full])
            x, row = x[keep], row[keep]
            if not j:
                # only small sets get this far; large ones never need their permutations
                order = np.tile(np.arange(places, dtype=np.int16), (len(x), 1))
                order[np.arange(len(x)), k[keep]] = 0
            elif full.any():
                order = order[keep]
        first = last
    return out.reshape(n, places)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for every band; the band's number is part of it."""
    n = len(signatures)
    parts = signatures.reshape(n, bands, rows)
    keys = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        keys = mix(keys * _PLACES[1] + parts[:, :, r])
    return keys


def _digests(h: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128 bits that name each set; none for an empty one."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ _PLACES[k]))]) for k in (2, 3)]
    both = np.stack([mix(s[at[1:]] - s[at[:-1]]) for s in sums], 1).astype(">u8")
    return [both[i].tobytes() if at[i + 1] > at[i] else None for i in range(len(at) - 1)]


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, bands) of every row; node and bands are null without shingles."""
    inner = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, SMALL_BLOCK):
            h, at = shingle_sets(text_array(part), width)
            keys = band_keys(superminhash(h, at, bands * rows), bands, rows).view(np.int64)
            empty = pa.array(np.diff(at) == 0)
            cut = pa.array(np.arange(len(at), dtype=np.int32) * bands)
            listed = pa.ListArray.from_arrays(cut, pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array(np.diff(at)),
                    pa.array(_digests(h, at), pa.binary()),
                    pc.if_else(empty, pa.scalar(None, listed.type), listed),
                ],
                ["doc_id", "text_hash", "n_shingles", "node", "bands"],
            )

    kind = inner.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, text_hash long, n_shingles long, node binary, bands array<long>"
    return inner.mapInArrow(run, columns)


def verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar; ``texts`` has (node, text) of all their nodes.

    Each node ``a`` meets its partners in runs of about ``SALT_ROWS``: its text
    comes first in a run and is held while the partners stream by.
    """
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).alias("runs"))
    salted = pairs.join(runs, "a").withColumn("run", F.pmod(F.xxhash64("b"), F.col("runs"))).drop("runs")
    members = salted.join(texts.withColumnRenamed("node", "b"), "b").select("a", "run", "b", "text")
    leaders = runs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"))
    leaders = leaders.join(texts.withColumnRenamed("node", "a"), "a").select(
        "a", "run", F.lit(None).cast("binary").alias("b"), "text"
    )
    rows = members.union(leaders).repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for part in blocks(batches, SMALL_BLOCK):
            h, at = shingle_sets(text_array(part), width)
            hits: list[tuple[bytes, bytes]] = []
            for i, (a, b) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                s = h[at[i] : at[i + 1]]
                if b is None:
                    leader, own = a, s.copy()
                    continue
                if leader != a:
                    raise ValueError("a pair without its first text")
                if 100 * min(len(s), len(own)) < PERCENT * max(len(s), len(own)):
                    continue
                place = np.minimum(np.searchsorted(own, s), len(own) - 1)
                same = int((own[place] == s).sum())
                if 100 * same >= PERCENT * (len(s) + len(own) - same):
                    hits.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in hits], pa.binary()) for k in (0, 1)], ["a", "b"]
            )

    return rows.mapInArrow(check, "a binary, b binary")


def _rare_pairs(texts: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """Pairs between components that share one of either side's rarest shingles.

    A text of ``n`` shingles that is similar to another shares one of its
    ``n - ceil(0.8 n) + 1`` first shingles in any order common to all texts;
    rarest first makes the lists of a shingle short. A first common shingle at
    a place leaves only the later ones to be shared, and two texts must share
    0.8 / 1.8 of their shingles together. Exact for any input.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, 200_000):
            h, at = shingle_sets(text_array(part), width)
            of = np.repeat(np.arange(part.num_rows), np.diff(at))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(of)), pa.array(np.diff(at)[of]), pa.array(h.view(np.int64))],
                ["node", "n", "shingle"],
            )

    rows = members.join(texts, "node").select("node", "text").mapInArrow(spread, "node binary, n long, shingle long")
    rows = materialize(rows, "shingles")
    counted = rows.join(rows.groupBy("shingle").agg(F.count("*").alias("df")), "shingle").where("df > 1")
    # places are counted among all shingles of a text: those found once come first and match nobody
    alone = rows.groupBy("node").agg(F.count("*").alias("all"))
    counted = counted.join(alone, "node").withColumn(
        "place",
        F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle"))
        + F.col("all")
        - F.count("*").over(Window.partitionBy("node")),
    )
    prefix = counted.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)
    prefix = prefix.join(members.select("node", "label"), "node")
    prefix = prefix.select("shingle", "node", "label", "n", (F.col("n") - F.col("place") + 1).alias("left"))
    one = prefix.toDF("shingle", "a", "la", "na", "ra")
    two = prefix.toDF("shingle", "b", "lb", "nb", "rb")
    needed = PERCENT * (F.col("na") + F.col("nb"))
    near = (
        (F.col("la") != F.col("lb"))
        & (F.col("a") < F.col("b"))
        & (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
        & ((100 + PERCENT) * F.least("ra", "rb") >= needed)
    )
    return one.join(two, "shingle").where(near).select("a", "b").distinct()


def linked_nodes(docs: DataFrame, signed: DataFrame, width: int) -> DataFrame:
    """(node, label) of all nodes that have a similar other node."""
    keyed = signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_hash", "bands")).alias("first")
    )
    keyed = materialize(keyed.select("node", "first.*"), "nodes")
    rows = keyed.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    buckets = materialize(rows.join(shared.drop("n"), "key"), "buckets")
    texts = join_bounded(
        docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")),
        buckets.select("node").distinct().join(keyed, "node").select("node", "doc_id", "text_hash"),
        ["doc_id", "text_hash"],
        null_safe=True,
    ).select("node", "text")
    # rows that repeat an id and its text would bring a text twice
    texts = materialize(texts, "texts").dropDuplicates(["node"])

    stars = buckets.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialize(stars, "stars")
    # the smallest leader of each node first: in a group of copies it links nearly all
    first = materialize(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    links = materialize(verified(first, texts, width), "verified")
    labels = components(links)

    def labelled(pairs: DataFrame) -> DataFrame:
        """Pairs between different components."""
        a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        named = pairs.join(a, "a", "left").join(b, "b", "left")
        apart = F.coalesce("la", "a") != F.coalesce("lb", "b")
        return named.where(apart).select("a", "b")

    def grown(pairs: DataFrame) -> bool:
        nonlocal links, labels
        more = materialize(verified(pairs, texts, width), "verified")
        if not more.limit(1).count():
            return False
        links = links.union(more)
        labels = components(links)
        return True

    rest = materialize(labelled(stars.join(first, ["a", "b"], "left_anti")), "pairs")
    grown(rest)

    named = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    apart = named.groupBy("key").agg(
        F.count("*").alias("rows"), (F.min("label") != F.max("label")).alias("apart")
    )
    open_rows = materialize(named.join(apart.where("apart").drop("apart"), "key"), "open")
    few = open_rows.where(F.col("rows") <= MANY).select("key", "node", "label")
    left = few.select("key", F.col("node").alias("a"), F.col("label").alias("la"))
    right = few.select("key", F.col("node").alias("b"), F.col("label").alias("lb"))
    cross = left.join(right, "key").where("a < b AND la <> lb").select("a", "b").distinct()
    many = open_rows.where(F.col("rows") > MANY).select("node", "label").distinct()
    if many.limit(1).count():
        cross = cross.union(_rare_pairs(texts, many, width)).distinct()
    # tested before: every star pair
    cross = materialize(cross.join(stars, ["a", "b"], "left_anti"), "pairs")
    grown(cross)
    return labels


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept, leads) of every row of ``docs`` (doc_id, text).

    ``leads`` is true for one (doc_id, text_hash) of each component, the
    smallest with null ids last; ``kept`` for every row with the smallest id.
    """
    signed = materialize(signatures(docs, width), "signatures")
    labels = linked_nodes(docs, signed, width)
    named = signed.drop("bands").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    smallest = named.where("label IS NOT NULL").groupBy("label").agg(
        F.min("doc_id").alias("smallest"), F.min(place).alias("first")
    )
    out = named.join(smallest, "label", "left")
    # without shingles a document stands alone
    out = out.withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("smallest")))
    return out.select(
        "doc_id", "text_hash", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        (F.col("label").isNull() | place.eqNullSafe(F.col("first"))).alias("leads"),
    )
