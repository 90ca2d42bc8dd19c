"""Byte strings that occur more than once, by block-wise suffix sorting with a difference cover.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else, in the same document or another. Sorting all suffixes of a corpus is out
of reach of any one task, so the suffixes are dealt into buckets that cannot
share such a string and each bucket is sorted on its own:

1. Every window of ``length`` bytes names an anchor, the smallest of its
   ``GRAM``-byte hashes (leftmost first). Equal windows name equal anchors at
   equal distances, so a suffix needs comparing only inside its anchor's
   bucket. Neighbouring windows with one anchor share a stretch of text. Only
   hashes and places of stretches are shuffled.
2. Anchors that occur once are done. Equal stretches are kept once, with their
   count: beyond one, all their windows repeat. Only the texts of different
   stretches with one anchor travel.
3. Buckets are gathered into blocks of bounded size and the suffixes of a block
   are sorted by their distance from the anchor and their first and last bytes;
   long ties are settled by ranks of a difference cover: for any two suffixes
   that may be equal there is a shift below ``COVER`` that takes both to sampled
   positions, whose ranks to depth ``length - COVER`` were computed once by
   doubling. Anchors are laid at multiples of ``COVER``, so suffixes of one
   distance share a residue and one sampled residue is a cover; without such
   buckets (:func:`repeated_windows`) it takes the residues of ``SAMPLED``.
   Equal neighbours are repeats.
4. A bucket of more than ``BUCKET`` different stretches (a passage in a large
   part of all documents has two, at its ends) never meets in one task. Its
   windows are halved again and again, by distance from the anchor: a half
   whose common core occurs once is unique, one that occurs twice as a whole
   repeats, and only what is left is halved further. Each round counts hashes
   with partial aggregation.

Cases: null texts are empty; texts shorter than ``length`` keep all bytes;
periodic texts are settled inside their document first; rows that repeat an id
and its text repeat each other; null ids are ids like others; other columns
are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.skew import join_bounded, materialize

from .blocks import BASE, BASE_2, INVERSE, INVERSE_2, LONG_TEXT, SMALL_BLOCK, blocks, mix, prefix_hashes, raw, release, span_hashes, text_array, word_spans

LENGTH = 400
#: Bytes of the hashed strings from which anchors are chosen.
GRAM = 32
#: Period of the difference cover, in bytes; one machine word.
COVER = 8
#: Different stretches of an anchor that are sorted in one task.
BUCKET = 2_000
#: Text bytes of a block of buckets (one bucket at least).
BLOCK = 400_000

#: The smallest set whose pairwise differences reach every residue.
SAMPLED = next(
    set(c)
    for k in range(2, COVER)
    for c in combinations(range(COVER), k)
    if len({(a - b) % COVER for a in c for b in c}) == COVER
)
#: SHIFT[r][s]: takes residues r and s to sampled residues at once.
SHIFT = [
    [next(d for d in range(COVER) if {(r + d) % COVER, (s + d) % COVER} <= SAMPLED) for s in range(COVER)]
    for r in range(COVER)
]
KEY = ["doc_id", "text_hash"]
#: Words of the hashed strings from which anchors of passages are chosen.
WORD_GRAM = 8
#: Low bits of a hash that give way to its place; the same in every block, so equal windows agree on the smallest one.
PLACE_BITS = LONG_TEXT.bit_length() + 1
#: Windows of words whose hashes are held at one time.
WINDOWS = 100_000


def _structs(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The row of each element of a column of lists of structs of long, and the fields."""
    of = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
    elements = lists.flatten()
    names = [elements.type.field(i).name for i in range(elements.type.num_fields)]
    return of, {k: v.to_numpy(zero_copy_only=False) for k, v in zip(names, elements.flatten())}


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text) with null texts empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n = len(key) - width + 1
    pad = -len(key) % width
    grid = np.concatenate([key, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, stretch hash, first and last window, anchor place) of all stretches.

    Places are counted from the start of the text. A long text is cut into
    pieces that overlap by ``length - 1`` bytes, so each window lies in one of
    them; a stretch over a cut becomes two.
    """
    if len(data) > LONG_TEXT:
        parts = []
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            for first in range(a, b, LONG_TEXT):
                piece = data[first : min(b, first + LONG_TEXT + length - 1)]
                of, anchor, whole, *places = _stretches(piece, np.array([0, len(piece)]), length)
                parts.append((of + k, anchor, whole, *(p + (first - a) for p in places)))
        return tuple(np.concatenate(x) for x in zip(*parts))
    return _stretches(data, at, length)


def _stretches(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    sums = prefix_hashes(data)
    begin = np.arange(len(data) - GRAM + 1)
    grams = span_hashes(sums, begin, begin + GRAM)
    low = np.uint64(max(PLACE_BITS, len(data).bit_length()))
    key = (grams >> low << low) | begin.astype(np.uint64)
    anchor = (_least(key, length - GRAM + 1) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    windows = np.arange(len(anchor))
    owner = np.searchsorted(at, windows, "right") - 1
    good = windows + length <= at[owner + 1]
    windows, anchor, owner = windows[good], anchor[good], owner[good]
    if not len(windows):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(windows)]]) - 1
    a, b, p, of = windows[first], windows[last], anchor[first], owner[first]
    whole = mix(span_hashes(sums, a, b + length) ^ mix((p - a).astype(np.uint64)))
    base = at[of]
    return of, grams[p], whole, a - base, b - base, p - base


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    """Stretches (once for each document, with their count) and, with a null anchor, settled spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, SMALL_BLOCK):
            data, at = raw(text_array(part))
            of, anchor, whole, a, b, p = stretches(data, at, length)
            order = np.lexsort((a, whole, anchor, of))
            of, anchor, whole, a, b, p = (x[order] for x in (of, anchor, whole, a, b, p))
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.concatenate([first, [len(of)]]))
            inside = np.repeat(n, n) > 1
            # stretches that repeat inside their document, joined where they touch
            s_of, s_a, s_b = of[inside], a[inside], b[inside] + length
            order = np.lexsort((s_b, s_a, s_of))
            s_of, s_a, s_b = s_of[order], s_a[order], s_b[order]
            reach = s_of * (1 << 40) + s_b
            far = np.maximum.accumulate(reach) if len(reach) else reach
            opens = np.ones(len(s_of), bool)
            opens[1:] = s_of[1:] * (1 << 40) + s_a[1:] > far[:-1]
            start = np.flatnonzero(opens)
            end = np.concatenate([start[1:], [len(s_of)]]) - 1 if len(start) else start
            rows = np.concatenate([of[first], s_of[start]])
            k = len(first)
            settled = np.arange(len(rows)) >= k

            def column(x: np.ndarray, y: np.ndarray) -> pa.Array:
                return pa.array(np.concatenate([x, y]).astype(np.int64))

            anchors = np.concatenate([anchor[first], np.zeros(len(start), np.uint64)]).view(np.int64)
            wholes = np.concatenate([whole[first], np.zeros(len(start), np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(rows)),
                    part.column(1).take(pa.array(rows)),
                    pa.array(anchors, mask=settled),
                    pa.array(wholes),
                    column(n, np.ones(len(start))),
                    column(a[first], s_a[start]),
                    column(b[first], (far[end] - s_of[start] * (1 << 40)) - length if len(start) else start),
                    column(p[first], np.zeros(len(start))),
                ],
                [*KEY, "anchor", "whole", "n", "a", "b", "p"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"doc_id {kind}, text_hash long, anchor long, whole long, n long, a long, b long, p long"
    )


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of rows of keys, the first key most significant; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        step[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def cover_ranks(word: np.ndarray, depth: int, sampled: set[int] = SAMPLED) -> np.ndarray:
    """Ranks of the positions at ``sampled`` residues among strings of ``depth`` bytes, a multiple of ``COVER``.

    ``word[i]`` is the machine word at byte ``i``; -1 marks other positions.
    """
    at = np.flatnonzero(np.isin(np.arange(len(word)) % COVER, list(sampled)))

    def joined(x: np.ndarray, n: int, y: np.ndarray) -> np.ndarray:
        """Ranks to the depth of ``x`` (n bytes) followed by ``y``."""
        use = at[at + n < len(word)]
        use = use[(x[use] >= 0) & (y[use + n] >= 0)]
        out = np.full(len(word), -1, np.int64)
        out[use] = np.unique(x[use] << 32 | y[use + n], return_inverse=True)[1]
        return out

    power = np.full(len(word), -1, np.int64)
    power[at] = np.unique(word[at], return_inverse=True)[1]
    have, n, size = None, 0, COVER
    while depth:
        if depth & size:
            have, n = (power, size) if have is None else (joined(have, n, power), n + size)
            depth -= size
        if depth:
            power, size = joined(power, size, power), 2 * size
    return have


def _shared(*keys: np.ndarray) -> np.ndarray:
    """Which rows may be equal to another one: exact but for collisions of a 64-bit hash."""
    h = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        h = mix(h ^ k.astype(np.uint64))
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(h), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def repeated_windows(data: np.ndarray, windows: np.ndarray, length: int, bucket: np.ndarray | None = None) -> np.ndarray:
    """Which of the ``length``-byte strings at ``windows`` are equal to another one of them.

    With ``bucket``, strings are compared inside their bucket only, where all
    must lie at one residue of ``COVER``.
    """
    padded = np.concatenate([data, np.zeros(COVER + -len(data) % COVER, np.uint8)])
    word = np.ndarray((len(padded) - COVER,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    # the bucket sort: first and last machine word; a string alone with them is done
    keys = [word[windows], word[windows + length - COVER]]
    keys = keys if bucket is None else [bucket, *keys]
    out = np.zeros(len(windows), bool)
    open_ = np.flatnonzero(_shared(*keys))
    if not len(open_):
        return out
    ends = _dense(*(k[open_] for k in keys))
    at = windows[open_]
    # only machine words that open strings cover are ranked; residues stay
    cells = np.zeros(len(word) // COVER + 1, np.int64)
    np.add.at(cells, at // COVER, 1)
    np.add.at(cells, (at + length - 1) // COVER + 1, -1)
    covered = np.cumsum(cells[:-1]) > 0
    at = (np.cumsum(covered) - 1)[at // COVER] * COVER + at % COVER
    word = word.reshape(-1, COVER)[covered].ravel()
    if bucket is not None:
        # a difference of 0 is all that a cover has to reach
        place = ends << 32 | cover_ranks(word, length - COVER, {0})[at + -at % COVER]
    else:
        rank, residue = cover_ranks(word, length - COVER), at % COVER
        members = [np.flatnonzero(residue == r) for r in range(COVER)]
        place = np.zeros(len(at), np.int64)
        for r in range(COVER):
            if not len(members[r]):
                continue
            for s in range(COVER):
                if not len(members[s]):
                    continue
                shift = SHIFT[r][s]
                mine = ends[members[r]] << 32 | rank[at[members[r]] + shift]
                theirs = np.sort(ends[members[s]] << 32 | rank[at[members[s]] + shift])
                place[members[r]] += np.searchsorted(theirs, mine)
    # `place` grows with the string inside a bucket: equal strings share it. What a shift
    # compares beyond the last machine word's start is equal in a bucket.
    final = np.unique(place, return_inverse=True)[1]
    out[open_] = np.bincount(final)[final] > 1
    return out


def _ranges(flags: np.ndarray, of: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags: owner, first and last offset."""
    i = np.flatnonzero(flags)
    if not len(i):
        return i, i, i
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (of[i[1:]] != of[i[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(i)]]) - 1
    return of[i[first]], offset[i[first]], offset[i[last]]


def _sorted_blocks(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, whole, lo, hi): windows of stretches (anchor, whole, stretch) found in another one of the bucket."""

    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        size = np.array([len(x[3]) for x in rows], np.int64)
        left = np.array([x[2] for x in rows], np.int64)
        anchors = np.array([x[0] for x in rows], np.int64)
        # anchors lie at multiples of COVER: equal windows, at equal distances from theirs, have equal residues
        before = -left % COVER
        after = -(before + size) % COVER
        data = np.frombuffer(b"".join(bytes(a) + x[3] + bytes(b) for a, x, b in zip(before.tolist(), rows, after.tolist())), np.uint8)
        start = np.cumsum(before + size + after) - size - after
        count = size - length + 1
        of = np.repeat(np.arange(len(rows)), count)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        anchor = np.concatenate([[0], np.cumsum(anchors[1:] != anchors[:-1])])
        flags = repeated_windows(data, start[of] + offset, length, anchor[of] * length + left[of] - offset)
        who, lo, hi = _ranges(flags, of, offset)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in who], pa.int64()),
                pa.array([rows[i][1] for i in who], pa.int64()),
                pa.array(lo, pa.int64()),
                pa.array(hi, pa.int64()),
            ],
            ["anchor", "whole", "lo", "hi"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BLOCK and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)
        del held
        release()

    rows = texts.select("anchor", "whole", "left", "stretch").repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(run, "anchor long, whole long, lo long, hi long")


def _halved(texts: DataFrame, length: int) -> DataFrame:
    """As :func:`_sorted_blocks` for buckets of any size, by halving ranges of windows.

    A range is a dyadic interval of distances from the anchor, so ranges of
    different stretches line up. Its core is what all its windows share.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores, fulls, complete = [], [], []
            for left, stretch, o, w in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                # window at distance x from the anchor starts at left - x
                core = stretch[left - o : max(left - o, left - (o + w - 1) + length)]
                full = stretch[max(0, left - (o + w - 1)) : left - o + length]
                whole = left - (o + w - 1) >= 0 and left - o + length <= len(stretch)
                cores.append(hashlib.blake2b(core, digest_size=16).digest())
                fulls.append(hashlib.blake2b(full, digest_size=16).digest() if whole else None)
                complete.append(whole)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cores, pa.binary()), pa.array(fulls, pa.binary())],
                [*batch.schema.names, "core", "full"],
            )

    columns = "anchor long, whole long, left long, stretch binary, o long, w long"
    width = 1 << (length - 1).bit_length()
    open_ = texts.select(
        "anchor", "whole", "left", "stretch", F.lit(0).cast("long").alias("o"), F.lit(width).cast("long").alias("w")
    )
    done = None
    while width:
        rows = materialize(open_.mapInArrow(hashed, f"{columns}, core binary, full binary"), "halves")
        where = ["anchor", "o", "core"]
        cores = rows.groupBy(where).agg(F.count("*").alias("cores")).where("cores > 1")
        fulls = rows.where("full IS NOT NULL").groupBy("anchor", "o", "full").agg(
            F.count("*").alias("fulls"), F.min("whole").alias("keeper")
        )
        rows = rows.join(cores, where).join(fulls.where("fulls > 1"), ["anchor", "o", "full"], "left")
        rows = materialize(rows.drop("core", "full"), "halves")
        found = rows.where("fulls > 1").select(
            "anchor", "whole", (F.col("left") - F.col("o") - F.col("w") + 1).alias("lo"), (F.col("left") - F.col("o")).alias("hi")
        )
        done = found if done is None else done.union(found)
        width //= 2
        if not width:
            break
        halves = F.explode(F.array(F.col("o"), F.col("o") + width))
        open_ = (
            # of equal ranges one goes on, for others to be compared with
            rows.where("fulls IS NULL OR whole = keeper")
            .select("anchor", "whole", "left", "stretch", halves.alias("o"), F.lit(width).cast("long").alias("w"))
            # halves with a window in the stretch
            .where((F.col("o") <= F.col("left")) & (F.col("left") - F.col("o") - F.col("w") + 1 + length <= F.length("stretch")))
        )
        if not open_.limit(1).count():
            break
    return done


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_hash, spans) of every document with repeats; spans hold start and end bytes, unmerged.

    ``rows`` is what :func:`keyed` gives.
    """
    all_ = materialize(_occurrences(rows, length), "stretches")
    settled = all_.where("anchor IS NULL").select(*KEY, F.col("a").alias("start"), (F.col("b") + length).alias("end"))
    occurrences = all_.where("anchor IS NOT NULL")
    shared = occurrences.groupBy("anchor").agg(
        F.sum("n").alias("times"), (F.min("whole") != F.max("whole")).alias("differ")
    )
    hits = materialize(occurrences.join(shared.where("times > 1").drop("times"), "anchor"), "hits")
    kinds = hits.groupBy("anchor", "whole", "differ").agg(
        F.sum("n").alias("times"), F.min(F.struct(*KEY, "a", "b", "p")).alias("at")
    )
    kinds = materialize(kinds, "kinds")
    wanted = kinds.where("differ").select("anchor", "whole", "at.*")
    per_doc = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "whole", "a", "b", "p")).alias("cuts"))
    per_doc = materialize(per_doc, "cuts")
    some = join_bounded(rows, per_doc.select(*KEY), KEY, "left_semi", null_safe=True)
    # repeated rows bring the same stretches again
    with_text = some.join(
        per_doc.withColumnsRenamed({k: f"_{k}" for k in KEY}),
        F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("text_hash").eqNullSafe(F.col("_text_hash")),
    ).select("text", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            data, at = raw(text_array(part))
            of, cuts = _structs(part.column(1))
            spans = zip((at[of] + cuts["a"]).tolist(), (at[of] + cuts["b"] + length).tolist())
            text = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cuts["anchor"]), pa.array(cuts["whole"]), pa.array(cuts["p"] - cuts["a"]),
                    pa.array([text[a:b] for a, b in spans], pa.binary()),
                ],
                ["anchor", "whole", "left", "stretch"],
            )

    texts = with_text.mapInArrow(cut, "anchor long, whole long, left long, stretch binary")
    large = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > BUCKET).select("anchor")
    large = materialize(large, "large")
    if large.limit(1).count():
        texts = materialize(texts.dropDuplicates(["anchor", "whole"]), "texts")
        found = _sorted_blocks(texts.join(large, "anchor", "left_anti"), length).union(
            _halved(texts.join(large, "anchor"), length)
        )
    else:
        found = _sorted_blocks(texts.dropDuplicates(["anchor", "whole"]), length)
    parts = found.join(kinds.where("times = 1").select("anchor", "whole"), ["anchor", "whole"])
    parts = hits.join(parts, ["anchor", "whole"]).select(
        *KEY, (F.col("a") + F.col("lo")).alias("start"), (F.col("a") + F.col("hi") + length).alias("end")
    )
    full = hits.join(kinds.where("times > 1").select("anchor", "whole"), ["anchor", "whole"]).select(
        *KEY, F.col("a").alias("start"), (F.col("b") + length).alias("end")
    )
    spans = settled.union(full).union(parts)
    return materialize(spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def word_stretches(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """Stretches of windows of ``words`` words that name one anchor, the smallest hash of ``WORD_GRAM`` words in them.

    (text number, anchor hash, two hashes of the stretch, first and last byte,
    words before the anchor). Places are counted from the start of the text.
    """
    start, end, owner = word_spans(data, at)
    parts = []
    for first in range(0, max(len(start) - words + 1, 0), WINDOWS):
        last = min(first + WINDOWS, len(start) - words + 1)
        s, e, of = start[first : last + words - 1], end[first : last + words - 1], owner[first : last + words - 1]
        base = s[0]
        piece = data[base : e[-1]]
        one, two = prefix_hashes(piece), prefix_hashes(piece, BASE_2)
        s, e = s - base, e - base
        n = len(s) - WORD_GRAM + 1
        grams = span_hashes(one, s[:n], e[WORD_GRAM - 1 :])
        low = np.uint64(max(PLACE_BITS, n.bit_length()))
        key = (grams >> low << low) | np.arange(n, dtype=np.uint64)
        anchor = (_least(key, words - WORD_GRAM + 1) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        windows = np.flatnonzero(of[: last - first] == of[words - 1 :])
        if not len(windows):
            continue
        anchor = anchor[windows]
        new = np.ones(len(windows), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (of[windows[1:]] != of[windows[:-1]]) | (np.diff(windows) > 1)
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(windows)]]) - 1
        a, b, p = windows[head], windows[tail] + words - 1, anchor[head]
        lead = (p - a).astype(np.uint64)
        hashes = [mix(span_hashes(x, s[a], e[b], y) ^ mix(lead)) for x, y in ((one, INVERSE), (two, INVERSE_2))]
        shift = base - at[of[a]]
        parts.append((of[a], grams[p], *hashes, s[a] + shift, e[b] + shift, p - a))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, *[none.astype(np.uint64)] * 3, none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


def repeated_words(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, spans) as :func:`repeated_spans`, of passages of more than ``words`` words.

    Such a passage is covered by windows of ``words + 1`` whole words, and a
    window repeats if its bytes start with a word anywhere else. Windows are
    dealt by anchors as byte strings are: equal windows name equal anchors at
    equal distances. Stretches that are equal as a whole repeat; only where
    different ones share an anchor are their windows written and counted.
    Hashes have 128 bits.
    """
    size = words + 1
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = [*KEY, "anchor", "w1", "w2", "n", "start", "end", "lead"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, SMALL_BLOCK):
            data, at = raw(text_array(part))
            found = word_stretches(data, at, size)
            order = np.lexsort((found[4], found[3], found[2], found[1], found[0]))
            of, anchor, w1, w2, start, end, lead = (x[order] for x in found)
            new = np.ones(len(of), bool)
            for x in (of, anchor, w1, w2):
                new[1:] &= x[1:] == x[:-1]
            new[1:] = ~new[1:]
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(of)))
            # stretches that repeat inside their document, joined where they touch, without an anchor
            inside = np.repeat(n, n) > 1
            order = np.lexsort((start[inside], of[inside]))
            s_of, s_a, s_b = of[inside][order], start[inside][order], end[inside][order]
            far = np.maximum.accumulate(s_of * (1 << 40) + s_b) if len(s_of) else s_of
            opens = np.ones(len(s_of), bool)
            opens[1:] = s_of[1:] * (1 << 40) + s_a[1:] > far[:-1]
            head = np.flatnonzero(opens)
            tail = np.append(head[1:], len(s_of)) - 1 if len(head) else head
            rows_of = np.concatenate([of[first], s_of[head]])
            settled = np.arange(len(rows_of)) >= len(first)
            none = np.zeros(len(head), np.int64)

            def column(x: np.ndarray, y: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
                return pa.array(np.concatenate([x.view(np.int64) if x.dtype == np.uint64 else x, y]), mask=mask)

            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(rows_of)), part.column(1).take(pa.array(rows_of)),
                    column(anchor[first], none, settled), column(w1[first], none), column(w2[first], none), column(n, none + 1),
                    column(start[first], s_a[head]), column(end[first], far[tail] - s_of[head] * (1 << 40)), column(lead[first], none),
                ],
                names,
            )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, SMALL_BLOCK):
            data, at = raw(text_array(part))
            of, cuts = _structs(part.column(3))
            a, b = at[of] + cuts["start"], at[of] + cuts["end"]
            # a long text a part at a time, others all at once
            for group in np.unique(a // LONG_TEXT):
                mine = np.flatnonzero(a // LONG_TEXT == group)
                first, last = a[mine].min(), b[mine].max()
                piece = data[first:last]
                s, e, _ = word_spans(piece, np.clip(at - first, 0, len(piece)))
                word = np.searchsorted(s, a[mine] - first)
                n = np.searchsorted(e, b[mine] - first, "right") - word - size + 1
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                which = np.repeat(mine, n)
                begin = s[np.repeat(word, n) + step]
                stop = e[np.repeat(word, n) + step + size - 1]
                # the anchor and its distance are part of a window's name
                place = mix((cuts["lead"][which] - step).astype(np.uint64) ^ cuts["anchor"][which].astype(np.uint64))
                h = [
                    mix(span_hashes(prefix_hashes(piece, x), begin, stop, y) ^ place).view(np.int64)
                    for x, y in ((BASE, INVERSE), (BASE_2, INVERSE_2))
                ]
                # of stretches that repeat as a whole, only the names are needed
                who = pa.array(of[which], mask=cuts["times"][which] > 1)
                shift = first - at[of[which]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[0]), pa.array(h[1]), part.column(0).take(who), part.column(1).take(who), pa.compute.is_valid(who),
                        pa.array(begin + shift), pa.array(stop + shift),
                    ],
                    ["h1", "h2", *KEY, "alone", "start", "end"],
                )

    schema = f"doc_id {kind}, text_hash long, anchor long, w1 long, w2 long, n long, start long, end long, lead long"
    found = materialize(rows.select(*KEY, "text").mapInArrow(run, schema), "word-stretches")
    settled = found.where("anchor IS NULL").select(*KEY, "start", "end")
    found = found.where("anchor IS NOT NULL")
    shared = found.groupBy("anchor").agg(F.sum("n").alias("times")).where("times > 1").select("anchor")
    hits = materialize(found.join(shared, "anchor"), "word-hits")
    what = ["anchor", "w1", "w2"]
    kinds = hits.groupBy(*what).agg(F.sum("n").alias("times"), F.min(F.struct(*KEY, "start", "end", "lead")).alias("at"))
    kinds = materialize(kinds, "word-kinds")
    full = hits.join(kinds.where("times > 1").select(*what), what).select(*KEY, "start", "end")
    # one stretch of each kind stands for all, where an anchor has several kinds
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    cuts = kinds.join(several, "anchor").select("anchor", "times", "at.*").groupBy(*KEY).agg(
        F.collect_list(F.struct("anchor", "times", "start", "end", "lead")).alias("cuts")
    )
    cuts = materialize(cuts, "word-cuts")
    some = join_bounded(rows.select(*KEY, "text"), cuts.select(*KEY), KEY, "left_semi", null_safe=True)
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("text_hash").eqNullSafe(F.col("_text_hash"))
    with_text = some.join(cuts.withColumnsRenamed({k: f"_{k}" for k in KEY}), on).select(*KEY, "text", "cuts")
    schema = f"h1 long, h2 long, doc_id {kind}, text_hash long, alone boolean, start long, end long"
    made = materialize(with_text.mapInArrow(windows, schema), "word-windows")
    # a repeated row brings its windows again, but then its stretches repeat as a whole
    again = made.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    parts = made.where("alone").join(again, ["h1", "h2"]).select(*KEY, "start", "end")
    spans = settled.union(full).union(parts)
    return spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def without_repeats(
    docs: DataFrame, length: int = LENGTH, words: int | None = None, marked: int | None = None
) -> DataFrame:
    """(doc_id, text_hash, n_bytes, n_removed, n_spans, kept_sha256, kept_text, n_passage) of every row.

    With ``words``, repeated passages of more whole words than that go too,
    however short their words are. With ``marked`` they are only counted:
    ``n_passage`` is the number of their bytes. ``kept_text`` drops characters
    that a removed span cuts apart; the digest is of the remaining bytes
    themselves.
    """
    rows = keyed(docs)
    spans = repeated_spans(rows, length)
    if words is not None:
        spans = spans.union(repeated_words(rows, words))
        spans = spans.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans = spans.select(*KEY, "spans", none.alias("marks"))
    if marked is not None:
        marks = repeated_words(rows, marked).select(*KEY, none.alias("spans"), F.col("spans").alias("marks"))
        spans = spans.union(marks).groupBy(*KEY).agg(
            *[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "marks")]
        )
    spans = materialize(spans, "spans")
    keys = spans.select(*KEY)
    touched = join_bounded(rows, keys, KEY, "left_semi", null_safe=True)
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("text_hash").eqNullSafe(F.col("_text_hash"))
    touched = touched.join(spans.withColumnsRenamed({k: f"_{k}" for k in KEY}), same).select(*KEY, "text", "spans", "marks")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            out = []
            for text, spans, marks in zip(text_array(part).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist()):
                data, cuts = text.encode(), _merged(spans)
                edges = [0, *(x for c in cuts for x in c), len(data)]
                pieces = [data[i:j] for i, j in zip(edges[::2], edges[1::2])]
                kept = b"".join(pieces)
                shown = "".join(p.decode("utf-8", "ignore") for p in pieces)
                out.append((len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), shown, sum(b - a for a, b in _merged(marks))))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array([r[k] for r in out], t) for k, t in enumerate(types))],
                [*KEY, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "n_passage"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, text_hash long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, n_passage long"
    changed = touched.mapInArrow(remove, columns)
    zero = F.lit(0).cast("long")
    whole = join_bounded(rows, keys, KEY, "left_anti", null_safe=True).select(
        *KEY,
        F.octet_length("text").cast("long").alias("n_bytes"),
        zero.alias("n_removed"),
        zero.alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
        F.col("text").alias("kept_text"),
        zero.alias("n_passage"),
    )
    return changed.union(whole)
