"""SentencePiece (BPE) encoding by suffix-array matching and edge relaxation.

A block of texts is cut into stretches that no piece can span, and each
distinct stretch is solved once. The distinct stretches form one text whose
suffixes are sorted; a binary search for every piece of the vocabulary gives
the range of its occurrences. Each occurrence is an edge from its start to its
end. Edges are sorted by end and relaxed: the encoding of a prefix ends in
exactly one piece that may follow the last piece of the prefix before it, so
one pass over the edges leaves the path that the merges of BPE lead to.

Whether one piece may follow another is decided by the merge order: walking
down the two derivations at the boundary, no merge across it may come before
the merges that use up its two sides. This needs derivations whose scores fall
from part to whole; pieces where they do not (runs of blanks share one score)
are left to plain merging of the stretches they occur in.

Decoding looks the bytes of all ids up at once.

Cases: null and empty texts have no pieces; characters outside the vocabulary
become byte pieces; repeated rows are encoded one by one; other columns are
never read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import BASE, INVERSE, blocks, mix, powers, raw, text_array

#: Text bytes that are solved together, and stretches that a task remembers.
BATCH, REMEMBERED = 1_000_000, 600_000
SPACE = 0x2581
NORMAL, BYTE = 1, 6
_FREE = np.int32(2**30)


#: Characters of a stretch beyond which it is merged plainly; the edges are relaxed one place at a time.
LONG_STRETCH = 20_000


@dataclass
class Vocabulary:
    """Tables of a model; all are as large as the vocabulary, or the ways to split its pieces."""

    text: list[str]  # pieces that merges can make, by number
    ids: np.ndarray  # model id of each
    rank: np.ndarray  # merge order; characters are -1
    left: np.ndarray  # last merge of each piece: parts, or -1
    right: np.ndarray
    plain: np.ndarray  # pieces that need plain merging
    joins: np.ndarray  # sorted left * size + right of all merges
    join_rank: np.ndarray
    byte_ids: np.ndarray
    surface: list[bytes]  # by model id
    letters: np.ndarray  # sorted code points of all pieces
    dummy: bool


def merge(text: str, scores: dict[str, float]) -> tuple[list[str], list[tuple[str, str]]]:
    """BPE of a string by plain merging: best score first, leftmost of equals; and the merges made.

    Pairs wait in a heap and parts are linked to their neighbours, so the time
    is that of sorting the string.
    """
    parts: list[str | None] = list(text)
    before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (s := scores.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (-s, i, parts[i] + parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    made = []
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else -1
        if j < 0 or parts[i] + parts[j] != both:
            continue  # one side has been merged since
        made.append((parts[i], parts[j]))
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in parts if p is not None], made


def load(path: str) -> Vocabulary:
    """Read a model file and derive the tables."""
    import sentencepiece as sp

    model = sp.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    scores, ids, byte_ids, surface = {}, {}, np.zeros(256, np.uint32), []
    for i, name in enumerate(names):
        if model.is_byte(i):
            byte_ids[int(name[1:-1], 16)] = i
            surface.append(bytes([int(name[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            surface.append(b"")
        else:
            scores[name] = model.get_score(i)
            ids[name] = i
            surface.append(name.replace(chr(SPACE), " ").encode())
    text = list(scores)
    number = {p: k for k, p in enumerate(text)}
    order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
    rank = np.array([-1 if len(p) == 1 else order[scores[p]] for p in text], np.int32)
    left, right = np.full(len(text), -1, np.int32), np.full(len(text), -1, np.int32)
    plain = np.zeros(len(text), bool)
    times = np.bincount(rank[rank >= 0], minlength=len(order))
    joins, join_rank = [], []
    for k, p in enumerate(text):
        if len(p) == 1:
            continue
        for c in range(1, len(p)):
            if p[:c] in number and p[c:] in number:
                joins.append(number[p[:c]] * len(text) + number[p[c:]])
                join_rank.append(rank[k])
        parts, made = merge(p, scores)
        if len(parts) > 1:
            continue  # never the outcome of merges; left as -1 beside -1
        a, b = made[-1]
        left[k], right[k] = number[a], number[b]
        steps = [rank[number[x + y]] for x, y in made]
        plain[k] = steps != sorted(steps) or times[rank[k]] > 1
    by = np.argsort(joins)
    letters = np.unique([ord(c) for p in text for c in p]).astype(np.uint32)
    # the dummy prefix: a blank before every text
    dummy = model.encode("a", out_type=str)[0].startswith(chr(SPACE))
    return Vocabulary(
        text, np.array([ids[p] for p in text], np.uint32), rank, left, right, plain,
        np.array(joins, np.int64)[by], np.array(join_rank, np.int32)[by], byte_ids, surface, letters, dummy,
    )


class Encoder:
    """Encodes arrays of texts; remembers stretches."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.size = len(v.text)
        self.scores = {p: -float(r) for p, r in zip(v.text, v.rank) if len(p) > 1}
        self.number = {p: k for k, p in enumerate(v.text)}
        self.longest = max(map(len, v.text))
        self.reached = (v.rank < 0) | (v.left >= 0)
        self.pair_key = np.full(1 << 20, -1, np.int64)
        self.pair_ok = np.zeros(1 << 20, bool)
        self.forget()

    def forget(self) -> None:
        self.seen = np.zeros(0, np.uint64)  # sorted hashes of stretches
        self.row = np.zeros(0, np.int64)
        self.start = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the text of ``a`` and ``b`` together gives these two pieces."""
        key = a.astype(np.int64) * self.size + b
        slot = (mix(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        known = self.pair_key[slot] == key
        out = self.pair_ok[slot]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self._follows(a[new], b[new])
            self.pair_key[slot[new]] = key[new]
            self.pair_ok[slot[new]] = out[new]
            # of several pairs in one slot the last one written stays; its answer with it
            last = self.pair_key[slot[new]] == key[new]
            self.pair_ok[slot[new[last]]] = out[new[last]]
        return out

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        v = self.v
        out = np.ones(len(a), bool)
        x, y = a.astype(np.int64), b.astype(np.int64)
        next_x, next_y = np.full(len(a), _FREE), np.full(len(a), _FREE)
        live = np.arange(len(a))
        while len(live):
            key = x[live] * self.size + y[live]
            i = np.minimum(np.searchsorted(v.joins, key), len(v.joins) - 1)
            q = np.where(v.joins[i] == key, v.join_rank[i], _FREE)
            # the merge across the boundary is first; of equals the left one is
            cross = (q < next_x[live]) & (q <= next_y[live]) & (q < _FREE)
            out[live[cross]] = False
            live = live[~cross]
            rx, ry = v.rank[x[live]], v.rank[y[live]]
            done = (rx < 0) & (ry < 0)
            live, rx, ry = live[~done], rx[~done], ry[~done]
            # step back over the merge that was made last: on a tie the right side's
            back_x = rx > ry
            one, two = live[back_x], live[~back_x]
            next_x[one] = v.rank[x[one]]
            x[one] = v.right[x[one]]
            next_y[two] = v.rank[y[two]]
            y[two] = v.left[y[two]]
        return out

    def _plain(self, text: str) -> list[int]:
        return [self.number[p] for p in merge(text, self.scores)[0]]

    def solve(self, chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all stretches ``chars[at[i]:at[i + 1]]``, and where each one's begin."""
        v, n = self.v, len(chars)
        stretch = np.repeat(np.arange(len(at) - 1), np.diff(at))
        alphabet, code = np.unique(chars, return_inverse=True)
        code = code.astype(np.uint64) + np.uint64(1)
        bits = int(len(alphabet)).bit_length()
        per = 63 // bits
        words = -(-self.longest // per)
        room = at[stretch + 1] - np.arange(n)
        # the suffixes, cut at the end of their stretch, as machine words of `per` characters
        keys = []
        for w in range(words):
            key = np.zeros(n, np.uint64)
            for t in range(w * per, (w + 1) * per):
                here = np.zeros(n, np.uint64)
                if t < n:
                    here[: n - t] = np.where(room[: n - t] > t, code[t:], 0)
                key = key << np.uint64(bits) | here
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        # binary search of every piece whose characters all occur
        lookup = {int(c): k + 1 for k, c in enumerate(alphabet)}
        numbers, lows, highs = [], [], []
        for k, p in enumerate(v.text):
            c = [lookup.get(ord(x), 0) for x in p]
            if not self.reached[k] or 0 in c:
                continue
            low, high = [], []
            for w in range(-(-len(c) // per)):
                part = c[w * per : (w + 1) * per]
                value = 0
                for x in part:
                    value = value << bits | x
                shift = bits * (per - len(part))
                low.append(value << shift)
                high.append((value + 1 << shift) if w == (len(c) - 1) // per else value << shift)
            numbers.append(k)
            lows.append(low)
            highs.append(high)
        first = np.searchsorted(keys[0], np.array([x[0] for x in lows], np.uint64))
        last = np.searchsorted(
            keys[0], np.array([h[0] if len(h) == 1 else h[0] + 1 for h in highs], np.uint64)
        )
        for j in np.flatnonzero((np.array([len(x) for x in lows]) > 1) & (last > first)):
            f, e = int(first[j]), int(last[j])
            for w in range(1, len(lows[j])):
                final = w == len(lows[j]) - 1
                top = highs[j][w] if final else lows[j][w] + 1
                f, e = (f + int(np.searchsorted(keys[w][f:e], np.uint64(x))) for x in (lows[j][w], top))
            first[j], last[j] = f, e
        count = last - first
        piece = np.repeat(np.array(numbers, np.int32), count)
        ends = np.cumsum(count)
        start = suffixes[np.arange(len(piece)) + np.repeat(first - (ends - count), count)]
        length = np.array([len(p) for p in v.text], np.int64)
        # stretches with pieces that share a score, and very long ones, are merged plainly
        bad = np.diff(at) > LONG_STRETCH
        bad[stretch[start[v.plain[piece]]]] = True
        use = ~bad[stretch[start]]
        start, piece = start[use], piece[use]
        # relax the edges in the order of their ends
        level = (start - at[stretch[start]] + length[piece]).astype(np.int32)
        order = np.argsort(level, kind="stable")
        level, start, piece = level[order], start[order], piece[order]
        edges = np.searchsorted(level, np.arange(1, (int(level[-1]) if len(level) else 0) + 2))
        tail = np.full(n, -1, np.int32)  # last piece of the prefix that ends with a character
        begin = np.zeros(n, np.int64)
        opening = at[stretch]
        for i, j in zip(edges[:-1], edges[1:]):
            s, p = start[i:j], piece[i:j]
            ok = s == opening[s]
            follow = np.flatnonzero(~ok)
            before = tail[s[follow] - 1]
            follow, before = follow[before >= 0], before[before >= 0]
            ok[follow] = self.may_follow(before, p[follow])
            e = s[ok] + length[p[ok]] - 1
            tail[e] = p[ok]
            begin[e] = s[ok]
        # walk back from the ends
        done = at[1:] - 1
        rows, found = np.flatnonzero(~bad), []
        cursor = done[rows]
        while len(rows):
            t = tail[cursor]
            lost = t < 0
            bad[rows[lost]] = True
            rows, cursor, t = rows[~lost], cursor[~lost], t[~lost]
            bad[rows[v.plain[t]]] = True
            found.append((rows, t))
            cursor = begin[cursor] - 1
            more = cursor >= at[rows]
            rows, cursor = rows[more], cursor[more]
        none = np.zeros(0, np.int64)
        who = np.concatenate([none, *(r for r, _ in found)])
        what = np.concatenate([none, *(t for _, t in found)])
        when = np.concatenate([none, *(np.full(len(r), -k) for k, (r, _) in enumerate(found))])
        if bad.any():
            use = ~bad[who]
            who, what, when = who[use], what[use], when[use]
            for i in np.flatnonzero(bad):
                got = self._plain("".join(map(chr, chars[at[i] : at[i + 1]].tolist())))
                who = np.append(who, np.full(len(got), i))
                what = np.append(what, got)
                when = np.append(when, np.arange(len(got)))
        order = np.lexsort((when, who))
        sizes = np.bincount(who, minlength=len(at) - 1)
        return what[order], np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin."""
        v = self.v
        strings = texts.to_pylist()
        lead = chr(SPACE) if v.dummy else ""
        joined = "".join([lead + t for t in strings if t])
        sizes = np.array([len(t) + len(lead) if t else 0 for t in strings], np.int64)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        chars[chars == 32] = SPACE
        n = len(chars)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(strings) + 1, np.int64)
        text_at = np.concatenate([[0], np.cumsum(sizes)])
        i = np.minimum(np.searchsorted(v.letters, chars), len(v.letters) - 1)
        known = v.letters[i] == chars
        blank = chars == SPACE
        cut = np.zeros(n, bool)
        cut[text_at[:-1][sizes > 0]] = True
        cut[1:] |= (blank[1:] & ~blank[:-1]) | ~known[1:] | ~known[:-1]
        at = np.concatenate([np.flatnonzero(cut), [n]])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
        h = mix((sums[at[1:]] - sums[at[:-1]]) * powers(INVERSE, n + 1)[at[:-1]] ^ np.diff(at).astype(np.uint64))
        if len(self.seen) > REMEMBERED:
            self.forget()
        distinct, example, back = np.unique(h, return_index=True, return_inverse=True)
        j = np.minimum(np.searchsorted(self.seen, distinct), max(0, len(self.seen) - 1))
        old = self.seen[j] == distinct if len(self.seen) else np.zeros(len(distinct), bool)
        fresh = example[~old]
        if len(fresh):
            ids, begin = self._fresh(chars, at, fresh, known)
            rows = len(self.start) - 1 + np.arange(len(fresh))
            self.start = np.concatenate([self.start, self.start[-1] + begin[1:]])
            self.pool = np.concatenate([self.pool, ids])
            seen = np.concatenate([self.seen, distinct[~old]])
            order = np.argsort(seen, kind="stable")
            self.seen, self.row = seen[order], np.concatenate([self.row, rows])[order]
        row = self.row[np.searchsorted(self.seen, distinct)][back]
        size = self.start[row + 1] - self.start[row]
        ends = np.cumsum(size)
        ids = self.pool[np.arange(ends[-1]) + np.repeat(self.start[row] - (ends - size), size)]
        first = np.searchsorted(at[:-1], text_at)
        return ids, np.concatenate([[0], ends])[first]

    def _fresh(self, chars: np.ndarray, at: np.ndarray, which: np.ndarray, known: np.ndarray):
        """Ids of the stretches ``which``, and where each one's begin."""
        v = self.v
        size = at[which + 1] - at[which]
        ends = np.cumsum(size)
        text = chars[np.arange(ends[-1]) + np.repeat(at[which] - (ends - size), size)]
        out_of = ~known[at[which]]  # one character that no piece has
        inside = ~np.repeat(out_of, size)
        bounds = np.concatenate([[0], np.cumsum(size[~out_of])])
        pieces, begin = self.solve(text[inside], bounds) if len(bounds) > 1 else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        if not out_of.any():
            return v.ids[pieces], begin
        # put byte pieces where characters are unknown
        ids, sizes = [], np.zeros(len(which), np.int64)
        sizes[~out_of] = np.diff(begin)
        k = 0
        for i, unknown in enumerate(out_of):
            if unknown:
                got = v.byte_ids[list(chr(int(chars[at[which[i]]])).encode("utf-8", "surrogatepass"))]
                sizes[i] = len(got)
                ids.append(got)
            else:
                ids.append(v.ids[pieces[begin[k] : begin[k + 1]]])
                k += 1
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)])


class Decoder:
    """Texts of id sequences."""

    def __init__(self, v: Vocabulary):
        size = np.array([len(s) for s in v.surface], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.data = np.frombuffer(b"".join(v.surface), np.uint8)
        self.dummy = v.dummy

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        size = self.start[ids + 1] - self.start[ids] if len(ids) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends[:-1], size)].tobytes() if len(ids) else b""
        out = []
        for i in range(len(at) - 1):
            text = data[ends[at[i]] : ends[at[i + 1]]]
            if self.dummy and text[:1] == b" ":
                text = text[1:]
            out.append(text.decode("utf-8", "replace"))
        return out


def encoded(docs: DataFrame, vocabulary: Vocabulary, columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``docs`` with n_bytes, ids, ids_crc32 and decoded_crc32.

    The ids were decoded again; ``round_trip`` says whether that gave the text.
    """
    inner = docs.select(*columns, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])
    schema = f"{kinds}, n_bytes long, ids array<int>, ids_crc32 long, decoded_crc32 long, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)

        def named(source):
            for b in source:
                yield b.rename_columns([*(f"c{i}" for i in range(len(columns))), "text"])

        for part in blocks(named(batches), BATCH):
            texts = text_array(part)
            ids, at = encoder.encode(texts)
            back = decoder.decode(ids, at)
            raw_ids = ids.astype("<u4")
            crc = [zlib.crc32(raw_ids[at[i] : at[i + 1]].tobytes()) for i in range(part.num_rows)]
            other = [zlib.crc32(t.encode()) for t in back]
            same = [a == b for a, b in zip(texts.to_pylist(), back)]
            listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(i) for i in range(len(columns))),
                    pa.array(np.diff(raw(texts)[1])),
                    listed,
                    pa.array(crc, pa.int64()),
                    pa.array(other, pa.int64()),
                    pa.array(same),
                ],
                [*columns, "n_bytes", "ids", "ids_crc32", "decoded_crc32", "round_trip"],
            )

    return inner.mapInArrow(run, schema)
