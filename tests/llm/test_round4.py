"""Long texts in pieces, passages by words, units by their bytes, repeatable fits."""

import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from geopanel.llm import blocks, neardup, pieces, repeats, spm, toxicity
from geopanel.llm.queries import QUERIES

from . import brute


def large(texts):
    return pa.array(texts, pa.large_string())


@pytest.mark.parametrize("width", [1, 2, 5])
def test_sets_of_long_texts(monkeypatch, width):
    rng = random.Random(width)
    texts = [" ".join(rng.choices(["a", "bb", "Ccc", "dé", "e" * 70], k=n)) + "  " for n in (0, 1, 3, 400)] + ["x" * 300, " \n" * 50, "one"]
    want, at = neardup.shingle_sets(large(texts), width)
    for limit in (1, 7, 64):
        monkeypatch.setattr(neardup, "LONG_TEXT", limit)
        got, ends = neardup.shingle_sets(large(texts), width)
        assert ends.tolist() == at.tolist() and (got == want).all()


def test_stretches_of_long_texts(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcd", k=n)) for n in (90, 500, 39, 40, 200)]
    data, at = blocks.raw(large(texts))

    def windows(found):
        of, anchor, _, a, b, p = found
        return Counter((o, h, i, q) for o, h, x, y, q in zip(of.tolist(), anchor.tolist(), a.tolist(), b.tolist(), p.tolist()) for i in range(x, y + 1))

    want = windows(repeats.stretches(data, at, 40))
    assert len(want) == sum(max(0, len(t) - 39) for t in texts)
    monkeypatch.setattr(repeats, "LONG_TEXT", 60)
    assert windows(repeats.stretches(data, at, 40)) == want


def test_one_text_of_fifty_megabytes():
    resource = pytest.importorskip("resource")
    rng = np.random.default_rng(0)
    text = rng.choice(np.frombuffer(b"abcdefgh   \n", np.uint8), 50_000_000).tobytes().decode()
    texts = large([text])
    blocks.release()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    of, *_ = repeats.stretches(*blocks.raw(texts), 400)
    h, at = neardup.shingle_sets(texts, 5)
    assert len(of) > 100_000 and len(h) > 5_000_000
    # about 14 bytes for a byte of text: the sets themselves, twice
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 900_000


def passages(texts, words):
    """Bytes of each text that a repeated window of ``words + 1`` words covers."""
    found, seen = [], Counter()
    for k, t in enumerate(texts):
        data = (t or "").encode()
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        for i in range(len(spans) - words):
            a, b = spans[i][0], spans[i + words][1]
            found.append((k, a, b, data[a:b]))
            seen[data[a:b]] += 1
    out = [set() for _ in texts]
    for k, a, b, w in found:
        if seen[w] > 1:
            out[k] |= set(range(a, b))
    return [len(s) for s in out]


@pytest.mark.parametrize("chunk", [100_000, 40])
def test_passages_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "WINDOWS", chunk)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    planted = [prose(n) for n in (51, 55, 60, 70, 50, 30)]
    texts = [prose(rng.randint(1, 150)) for _ in range(20)] + [None, "", " \n"]
    for k, p in enumerate(planted):
        for _ in range(2 + 6 * (k == 1)):
            texts.append(f"{prose(rng.randint(0, 40))}\n{p}  {prose(rng.randint(0, 30))}".strip())
    texts += [f"{planted[2]} x {planted[2]}", "a b c " * 60, planted[3].replace(" ", "  "), texts[3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_passage"] for r in repeats.without_repeats(docs, marked=50).collect()}
    want = passages(texts, 50)
    assert [got[k] for k in range(len(texts))] == want
    assert all(want[k] for k in range(23, 33)) and not any(want[:3]) and want[-4] > 0


def test_op3_marks(spark, folder, everything):
    got = QUERIES["op3_suffix_array_dedup"](spark, folder).select("doc_id", "n_bytes", "n_removed_words").collect()
    want = [(i, len((t or "").encode()), n) for (i, t), n in zip(everything, passages([t for _, t in everything], 50))]
    assert Counter(map(repr, map(tuple, got))) == Counter(map(repr, want))
    assert brute.repeats(["x" * 500, "x" * 500], 400)[0][1] == 500


def test_units_are_those_of_the_pattern(library):
    rng = random.Random(1)
    odd = ["\x85", "\xa0", " ", "　", " ", " ", " ", " ", "​", "\x1c", "\xc2", "<|endoftext|>"]
    letters = ["a", "b", "the", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "é", "字", "'s", "12", "!!", *odd]
    units = pieces.Units(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    for _ in range(20):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(40)]
        data, at = blocks.raw(large(texts))
        assert [x.tolist() for x in units.encode_block(data, at)] == [
            e.ids for e in library["byte"].encode_batch(texts, add_special_tokens=False)
        ]
        start, end, owner = pieces.unit_spans(data, at)
        for k, t in enumerate(texts):
            if not len(pieces.other_white(np.frombuffer(t.encode(), np.uint8))):
                got = [data[a:b].tobytes().decode() for a, b in zip(start[owner == k], end[owner == k])]
                assert got == pieces.BLANK_LED.findall(t)


def test_units_forget(monkeypatch, library):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    monkeypatch.setattr(pieces, "RECENT", 10)
    units = pieces.Units(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    for k in range(30):
        texts = [f"number {k} and {j * j} of {k * j}" for j in range(8)]
        got = units.encode_block(*blocks.raw(large(texts)))
        assert [x.tolist() for x in got] == [e.ids for e in library["byte"].encode_batch(texts, add_special_tokens=False)]


def test_op1_runs_of_blanks(library, monkeypatch):
    v = spm.load(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [f"x{' ' * n}y" for n in (2, 17, 1000, 100_000)] + ["lorem" * 3000, " " * 5000, "a  b   c    d " * 50]
    start = time.process_time()
    ids, at = spm.Encoder(v).encode(large(texts))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == library["piece"].encode(texts)
    assert time.process_time() - start < 20  # plain rescanning took half an hour for the fourth
    monkeypatch.setattr(spm, "LONG_STRETCH", 3)
    ids, at = spm.Encoder(v).encode(large(texts[4:]))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(3)] == library["piece"].encode(texts[4:])


def test_op10_fits_are_repeatable(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    monkeypatch.setattr(toxicity, "FIT_ROWS", 100)
    sample = toxicity.sampled_labels(labels).collect()
    assert len(sample) == 100
    one = toxicity.fit(docs, labels)
    two = toxicity.fit(docs.repartition(7, "text"), labels.repartition(5))
    assert (one.entries == two.entries).all() and (one.weights == two.weights).all()
    assert (one.patterns == two.patterns).all() and one.bias == two.bias
