"""Pre-tokens on bytes, windows that are compared only at one distance from their anchor."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import public_tokenizers
import regex

from geopanel.llm import blocks, pieces, quality, repeats
from tests.llm.test_round4 import large, passages


def test_pre_tokens_are_those_of_the_pattern(library):
    assert public_tokenizers.PATTERN == pieces.BYTE_LEVEL
    rng = random.Random(8)
    odd = ["\x1c", "\u0301", "½", "²", "٣", "’", "—", "😀", "字", "ñ", "Ж", "\u200b", "_", "\x00", "<|endoftext|>", "\xa0"]
    parts = ["a", "S", "the", "s", "t", "re", "ve", "ll", "l", "'", "''", " ", "  ", "\n", "\t", "7", "12", ".", "!?", *odd]
    spans = pieces.TokenSpans()
    units = pieces.Units(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    for _ in range(60):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(40)]
        data, at = blocks.raw(large(texts))
        start = spans.starts(data, at)
        end = np.append(start[1:], len(data))
        for k, t in enumerate(texts):
            if "\xa0" not in t:
                mine = (start >= at[k]) & (start < at[k + 1])
                got = [data[a:b].tobytes().decode() for a, b in zip(start[mine], end[mine])]
                assert got == regex.findall(public_tokenizers.PATTERN, t)
        want = [e.ids for e in library["byte"].encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in units.encode_block(data, at)] == want


def test_a_word_is_encoded_once_whatever_follows_it():
    units = pieces.Units(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    units.encode_block(*blocks.raw(large([" word, word. word", " word word; word!"])))
    assert len(units.start) - 1 == 5  # the word and four marks


def test_powers():
    for n in (0, 1, 2, 3, 1000):
        assert blocks.powers(blocks.BASE, n).tolist() == [pow(blocks.BASE, k, 2**64) for k in range(n)]


def test_windows_are_compared_inside_their_bucket():
    rng = np.random.default_rng(6)
    text = rng.choice(list(b"ab"), 1600).astype(np.uint8)
    text[800:1400] = text[80:680]
    text[1500:1564] = text[603:667]  # equal to others, but at another residue
    for length in (24, 64):
        windows = np.arange(len(text) - length + 1)
        bucket = windows % repeats.COVER + 8 * (windows % 5 > 2)
        seen = Counter((b, text[i : i + length].tobytes()) for i, b in zip(windows, bucket))
        want = [seen[b, text[i : i + length].tobytes()] > 1 for i, b in zip(windows, bucket)]
        assert any(want) and repeats.repeated_windows(text, windows, length, bucket).tolist() == want


def test_anchors_do_not_depend_on_the_block():
    """A hash that gives way to its place must lose the same bits in a short and a long block."""
    rng = random.Random(3)
    text = "".join(rng.choices("abc ", k=900))
    data, at = blocks.raw(large([text]))
    assert repeats.PLACE_BITS >= (blocks.LONG_TEXT + repeats.LENGTH).bit_length()
    alone = repeats.stretches(data, at, 400)
    more, ends = blocks.raw(large([text, "x" * 300_000, text]))
    of, *rest = repeats.stretches(more, ends, 400)
    for k in (0, 2):
        assert [x[of == k].tolist() for x in rest] == [x.tolist() for x in alone[1:]]


def test_passages_of_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "LONG_TEXT", 700)
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(n))
    planted = [prose(n) for n in (60, 80, 200)]
    texts = [f"{prose(150)} {p} {prose(rng.randint(0, 300))}" for p in planted for _ in range(2)]
    texts += [f"{planted[2][:600]}{prose(100)}", planted[0] + "\n", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_passage"] for r in repeats.without_repeats(docs, marked=50).collect()}
    assert [got[k] for k in range(len(texts))] == passages(texts, 50) and got[0] > 0


def test_costs_below_the_noise_are_equal():
    # reading alone was disturbed in two turns: the second rule is not free, and one slow run makes no rule dear
    turns = [[0.10, 0.16, 0.13, 0.50], [0.13, 0.16, 0.12, 0.49], [0.13, 0.90, 0.13, 0.50]]
    costs = quality.rule_costs(turns)
    assert [round(x, 3) for x in costs] == [0.06, 0.03, 0.39]
    assert quality.rule_costs([[0.1, 0.1]]) == [0.001]
