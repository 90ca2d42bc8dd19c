"""Language identification with bit-sliced Bloom filters of byte n-grams.

Every slot of the filter holds one bit per language. Reading the slots of an
n-gram and AND-ing them returns, in one step, all languages that (may) contain
it. A text's n-grams are looked up, the bits are counted per language, each
count is corrected for the language's false-positive rate, and the largest
corrected count decides.

Cases: a null, empty or letterless text is ``und`` with score 0; ties go to the
alphabetically first language; with no training row every text is ``und``;
repeated rows are predicted one by one; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, blocks, mix, raw, text_array

#: Bytes of an n-gram; the statistics have at most 2**24 n-grams a language.
GRAM = 3
#: Slots of the filter and slots of one n-gram.
SLOTS, PROBES = 1 << 18, 2
#: An n-gram belongs to a language with this share of the language's n-grams...
LEAST_RATE = 1e-5
#: ...and this part of the rate it has in the language where it is most frequent.
LEAST_SHARE = 0.3
UNKNOWN = "und"

_letter = re.compile(r"[^\W\d_]")
#: Letters stay (lower case), bytes of other alphabets stay, all else is a blank.
_CODE = LOWER.copy()
_CODE[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass
class Filters:
    """The fitted filter: ``planes[p][slot]`` has the bits of 64 languages."""

    languages: list[str]
    planes: np.ndarray
    false_rate: np.ndarray


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n-gram keys of every text, edges padded by blanks, and each key's text number."""
    data, at = raw(texts)
    n, owner = len(at) - 1, np.repeat(np.arange(len(at) - 1), np.diff(at))
    codes = np.full(len(data) + 2 * n, 32, np.uint8)
    codes[np.arange(len(data)) + 2 * owner + 1] = _CODE[data]
    wide = codes.astype(np.uint32)
    key = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
    of = np.repeat(np.arange(n), np.diff(at) + 2)
    # inside one text, and not blanks alone around nothing
    good = (of[:-2] == of[2:]) & (wide[1:-1] != 32)
    return key[good], of[:-2][good]


def _probe(key: np.ndarray, slots: int) -> list[np.ndarray]:
    h = mix(key.astype(np.uint64) + np.uint64(1))
    return [((h >> np.uint64(20 * i)) & np.uint64(slots - 1)).astype(np.int64) for i in range(PROBES)]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each n-gram occurs in the texts of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([c for _, c in held])).astype(np.int64)
            return keys, n

        for part in blocks(batches):
            lang = [names.setdefault(x, len(names)) for x in part.column("lang").to_pylist()]
            key, of = grams(text_array(part))
            both = np.array(lang, np.int64)[of] << 24 | key.astype(np.int64)
            held.append(np.unique(both, return_counts=True))
            if len(held) > 8:
                held = [merged()]
        if held:
            keys, n = merged()
            order = np.array(list(names), object)
            for i in range(0, len(keys), 50_000):
                k = keys[i : i + 50_000]
                yield pa.record_batch(
                    [
                        pa.array(order[k >> 24], pa.string()),
                        pa.array((k & 0xFFFFFF).astype(np.int32)),
                        pa.array(n[i : i + 50_000]),
                    ],
                    ["lang", "gram", "n"],
                )

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counted = rows.mapInArrow(count, "lang string, gram int, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> Filters:
    """Learn the filters from every row of ``docs`` (text, lang).

    Only the n-grams that pass both rate limits reach the driver: at most
    1 / LEAST_RATE for each language, whatever the size of the corpus.
    """
    counts = gram_counts(docs)
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.join(F.broadcast(total), "lang").select(
        "lang", "gram", (F.col("n") / F.col("total")).alias("rate")
    )
    rate = rate.where(F.col("rate") >= LEAST_RATE)
    kept = (
        rate.groupBy("gram")
        .agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("of"))
        .select("gram", F.expr(f"transform(filter(of, x -> x.rate >= {LEAST_SHARE} * top), x -> x.lang)").alias("of"))
        .select("gram", F.explode("of").alias("lang"))
        .toPandas()
    )
    languages = sorted(kept["lang"].unique())
    planes = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), np.uint64)
    false_rate = np.zeros(len(languages))
    for i, name in enumerate(languages):
        key = kept["gram"][kept["lang"] == name].to_numpy(np.int64)
        bit = np.uint64(1 << (i % 64))
        for slot in _probe(key, SLOTS):
            planes[i // 64][slot] |= bit
        false_rate[i] = ((planes[i // 64] & bit) > 0).mean() ** PROBES
    small = np.uint8 if len(languages) <= 8 else np.uint64
    return Filters([str(x) for x in languages], planes.astype(small), false_rate)


def classify(texts: pa.Array, model: Filters) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n, count = len(texts), len(model.languages)
    key, of = grams(texts)
    total = np.bincount(of, minlength=n).astype(float)
    if not count:
        return [UNKNOWN] * n, np.zeros(n)
    slots = _probe(key, model.planes.shape[1])
    found = []
    for plane in model.planes:
        bits = plane[slots[0]]
        for s in slots[1:]:
            bits = bits & plane[s]
        found.append(bits)
    corrected = np.zeros((count, n))
    one = model.planes.dtype.type(1)
    for i in range(count):
        hit = (found[i // 64] >> model.planes.dtype.type(i % 64)) & one
        seen = np.bincount(of[hit > 0], minlength=n)
        f = model.false_rate[i]
        corrected[i] = np.clip((seen - f * total) / max(1e-9, 1 - f), 0, None)
    best = corrected.argmax(0)
    top = corrected[best, np.arange(n)]
    # how far the best language explains the text, and how far the others do not
    rest = np.where(np.arange(count)[:, None] == best, 0, corrected).max(0) if count > 1 else np.zeros(n)
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.where(top > 0, (top / np.maximum(total, 1)) * (1 - 0.5 * rest / np.maximum(top, 1e-9)), 0.0)
    data, at = raw(texts)
    plain = np.concatenate([[0], np.cumsum(_CODE[data] != 32)])
    letters = plain[at[1:]] - plain[at[:-1]] > 0
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    doubt = np.flatnonzero(letters & (plain[at[1:]] - plain[at[:-1]] == high[at[1:]] - high[at[:-1]]))
    for i in doubt:
        letters[i] = _letter.search(texts[int(i)].as_py()) is not None
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
    return names, np.clip(np.where(letters, score, 0.0), 0, 1)


def predict(docs: DataFrame, model: Filters, columns: list[str]) -> DataFrame:
    """``columns`` of every row with ``lang_pred`` and ``score``."""
    inner = docs.select(*columns, F.col("text").alias("_text"))
    schema = inner.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def renamed(source):
            for b in source:
                yield b.rename_columns([*(f"c{i}" for i in range(len(columns))), "text"])

        for part in blocks(renamed(batches)):
            names, score = classify(text_array(part), model)
            out = [part.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(names, pa.string()), pa.array(score)], [*columns, "lang_pred", "score"]
            )

    return inner.mapInArrow(run, schema)
