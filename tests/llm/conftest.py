"""A small folder of tables with every odd case, written as Parquet."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

CLASH = ["text_hash", "node", "label", "shard", "slot", "score", "place", "hash", "n", "a", "b", "key", "anchor", "_text", "c0"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)

SYLLABLES = {
    "en": "the of and ing er th on re tion st".split(),
    "de": "der und sch ung keit ein ver lich che tz".split(),
    "es": "que ción los ado ez mente ar ñ co ja".split(),
}
INSULTS = "idiot moron scum".split()


def prose(rng, lang, n):
    words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ",", "."]) for w in words)


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang)."""
    rng = random.Random(7)
    out = []
    for i in range(90):
        lang = rng.choice(list(SYLLABLES))
        out.append([i, prose(rng, lang, rng.randint(1, 160)), lang])
    shared = prose(rng, "en", 120)
    for i in range(90, 110):  # one passage in many documents
        out.append([i, f"{prose(rng, 'en', 20)}\n{shared} {prose(rng, 'en', rng.randint(1, 60))}", "en"])
    base = prose(rng, "de", 150).split()
    for i in range(110, 125):  # near copies, all a little different
        copy = list(base)
        for _ in range(rng.randint(1, 2)):
            copy[rng.randrange(len(copy))] = f"anders{rng.randrange(99)}"
        out.append([i, " ".join(copy), "de"])
    out += [[125 + i, out[3][1], "en"] for i in range(6)]  # exact copies
    for i in range(131, 151):  # toxic
        words = prose(rng, "en", 60).split()
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        out.append([i, " ".join(words), "en"])
    odd = [
        None, "", "   \n\t ", "12 345 !!", "x", "éñ", "日本語 テスト", "same line\nsame line\nsame line", "a b c",
        "a b c d", "buy buy buy " * 400, "ab" * 3000, "<|endoftext|> in  two  \n\n spaces", "<s> </s> ▁x",
        "word*** word### | | | " * 20, "LOUD TEXT!! " * 40, prose(rng, "en", 20_000),
    ]
    out += [[200 + i, t, "en" if i % 2 else None] for i, t in enumerate(odd)]
    out += [[None, "a text without an id, " + prose(rng, "en", 30), "en"], [5, out[5][1], out[5][2]], [6, "another text of id six", None]]
    return [tuple(r) for r in out]


ITEMS = [
    (1, "When does the slow river train reach the northern harbour if it leaves at noon on market day"),
    (2, "Yesterday we saw that Alice carried 12 kg of fresh apples home and then sold Bob 3 of these apples for his lunch"),
    (3, "short item"),
    (4, None),
]


@pytest.fixture(scope="session")
def leaks():
    """(doc_id, text, item found or None)."""
    return [
        (301, "before it " + ITEMS[0][1] + ", and after", 1),
        (302, ITEMS[0][1].upper(), 1),
        (303, "x y z. " + ITEMS[1][1].replace("Alice", "Karen").replace("12 kg", "95 lb").replace("Bob 3", "Dave 8"), 2),
        (304, "When does the slow river boat reach the southern harbour if it leaves before noon on any day", None),
    ]


VECTORS = "vec_id long, embedding array<float>, label int, cluster string, distance string, ids string"


@pytest.fixture(scope="session")
def vectors():
    """(vec_id, embedding)."""
    rng = random.Random(11)
    places = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(7)]
    out = [(i, [x + rng.gauss(0, 0.05 + i % 3 / 10) for x in rng.choice(places)]) for i in range(300)]
    out += [(300 + i, out[4][1]) for i in range(200)]  # one very common vector
    out += [(5, out[5][1]), (5, out[6][1]), (None, out[7][1]), (None, out[8][1])]  # repeated rows and ids
    out += [(600, None), (601, []), (602, out[0][1][:63]), (603, [*out[0][1], 0.0])]
    out += [(604 + i, [*out[0][1][:63], x]) for i, x in enumerate([None, float("nan"), float("inf"), -float("inf")])]
    out += [(610, [0.0] * 64), (611, [-0.0] * 64), (612, [1 / 256] * 64), (613, [-1e-9] * 64)]
    return out


@pytest.fixture(scope="session")
def folder(spark, rows, leaks, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    full = [*rows, *((i, t, "en") for i, t, _ in leaks)]
    data = [(i, t, lang, "src", len(t or ""), *["x"] * len(CLASH)) for i, t, lang in full]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(131 <= i < 151)) for i in range(151)] + [(None, 1, 1), (3, None, None), (999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    data = [(i, v, 1, "x", "x", "x") for i, v in vectors]
    spark.createDataFrame(data, VECTORS).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], VECTORS).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="session")
def everything(rows, leaks):
    return [*((i, t) for i, t, _ in rows), *((i, t) for i, t, _ in leaks)]


@pytest.fixture(scope="session")
def library():
    """The tokenizers that the operators must agree with."""
    return {
        "word": Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")),
        "byte": Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")),
        "piece": sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")),
    }
