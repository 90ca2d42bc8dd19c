"""The cases of the second review, each against a plain or SQL version."""

from collections import Counter

import duckdb

import corpus_pipeline
from geopanel.llm import decontaminate
from geopanel.llm.queries import ORACLES, QUERIES

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def bag(rows):
    return Counter(repr(tuple(r)) for r in rows)


def written(spark, path, rows):
    """A folder with ``rows`` (doc_id, text) as its documents."""
    data = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(data, DOCUMENT).repartition(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_op5_lines(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(60))
    texts = [
        "hello\n" * 100,
        f"{words}\n" + "END\nReply\nx09\n" * 30,
        f"{words}\n" + "   \n\t\n \r\n" * 40,
        f"{words}\r\nMenu\r\nMenu\r\n\r\n{words}\r\n",
        "\n\n \n",
        None,
    ]
    folder = written(spark, tmp_path, enumerate(texts))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    result = con.sql(ORACLES["op5_quality_rules"])
    got = QUERIES["op5_quality_rules"](spark, folder).select(*result.columns).collect()
    assert bag(got) == bag(result.fetchall())
    assert {r["doc_id"]: r["n_dup_lines"] for r in got} == {0: 99, 1: 87, 2: 0, 3: 2, 4: 0, 5: 0}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], DOCUMENT)


def test_one_row_of_each_group_stays(spark):
    def text(seed, n=120):
        return " ".join(f"w{seed}x{k * 7 % 101}" for k in range(n))

    near = text(3).replace("w3x7 ", "other ")
    rows = [
        (1, text(1)), (1, text(1)),  # delivered twice
        (2, text(2)), (3, text(2)), (2, text(2)),
        (4, text(3)), (4, near),  # one id, two near texts
        (None, text(5)), (None, text(5)), (None, text(6)),  # groups without ids
        (7, text(7)), (7, text(8)), (8, text(8)),  # one id in two groups
        (9, None), (9, None),
    ]
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()]
    assert Counter(i for i, _ in left) == {1: 1, 2: 1, 4: 1, None: 2, 7: 2, 9: 2}
    assert {t for _, t in left if t and t not in (text(3), near)} == {text(k) for k in (1, 2, 5, 6, 7, 8)}


def test_repeated_row_reaches_the_end(spark, tmp_path):
    sentence = " ".join(f"the clear{k} river runs{k}" for k in range(40))
    folder = written(spark, tmp_path, [(1, sentence), (1, sentence), (2, sentence), (3, "another small text")])
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()) == [1, 3]


def test_passages_of_short_words(spark):
    numbers = " ".join(str(k % 10) for k in range(49)) + " x y"
    assert len(numbers.split()) == 51 and len(numbers) < corpus_pipeline.PASSAGE
    fewer = " ".join("abcdefghi"[k * k % 9] for k in range(50))
    rows = [
        (1, f"first begins {numbers} and ends"), (2, f"second opens {numbers}\nso it closes"), (3, numbers), (None, numbers),
        (4, f"third has {fewer} alone"), (5, f"fourth had {fewer} too"),  # fifty words stay
        (6, "m n o " * 30),  # repeats inside a document
    ]
    got = corpus_pipeline.repeated_passages(spark, documents(spark, rows), "").collect()
    want = [(1, "first begins  and ends"), (2, "second opens \nso it closes"), *rows[4:6]]
    assert bag((r["doc_id"], r["text"]) for r in got) == bag(want)


def found(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return decontaminate.contaminated(docs, items).collect()


def test_op4_names_anywhere(spark):
    item = "Natalia sold 48 clips to friends in April. Natalia then sold half as many clips in May."
    other = (
        "Yesterday we saw that Alice carried 12 kg of fresh apples home and then sold Bob 3 of these apples for his lunch"
    )
    docs = [
        (1, item.replace("Natalia", "Karen")),
        (2, "the question: " + item.replace("Natalia", "Karen").replace("48", "50")),
        (3, item.lower()),
        (4, other.lower()),
        (5, other.upper().replace("12 KG", "15 KG")),
        (6, other.title()),
        (7, "The Bob of The Home And The Lunch. " + other.replace("Alice", "Karen")),
    ]
    got = found(spark, docs, [(1, item), (2, other)])
    assert sorted((r["doc_id"], r["item_id"], r["kind"]) for r in got) == [
        (1, 1, "reparameterised"), (2, 1, "reparameterised"), (3, 1, "verbatim"), (4, 2, "verbatim"),
        (5, 2, "reparameterised"), (6, 2, "verbatim"), (7, 2, "reparameterised"),
    ]
    assert {r["doc_id"]: (r["n_windows"], r["n_matched"]) for r in got}[1] == (13, 13)


def test_op4_one_edited_slot(spark):
    item = (
        "the farmer has 3 red hens in the yard and the same man keeps 3 white geese by the pond where his old dog "
        "sleeps all day long while the wind blows over the wide green hills and the river flows slowly to the sea"
    )
    docs = [
        (1, item.replace("3 white", "8 white")),
        (2, item.replace("3 red", "7 red").replace("3 white", "8 white")),
        (3, " ".join(item.split()[:20]) + " and then nothing of all that was told before has happened here at all"),
    ]
    got = found(spark, docs, [(1, item)])
    assert sorted((r["doc_id"], r["n_windows"], r["n_matched"]) for r in got) == [(1, 41, 36), (2, 41, 37)]


def test_op4_null_and_repeated_ids(spark):
    item = "When does the slow river train reach the northern harbour if it leaves at noon on market day"
    got = found(spark, [(1, item), (1, item), (None, item)], [(None, item), (None, item)])
    assert sorted(map(repr, ((r["doc_id"], r["item_id"]) for r in got))) == ["(1, None)", "(None, None)"]
