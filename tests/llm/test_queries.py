"""Every query on the odd tables against plain versions, and on empty tables."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from geopanel.llm import decontaminate, records, repeats, shards, spm, toxicity
from geopanel.llm.queries import ORACLES, QUERIES

from . import brute


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def bag(rows):
    return Counter(map(repr, rows))


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert rows_of(QUERIES[name](spark, empty)) == []


def test_op1(spark, folder, everything, library):
    piece = library["piece"]
    want = []
    for i, t in everything:
        ids = piece.encode(t or "")
        back = piece.decode(ids)
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        want.append((i, len((t or "").encode()), len(ids), crc, zlib.crc32(back.encode()), back == (t or "")))
    assert bag(rows_of(QUERIES["op1_sentencepiece"](spark, folder))) == bag(want)


def test_op1_random_strings(library):
    import public_tokenizers

    v = spm.load(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    letters = list("aabcdeeinorst  \n▁éü日") + [p for p in v.text if 1 < len(p) < 6][:3000]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(500)] + [" " * k for k in range(40)]
    encoder = spm.Encoder(v)
    for part in (texts[:300], texts[300:]):
        ids, at = encoder.encode(pa.array(part, pa.large_string()))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(part))] == library["piece"].encode(part)


def test_op2(spark, folder, everything):
    found, sets = brute.components(everything, 4)
    want = [(i, len(s), c, i == c) for (i, _), s, c in zip(everything, sets, found)]
    # a null id is its own component only where no other id is in it
    want = [(i, n, c, i == c) for i, n, c, _ in want]
    assert bag(rows_of(QUERIES["op2_superminhash_dedup"](spark, folder))) == bag(want)


def test_op2_many_components(spark, folder, everything, monkeypatch):
    from geopanel.llm import neardup

    # short bands throw unlike documents together; the prefix filter must find the same links
    monkeypatch.setattr(neardup, "MANY", 1)
    everything = [r for r in everything if r[0] not in (5, 6, None)]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id NOT IN (5, 6)")
    signed = neardup.materialize(neardup.signatures(docs, 4, 60, 1), "signatures")
    labels = neardup.linked_nodes(docs.select("doc_id", "text"), signed, 4)
    joined = signed.join(labels, "node").select("doc_id", "label").collect()
    groups = defaultdict(set)
    for i, label in joined:
        groups[bytes(label)].add(i)
    found, sets = brute.components(everything, 4)
    want = defaultdict(set)
    distinct = defaultdict(set)
    for (i, _), c, s in zip(everything, found, sets):
        if s:
            want[c].add(i)
            distinct[c].add(s)
    assert len(groups) > 1 or max(map(len, groups.values())) > 10
    assert {frozenset(g) for g in groups.values()} == {frozenset(want[c]) for c in want if len(distinct[c]) > 1}


@pytest.mark.parametrize("bucket", [2000, 1])
def test_op3(spark, folder, everything, monkeypatch, bucket):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    want = [(i, *r[:4]) for (i, _), r in zip(everything, brute.repeats([t for _, t in everything], 400))]
    got = QUERIES["op3_suffix_array_dedup"](spark, folder).drop("n_removed_words")  # of its own: test_round4.py
    assert bag(rows_of(got)) == bag(want)


def test_difference_cover_order():
    rng = np.random.default_rng(5)
    text = rng.choice(list(b"ab"), 3000).astype(np.uint8)
    text[2000:2600] = text[100:700]
    for length in (24, 64, 120):
        windows = np.arange(len(text) - length + 1)
        seen = Counter(text[i : i + length].tobytes() for i in windows)
        want = [seen[text[i : i + length].tobytes()] > 1 for i in windows]
        assert repeats.repeated_windows(text, windows, length).tolist() == want
        ranks = repeats.cover_ranks(
            np.ndarray((len(text),), ">u8", text.tobytes() + b"\0" * 8, strides=(1,)).astype(np.uint64), length - 8
        )
        at = np.flatnonzero(ranks >= 0)
        strings = [text[i : i + length - 8].tobytes() for i in at]
        assert [strings[i] for i in np.argsort(ranks[at], kind="stable")] == sorted(strings)


def test_op4(spark, folder, everything, leaks):
    got = rows_of(QUERIES["op4_template_decontamination"](spark, folder).select("doc_id", "item_id", "kind"))
    want = [(i, item, "reparameterised" if i == 303 else "verbatim") for i, _, item in leaks if item]
    assert sorted(got) == sorted(want)


def test_op4_slots(spark):
    item = "we know that Alice has 12 kg of sweet apples here and later Alice gives back 3 of the apples to a friend"
    same = item.replace("Alice", "Peter").replace("12 kg", "40 lb")
    broken = same.replace("later Peter", "later Susan")
    docs = spark.createDataFrame([(1, item), (2, same), (3, broken), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (9, item)], "item_id long, text string")
    found = decontaminate.contaminated(docs, items).select("doc_id", "kind", "n_changed").collect()
    assert sorted(map(tuple, found)) == [(1, "verbatim", 0), (2, "reparameterised", 3)]


def test_op5(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    result = con.sql(ORACLES["op5_quality_rules"])
    got = QUERIES["op5_quality_rules"](spark, folder).select(*result.columns)
    assert bag(rows_of(got)) == bag(result.fetchall())


def test_op5_order_does_not_matter(spark, folder):
    from geopanel.llm import quality

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one = quality.judge(docs, ["doc_id"], quality.RULES).select("doc_id", "kept")
    two = quality.judge(docs, ["doc_id"], quality.RULES[::-1]).select("doc_id", "kept")
    assert bag(rows_of(one)) == bag(rows_of(two))
    assert {r.name for r in quality.order_rules(docs)} == {r.name for r in quality.RULES}


def test_op5_order_follows_cost_and_what_is_left(spark):
    from geopanel.llm.quality import Rule, order_rules

    words = "concat_ws(' ', transform(sequence(1, 80), i -> concat('w', id * i)))"
    docs = spark.range(300).selectExpr("id AS doc_id", f"{words} AS text")
    slow = " + ".join(f"length(regexp_replace(text, '[{i}w]', ''))" for i in range(8))
    plain = Rule("plain", "crc32(text) % 3 = 0")
    dear = Rule("dear", f"{slow} > 0 AND crc32(text) % 3 = 0")
    other = Rule("other", "crc32(text) % 7 = 1 AND crc32(text) % 3 = 1")
    ordered = [r.name for r in order_rules(docs, [dear, plain, other])]
    assert ordered == ["plain", "other", "dear"]


def test_op6(spark, folder, everything):
    got = rows_of(QUERIES["op6_consistent_shards"](spark, folder))
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in everything]
    assert bag([r[:3] for r in got]) == bag(want)
    slots = defaultdict(list)
    for *_, law, shard, slot, grown in got:
        assert law == "rows" and grown is None
        slots[shard].append(slot)
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_ring_moves_little_and_splits_a_hot_key(spark):
    rows = spark.range(4000).selectExpr("id AS k")
    one = {r["k"]: r["shard"] for r in shards.assign(rows, "k", 8, []).collect()}
    two = {r["k"]: r["shard"] for r in shards.assign(rows.where("k < 3960"), "k", 8, []).collect()}
    assert sum(one[k] != s for k, s in two.items()) < 400
    hot = rows.selectExpr("IF(k < 2000, 7, k) AS k")
    counts = Counter(r["shard"] for r in shards.assign(hot, "k", 8, []).collect())
    assert set(counts.values()) == {500}


def test_overflow_continues_clockwise():
    ring = shards.Ring(np.array([10, 20, 30, 40]), np.array([0, 1, 0, 2]))
    got = shards.segments(ring, [(0, 5, 0), (5, 1, 1), (6, 3, 2)], [3, 3, 3])
    # shard 0 keeps three of its first five; two go on to shard 1; its later three pass to shard 2
    assert got.tolist() == [[0, 0, 0], [3, 1, 1], [5, 1, 0], [6, 2, 0]]


def test_op7(spark, folder, everything, library):
    want = []
    for i, t in everything:
        n = len(library["word"].encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert bag(rows_of(QUERIES["op7_token_counts"](spark, folder))) == bag(want)


def test_op8(spark, folder, everything, library):
    got = sorted(rows_of(QUERIES["op8_token_records"](spark, folder)), key=lambda r: r[1])
    ids = {}
    for i, t in everything:
        ids.setdefault(i, []).append([*library["byte"].encode(t or "", add_special_tokens=False).ids, 2])
    assert [r[0] for r in got] == sorted((i for i, _ in everything), key=lambda i: (i is not None, i))
    at = 0
    for i, start, n, crc in got:
        assert start == at
        match = [x for x in ids[i] if len(x) == n and zlib.crc32(np.array(x, "<u4").tobytes()) == crc]
        ids[i].remove(match[0])
        at += n


def test_record_files(spark, folder, tmp_path, library):
    import public_tokenizers

    docs = spark.createDataFrame([(2, "two words"), (1, None), (3, "three 字")], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = records.write(docs, path, str(tmp_path / "out"), 2, public_tokenizers.PATTERN)
    assert sum(r["docs"] for r in manifest) == 3
    seen = [(i, ids.tolist()) for r in manifest for i, ids in records.read_file(r["path"])]
    assert [i for i, _ in seen] == [1, 2, 3] and seen[0][1] == [2]
    for r in manifest:
        for k in range(r["docs"]):
            assert records.read_at(r["path"], k)[0] in (1, 2, 3)
    name = manifest[0]["path"]
    data = bytearray(open(name, "rb").read())
    data[-6] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        list(records.read_file(name))


def test_op9(spark, folder, rows):
    got = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, folder).collect()}
    for i, t, lang in rows:
        if i is None or i in (5, 6):
            continue
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i]["score"] <= 1
    for i in (200, 201, 202, 203):  # null, empty, blank, no letters
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    held = [(got[i]["lang_pred"], lang) for i, t, lang in rows[:150] if got[i]["held_out"] and len(t) > 40]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_op10(spark, folder, rows):
    got = QUERIES["op10_toxicity"](spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] <= 150]
    assert {r["held_out"] for r in got} == {True, False}
    for r in held:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)
    right = [r["predicted"] == (131 <= r["doc_id"] <= 150) for r in held]
    assert sum(right) >= 0.9 * len(right)


def test_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    noisy = [np.where(rng.random(4000) < 0.85, y, ~y) for _ in range(4)]
    copies = [noisy[0]] * 3
    votes = np.stack([*copies, *noisy[1:], noisy[1]], 1).astype(float)
    post, share = toxicity.label_model(votes, 0.3)
    assert share[:3].max() < 0.6 and ((post > 0.5) == y).mean() > 0.9


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        out.append((name, docs.columns, docs.collect()))
    return out


def test_pipeline(spark, folder, stages, everything, library):
    names = [n for n, *_ in stages]
    assert names == ["language", "near_duplicates", "repeated_passages", "benchmark_items", "pieces"]
    assert all(columns == corpus_pipeline.COLUMNS for _, columns, _ in stages[:-1])
    left = [(r["doc_id"], r["text"]) for r in stages[0][2]]
    unknown = {i for i, t in everything if not any(c.isalpha() for c in t or "")}
    assert {i for i, _ in left}.isdisjoint(unknown)
    assert {i for i, t in everything if len(t or "") > 60 and i is not None and i < 200} <= {i for i, _ in left}

    found, _ = brute.components(left, 5)
    kept = [r for r, c in zip(left, found) if r[0] == c]
    assert bag((r["doc_id"], r["text"]) for r in stages[1][2]) == bag(kept)

    want = []
    for (i, t), r in zip(kept, brute.repeats([t for _, t in kept], corpus_pipeline.PASSAGE)):
        data, gone = t.encode(), r[4]
        pieces, run = [], bytearray()
        for x, g in zip(data, gone):
            if g:
                pieces.append(bytes(run))
                run = bytearray()
            else:
                run.append(x)
        text = "".join(p.decode("utf-8", "ignore") for p in [*pieces, bytes(run)])
        if text.strip(" "):
            want.append((i, text))
    assert bag((r["doc_id"], r["text"]) for r in stages[2][2]) == bag(want)

    clean = [(i, t) for i, t in want if i not in (301, 302, 303)]
    assert bag((r["doc_id"], r["text"]) for r in stages[3][2]) == bag(clean)
    ids = [(i, library["piece"].encode(t)) for i, t in clean]
    assert bag((r["doc_id"], list(r["ids"])) for r in stages[4][2]) == bag(ids)
    assert bag(map(repr, corpus_pipeline.run(spark, folder).select("doc_id", "ids_crc32").collect())) == bag(
        map(repr, [r for r in spark.createDataFrame(stages[4][2]).select("doc_id", "ids_crc32").collect()])
    )


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
