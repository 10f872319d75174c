"""Cases that the operators of the subpackage and the pipeline once did in part."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from ledgerline.llm import lm_scoring, ngram_join, personal_data, sentence_pieces


def test_near_copies_by_five_words(spark):
    """Two inner words of a hundred changed: three-word similarity 92/104,
    five-word 86/106."""
    base = [f"w{k}" for k in range(100)]
    near = [f"x{k}" if k in (30, 70) else w for k, w in enumerate(base)]
    far = [f"y{k}" if k in (20, 40, 60) else w for k, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, "something else")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3, 4]


def test_lm_learns_word_order(spark):
    """Better than the base on held-out texts whose words follow one another
    by a rule, which only the word before tells."""
    rnd = random.Random(4)
    follow = {f"v{k}": [f"v{rnd.randrange(40)}" for _ in range(2)] for k in range(40)}
    texts = {}
    for i in range(500):
        w = ["v0"]
        for _ in range(rnd.randint(5, 200)):
            w.append(rnd.choice(follow[w[-1]]))
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    held = [r for r in lm_scoring.score_texts(df.repartition(3)).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)


def test_overlapping_spans_are_masked_whole(spark):
    docs = spark.createDataFrame([(1, "at 192.168.1.0 4111 1111 1111 1111 now"), (2, "password=abcdefgh12345678IJKL.x@mail.example.com ok")],
                                 "doc_id bigint, text string")
    # a model that accepts every candidate of the wider kinds
    model = personal_data.SpanModel([], 9.0, [0.0] * len(personal_data.KINDS), {})
    got = {r["doc_id"]: r["text"] for r in personal_data.redact(personal_data.find_spans(docs, model)).collect()}
    assert got[1] == "at <IP> now"
    assert got[2] == "<SECRET> ok"


def test_two_rows_of_an_id_hide_no_other_id(spark):
    """The least and the greatest set of every key are of id 1, 2 lies between."""
    words = [f"w{k}" for k in range(14)]
    rows = [(1, " ".join(words[:12])), (2, " ".join(words[:13])), (1, " ".join(words))]
    # the sequences that not all three have are the most common ones, so they come last in the prefixes
    rows += [(10 + j, " ".join([*words[10:], *(f"z{j}v{k}" for k in range(20))])) for j in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.component_table(df).collect()}
    assert got[2, 11] == 1 and got[1, 10] == 1 and got[1, 12] == 1 and got[10, 22] == 10


def test_pipeline_decodes(spark):
    from hashlib import sha256
    texts = {1: "Some text, and more of it.", 2: None, 3: "two  spaces é"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    own = sentence_pieces.load(sentence_pieces.tokenizer_path(sentence_pieces.MODEL))
    got = {r["doc_id"]: r for r in corpus_pipeline.encode(spark, docs, "").collect()}
    plain = {r["doc_id"]: r["decoded"] for r in sentence_pieces.encode(docs, ("decoded",)).collect()}
    assert plain[1] == texts[1] and own.end in got[1]["ids"]
    assert all(got[i]["decoded_sha256"] == sha256(plain[i].encode()).hexdigest() for i in texts)


def test_lm_sample_holds_whole_texts(spark, monkeypatch):
    sizes, fitted = [], lm_scoring.first_weights
    monkeypatch.setattr(lm_scoring, "first_weights", lambda counts, rows, *more: (
        sizes.extend(n for r in rows for n in r["sizes"]), fitted(counts, rows, *more))[1])
    df = spark.createDataFrame([(i, "a b " * 2500) for i in range(3)], "doc_id bigint, text string")
    lm_scoring.score_texts(df).collect()
    assert sizes and set(sizes) == {5001}


def test_counts_beyond_four_bytes():
    numbers = [0, 2**32 - 1, 2**32, 2**32 + 5, 2**40, 2**62, 7]
    assert lm_scoring.unpack(lm_scoring.pack(np.array(numbers, np.int64))).tolist() == numbers
    chunk = pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([lm_scoring.pack(np.array([2**32 - 1, 1]))], pa.binary())],
                                       names=["chunk", "data"])
    made = next(lm_scoring._add_chunks([chunk, chunk]))
    assert lm_scoring.unpack(made.column("data")[0].as_py()).tolist() == [2**33 - 2, 2]


def test_texts_that_share_an_id_are_judged_each(spark):
    """Six rows with five distinct texts: only copies go, in any order of the rows."""
    near = " ".join(f"w{k}" for k in range(100))
    rows = [(1, near), (2, near + " end"), (2, "another text that nothing else is like"), (3, "p q r s t u v"),
            (4, "x y z"), (4, "p q"), (4, "x y z"), (None, "x y z"), (None, "x y z"), (5, "x y z")]
    want = None
    for seed in range(3):
        some = rows[:]
        random.Random(seed).shuffle(some)
        docs = spark.createDataFrame([(*r, "k") for r in some], "doc_id bigint, text string, node string").repartition(3)
        made = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert made.dtypes == docs.dtypes
        got = sorted(((r["doc_id"] or 0, r["text"]) for r in made.collect()))
        assert want in (None, got)
        want = got
    texts = [t for _, t in want]
    assert len(want) == 7 and set(t for t in texts if t != near + " end" and t != near) == {r[1] for r in rows[2:]}
    assert (near in texts) + (near + " end" in texts) == 1 and texts.count("x y z") == 3


def test_columns_called_like_helpers_are_kept(spark):
    from ledgerline.llm import quality_rules, url_filters
    text = "mail a@b.example.com or +49 30 1234567 of example words here " * 3
    names = ["_words", "_lines", "_flat", "_hashes", "_sorted", "_H1", "aside_0"]
    df = spark.createDataFrame([(1, text, *names)], "doc_id int, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = quality_rules.apply_rules(quality_rules.measures(df)).first()
    assert [got[n] for n in names] == names and got["n_words"] == 30
    names = ["won", "W_host", "w_path", "r_host", "digest", "suffix"]
    df = spark.createDataFrame([(1, "http://a.net/es/x", *names)], "page_id int, url string, " + ", ".join(f"{n} string" for n in names))
    got = url_filters.filter_urls(df, url_filters.RULES).first()
    assert [got[n] for n in names] == names and got["rule"] == "net/es/" and got["verdict"] == "block"
    names = ["_t", "_c", "_more", "_done", "_h1", "_S3", "candidates"]
    df = spark.createDataFrame([(1, text, *names)], "doc_id int, text string, " + ", ".join(f"`{n}` string" for n in names))
    model = personal_data.train(df)
    found = personal_data.find_spans(df, model)
    got = personal_data.redact(found).first()
    assert [got[n] for n in names] == names and "<EMAIL>" in got["text"] and "a@b" not in got["text"]


def test_benchmark_in_several_blocks(spark):
    from ledgerline.llm import decontaminate
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(60)}"
    items = spark.createDataFrame([(k, " ".join(word() for _ in range(rnd.randint(0, 15)))) for k in range(60)], "item_id int, text string")
    docs = spark.createDataFrame([(k, " ".join(word() for _ in range(200))) for k in range(20)], "doc_id int, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    whole, parts = (sorted(map(str, decontaminate.summarise(decontaminate.find_windows(docs, items, window=2, block_bytes=b))
                               .select(columns).collect())) for b in (1 << 20, 700))
    assert whole == parts


def test_lm_fits_ask_all_training_texts(spark, monkeypatch):
    """Kinds and weights don't come from the sample (F13): with one document
    as the sample they know the same words and weigh alike."""
    docs = spark.range(120).selectExpr(
        "id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), k -> concat(if(id % 3 = 0, 'a', 'b'), pow(id * 7 + k, 2) % 11))) AS text")
    found, fit_kinds, fit_weights = [], lm_scoring.fit_kinds, lm_scoring.fit_weights

    def kinds_of(encoded, corpus, start):
        found.append(fit_kinds(encoded, corpus, start))
        return lm_scoring.Kinds(np.zeros(0, np.uint64), np.zeros((0, lm_scoring.KINDS), np.float32))

    def weights_of(*args):
        found.append(fit_weights(*args))
        return found[-1]

    monkeypatch.setattr(lm_scoring, "fit_kinds", kinds_of), monkeypatch.setattr(lm_scoring, "fit_weights", weights_of)
    lm_scoring.score_texts(docs, sample=1), lm_scoring.score_texts(docs, sample=100)
    few, few_weights, many, many_weights = found
    assert len(few.names) > 12 and (few.names == many.names).all()
    assert np.abs(few_weights - many_weights).max() < 0.02
