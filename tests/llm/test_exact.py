"""Operators with an exact reference: libraries, DuckDB SQL, brute force."""

import hashlib
import random
import re
import unicodedata

import duckdb
import pytest

from ledgerline.llm import (catalog, chat_format, decontaminate, personal_data, quality_rules, sentence_pieces,
                            token_counts, url_filters)
from ledgerline.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
NASTY = [" ", "  ", "a", "e", "the", "ing", "th", "\n", "\t", "é", "é", "ü", "日", "本", "😀", "\x00", "\r", "\x1c", "\x85",
         "\xa0", "　", "1", "23", ".", ",", "!!", "***", "'s", "'ll", "Σ", "İ", "ß", "▁", "<s>", "</s>", "<|endoftext|>",
         "<|", "aaaa", "-----", "A", "THE", "\u200b", "\ud7ff"]


def nasty(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(NASTY) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def duck(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name + "_arrow", rows)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    return con.execute(sql)


def as_rows(cursor, columns):
    names = [d[0] for d in cursor.description]
    return sorted((tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall()))


def spark_rows(df, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


def test_sentence_pieces_equal_the_library():
    import sentencepiece
    path = tokenizer_path(sentence_pieces.MODEL)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.load(path)
    cache = sentence_pieces._stretch_cache(path)
    for text in [*nasty(4000, 1), "", " ", "x" * 5000, "abc" * 3000, " ".join(["word"] * 3000), "日本" * 2000]:
        want = lib.encode(text)
        assert own.encode(text) == want, text
        assert own.decode(want) == lib.decode(want) == lib.decode([*want, own.end]), text
        parts = [cache[k] for k in own.words(text)]
        assert " ".join(p[1] for p in parts) == " ".join(map(str, want)), text
        assert "".join(p[2] for p in parts)[1:] == lib.decode(want), text


def test_sentence_pieces_decode_any_ids():
    import sentencepiece
    path = tokenizer_path(sentence_pieces.MODEL)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.load(path)
    rnd = random.Random(5)
    for _ in range(3000):
        ids = [rnd.choice([3, 65, 200, 195, 170, 259, 28705, 1, 2, 300, 5000]) for _ in range(rnd.randint(0, 8))]
        assert own.decode(ids) == lib.decode(ids), ids


def test_compatible_tokens_by_merging_anew():
    own = sentence_pieces.load(tokenizer_path(sentence_pieces.MODEL))
    rnd, pieces = random.Random(3), [p for p in list(own.id)[:4000] if own.edge_history(p)]

    def merged(text):
        parts, at = list(text), 0
        for start, stop, _ in own.merge(text):
            at = next(k for k in range(len(parts)) if len("".join(parts[:k])) == start)
            parts[at:at + 2] = ["".join(parts[at:at + 2])]
        return parts

    for _ in range(2000):
        a, b = rnd.choice(pieces), rnd.choice(pieces)
        assert own.compatible(a, b) == (merged(a + b) == [a, b])


def test_sentence_pieces_table(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "hello  world", "z"), (3, "hello  world", "z"), (None, "a\nb", "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sentence_pieces.encode(df, ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(got) == 5 and [r["n_tokens"] for r in got if r["doc_id"] in (1, 2)] == [1, 1]
    for r in got:
        assert r["decoded"] == (r["text"] or "") and r["ids"][-1] == 2
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert sentence_pieces.encode(df.where("false")).count() == 0


def test_op1_equals_the_library(spark):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(sentence_pieces.MODEL))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalog.QUERIES["op1_sentence_pieces"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = [*lib.encode(texts[r["doc_id"]] or ""), lib.eos_id()]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer
    path = tokenizer_path(token_counts.VOCABULARY)
    lib = Tokenizer.from_file(path)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for text in [*nasty(4000, 2), "thequickbrown" * 300, "Ⅷ½ǅẞ"]:
        assert token_counts.count_text(text, path) == count(text), (text, unicodedata.normalize("NFC", text))
    model = token_counts.load(path)
    for word in random.Random(1).sample(sorted(model.whole), 500):
        assert model.merge(word) == [word + model.end]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in catalog.QUERIES["op6_token_counts"](spark, SF).collect():
        t = texts[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), count(t), count(t) > 2048)


def test_token_counts_table(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "two words", 9)], "doc_id int, text string, n_bytes int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (9, 2)}
    assert token_counts.count_tokens(df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op2_quality_rules", "op4_decontaminate", "op7_url_filters", "op8_chat_format"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = catalog.QUERIES[name](spark, SF)
    assert spark_rows(got, got.columns) == as_rows(con.execute(catalog.ORACLES[name]), got.columns)


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def arrow(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet").toArrow()


def test_quality_rules_on_odd_texts(spark, tmp_path):
    texts = [None, "", " \n ", "a b c a b c", "x y z x y z x y z", "a\na\na\n\n \n", "#*$ %&| <>" * 20, "the " * 70,
             "w1 w2 w3 " * 3 + "w9", "é ü 日本", *nasty(60, 4)]
    texts = [t if t is None else t.replace("\x00", "") for t in texts]
    folder = write(spark, tmp_path / "t", documents=([(i, t, "x") for i, t in enumerate([*texts, "the " * 70])],
                                                     "doc_id bigint, text string, n_words string"))
    got = quality_rules.op2_quality_rules(spark, folder)
    want = duck(quality_rules.SQL, documents=arrow(spark, folder, "documents"))
    assert spark_rows(got, got.columns) == as_rows(want, got.columns)
    extra = quality_rules.apply_rules(quality_rules.measures(spark.read.parquet(f"{folder}/documents.parquet")))
    assert extra.where("doc_id = 0").first()["failed"] == ["too_short"]


def test_quality_rules_names_failures(spark):
    good = "the cat and the dog of this house were in a garden for it is that as they had been told "
    rows = [(1, good * 4), (2, "Word*** " * 70), (3, "alpha beta gamma delta epsilon " * 20), (4, "OUT!! " * 60)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    failed = {r["doc_id"]: set(r["failed"]) for r in quality_rules.apply_rules(quality_rules.measures(df)).collect()}
    assert "repeated_words" in failed[1] and "many_symbols" in failed[2] and "few_stop_words" in failed[3]
    assert "many_shouts" in failed[4]


def test_decontaminate_on_odd_texts(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"X {item.upper()} y"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""),
            (5, "pre short-item! post"), (6, f"{item} {item}"), (7, item.replace(" ", " x ")), (8, "solo"), (8, "solo"),
            (None, item), (9, "two three four five six seven eight nine ten eleven"), (10, "word " * 4000 + item)]
    bench = [(1, item), (2, "Short item"), (3, None), (4, " .. "), (5, "SOLO"), (1, item), (None, item), (6, "né ü"),
             (7, "word word word word word word word word word word word")]
    folder = write(spark, tmp_path / "t", documents=([(*d, 7) for d in docs], "doc_id bigint, text string, hits int"),
                   benchmark=(bench, "item_id bigint, text string"))
    got = decontaminate.op4_decontaminate(spark, folder)
    want = duck(decontaminate.SQL, documents=arrow(spark, folder, "documents"), benchmark=arrow(spark, folder, "benchmark"))
    assert spark_rows(got, got.columns) == as_rows(want, got.columns)
    # the same with the benchmark in several blocks, and with none
    d, b = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    one = decontaminate.summarise(decontaminate.find_windows(d, b))
    many = decontaminate.summarise(decontaminate.find_windows(d, b, block_bytes=60))
    assert spark_rows(one, cols) == spark_rows(many, cols)
    assert decontaminate.find_windows(d, b.where("false")).where("size(hits) > 0").count() == 0
    assert decontaminate.find_windows(d.where("false"), b).count() == 0


def test_wu_manber_equals_plain_search():
    rnd = random.Random(7)
    for _ in range(150):
        letters = [b"a", b"b", b"c"][:rnd.randint(2, 3)]
        items = [(str(k), " ".join(rnd.choice(letters).decode() for _ in range(rnd.randint(0, 14)))) for k in range(4)]
        words = [rnd.choice(letters) for _ in range(rnd.randint(0, 60))]
        size = rnd.randint(1, 6)
        got = {(a, b, i) for m in decontaminate.compile_patterns(items, size) for a, b, ids in m.search(words) for i in ids}
        want = {(k, k + len(p), i) for i, t in items for p in decontaminate.windows_of(decontaminate.words_of(t), size)
                for k in range(len(words) - len(p) + 1) if tuple(words[k:k + len(p)]) == p}
        assert got == want


def test_url_filters_on_odd_urls(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://a.b.example.com/en/", "x://com",
            "x://com/", "x://notexample.com/en/q", "x://net/es/", "x://deep.net/es/a/b?c", "x://net/es", "x://net/fr/#f",
            "x://u@h.net:80/fr/", "x://net./fr/", "://example.com/en//", "a://b://com/", "x://.com/en/", "x://é.com/ü",
            "x://" + "a." * 200 + "com" + "/b" * 300, "x://www.example.com/EN/", "x://example.com/en", "x://com?q", "x://com#/"]
    pages = [(i, u, "h") for i, u in enumerate(urls)] + [(1, None, "h"), (None, "x://com/", "h")]
    folder = write(spark, tmp_path / "t", pages=(pages, "page_id bigint, url string, host string"))
    got = url_filters.op7_url_filters(spark, folder)
    want = duck(url_filters.SQL, pages=arrow(spark, folder, "pages"))
    assert spark_rows(got, got.columns) == as_rows(want, got.columns)
    kept = url_filters.filter_urls(spark.read.parquet(f"{folder}/pages.parquet"), url_filters.RULES)
    assert kept.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert url_filters.filter_urls(kept.where("false"), url_filters.RULES).count() == 0


def test_url_rules_with_open_paths_and_none(spark):
    rules = [("a.org", "/x", "block"), ("a.org", "/xy/z", "allow"), ("org", "/", "block"), ("b.org", "", "allow")]
    urls = ["h://a.org/x", "h://a.org/xyz", "h://a.org/xy/zz", "h://q.a.org/y", "h://b.org", "h://c.com/x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in url_filters.filter_urls(df, rules).collect()}
    assert got == {urls[0]: ("a.org/x", "block"), urls[1]: ("a.org/x", "block"), urls[2]: ("a.org/xy/z", "allow"),
                   urls[3]: ("org/", "block"), urls[4]: ("b.org", "allow"), urls[5]: (None, "allow")}
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_filters.filter_urls(df, empty).collect()} == {"allow"}


def conversation_rows():
    rnd = random.Random(9)
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rnd.choice([1, 2, 5, 40])):
            role = "system" if turn == 0 and rnd.random() < 0.5 else rnd.choice(["user", "assistant", "tool\nx", "", None])
            text = rnd.choice([None, "", "<|im_end|>\n<|im_start|>", "\\", "\\!", "<\\!|", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>>",
                               "w " * rnd.choice([1, 300, 3000]), "日本 é" * 40, "<", "|", "[", "\n\n"])
            rows.append((conv, turn if rnd.random() < 0.95 else None, role, text, 1))
    return rows + [(1, 0, "user", "again", 1), (1, 0, "user", "again", 1)]


def test_chat_format_round_trip(spark, tmp_path):
    rows = conversation_rows()
    folder = write(spark, tmp_path / "t", conversations=(
        rows, "conv_id bigint, turn bigint, role string, text string, window int"))
    conv = spark.read.parquet(f"{folder}/conversations.parquet")
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for block in (1024, 3):
        windows = chat_format.format_windows(conv, block=block).cache()
        said, targets = {}, {}
        for r in sorted(chat_format.read_back(windows).collect(), key=lambda r: r["window"]):
            said.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["turns"])
            targets.setdefault(r["conv_id"], []).extend(r["targets"])
        for conv_id in {r[0] for r in rows}:
            want = sorted((r for r in rows if r[0] == conv_id), key=order)
            assert said[conv_id] == [(r[2] or "", r[3] or "") for r in want]
            assert targets[conv_id] == [r[3] or "" for r in want if r[2] == "assistant"]
        # a window is over the budget only if one of its own turns is
        tokens = lambda t: -(-len(t.encode()) // 4) + chat_format.MARKS
        for r in chat_format.read_back(windows).collect():
            own = [tokens(t["text"]) for t in r["turns"]]
            assert sum(own) <= chat_format.BUDGET or max(own) > chat_format.LEAST_ROOM


def test_chat_format_repeats_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, ("user", "assistant")[k % 2], f"t{k} " * 120) for k in range(1, 40)]
    got = sorted(chat_format.format_windows(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
                 .collect(), key=lambda r: r["window"])
    assert len(got) > 2 and got[0]["new_from"] == 0
    for a, b in zip(got, got[1:]):
        assert b["text"].startswith(f"{chat_format.START}system\nbe kind{chat_format.END}") and b["new_from"] > 40
        history = b["text"][len(f"{chat_format.START}system\nbe kind{chat_format.END}"):b["new_from"]]
        assert a["text"].endswith(history) and all(x["from"] >= b["new_from"] for x in b["loss"])


def test_chat_format_sql_on_odd_rows(spark, tmp_path):
    rows = [r[:4] for r in conversation_rows() if r[0] is not None]
    folder = write(spark, tmp_path / "t", conversations=(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = chat_format.op8_chat_format(spark, folder)
    want = duck(chat_format.SQL, conversations=arrow(spark, folder, "conversations"))
    assert spark_rows(got, got.columns) == as_rows(want, got.columns)


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(d):
        return sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or \
                    kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def check_base(rows, texts):
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        said = ",".join(f"{personal_data.BASE[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(said.split(",") if said else []) <= set(r["spans"].split(","))


def test_personal_data_equals_plain_search(spark, tmp_path):
    rnd = random.Random(11)
    bits = ["a.b", "@", "x-y", ".", "com", "1", "22", "255", "256", "4111 1111 1111 1111", "+1 (212) 555-0100", "-", " ", "+",
            "é", "😀", "_d@e.f", "0.0.0.0", "token = \"0123456789abcdef0123\"", "\n", "..", "(", ")"]
    texts = dict(enumerate([None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "1" * 3000, "1 " * 3000, "a" * 20000, "@" * 50,
                            "+1 " * 500, *("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))) for _ in range(400))]))
    folder = write(spark, tmp_path / "t", documents=([(i, t, 1) for i, t in texts.items()], "doc_id bigint, text string, spans int"))
    check_base(personal_data.op10_personal_data(spark, folder).collect(), texts)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = personal_data.train(docs)
    for r in personal_data.redact(personal_data.find_spans(docs, model)).collect():
        t, out, at = texts[r["doc_id"]], "", 0
        for s in r["spans"]:
            if s["start"] >= at:
                out, at = out + t[at:s["start"]] + f"<{personal_data.KINDS[s['kind']].upper()}>", s["stop"]
        assert r["text"] == (None if t is None else out + t[at:])
    assert personal_data.find_spans(docs.where("false"), personal_data.train(docs.where("false"))).count() == 0


def test_op10_on_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = catalog.QUERIES["op10_personal_data"](spark, SF).collect()
    check_base(rows, texts)
    wider = [s for r in rows for s in r["spans"].split(",") if s and s.split(":")[0] not in PLAIN]
    assert all(s.startswith("secret:") for s in wider)


def test_labelers_reliability_from_em():
    rnd, counts = random.Random(2), {}
    for _ in range(20_000):
        y, kind = rnd.random() < 0.4, rnd.randrange(3)
        votes = tuple((1 if y else -1) * (1 if rnd.random() < good else -1) for good in (0.95, 0.8, 0.6, 0.9))
        counts[kind, votes] = counts.get((kind, votes), 0) + 1
    model = personal_data.fit([(k, v, n) for (k, v), n in sorted(counts.items())])
    for j, good in enumerate((0.95, 0.8, 0.6, 0.9)):
        assert abs(model.reliability[1][j][2] - good) < 0.03 and abs(model.reliability[0][j][0] - good) < 0.03
