import itertools
import random
import unicodedata

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rootweave.llm import leaks, queries, sentences, similar_sets, tokenizer, topn

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- similar sets


def plain_pairs(sets, num, den, least):
    names = sorted(k for k, v in sets.items() if len(v) >= least)
    return sorted((a, b) for a, b in itertools.combinations(names, 2) if len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num)


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(4)
    sets = {}
    for i in range(120):
        base = set(rng.sample(range(3000), rng.randrange(5, 40)))
        sets[f"r{i:03d}a"] = base
        other = set(base)
        for x in rng.sample(sorted(base), rng.randrange(0, max(1, len(base) // 3))):
            other.discard(x)
            other.add(rng.randrange(3000))
        sets[f"r{i:03d}b"] = other
    sets |= {"c1": {1, 2, 3, 4, 5}, "c2": {1, 2, 3, 4, 5}, "c3": {1, 2, 3, 4, 5}, "small": {1, 2}, "edge": {1, 2, 3, 9, 8}}
    data = [(r, f"i{x}") for r, xs in sets.items() for x in xs]
    members = spark.createDataFrame(data + data[:50], "rec string, item string")
    s = similar_sets.SimilarSets(members, 3, 5, min_size=5)
    got = rows(s.expanded())
    want = plain_pairs(sets, 3, 5, 5)
    assert len(got) == len(set(got)) and set(got) <= set(want)  # every pair is verified
    assert len(got) >= 0.99 * len(want)  # sketches are calibrated to 0.999 at the threshold
    links = {r["rec"]: (r["rep"], r["n_links"]) for r in s.membership().collect()}
    assert links["c2"] == ("c1", sum("c2" in p for p in got)) and "small" not in links
    assert similar_sets.SimilarSets(members.where("false"), 3, 5).expanded().count() == 0


def test_pieces_merge_to_the_same_sketch(spark, monkeypatch):
    members = spark.createDataFrame([("a", str(i)) for i in range(300)] + [("b", str(i)) for i in range(20, 320)], "rec string, item string")
    monkeypatch.setattr(similar_sets, "PIECE", 60)
    assert rows(similar_sets.SimilarSets(members, 3, 5).expanded()) == [("a", "b")]


def test_plan_grows_with_the_records():
    plans = [similar_sets.plan(n, 0.6) for n in (10, 10**4, 10**6, 10**9)]
    assert [p[0] for p in plans] == sorted(p[0] for p in plans)
    for w, m, radius in plans:
        assert 1 - (1 - 0.8**w) ** m >= 0.999 and radius > similar_sets.CHECK_BITS * 0.2


# ---- top N


@pytest.mark.parametrize("hot_rows, hot_parts", [(1, 10**9), (10**9, 1), (50, 1000)])
def test_top_n(spark, hot_rows, hot_parts):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(30)}", f"i{rng.randrange(200)}", rng.randrange(6)) for _ in range(1500)]
    data += [(None, "x", 1), ("g1", None, 1), ("g1", "x", None), ("one", "x", 1), ("one", "x", 3)]
    best = {}
    for g, i, s in data:
        if None not in (g, i, s):
            best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, -1))
    want = sorted((g, i, s, k) for g, items in best.items() for k, (i, s) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:5], 1))
    df = spark.createDataFrame(data, "grp string, item string, score int").withColumn("place", F.lit("clash"))
    assert rows(topn.top_n(df, 5, hot_rows, hot_parts)) == want
    assert topn.top_n(df.where("false"), 5).count() == 0


# ---- tokenizer


@pytest.fixture(scope="module")
def automaton():
    return tokenizer.Automaton(tokenizer.read_ranks())


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {t: i for i, t in enumerate(tokenizer.read_ranks())}
    return tiktoken.Encoding("own", pat_str=tokenizer.WORDS, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab th  ein=-0\n"))))
def test_tokens_of_any_text(automaton, reference, text):
    got = [t for w in regex.findall(tokenizer.WORDS, text) for t in automaton.spell(w.encode())]
    assert got == reference.encode_ordinary(text)
    assert b"".join(automaton.tokens[t] for t in got).decode() == text


def test_encode_whole_tables(spark, reference):
    special = [(None, None), (1, ""), (2, "<|endoftext|> x"), (3, "a" * 30_000 + " " * 5000), (3, "a"), (4, "नमस्ते 漢字 ​🧬")]
    df = spark.createDataFrame(special, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = tokenizer.encode(df)
    assert sorted(map(str, got.collect())) == sorted(f"Row(doc_id={k}, ids={reference.encode_ordinary(t or '')})" for k, t in special)
    assert sorted((r["text"] or "") for r in tokenizer.decode(got).collect()) == sorted(t or "" for _, t in special)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert {r["doc_id"]: r["ids"] for r in queries.p7_ids(spark, DATA).collect()} == {k: reference.encode_ordinary(t) for k, t in texts.items()}
    assert tokenizer.encode(df.where("false")).count() == 0


# ---- leaks


def plain_words(text):
    text = unicodedata.normalize("NFKC", "".join(c for c in text if c not in "​‌‍﻿­")).lower()
    out, run = [], ""
    for c in text:
        single = any(a <= c <= b for a, b in ("ぁゖ", "ァヺ", "㐀䶿", "一鿿"))
        if unicodedata.category(c)[0] in "LN" and not single:
            run += c
            continue
        if run:
            out.append(run)
            run = ""
        if single:
            out.append(c)
    return out + [run] if run else out


def plain_leaks(docs, items, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [plain_words(t or "")] for i in range(len(w) - n + 1)}
    of = {i: grams(t) for i, t in items}
    return sorted({(d, i) for d, t in docs for g in [grams(t)] for i in of if g & of[i]})


@pytest.mark.parametrize("block", [10**6, 30])
def test_leaks_against_plain(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", block)
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "Ａ", "d1", "é", "e" + "́", "漢", "字カ"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "​ "]) for _ in range(n))
    items = [(i, text(rng.randrange(3, 25))) for i in range(25)] + [(98, None), (99, ""), (25, "a b c d1 a b c d1")]
    docs = [(i, text(40)) for i in range(60)] + [(100, items[0][1].upper()), (101, None), (102, ""), (103, "x " * 20_000 + items[1][1])]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")
    want = plain_leaks(docs, items, 5)
    assert rows(leaks.leaks(d, e, 5).select("doc_id", "item_id")) == want and want
    assert {r["doc_id"] for r in leaks.scrub(d, e, 5).collect()} == {x for x, _ in want}
    left = [(r["doc_id"], r["clean_text"]) for r in leaks.scrub(d, e, 5, drop_share=1.0).collect()]
    longest = {r["doc_id"]: r["n_leaked"] for r in leaks.scrub(d, e, 5).collect()}
    assert len(left) == len(longest) and all(n >= 5 for n in longest.values())
    assert leaks.leaks(d.where("false"), e, 5).count() == 0 and leaks.leaks(d, e.where("false"), 5).count() == 0


def test_scrub_cuts_the_span(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    d = spark.createDataFrame([(1, f"Start here and keep this part of the text, please do. {item.title()}! And the end stays too, all of it indeed."), (2, item)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in leaks.scrub(d, spark.createDataFrame([(7, item)], "item_id bigint, item_text string")).collect()}
    assert got[1]["clean_text"] == "Start here and keep this part of the text, please do. And the end stays too, all of it indeed." and got[1]["n_leaked"] == 12
    assert got[2]["dropped"] and got[2]["clean_text"] is None


# ---- sentences


@pytest.fixture(scope="module")
def tagger(spark):
    model = sentences.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text"))
    return sentences.Tagger(model)


def cut(tagger, text):
    return [text[a + x : a + y] for a, b, unit in sentences.blocks(text) if b > a for x, y in ([(0, b - a)] if unit else tagger.cut(text[a:b]))]


CASES = [
    ["J. Praglidra Jr. fixed the row at 7 p.m. on a Monday.", "The U.S. mirror slowly counts the herb.", "See Fig. 3 and Sec. 0.5 of the table manual."],
    ['"It does.", said Kelwex, "but only against the dose."', "It runs on v6.4 but not on v4.7.4.", "edges.tsv is weighted."],
    ['Cornor wrote "It never ends. Try again." in the table notes and left.', "The graph returns itself, what?!", "It needs columns, rows, herbs, etc.", "It works!"],
    ["Am 1. Mai lief die Tabelle noch.", "Dr. Glifi meint, die ganze Gruppe sei ca. 27 Zeilen groß.", "„Die Datei ist leer. Ende.“, stand im Protokoll.", "Das hilft nicht!"],
    ["El Sr. Kapra usa p. ej. edges.py y la matriz rara.", "¡No funciona!", "Dijo «La red está rara. Fin.» y cerró el hilo.", "¿Por qué la red pierde solo 9,3 filas?"],
    ["M. Stoven dit : « La table est vide. Voilà. » et s'en va.", "Ça marche !", "Je n'ai pas d'idée… la colonne ignore tout.", "Voir p. 6, fig. 11, dans out.csv."],
    ["А. Б. Талвин считает, что матрица не нужна.", "Там малая выборка, целая колонка и т. д.", "«Здесь ячейка. Конец.» — написал Dravo и ушёл.", "Не работает!"],
    ["Ο κ. Wexkafi λέει ότι η μέτρηση είναι διπλή.", "Γιατί η ακμή χάνει 51,9 γραμμές;", "Δεν δουλεύει!"],
    ["그는 \"표적이 비었다. 끝.\" 이라고 적었습니다.", "안 됩니다!", "왜 경로은 44.70만 반환합니까?"],
    ["작은 행렬은 4행 뒤에 간선을 반환합니다.", "행렬이 없으면 경로을 잃습니다.", "run3.csv의 그림 9.5을 보세요."],
    ["Die Tabelle endet in Zeile 307.", "Am 11. Mai lief die Datei noch.", "Warum verliert die Gruppe nur 18,3 Prozent?"],
    ['"It fails."', '"Why?"', '"No idea..."', "The U.S. mirror slowly counts the herb."],
    ["डॉ. रेमन ने कहा कि तालिका छोटी है।", "यह नहीं चलता!"],
    ["قال د. رمين: \"العمود فارغ. انتهى.\" ثم خرج.", "لا يعمل!"],
    ["ทำไมตารางถึงไม่นับกราฟคะ", "ผมลองเก็บตารางแล้วแต่ยังว่างอยู่ครับ"],
]
DENSE = [["他说：“草药是空的。重来。”然后就走了。", "如果分数是很小的，蛋白就会排序矩阵……结果还是一样。", "不行！", "如果索引是旧的，网络就会合并通路……结果还是一样。"], ["他说：“靶点是空的。重来。”然后就走了。", "真的？！", "为什么索引只丢失了99.9？", "请看图4.6和文件edges.csv。"], ["「網は空です。」とケンロさんは言った。", "だめです！", "「本当？」「はい。」という会話のあと標的を返すことにした。"]]


@pytest.mark.parametrize("want", CASES)
def test_spaced_scripts(tagger, want):
    assert cut(tagger, " ".join(want)) == want


@pytest.mark.parametrize("want", DENSE)
def test_dense_scripts(tagger, want):
    assert cut(tagger, "".join(want)) == want


def test_blocks(tagger):
    code = "```py\nx = 1. Y\n\n# no\n```"
    text = f"\r\n# Head. Line\r\nIt works!\r\nNo idea.\r\n\r\n- a. B\n- c\n1. d. E\n{code}\nWhy?\nIt needs\nrows.\n \n  \n```\nopen. End"
    assert cut(tagger, text) == ["# Head. Line", "It works!", "No idea.", "- a. B", "- c", "1. d. E", code, "Why?", "It needs\nrows.", "```\nopen. End"]
    assert cut(tagger, "") == [] and cut(tagger, " \n\t") == []


def test_end_mark_before_a_thai_space(tagger):
    assert cut(tagger, "A? ก") in (["A?", "ก"], ["A? ก"])


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("Ab. !?\"'«»()“”„。」「\n\r\t-#1`ก  …;")))
def test_every_character_lies_in_one_unit(tagger, text):
    seen = [0] * len(text)
    for a, b, unit in sentences.blocks(text):
        for x, y in ([(0, b - a)] if unit else tagger.cut(text[a:b])) if b > a else []:
            assert x < y and text[a + x : a + y] == text[a + x : a + y].strip()
            for i in range(a + x, a + y):
                seen[i] += 1
    assert all(n == 1 or (n == 0 and c.isspace()) for n, c in zip(seen, text))


def test_sentences_of_a_table(spark):
    data = [(1, None), (2, ""), (3, "  "), (4, "One. Two."), (4, "One. Two."), (5, "x" * 50_000 + ". " + "Word " * 5000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("start_pos", F.lit("clash"))
    got = sentences.sentences(df).groupBy("doc_id").count()
    assert {r["doc_id"] for r in got.collect()} == {4, 5}
    assert sentences.sentences(df.where("false")).count() == 0


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


# ---- second review: each of these failed on the code before it


def test_leaks_are_the_same_for_any_blocks(spark, monkeypatch):
    passage = "one two three four five six seven eight nine ten"
    items = [(1, f"x {passage} y"), (2, "three four five six seven"), (3, "seven eight nine ten eleven twelve"), (3, "five six seven eight q")]
    docs = [(1, f"A {passage.upper()} B"), (1, f"A {passage.upper()} B"), (2, "four five six seven"), (3, f"{passage} eleven. Twelve!"), (None, passage)]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")
    found = {}
    for block in (10**6, 30, 5):
        monkeypatch.setattr(leaks, "BLOCK_WORDS", block)
        found[block] = (sorted(map(str, leaks.leaks(d, e, 4).collect())), sorted(map(str, leaks.scrub(d, e, 4, drop_share=1.0).collect())))
    assert found[10**6] == found[30] == found[5]
    got = [(r["item_id"], r["longest"], r["hits"]) for r in leaks.leaks(d, e, 4).where("doc_id = 1").collect()]
    assert sorted(got) == sorted([(1, 10, 7), (2, 5, 2), (3, 4, 2)] * 2)  # every item has its own longest run
    got = {r["doc_id"]: r["longest"] for r in leaks.leaks(d, e, 4).where("item_id = 3").collect()}
    assert got == {1: 4, 3: 6, None: 4}


def test_scrub_leaves_the_rest_as_it_is(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    text = f"def f():\n    return 1\n\nSee  {item}   there.\n\n    pass"
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = leaks.scrub(d, spark.createDataFrame([(7, item)], "item_id bigint, item_text string"), drop_share=1.0).first()
    assert got["clean_text"] == "def f():\n    return 1\n\nSee  there.\n\n    pass"


def test_cold_groups_are_bounded_by_a_number(spark):
    # Each of 40 groups is far below 1/20 of all rows; with a bound of 30 items all 40 still take the hot way.
    data = [(f"g{g:02d}", f"i{i:03d}", (g * 7 + i * 13) % 50) for g in range(40) for i in range(60)]
    df = spark.createDataFrame(data, "grp string, item string, score int")
    plain = rows(topn.top_n(df, 3, 10**9, 20, hot_items=10**9))
    assert rows(topn.top_n(df, 3, 10**9, 20, hot_items=30)) == plain and len(plain) == 120


def test_word_table_grows_and_starts_anew(automaton, reference, monkeypatch):
    monkeypatch.setattr(tokenizer, "STATES", len(automaton.ends) + 5)
    for word in ("zqxjkvbpyf", "ñandú", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "漢字仮名交じり文", "ab" * 500):
        assert automaton.spell(word.encode()) == [t for w in regex.findall(tokenizer.WORDS, word) for t in reference.encode_ordinary(w)]


QUOTED = [
    ["He said ‘It ends. Try again.’ and left.", "The dogs’ bowl isn’t full.", "It’s the readers’ choice."],
    ["Er schrieb ‚Die Datei ist leer. Ende.‘ ins Protokoll.", "Das hilft nicht!"],
    ["Er schrieb „Die Datei ist leer. Ende.“ ins Protokoll.", "Das „Blatt“ ist „neu“ und „gut“.", "Das hilft nicht!"],
]


@pytest.mark.parametrize("want", QUOTED)
def test_single_quotation_marks(tagger, want):
    assert cut(tagger, " ".join(want)) == want


def test_chain_has_weights_between_tags(tagger):
    (ii, ib), (bi, bb) = tagger.change
    assert ib > ii and bi > bb  # counted, not set: boundaries alternate with other places here
    marked = "It works. No idea."
    assert tagger._plain_chain(marked, list(sentences.places(marked))) == tagger._chain(marked, list(sentences.places(marked)), [])


def test_long_paragraphs_take_linear_time(tagger):
    import time

    def took(n):
        text = 'It "fails now" and works. „Das“ geht. ' * n
        t = time.process_time()
        sentences._within(text)
        found = sentences._within(text)
        assert not any(found(stop) for stop, _, _ in list(sentences.places(text))[:50])
        list(sentences._marks(text))
        for stop, _, _ in sentences.places(text):
            found(stop)
        return time.process_time() - t

    took(500)
    assert took(16_000) < 16 * max(took(2000), 0.01)


def test_a_kept_model_is_the_same(spark, tagger, tmp_path):
    sentences.save(tagger.model, spark, str(tmp_path / "model"))
    assert (sentences.restore(spark, str(tmp_path / "model")) == tagger.model).all()
