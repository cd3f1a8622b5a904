"""Packing, leaked items and sentences: brute force on small inputs and the odd cases each docstring defines."""

import random

import pytest

pytest.importorskip("quern.llm")
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import leakage, packing, queries
from quern.llm import sentences as sent

SF = "/root/testdata/sf0.001"
KINDS = [("big", 100), ("mid", 40), ("small", 10)]


# Packing


def test_no_container_kind_is_dropped(spark, tmp_path):
    rows = [
        ("small", 10), ("small", 10), ("also", 10), ("none", None), ("zero", 0),
        *((f"k{i}", 20 + i) for i in range(3000))
    ]
    spark.createDataFrame(
        rows, "container_kind string, capacity_tokens int"
    ).repartition(7).write.parquet(f"{tmp_path}/a")
    kinds = packing.container_kinds(spark, f"{tmp_path}/a")
    assert kinds == [("also", 10), *((f"k{i}", 20 + i) for i in range(3000))]
    assert {r[5] for r in packing.pack([(1, 3019), (2, 1500), (3, 10)], kinds, 1, "t")} == {"k2999", "k1490"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 250), max_size=120), st.integers(1, 8))
def test_pack_keeps_every_token_once(sizes, most_open):
    rows = list(packing.pack(enumerate(sizes), KINDS, most_open, "t"))
    pieces, used, cap = {}, {}, {}
    for doc, piece, a, b, cid, kind, capacity in rows:
        pieces.setdefault(doc, []).append((piece, a, b))
        used[cid] = used.get(cid, 0) + b - a
        cap[cid] = capacity
        assert (kind, capacity) in KINDS
    assert set(pieces) == set(range(len(sizes)))
    for doc, ps in pieces.items():
        ps.sort()
        assert [p for p, _, _ in ps] == list(range(len(ps))) and ps[0][1] == 0 and ps[-1][2] == sizes[doc]
        assert all(x[2] == y[1] for x, y in zip(ps, ps[1:], strict=False))
        assert len(ps) == max(1, -(-sizes[doc] // 100))
    for cid, n in used.items():
        assert n <= cap[cid] and all(c < n for _, c in KINDS if c < cap[cid])


def test_best_fit_and_fullest_closes_first():
    b = packing.Bins(10, 2)
    assert b.put(6) == (0, []) and b.put(7) == (1, [])
    assert b.put(3) == (1, [(1, 10)])  # the bin with the least room that holds it, full now
    assert b.put(8) == (2, []) and b.put(9) == (3, [(2, 8)])  # the fullest of the two closes
    assert sorted(b.close()) == [(0, 6), (3, 9)]
    with pytest.raises(ValueError):
        b.put(11)


def test_containers_of_texts(spark):
    tok = packing.encoder(packing.load(packing.default_tokenizer()))
    texts = [(1, "a b c"), (2, None), (3, ""), (None, "x"), (1, "again"), (4, "word " * 3000), (5, "é" * 500)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("container_id", F.lit("clash"))
    rows = packing.containers(df, KINDS).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.token_end - r.token_start
    size = lambda t: len(tok.encode_ordinary(t))
    assert total == {
        1: size("a b c") + size("again"), 2: 0, 3: 0, None: size("x"), 4: size("word " * 3000), 5: size("é" * 500)
    }
    assert packing.containers(df.limit(0), KINDS).count() == 0
    none = packing.containers(df, [("zero", 0)]).collect()
    assert len(none) == len(texts) and all(r.container_id is None and r.capacity_tokens is None for r in none)
    assert packing.containers(df.limit(0), []).count() == 0


def test_containers_are_nearly_full(spark):
    r = queries.p7_containers(spark, "/root/testdata/sf0.01")
    g = r.groupBy("container_id", "capacity_tokens").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n"))
    fill = g.agg(F.sum("n") / F.sum("capacity_tokens"), F.max(F.col("n") - F.col("capacity_tokens"))).first()
    assert fill[0] > 0.97 and fill[1] <= 0
    assert r.select("doc_id").distinct().count() == spark.read.parquet(
        "/root/testdata/sf0.01/documents.parquet"
    ).count()


# Leaks

ITEM = "The marble herring borrows 683 keen tolls across the copper hall, and after heavy rain the northern stonecutter borrows 75 of them. Größe über alles"


def disguises(text):
    w = text.split()
    yield text
    yield text.upper()
    yield "> " + "\n> ".join(" ".join(w[i : i + 4]) for i in range(0, len(w), 4))
    yield "# " + "\n# ".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5))
    yield "<div><p>" + " ".join(f"<b>{x}</b>" if i % 3 == 0 else x for i, x in enumerate(w)) + "<br/></p></div>"
    yield " ".join(f"**{x}**" if i % 2 else f"_{x}_" for i, x in enumerate(w))
    yield " ".join(x[:2] + "​" + x[2:] + "­" for x in w)
    yield '{"q": "' + text.replace(", ", ",\\n\\t").replace("ö", "\\u00f6").replace("ü", "\\xfc") + '\\"ok\\""}'
    yield "x = (" + "\n".join(f'"{" ".join(w[i : i + 3])} "' for i in range(0, len(w), 3)) + ")"
    yield text.replace("ö", "&ouml;").replace("ü", "&#252;").replace(", ", " &mdash; ")
    yield "“" + text.replace("Größe", "Größe") + "”"


def brute(docs, items, run=12):
    got = set()
    for i, p, a in items:
        w = leakage.words(p) + leakage.words(a)
        grams = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for d, t in docs:
            x = leakage.words(t)
            if d is not None and any(tuple(x[k : k + run]) in grams for k in range(len(x) - run + 1)):
                got.add((d, i))
    return got


def test_disguises_are_read(spark):
    want = leakage.words(ITEM)
    for t in disguises(ITEM):
        x = leakage.words(t)
        assert any(x[k : k + len(want)] == want for k in range(len(x))), t


@pytest.mark.parametrize(("block", "columns"), [(leakage.BLOCK_BYTES, leakage.COLUMNS), (20_000, 8)])
def test_leaks_equal_brute_force(spark, monkeypatch, block, columns):
    monkeypatch.setattr(leakage, "BLOCK_BYTES", block)
    monkeypatch.setattr(leakage, "COLUMNS", columns)  # words that share columns lose nothing
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    items = [
        (1, ITEM, None),
        *((i, " ".join(rnd.choices(vocab, k=30)), " ".join(rnd.choices(vocab, k=5))) for i in range(2, 30)),
        (90, "too short", None), (91, None, None), (None, ITEM, None), (92, ITEM, "same item twice")
    ]
    docs = [(k, t) for k, t in enumerate(disguises(ITEM))]
    for k in range(100, 400):
        text = rnd.choices(vocab + ["zzz"] * 20, k=rnd.randrange(0, 200))
        if rnd.random() < 0.5:
            it = rnd.choice(items[1:29])
            w = (it[1] + " " + it[2]).split()
            n, at = rnd.choice([11, 12, 13, 20]), rnd.randrange(0, 12)
            text[5:5] = w[at : at + n]
        docs.append((k, " ".join(text)))
    docs += [
        (500, None), (501, ""), (None, ITEM), (502, "pad " * 20_000 + ITEM + " pad" * 20_000), (503, ITEM), (503, ITEM)
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0)).repartition(3)
    got = leakage.leaks(df, items)
    assert {
        (r.doc_id, r.item_id) for r in got.where("copied").collect()
    } == brute(docs, [i for i in items if i[0] is not None])
    assert got.count() == got.distinct().count()
    assert leakage.leaks(df.limit(0), items).count() == 0 and leakage.leaks(df, []).count() == 0
    table = spark.createDataFrame(items, "item_id bigint, prompt string, answer string")
    in_blocks = leakage.leaks_of(df, table, block=11)
    assert {
        (r.doc_id, r.item_id) for r in in_blocks.where("copied").collect()
    } == brute(docs, [i for i in items if i[0] is not None])
    assert leakage.leaks_of(df, table.limit(0)).count() == 0


def test_latent_products_are_upper_bounds():
    rnd = np.random.default_rng(0)
    columns = 40
    a, b = rnd.integers(-1, 60, (50, 9)).astype(np.int32), rnd.integers(-1, 60, (30, 12)).astype(np.int32)
    idf = rnd.random(columns).astype(np.float32) + 1
    space = leakage.weighted(np.linalg.qr(rnd.standard_normal((columns, 6)))[0], idf)
    sa, sb = (leakage.column_sets(x, columns) for x in (a, b))
    exact = np.array([[sum(idf[c] ** 2 for c in set(p) & set(q) if c >= 0) for q in sb.tolist()] for p in sa.tolist()])
    assert (leakage.latent(sa, idf, space) @ leakage.latent(sb, idf, space).T >= exact - 1e-3).all()
    for p, q in zip(a, b, strict=False):  # any n words, repeated ones counted, have at least the least n shares
        held = [
            c % columns for c in p.tolist() if c >= 0 and c % columns in {x % columns for x in q.tolist() if x >= 0}
        ]
        assert leakage.shares(p[None, :], idf)[0, : len(held)].sum() <= sum(idf[c] ** 2 for c in set(held)) + 1e-3


def test_paraphrases_of_all_lengths_are_found(spark):
    """Every ninth word of an item replaced, so that no run of twelve is left; the rest of the document is other
    text."""
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    items = [
        (k, " ".join(rnd.choices(vocab, k=n)), None) for k,
        n in enumerate(n for n in (12, 15, 18, 20, 24, 27, 30, 40, 60) for _ in range(12))
    ]
    docs = []
    for k, text, _ in items:
        w = [x if i % 9 != 8 else f"other{rnd.randrange(999)}" for i, x in enumerate(text.split())]
        docs.append(
            (k, " ".join([*rnd.choices(vocab, k=rnd.randrange(200)), *w, *rnd.choices(vocab, k=rnd.randrange(200))]))
        )
    got = {
        (r.doc_id, r.item_id) for r in leakage.leaks(
            spark.createDataFrame(docs, "doc_id bigint, text string"), items, paraphrase=0.85
        ).collect()
    }
    assert got == {(k, k) for k, _, _ in items}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-1, 4), max_size=30), st.lists(st.integers(-1, 4), max_size=30))
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y >= 0 else max(t[i][j + 1], t[i + 1][j])
    assert leakage.lcs(np.array(a, np.int32), np.array(b, np.int32)) == t[-1][-1]


def test_paraphrases_are_found(spark):
    w = leakage.words(ITEM)
    close = [x if i % 11 else "other" for i, x in enumerate(w)]  # no twelve words in a row
    far = random.Random(2).sample(w, len(w))
    df = spark.createDataFrame(
        [(1, " ".join(close) + " 329"), (2, " ".join(far)), (3, ITEM)], "doc_id bigint, text string"
    )
    got = {r.doc_id: r for r in leakage.leaks(df, [(7, ITEM, None)], paraphrase=0.8).collect()}
    assert set(got) == {1, 3} and not got[1].copied and got[1].common >= 19 and got[3].copied and not got[3].answered


def test_paraphrases_are_found_wherever_they_begin(spark):
    w = [f"w{i}" for i in range(80)]
    items = [(7, " ".join(w[:60]), " ".join(w[60:])), (8, " ".join(f"v{i}" for i in range(15)), None)]
    part = lambda k, n: " ".join(x if i % 11 != 8 else "other" for i, x in enumerate(w[k : k + n]))  # noqa: E731  no twelve words in a row, 22 of 24 kept
    docs = [(12 * k + pad, "pad " * pad + part(k, 24) + " pad" * 30) for k in range(12) for pad in range(12)]
    docs += [
        (1000 + pad, "pad " * pad + " ".join(f"v{i}" if i != 7 else "other" for i in range(15))) for pad in range(12)
    ]
    docs += [(500 + pad, "pad " * pad + " ".join(x for i, x in enumerate(w[10:46]) if i % 3 != 2)) for pad in range(12)]  # every third word left out
    docs += [(2000, part(3, 24) + " pad" * 90 + " " + " ".join(w[60:]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in leakage.leaks(df, items, paraphrase=0.85).collect()}
    assert set(got) == {(k, 8 if 1000 <= k < 2000 else 7) for k, _ in docs}
    assert all(r.common == 22 for r in got.values() if r.doc_id < 500) and all(
        r.common == 24 for r in got.values() if 500 <= r.doc_id < 1000
    ) and all(r.common == 14 for r in got.values() if 1000 <= r.doc_id < 2000)
    assert {k for k, r in got.items() if r.answered} == {(2000, 7)}


# Sentences

CASES = {
    "Dr. Velm left at 3 a.m. The rest stayed, e.g. J. R. Quill. It cost 3.14 vs. 2.71.": [
        "Dr. Velm left at 3 a.m.", "The rest stayed, e.g. J. R. Quill.", "It cost 3.14 vs. 2.71."
    ],
    "“Stop!” the log said, and it ran. It says “no.” Then: 1) load, 2) fit. See Fig. 3 and Eq. 2: done?! (Good, cf. No. 7.) Open a_1.csv first. df_x holds 2 rows": [
        "“Stop!” the log said, and it ran.", "It says “no.”", "Then: 1) load, 2) fit.", "See Fig. 3 and Eq. 2: done?!",
        "(Good, cf. No. 7.)", "Open a_1.csv first.", "df_x holds 2 rows"
    ],
    "It waits... then goes. It waits... The end… df_y holds 3.5 rows, etc. Most of it. Notes at https://a.example/b.html?v=1.2 for now.": [
        "It waits... then goes.", "It waits...", "The end…", "df_y holds 3.5 rows, etc.", "Most of it.",
        "Notes at https://a.example/b.html?v=1.2 for now."
    ],
    "## 6.4 Carga\n\n1. one item. Two here\n2. two\n\n- a b\n* c\n\n> Line one. Line\n> two": [
        "6.4 Carga", "one item.", "Two here", "two", "a b", "c", "Line one.", "Line", "two"
    ],
    "A line\nbreaks. Next vol.\n16. The\nend": ["A line\nbreaks.", "Next vol.\n16.", "The\nend"],
    "„Läuft es noch?“, fragte Velm. Der 26. Versuch am 1. Mai, z. B. hier, d. h. ca. 3 Zeilen usw. Die Zelle. Siehe Nr. 2 bzw. S. 2.": [
        "„Läuft es noch?“, fragte Velm.", "Der 26. Versuch am 1. Mai, z. B. hier, d. h. ca. 3 Zeilen usw.",
        "Die Zelle.", "Siehe Nr. 2 bzw. S. 2."
    ],
    "« Arrêtez ! » dit-il, et M. Velm part. Il dit : « Fin. » Le reste… ¿Qué? ¡Cuidado, ya! «¿Sigue?», dijo la Sra. Velm (véase pág. 4).": [
        "« Arrêtez ! » dit-il, et M. Velm part.", "Il dit : « Fin. »", "Le reste…", "¿Qué?", "¡Cuidado, ya!",
        "«¿Sigue?», dijo la Sra. Velm (véase pág. 4)."
    ],
    "«Всё работает?» — спросил др. Velm. Это т. е. ок. 3 строк и т. д. Далее, напр. 1 мая.": [
        "«Всё работает?» — спросил др. Velm.", "Это т. е. ок. 3 строк и т. д.", "Далее, напр. 1 мая."
    ],
    "曲线读取了数据（见图42.1）。“缓存吗？”他问道。日志写着：“旧的数值。”模型丢弃……后来填满！在v1.2中，它……。完": [
        "曲线读取了数据（见图42.1）。", "“缓存吗？”他问道。", "日志写着：“旧的数值。”", "模型丢弃……后来填满！", "在v1.2中，它……。", "完"
    ],
    "「確認するか？」と彼女は尋ねた。「読む。」と書いてある。捨てる……そして置く！値は2.5なので、続く": [
        "「確認するか？」と彼女は尋ねた。", "「読む。」と書いてある。", "捨てる……そして置く！", "値は2.5なので、続く"
    ],
    "ตารางลบค่าเดิม 43 ครั้งค่ะ บันทึกอ่านแล้ว ไฟล์ a_1.csv สคริปต์ลบครับ": [
        "ตารางลบค่าเดิม 43 ครั้งค่ะ", "บันทึกอ่านแล้ว", "ไฟล์ a_1.csv สคริปต์ลบครับ"
    ],
    "डॉ. वेल्मा पढ़ता है? “लेख भरता है?” उसने पूछा। वक्र 7.22 है।": [
        "डॉ. वेल्मा पढ़ता है?", "“लेख भरता है?” उसने पूछा।", "वक्र 7.22 है।"
    ],
    "قال د. سمرون إنه هنا. «قف!» كتب السجل، ثم مضى. هل انتهى؟ نعم": [
        "قال د. سمرون إنه هنا.", "«قف!» كتب السجل، ثم مضى.", "هل انتهى؟", "نعم"
    ],
    "Text before.\n\n```python\n# not. A. heading\n\nx = 1. \n```\n\n| a. B | c |\n|---|---|\n\n![i](data:x.y=)\n\n---\n\nAfter the cache is full.The next. It works 🚀! Done": [
        "Text before.", "After the cache is full.", "The next.", "It works 🚀!", "Done"
    ],
    " ​ Spaced out.  Next  ": ["Spaced out.", "Next"], "日志写着：“旧的数值。”": ["日志写着：“旧的数值。”"],
    "Le journal dit : « La fin. »": ["Le journal dit : « La fin. »"],
    "Title here\n=====\nBody one. Two\n---\nThree\n  - sub one\n  - sub two. End": [
        "Title here", "Body one.", "Two", "Three", "sub one", "sub two.", "End"
    ],
    "**All of it.** Next *one?* Last": ["**All of it.**", "Next *one?*", "Last"], "": [], "   \n ": [], "...": [],
    "```\nopen fence. Never. Closed": []
}


def test_sentences_by_script(spark):
    docs, want = [], {}
    for k, (cell, expected) in enumerate(CASES.items()):
        text = "🚀é\n" + cell + "\nIn [1]:\ncode. Here"
        docs.append((k, text, [(0, "markdown", None, 3, 3 + len(cell)), (1, "code", 1, 3, 20)]))
        want[k] = expected
    df = spark.createDataFrame(
        docs,
        "doc_id bigint, text string, cells array<struct<cell_no: int, cell_type: string, execution_count: int, char_start: int, char_end: int>>"
    ).withColumn("_at", F.lit(1))
    got = {k: [] for k in want}
    for r in sorted(sent.sentences(df).collect()):
        got[r.doc_id].append(docs[r.doc_id][1][r.sent_start : r.sent_end])
    for k in want:
        assert got[k] == want[k], docs[k][1]
    assert sent.sentence_texts(df).where("doc_id = 0").count() == 3


def test_sentences_of_odd_documents(spark):
    cell = lambda a, b, kind="markdown": (0, kind, None, a, b)
    big = "A bee. " * 200_000
    docs = [
        (1, None, [cell(0, 5)]), (2, "", [cell(0, 5)]), (3, "One. Two", None), (4, "One. Two", []),
        (5, "One. Two", [cell(0, 900), cell(None, 3), cell(2, None), cell(5, 2), cell(0, 3, None)]),
        (6, big, [cell(0, len(big))]), (None, "One", [cell(0, 3)]), (7, "Same", [cell(0, 4)]), (7, "Same", [cell(0, 4)])
    ]
    df = spark.createDataFrame(
        docs,
        "doc_id bigint, text string, cells array<struct<cell_no: int, cell_type: string, execution_count: int, char_start: int, char_end: int>>"
    )
    n = {r.doc_id: r["count"] for r in sent.sentences(df).groupBy("doc_id").count().collect()}
    assert n[5] >= 2 and n[6] == 200_000 and n[7] == 2 and n[None] == 1 and set(n) == {5, 6, 7, None}
    assert sent.sentences(df.limit(0)).count() == 0


def test_spans_are_whole_and_apart(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    last = {}
    for r in sorted(sent.sentences(df).collect()):
        s = texts[r.doc_id][r.sent_start : r.sent_end]
        assert s == s.strip() and s and r.sent_start >= last.get(r.doc_id, 0)
        last[r.doc_id] = r.sent_end
