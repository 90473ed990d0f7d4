"""The training-data operators against brute force, exact round trips and hand-made cases; nulls, empty tables, repeated rows and clashing names."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from docweave.llm import form, knn, mix, neardup, pack, pii, split, templates, tokens

SYLLABLES = "가나다라마바사아자차카타파하"


def plain_form(s):
    s = "".join(c for c in s if not (unicodedata.category(c) == "Cf" or c in form.NO_WIDTH))
    s = "".join(form.LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFKD", s))
    return " ".join(unicodedata.normalize("NFC", s).split())


ODD = ["ｗａｓ　ｗｅａｋ", "Сοntrоl", "점​검­표", unicodedata.normalize("NFD", "점검표 é"), "a \tb\r\nc", "℃ ㎜ ﬁ ½ ①", "‐‑–—−", "ﾃﾞｰﾀ ｶﾞ ﾡ", "", "  ", "Ω μ É é", "x'y''z\\", "\U0001d400bc", ""]


def test_form_equals_the_definition(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None, "긴 글 " * 20_000])], "i int, t string")
    got = {r.i: r.form for r in form.with_form(d, "t").collect()}
    assert [got[i] for i in range(len(ODD))] == [plain_form(t) for t in ODD]
    assert got[len(ODD)] is None and got[len(ODD) + 1] == ("긴 글 " * 20_000).strip()
    assert form.with_form(d.limit(0), "t").count() == 0
    with pytest.raises(ValueError):
        form.with_form(d.withColumn("form", F.lit(1)), "t")


def test_form_keeps_rows_and_other_columns(spark):
    d = spark.createDataFrame([(1, "ａ", [1.0], 5), (1, "ａ", [1.0], 5)], "text int, batch string, form2 array<double>, mapped int")
    assert sorted(map(str, form.with_form(d, "batch").collect())) == [str(r) for r in d.withColumn("form", F.lit("a")).collect()]


def test_equal_looking_pairs(spark):
    d = spark.createDataFrame([("a", "x y"), ("b", "x  y"), ("c", "ｘ y"), ("d", "x y"), ("a", "x y"), ("e", None), ("f", "z"), (None, "x y")], "k string, t string")
    assert sorted(map(tuple, form.equal_looking(d, "k", "t").collect())) == [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")]
    assert form.equal_looking(d.limit(0), "k", "t").count() == 0


CHUNK = "doc_id string, content string, sosok string, site string, file_id string"


def test_repeated_lines(spark):
    rng = random.Random(1)
    rows = [(f"d{i}", f"문서\n<h2>t</h2>\nPage {i} of ９９\n{''.join(rng.choices(SYLLABLES, k=9))} 고유\n\nＮotice", "A", " s " if i % 2 else "s", f"f{i // 2}") for i in range(40)]
    rows += [rows[0], ("n", "Page 1 of 9", "A", None, "g"), ("m", None, "A", "s", "h"), ("o", "other Page 1 of 99", "A", "t", "k")]
    d = spark.createDataFrame(rows, CHUNK)
    got = {r.doc_id: sorted(r.lines) for r in templates.repeated_lines(d).collect()}
    assert got == {f"d{i}": [1, 2, 3, 6] for i in range(40)}
    clean = {r.doc_id: r.content for r in templates.without_repeated_lines(d, share=0.5).collect()}
    assert clean["d3"].split("\n")[1:] == [""] and clean["n"] == "Page 1 of 9" and clean["m"] is None
    assert templates.repeated_lines(d.limit(0)).count() == 0


def test_token_trees_merge(spark):
    t, u = templates.TokenTree(), templates.TokenTree(most=0)
    lines = ["page 1 of 20", "page 33 of 4", "page x of 4", "page 1 of 20 more words", "1"]
    ids = [t.add(1, x, d) for d, x in enumerate(lines)]
    assert ids[0] == ids[1] and len(set(ids)) == 4 and t.add(2, lines[0], 9) not in ids
    assert sorted(t.put_out())[:1] != [] and t.put_out() == []
    parts = []
    for d, x in enumerate(lines):  # a tree begun anew for every line puts out the same leaves
        assert u.add(1, x, d) == ids[d] and u.full()
        parts += u.put_out()
    assert sorted(parts) == sorted((1, i, d) for d, i in enumerate(ids))
    rows = [(f"d{i}", f"same line {i}\nown {'abcdefghij'[i]}", "A", "s", f"f{i}") for i in range(10)]
    d = spark.createDataFrame(rows, CHUNK).repartition(5)  # the leaves of five trees are one template
    assert {r.doc_id: r.lines for r in templates.repeated_lines(d, 10, 1.0).collect()} == {f"d{i}": [1] for i in range(10)}


def jaccard(a, b, n, unit):
    def runs(s):
        w = s.split(" ") if unit == "word" else s
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.mark.parametrize(("unit", "size", "threshold", "longest"), [("word", 3, 0.6, 512), ("char", 3, 0.6, 512), ("word", 5, 0.8, 2)])
def test_near_duplicates_against_all_pairs(spark, unit, size, threshold, longest, monkeypatch):
    monkeypatch.setattr(neardup, "LIST", longest)
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        w = rng.choices([f"w{i}" for i in range(400)], k=rng.randint(size, 60))
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randint(0, 5)):
                v[rng.randrange(len(v))] = f"e{rng.randrange(99)}"
            texts.append(" ".join(v))
    texts += texts[:3] + ["", "a b"]
    keys = [f"k{i:03}" for i in range(len(texts))]
    d = spark.createDataFrame([*zip(keys, texts, strict=True), (keys[0], texts[0]), ("null", None)], "k string, t string")
    s = neardup.signed(d, "k", "t", size, unit)
    sets = neardup.similar_sets(s, threshold) if longest == 512 else None
    if sets is None:  # the same through lists joined block by block
        pairs = neardup.colliding(s, longest=longest).where(F.col("matches") >= neardup.LEAST)
        assert {tuple(r)[:2] for r in pairs.collect()} == {tuple(r)[:2] for r in neardup.colliding(s, longest=512).where(F.col("matches") >= neardup.LEAST).collect()}
        sets = neardup.similar_sets(s, threshold)
    got = {tuple(r) for r in neardup.record_pairs(s, sets).collect()}
    want = {(a, b) for i, a in enumerate(keys) for j, b in enumerate(keys[i + 1 :], i + 1) if jaccard(texts[i], texts[j], size, unit) >= threshold}
    assert got == want
    c = {r.key: r for r in neardup.classes(s, sets).collect()}
    for a, b in want:
        assert c[a].class_id == c[b].class_id
    assert all(c[k].class_id <= k for k in c) and c[keys[0]].copies >= 1


def test_two_sided_short_names_and_scopes(spark):
    rows = [("f1", "ab", 0, 1), ("f2", "report-2024.pdf", 0, 1), ("f3", "report-2024.pdf", 0, 2), ("r1", "ab", 1, 1), ("r2", "report-2024_.pdf", 1, 1), ("r3", "", 1, 1)]
    d = spark.createDataFrame(rows, "k string, t string, side int, scope long")
    s = neardup.signed(d, "k", "t", 3, "char", "whole", "scope", "side")
    assert sorted(map(tuple, neardup.record_pairs(s, neardup.similar_sets(s, 0.6, True), True).collect())) == [("f1", "r1"), ("f2", "r2")]
    empty = neardup.signed(d.limit(0), "k", "t")
    assert neardup.record_pairs(empty, neardup.similar_sets(empty)).count() == 0


def test_a_chain_is_one_class(spark):
    import itertools

    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(1, 40)], "a long, b long, similarity double")
    s = spark.createDataFrame([(f"k{i:02}", i, 0) for i in range(1, 45)], "key string, set_id long, side int")
    c = {r.key: (r.class_id, r.links) for r in neardup.classes(s, edges).collect()}
    assert len({v[0] for k, v in itertools.islice(sorted(c.items()), 40)}) == 1 and c["k44"] == ("k44", 0) and c["k01"][1] == 1 and c["k20"][1] == 2


def test_nearest_vectors(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(knn, "CELL", 60)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 64))
    x = np.concatenate([b + rng.normal(size=(rng.integers(1, 9), 64)) * 0.2 for b in base]).astype(np.float32)
    x[7:19] = x[6]  # equal vectors
    x *= rng.uniform(0.5, 2, (len(x), 1)).astype(np.float32) * 0 + 1
    keys = [f"v{i:04}" for i in range(len(x))]
    rows = [(k, v.tolist()) for k, v in zip(keys, x, strict=True)] + [("null", None), ("short", [1.0]), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("empty", []), (keys[0], x[0].tolist())]
    d = spark.createDataFrame(rows, "k string, e array<float>")
    got = {}
    for r in knn.nearest(d, "k", "e").collect():
        got.setdefault(r.key, []).append((r.neighbor, r.cosine))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    hit = total = 0
    for i, k in enumerate(keys):
        want = {keys[j] for j in np.lexsort((np.arange(len(x)), -np.round(s[i], 9)))[:5] if s[i, j] >= 0.85}
        total += len(want)
        hit += len(want & {n for n, _ in got.get(k, [])})
    assert hit / total >= 0.97 and set(got) <= set(keys) and max(map(len, got.values())) == 5
    assert [n for n, _ in sorted(got[keys[6]])] == keys[7:12]
    assert knn.nearest(d.limit(0), "k", "e").count() == 0
    monkeypatch.setattr(knn, "BLOCK", 16)  # cells cut into blocks give the same
    assert {(r.key, r.neighbor) for r in knn.nearest(d, "k", "e").collect()} == {(k, n) for k, v in got.items() for n, _ in v}


def test_nearest_vectors_of_a_tight_group(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    mean = rng.normal(size=64)
    tight = mean / np.linalg.norm(mean) + rng.normal(size=(2500, 64)) * (1e-4 / 64) ** 0.5  # a mean cosine of 0.9999
    x = np.concatenate([tight, rng.normal(size=(6000, 64))]).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, e array<float>")
    got = {}
    for r in knn.nearest(d, "k", "e").collect():
        got.setdefault(int(r.key), set()).add(int(r.neighbor))
    u = x[:2500].astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = np.argsort(-s, axis=1)[:, :5]
    assert sum(len(got.get(i, set()) & set(w.tolist())) for i, w in enumerate(want)) / want.size >= 0.97


@pytest.mark.parametrize("unit", ["word", "char"])
def test_splitting(spark, unit):
    rng = random.Random(4)
    limit, overlap = 30, 8
    texts = ["".join(rng.choice(["w", "word", "끝."]) + rng.choice([" ", " ", "\n", "\n\n", "　", " ​"]) for _ in range(n)) for n in (0, 1, 29, 30, 31, 100, 400)] + ["x" * 500, "  lead " + "y " * 70]
    d = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)] + [(99, None, "p")], "i int, t string, page string")
    by = {}
    for r in split.split_oversized(d, "t", limit, overlap, unit).orderBy("i", "piece_no").collect():
        by.setdefault(r.i, []).append(r)
    size = (lambda s: len(s.split())) if unit == "word" else len
    assert by[99][0].piece is None
    for i, t in enumerate(texts):
        end = 0
        for p in by[i]:
            assert t[p.start : p.start + len(p.piece)] == p.piece and p.page == "p" and size(p.piece) <= limit
            if p.piece_no > 1:
                assert size(t[p.start : end]) == overlap
            end = p.start + len(p.piece)
        assert end == len(t) and (len(by[i]) > 1) == (size(t) > limit)
    assert {r.i for r in split.split_oversized(d, "t", limit, overlap, unit, only_oversized=True).collect()} == {i for i, t in enumerate(texts) if size(t) > limit}
    with pytest.raises(ValueError):
        split.split_oversized(d.withColumn("piece", F.lit(1)), "t")


def test_natural_boundaries(spark):
    t = "One two three four five. Six seven eight\nnine ten eleven twelve thirteen fourteen fifteen"
    got = [r.piece for r in split.split_oversized(spark.createDataFrame([(t,)], "t string"), "t", 9, 2).orderBy("piece_no").collect()]
    assert got[0].endswith("eight\n") and got[1].startswith("seven eight\nnine")


def test_tokens_add_up():
    s = tokens.Sizes(tokens.VOCABULARY)
    for t in [*ODD, "it's 12 tokens,  not\n\n 13!? ", "don't\tyou", "가나다 라마 1234 #"]:
        assert s.of(t) == len(s.encode(t))


def test_packing(spark):
    rng = random.Random(6)
    sizes = [0, None, 1, 100, 101, 200, 250] + [min(400, int(rng.lognormvariate(3.5, 0.8)) + 1) for _ in range(600)]
    d = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "id long, n long, extra string")
    rows = pack.pack(d, "id", "n", {"a": 100, "b": 1000}).collect()
    for spec, cap in (("a", 100), ("b", 1000)):
        mine = [r for r in rows if r.spec_name == spec]
        full, parts = {}, {}
        for r in mine:
            full[r.container_id] = full.get(r.container_id, 0) + r.piece_tokens
            parts.setdefault(r.id, []).append(r)
        assert max(full.values()) <= cap and {i for i, n in enumerate(sizes) if n} == set(parts)
        for i, p in parts.items():
            p.sort(key=lambda r: r.piece_no)
            assert sum(r.piece_tokens for r in p) == sizes[i] and (len(p) == 1 or sizes[i] > cap)
            assert [r.token_start for r in p] == [k * cap for k in range(len(p))]
        assert sum(filter(None, sizes)) / (len(full) * cap) > 0.95
    assert pack.pack(d.limit(0), "id", "n", {"a": 100}).count() == 0


def test_least_squares_and_greedy():
    import numpy as np

    c = pack.combinations(np.array([2, 3, 5, 10]), 10)
    assert sorted(sorted(np.array([2, 3, 5, 10])[i] for i in x if i >= 0) for x in c) == [[2, 3, 5], [5, 5], [10]]
    x = pack.least_squares(c, np.array([7, 7, 13, 4]))
    assert sorted(np.round(x[x > 0.5]).astype(int)) == [3, 4, 7]
    rng = random.Random(8)
    h = {k: rng.randint(0, 40) for k in range(1, 60)}
    used = {}
    for n, p in pack.patterns(h, 64):
        assert n > 0 and sum(k * v for k, v in p.items()) <= 64
        for k, v in p.items():
            used[k] = used.get(k, 0) + n * v
    assert used == {k: v for k, v in h.items() if v}


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, s, rng.randint(1, 200)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 500 + ["small"] * 60)] + [(9001, None, 5), (9002, "small", 0), (9003, "small", None), (9004, "untargeted", 10**6)]
    d = spark.createDataFrame(rows, "id long, source string, n long")
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("gone", 0.05, 3)]
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    recipe = mix.plan(d, "id", "source", "n", targets)
    m = mix.mix(d, "id", "source", "n", targets)
    got = {r.source: r for r in mix.shares(d, m, "source", "n", "id", t, recipe).collect()}
    for s, share, cap in targets[:3]:
        assert abs(got[s].actual_share - share / 0.95) < 0.01 and got[s].most_repeats <= cap and got[s].status == "reached" and 0 < recipe.draws[s][1] < 20
    assert got["gone"].actual_share == 0.0 and got["gone"].records_at_hand == 0 and got["gone"].status == "no records"
    big = mix.plan(d, "id", "source", "n", targets, total=1e6)
    assert big.status["small"] == "short" and set(big.status.values()) == {"short"} and big.total == pytest.approx(sum(big.goals.values()))
    some = mix.plan(d, "id", "source", "n", targets, total=2e5)
    assert some.status["small"] == "short" and some.status["big"] == "reached" and sum(some.goals.values()) == pytest.approx(2e5)
    few = spark.createDataFrame([(1, "a", 100_000), *((i, "b", 10) for i in range(2, 400)), (500, "c", 3)], "id long, source string, n long")
    part = mix.plan(few, "id", "source", "n", [("a", 0.4, 1), ("b", 0.5, 2), ("c", 0.1, 1)])
    assert part.status["a"] == "coarse" or part.status["b"] == "short"
    order = [r.shuffle_key for r in m.collect()]
    assert order == sorted(order) and m.exceptAll(mix.mix(d, "id", "source", "n", targets)).count() == 0
    assert mix.mix(d.limit(0), "id", "source", "n", targets).count() == 0
    with pytest.raises(ValueError):
        mix.mix(d, "id", "source", "n", [*targets, ("big", 0.1, 1)])
    assert abs(mix.expected(mix.mean_for(1.7, 3), 3) - 1.7) < 1e-9


PII = [
    ("Contact Mr. Joss Nyborg at eunbom[at]aracomm[dot]invalid or +82 10 1948 5773 today.", [("person_name", "Joss Nyborg"), ("email", "eunbom[at]aracomm[dot]invalid"), ("phone", "+82 10 1948 5773")]),
    ("문의: 황 슬울, 전화 ０４２－０７２－５６６６, 전자우편 pa​skos＠post.haesol.example", [("person_name", "황 슬울"), ("phone", "０４２－０７２－５６６６"), ("email", "pa​skos＠post.haesol.example")]),
    ("신원 확인 770102 - 2385227 (박도현) 완료", [("id_number", "770102 - 2385227"), ("person_name", "박도현")]),
    ("배송지는 (우 05831) 누리특별자치도 도담구 해솔면 느티리 242-1번지 이며", [("address", "누리특별자치도 도담구 해솔면 느티리 242-1번지")]),
    ("Ship it to 93 Hollowmere Street, Unit 28, Velport 00532 and call (042) 158-6108.", [("address", "93 Hollowmere Street, Unit 28, Velport 00532"), ("phone", "(042) 158-6108")]),
    ("전화 공일공 일이삼사 오육칠팔 로", [("phone", "공일공 일이삼사 오육칠팔")]),
    ("ID M 05410840, Torque 61 Nm note 920.765.4450, S/N 221253-3059, bin 639-71-3629, IP 192.0.2.61", [("id_number", "M 05410840")]),
    ("공급사 Zorvane 제 급전선, Orrick probe kit rev 72-7111, 24V@2A, 2번 유도로 28 지점", []),
    (unicodedata.normalize("NFD", "작업 확인 서명: 강다결"), [("person_name", unicodedata.normalize("NFD", "강다결"))]),
]


@pytest.mark.parametrize(("text", "want"), PII)
def test_personal_information(text, want):
    assert [(k, text[i:j]) for k, i, j in pii.items(text)] == want


def test_offsets_and_redaction(spark):
    all_text = "\n".join(t for t, _ in PII)
    d = spark.createDataFrame([(1, all_text, "t"), (2, None, "t"), (3, "", "t"), (1, all_text, "t"), (4, "말 " * 50_000 + "a.b@c.test", "t")], "id long, text string, start_pos string")
    rows = pii.find_pii(d, "id", "text").collect()
    assert all(all_text[r.start_pos : r.end_pos].strip() for r in rows if r.id == 1) and [r.start_pos for r in rows if r.id == 4] == [100_000]
    out = {r.id: r for r in pii.redact(d, "text").collect()}
    assert "[EMAIL]" in out[1].text and "eunbom" not in out[1].text and "note 920.765.4450" in out[1].text and out[2].text is None and out[3].text == "" and out[1].start_pos == "t"
    assert pii.find_pii(d.limit(0), "id", "text").count() == 0


def test_deobfuscation_maps_back():
    text = "가​나" + unicodedata.normalize("NFD", "각") + "ＡＢ﻿ (at) Ｃ"
    m = pii.deobfuscated(text)
    assert m.text == "가나각AB@C"
    assert [text[m.origin(i)] for i in (0, 1, 3, 4)] == ["가", "나", "Ａ", "Ｂ"]


def test_nothing_else_imports_this():
    import pathlib

    root = pathlib.Path(form.__file__).parent.parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "docweave.llm" in p.read_text()]


def test_with_tokens(spark):
    d = spark.createDataFrame([(1, "가나 12"), (2, None), (3, ""), (1, "가나 12")], "id int, text string")
    n = sorted((r.id, r.n_tokens) for r in tokens.with_tokens(d, "text").collect())
    assert n[0] == n[1] and n[0][1] > 2 and n[2:] == [(2, None), (3, 0)]
    with pytest.raises(ValueError):
        tokens.with_tokens(d, "text", "id")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    head = "문서\n<h2>t</h2>\n"
    rows = [("a", head + "네 단어 짜리 글", "ａ.pdf", 9), ("b", head + "네 단어  짜리 글", "b.pdf", 9), ("c", None, None, None), ("d", "문서", "d.pdf", 1), ("e", head + "w " * 900, "e.pdf", 7), ("e", head + "w " * 900, "e.pdf", 7)]
    c = spark.createDataFrame([(*r, f"f{r[0]}", "1", "t", 1, 2) for r in rows], "doc_id string, content string, original_filename string, total_pdf_pages int, file_id string, section_id string, section_title string, section_number int, page_number int")
    c.write.parquet(str(d / "chunks.parquet"))
    spark.createDataFrame([(1, ["ｂ.pdf", None]), (2, None), (3, ["x\u00a0 y"])], "request_id long, filenames array<string>").write.parquet(str(d / "duplicate_requests.parquet"))
    return str(d)


def test_every_name_comes_out_in_one_form(spark, tables):
    rows = form.p5_forms(spark, tables).collect()
    assert sorted((r.request_id, r.place, r.filename_form) for r in rows if r.doc_id is None) == [(1, 1, "b.pdf"), (1, 2, None), (3, 1, "x y")]
    assert sorted((r.doc_id, r.filename_form) for r in rows if r.doc_id) == [("a", "a.pdf"), ("b", "b.pdf"), ("c", None), ("d", "d.pdf"), ("e", "e.pdf")]


def test_every_chunk_has_a_class(spark, tables):
    assert sorted(tuple(r) for r in neardup.p2_classes(spark, tables).select("doc_id", "class_id", "links", "copies").collect()) == [("a", "a", 0, 1), ("b", "a", 0, 1), ("c", "c", 0, 0), ("d", "d", 0, 0), ("e", "e", 0, 0)]


def test_pieces_keep_file_and_pages(spark, tables):
    got = {(r.piece_no, r.original_filename, r.total_pdf_pages, r.file_id, r.page_number) for r in split.p6_pieces(spark, tables).collect()}
    assert got == {(i, "e.pdf", 7, "fe", 2) for i in (1, 2)}


FAR = "a line of plain words about nothing, " * 8
MANY = ["Joss Nyborg", "Mara Ellison", "Tove Lindqvist", "Aron Belka", "Nils Okafor"] * 5
KO_MANY = ["강다결", "황슬울", "박도현", "김하린"] * 25


@pytest.mark.parametrize(("text", "want"), [(FAR + "M123A4567 " + FAR, ["M123A4567"]), (f"{FAR}\nAttendees: {', '.join(MANY)}\n{FAR}", MANY), (f"{FAR}\nPresent : {', '.join(MANY[:9])}", MANY[:9]), (f"{FAR}\n참석자: {', '.join(KO_MANY)}\n{FAR}", KO_MANY)])
def test_windows_are_as_wide_as_the_detectors(text, want):
    assert [text[i:j] for _, i, j in pii.items(text)] == want
