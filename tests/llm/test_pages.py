"""Reading pages, articles, repeated lines and near duplicates."""

import itertools
import math
import random
import re
import time

import numpy as np
import pandas as pd
import pytest

from ringlore.llm import boiler, graph, label_pages, neardup, pages, queries, repeats

HTML = """<!DOCTYPE html>
<head><title>Bản vá ở bến An: vá lỗi | Báo X</title><script>var a = "<p>nope</p>";
var b;</script></head><body>
<nav><ul><li><a href="#">Trang chủ</a></li> <li><a href="#">Tin tức</a></li></ul></nav>
<div class="c1">
<h1>Bản vá ở bến An: vá lỗi</h1>
<div>Nhiều tài xế phàn nàn máy chủ dự phòng chậm hơn 31 ngày.
Kỹ sư máy chủ hẹn phụ huynh lúc 10h40, thứ hai để bàn về bản vá.</div>
<p>Theo nhóm lập trình, mã nguồn ở bến Lập Thạch tăng 87,8% so với 10/8/2023.
<div>Chia sẻ bài này cho người thân qua Báo X nhé!</div>
</div>
<footer><p>&copy; Báo X. Giữ mọi quyền đối với nội dung.</p></footer>
</body>"""


def test_reading():
    lines = dict(pages.visible_lines(HTML))
    assert lines[4] == "Trang chủ Tin tức" and "nope" not in " ".join(lines.values()) and lines[12].startswith("© Báo X")
    assert set(lines) == {2, 4, 6, 7, 8, 9, 10, 12}
    assert pages.visible_lines("a  b\n\n--\nc") == [(1, "a b"), (4, "c")]
    assert dict(pages.visible_lines('<p>một</p>\n<a\nhref="x">hai</a>'))[3] == "hai"


def test_article():
    model = boiler.load_model()
    assert boiler._lines(HTML, model) == [6, 7, 8, 9]
    for nothing in (None, "", "<p></p>", "<html><body><h1>Trang bạn tìm không còn ở đây.</h1></body></html>"):
        assert boiler._lines(nothing, model) == []


def test_messages_are_exact():
    """Sum-product on a small tree against the sum over all states."""
    model = {"node": [[-0.1, -2.3], [-1.2, -0.35]], "leaf": [[-0.2, -1.7], [-0.9, -0.5]], "names": {"div": 0.4, "nav": -1.1}}
    page = pages.Page(["#page", "div", "nav", "div"], [-1, 0, 0, 1], [pages.Leaf(i, n, "x", frozenset()) for i, n in enumerate((1, 1, 2, 3))], "", True)
    unary = [0.7, -1.3, 2.0, 0.1]
    got = boiler.marginals(page, unary, model)
    mass = np.zeros((4, 2))
    for ns in itertools.product((0, 1), repeat=4):
        for ls in itertools.product((0, 1), repeat=4):
            w = sum(model["names"].get(n, 0.0) * s for n, s in zip(page.names, ns)) + sum(u * s for u, s in zip(unary, ls))
            w += sum(model["node"][ns[page.parents[k]]][ns[k]] for k in range(1, 4)) + sum(model["leaf"][ns[leaf.node]][s] for leaf, s in zip(page.leaves, ls))
            for i, s in enumerate(ls):
                mass[i, s] += math.exp(w)
    assert got == pytest.approx(np.log(mass[:, 1] / mass[:, 0]).tolist())


def test_article_column(spark):
    df = spark.createDataFrame([(1, HTML, 200, "e"), (2, HTML, 404, "e"), (3, None, 200, "e"), (4, "", None, "e"), (1, HTML, 200, "e")], "id int, raw string, status int, article string")
    got = boiler.with_article(df, "raw", status="status").orderBy("id").collect()
    assert [len(r["article_lines"]) for r in got] == [4, 4, 0, 0, 0] and got[0]["article"] == "e"
    assert boiler.with_article(df.limit(0), "raw").count() == 0


def test_article_queries(spark, sf_dir):
    found = queries.p5_found(spark, sf_dir)
    assert found.count() == found.distinct().count() > 300
    texts = queries.p5_articles(spark, sf_dir)
    assert sum(len(r["text"].split("\n")) for r in texts.collect() if r["text"]) >= found.count()


#: Pages written for this test by hand, none of them after a page of the test tables, and the lines of their articles.
OTHER_PAGES = [('''<html><head><title>River floods close two bridges | Valley Courier</title></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather</a></li></ul></nav>
<div class="banner"><p>This site stores cookies on your device to improve your visit. Accept or reject them.</p></div>
<article>
<h1>River floods close two bridges</h1>
<p class="by">By Martha Quill</p>
<p>Heavy rain over the weekend pushed the river above its banks on Sunday evening.</p>
<p>The county closed both bridges shortly before midnight, and drivers were sent along the northern road.</p>
<ul><li>Engineers will inspect the piers once the water has gone down.</li>
<li>Buses keep running on the eastern bank of the river.</li></ul>
<p>No one was hurt, according to the fire brigade.</p>
</article>
<aside><h3>Read next</h3><a href="/a">School opens new library</a><a href="/b">Market hall to be rebuilt</a></aside>
<footer><p>Copyright Valley Courier. All rights reserved.</p><p>Contact - Imprint - Privacy</p></footer>
</body></html>''',{5, 7, 8, 9, 10, 11}),
('''<html><head><title>Cách trồng rau trên sân thượng | Vườn Nhà</title></head><body>
<div class="menu"><a href="#">Trang chủ</a> <a href="#">Cây cảnh</a> <a href="#">Liên hệ</a></div>
<div class="main">
<h2>Cách trồng rau trên sân thượng</h2>
<p>Đăng bởi Hoàng Lan, 12/03/2024</p>
<p>Nhiều gia đình ở thành phố tận dụng sân thượng để trồng rau sạch cho bữa ăn hằng ngày.</p>
<p>Đất nên trộn với phân hữu cơ và xơ dừa để giữ ẩm lâu hơn.</p>
<p>Sau ba tuần, rau cải có thể thu hoạch lứa đầu tiên.</p>
</div>
<div class="side"><p>Bài cùng chuyên mục</p><p>Chọn chậu cho cây ăn quả</p></div>
<div class="foot"><p>© Vườn Nhà. Ghi rõ nguồn khi sử dụng lại.</p></div>
</body></html>''',{4, 6, 7, 8}),
('''<html><head><title>How we moved the database | Dev Notes</title></head><body>
<header><a href="/">Dev Notes</a> <a href="/archive">Archive</a></header>
<main><h1>How we moved the database</h1>
<p>Last month we moved our main database to a new server without stopping the service.</p>
<p>First we copied the old tables at night, then we replayed the log of changes until both sides were equal.</p>
<p>The switch itself took nine seconds.</p></main>
<section><h4>Share</h4><p>Share this post with your friends and subscribe to the newsletter.</p></section>
<footer>Powered by a small script. Terms of use.</footer></body></html>''',{3, 4, 5, 6}),
('''Home > News > City council votes on parking

City council votes on parking
The council voted on Tuesday to raise parking fees in the old town from next year.
Residents will still be able to buy a yearly permit at half the price.
A spokesman said that the money would go into new bicycle lanes.

----
Related: Bus fares stay the same
Follow us for more local news
====
All content belongs to the City Gazette. Reproduction only with permission.''',{3, 4, 5, 6})]


def test_pages_of_other_hands():
    model, good, wrong = boiler.load_model(), 0, 0
    for text, article in OTHER_PAGES:
        found = set(boiler._lines(text, model))
        good += len(found & article)
        wrong += len(found ^ article)
    assert good / (good + wrong) >= 0.9


def test_long_lines_are_judged_by_their_words_too():
    model = boiler.load_model()
    page = pages.read_page("<div><p>Đăng ký kênh để không bỏ lỡ tin mới " + "và nhận thêm tin " * 12 + "</p></div>")
    known = boiler.page_unary(page, model, {})
    plain = boiler.page_unary(pages.read_page("<div><p>" + "xyz " * 60 + "</p></div>"), model, {})
    assert known != plain and len(boiler.word_features("một " * 30)) == 2


def test_what_the_words_of_lines_say():
    """The tables against the sums of the listed features."""
    model = boiler.load_model()
    lines = ["", "Ðăng Ký KÊNH Trang Chủ", "A.B.C nói A B, a b a b", "* Trang chủ > Tin tức | Báo - X - Y", "> - |", "© 2024 Báo X", "12/3/2024 8h30", "path bars dashes > | open open", "ΟΔΟΣ Σ. ΟΔΟΣ", "ĐĂNG", "đăng"]
    lines += [leaf.text for text, _ in OTHER_PAGES for leaf in pages.read_page(text).leaves] + [leaf.text for leaf in pages.read_page(HTML).leaves]
    said = boiler.Said(model)
    want = [sum(model["weights"].get(f, 0.0) for f in boiler.word_features(x)) for x in lines]
    assert said(lines) == pytest.approx(want) and said(lines * 2) == said(lines) + said(lines) and said([]) == [] and [said([x])[0] for x in lines] == pytest.approx(want)


def test_lines_met_before_read_the_same(monkeypatch):
    furniture = ["<b>Tin</b><br>", "<div>Góc bạn đọc</div>", "<a href='/x'>Mạng lưới</a> &amp; bạn", "<li>một</li>", "<hr>", "<script>var a;</script>", "<title>Báo</title>", "<p>mở", "đóng</p>", "<td>ô", "</td>", "<noscript>", "x</noscript> y"]
    rng = random.Random(3)
    texts = ["\n".join(rng.choices(furniture, k=12)) for _ in range(200)]
    together = [pages.read_page(t) for t in texts]
    assert [pages.read_page(t) for t in texts] == together and len(pages._LINES) > 4
    pages._LINES.clear()
    monkeypatch.setattr(pages, "_keep", lambda line, read: None)
    assert [pages.read_page(t) for t in texts] == together and not pages._LINES


def test_words_are_judged_for_less_than_listing_them():
    """CPU of whole pages of long lines, which no memory of lines helps, against that of listing their features alone."""
    model, rng = boiler.load_model(), random.Random(9)
    words = [w for w in model["weights"] if w.isalpha() and len(w) > 1] + [f"Tên{k}" for k in range(50)]
    texts = pd.Series(["\n\n".join(" ".join(rng.choices(words, k=80)) + "." for _ in range(6)) for _ in range(300)])
    lines = [line for text in texts for line in text.split("\n") if line]

    def cpu(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    listed = min(cpu(lambda: [boiler.word_features(x) for x in lines]) for _ in range(5))
    judged = min(cpu(lambda: list(boiler._line_batches(iter([texts]), model))) for _ in range(5))
    assert judged < 0.9 * listed


def test_runs_of_words_stay_within_their_text():
    texts = ["a b c d", "", "hai từ", "x, Y-z a b c", None, "b c d", "a b c d a b c d", "ΟΔΟΣ b_c d"]
    got = neardup.gram_hashes([(t or "").split() for t in texts], 3, neardup.WordHashes())
    alone = [neardup.gram_hashes([(t or "").split()], 3, neardup.WordHashes())[0] for t in texts]
    runs = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (re.findall(r"[^\W_]+", (t or "").lower()) for t in texts)]
    assert [g.tolist() for g in got] == [g.tolist() for g in alone] and [len(g) for g in got] == [len(r) for r in runs]
    assert all(len(set(a.tolist()) & set(b.tolist())) == len(r & s) for (a, r), (b, s) in itertools.combinations(zip(got, runs), 2))
    sets = [g for g in got if len(g)]
    assert [[x.tolist() for x in s] for s in neardup.sketch(sets)] == [[x.tolist() for x in neardup.sketch([g])[0]] for g in sets]


def test_labels_come_from_repetition():
    def site(k, name, article):
        return f"<title>Tin {k} | {name}</title>\n<p>Đăng ký nhận thư của {name} mỗi ngày nhé bạn.</p>\n<h1>Tin {k}</h1>\n<p>{article}</p>\n<p>Mục này do tòa soạn giữ bản quyền lâu dài.</p>"

    rows = [(f"{name}{k}", name, site(k, name, f"Câu chuyện riêng thứ {k} kể về một người ở làng {'xa' * k}."), 200) for name in ("Báo A", "Báo B", "Báo C") for k in range(40)]
    rows.append(("gone", "Báo A", site(99, "Báo A", "Trang này không còn ở đây nữa đâu bạn."), 404))
    got = label_pages.labelled(rows)
    assert got["gone"] == set() and {i: v for i, v in got.items() if i != "gone"} == {i: {3, 4} for i in got if i != "gone"}
    assert label_pages.labelled(rows[:10]) == {}  # a small site tells nothing
    assert len(label_pages.sample(got, {i: s for i, s, _, _ in rows})) == 121


def _brute_repeats(docs, least, share):
    by = {}
    for i, (rec, src, text) in enumerate(docs):
        for n, line in pages.visible_lines(text) if text else ():
            by.setdefault((src or "", line), set()).add(i)
    total = {}
    for _, src, _ in docs:
        total[src or ""] = total.get(src or "", 0) + 1
    good = {k for k, d in by.items() if len(d) >= least and len(d) >= share * total[k[0]] - 1e-9}
    return sorted((rec, n) for rec, src, text in docs if text for n, line in pages.visible_lines(text) if (src or "", line) in good)


def test_repeats_against_brute_force(spark):
    rng = random.Random(1)
    stock = ["Liên hệ 0912", "© Báo  X", "Trang chủ", "Đăng ký nhận tin", "Mục 1", "Mục 2"]
    docs = [(f"d{i}", rng.choice(["a", "a", "a", "b", None]), "\n".join(rng.choices(stock, k=4) + [f"câu riêng số {i} ở đây"])) for i in range(90)] + [("n", "a", None), ("e", "b", ""), ("d0", "a", "Trang chủ\nTrang chủ")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "id string, source string, raw string, doc int")
    got = sorted((r["record"], r["line_no"]) for r in repeats.repeated_lines(df, "id", "source", "raw").collect())
    assert got == _brute_repeats(docs, 5, 0.2)
    clean = repeats.without_lines(df.where("id = 'd1'"), "id", "raw", repeats.repeated_lines(df, "id", "source", "raw")).head()["raw"]
    assert "câu riêng số 1 ở đây" in clean and clean.count("\n") < 4
    assert repeats.repeated_lines(df.limit(0), "id", "source", "raw").count() == 0


def test_templates_have_slots(spark):
    docs = [(f"d{i}", "s", f"Cập nhật lúc {i}h{i % 60:02d} ngày {i % 28 + 1}/3\nMời quý vị bạn {('An', 'Ba', 'Chi')[i % 3]} gửi thư\nĐoạn văn này của {'xyz'[i % 3] * (i + 1)} kể riêng") for i in range(30)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "id string, source string, raw string, template string")
    got = {r["template"]: r["docs"] for r in repeats.templates(df, "id", "source", "raw").collect()}
    assert got == {"Cập nhật lúc * ngày *": 30, "Mời quý vị bạn * gửi thư": 30, "Đoạn văn này của * kể riêng": 30}
    gone = repeats.template_lines(df, "id", "source", "raw")
    assert {r["line_no"] for r in gone.where("template = 'Cập nhật lúc * ngày *'").collect()} == {1}
    clean = repeats.without_lines(df, "id", "raw", gone.where("line_no = 1")).collect()
    assert all("Cập nhật" not in r["raw"] and "Mời quý" in r["raw"] and r["template"] == "x" for r in clean)
    assert repeats.repeated_lines(df, "id", "source", "raw").count() == 30  # exact texts: each name's line stands in ten documents, a third
    assert repeats.templates(df.limit(0), "id", "source", "raw").count() == 0


def test_references_are_read_in_plain_text():
    assert pages.visible_lines("&copy; Báo X\nA &amp; B") == [(1, "© Báo X"), (2, "A & B")]


def _texts(rng, n):
    words = [f"từ{i}" for i in range(3000)]
    out = {}
    for k in range(n):
        base = rng.choices(words, k=120)
        out[f"a{k:03d}"] = " ".join(base)
        for v in range(rng.randint(0, 3)):
            copy = base[:]
            for _ in range(rng.randint(0, 14)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out[f"a{k:03d}v{v}"] = " ".join(copy)
    return out


def _brute_pairs(texts, size, threshold):
    sets = {k: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for k, t in texts.items() if (w := re.findall(r"[^\W_]+", (t or "").lower()))}
    return {(a, b) for a, b in itertools.combinations(sorted(k for k in sets if sets[k]), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("bucket", [64, 2])
def test_near_pairs_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(neardup, "BUCKET", bucket)  # 2: nearly every bucket is keyed once more
    texts = _texts(random.Random(4), 60) | {"n": None, "e": "", "s": "hai từ"}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + [("a000", texts["a000"], 1)], "id string, body string, klass int")
    rows = neardup.sketches(df, "id", "body", 3)
    got = {tuple(r) for r in neardup.near_pairs(rows, 0.6).collect()}
    want = _brute_pairs(texts, 3, 0.6)
    assert got <= want and len(want - got) <= 0.03 * len(want) and len(want) > 40
    groups = {r["record"]: r["group"] for r in neardup.near_groups(rows, 0.6).collect()}
    assert all(groups[a] == groups[b] for a, b in got) and set(groups) == {k for k, t in texts.items() if t and len(t.split()) > 2}
    assert neardup.near_pairs(neardup.sketches(df.limit(0), "id", "body", 3), 0.6).count() == 0


def test_five_words_and_a_high_threshold(spark):
    texts = _texts(random.Random(8), 30)
    df = spark.createDataFrame(list(texts.items()), "id string, body string")
    got = {tuple(r) for r in neardup.near_pairs(neardup.sketches(df, "id", "body", 5), 0.8).collect()}
    assert got == _brute_pairs(texts, 5, 0.8)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(None, 3), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for e in edges if e[0] is not None and e[0] != e[1] for x in e}


def test_found_queries(spark, sf_dir):
    for name in ("p6_found", "p7_found"):
        df = queries.QUERIES[name](spark, sf_dir)
        assert df.count() == df.distinct().count()
    docs = [(r["id"], r["source_id"], r["raw_content"]) for r in spark.read.parquet(f"{sf_dir}/raw_documents.parquet").collect()]
    assert sorted((r["raw_document_id"], r["line_no"]) for r in queries.p6_found(spark, sf_dir).collect()) == _brute_repeats(docs, 5, 0.2)


def test_markup_behind_a_long_preamble():
    log = "fetched at noon\n" * 400
    assert pages.is_markup(log + "<p>Hello there</p>") and pages.is_markup(log + "<!-- 1 < 2 -->") and not pages.is_markup(log + "1 < 2 and <!-- open")
    assert [x.text for x in pages.read_page(log + "<p>Hello there</p>").leaves][-1] == "Hello there"
