"""Packing, mixing and subjects."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from ringlore.llm import mixing, packing, queries, subjects, tokens

TOKENIZER = tokens.TOKENIZER


def _best_fit(lengths, capacity):
    """Item by item, the longest first."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_item_by_item_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([1, 30, 300]))]
    counts = collections.Counter(lengths)
    slots = packing.plan(counts, capacity)
    filled = collections.Counter()
    ranks = collections.defaultdict(list)
    for n, a, b, first, each in slots:
        ranks[n] += range(a, b)
        for r in range(a, b):
            filled[first + (r - a) // each] += n
    assert all(sorted(ranks[n]) == list(range(c)) for n, c in counts.items())
    assert max(filled.values()) <= capacity and sum(filled.values()) == sum(lengths)
    assert len(filled) == _best_fit(lengths, capacity)


def test_packed(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 5)  # lengths are ranked in parts
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 7, 7, 7, 3, 25, 61])) for i in range(120)] + [(None, 7), (5, 9), (5, 9)]
    items = spark.createDataFrame(sizes, "id int, n bigint")
    rows = packing.packed(items, 20).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(n for _, n in sizes)
    load = collections.Counter()
    for r in rows:
        load[r["container"]] += r["n_tokens"]
    assert max(load.values()) <= 20 and sorted(load) == list(range(len(load)))
    assert all(r["n_tokens"] == 20 for r in rows if r["start_token"] + 20 <= dict(sizes).get(r["id"], 0))
    assert packing.packed(items.limit(0), 20).count() == 0 and packing.packed(items.where("n = 0"), 20).count() == 0


def test_pack_texts(spark):
    df = spark.createDataFrame([(1, "xin chào các bạn", "c"), (2, None, "c"), (3, "", "c"), (4, "một hai ba " * 300, "c")], "id int, t string, container string")
    rows = packing.pack(df, "id", "t", [("s", 64), ("l", 4096)]).collect()
    enc = tokens.encoding()
    for kind, capacity in (("s", 64), ("l", 4096)):
        mine = [r for r in rows if r["container_kind"] == kind]
        assert {r["id"]: sum(x["n_tokens"] for x in mine if x["id"] == r["id"]) for r in mine} == {1: len(enc.encode_ordinary("xin chào các bạn")), 4: len(enc.encode_ordinary("một hai ba " * 300))}
    with pytest.raises(ValueError):
        packing.pack(df, "id", "t", [])


def test_long_texts_are_counted_whole(monkeypatch):
    enc, rng = tokens.encoding(), random.Random(3)
    text = " ".join(rng.choices(["xin", "chào", "it's", "12.000", "đồng,", "\nabc", "ok  "], k=4000))
    whole = len(enc.encode_ordinary(text))
    for size in (100, 777, 5000):
        monkeypatch.setattr(tokens, "PIECE", size)
        assert tokens.length(enc, text) == whole


def _mix_rows(spark, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["big", "big", "mid", "small", "none"]), rng.randint(1, 50)) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "id int, source string, n bigint").withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 4))


def test_mix(spark):
    rows, df = _mix_rows(spark)
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)]
    blend, shares = mixing.mixed(df, targets)
    got = blend.collect()
    used = collections.Counter()
    for r in got:
        used[r["source"]] += r["n_tokens"] * r["repeats"]
    total = sum(used.values())
    assert all(abs(used[s] / total - t) < 0.01 for s, t, _ in targets)
    assert all(1 <= r["repeats"] <= m for s, _, m in targets for r in got if r["source"] == s)
    have = collections.Counter()
    for _, s, n in rows:
        have[s] += n
    assert total > 0.98 * min(have[s] * m / t for s, t, m in targets)  # as large as the scarcest source allows
    report = {r["source"]: r for r in mixing.share_report(blend, shares).collect()}
    assert report["big"]["used_tokens"] == used["big"] and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    again, _ = mixing.mixed(df.repartition(7), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_no_record_is_left_that_still_fits(spark):
    rng = random.Random(8)
    rows = [(i, "b", rng.choice((900, 700, 400, 90, 35, 12, 5, 3, 2))) for i in range(400)] + [(1000 + i, "a", 997) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, source string, n long").withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 4))
    blend, shares = mixing.mixed(df, [("a", 0.5, 1), ("b", 0.5, 1)])
    taken = {r["id"]: r["n_tokens"] for r in blend.where("source = 'b'").collect()}
    left = 5 * 997 - sum(taken.values())
    assert 0 <= left < min(n for i, s, n in rows if s == "b" and i not in taken)
    few = spark.createDataFrame([(i, "b", 50 + i % 40) for i in range(3000)] + [(5000, "a", 300)], "id long, source string, n long").withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 4))
    got = mixing.mixed(few, [("a", 0.5, 1), ("b", 0.5, 1)])[0].where("source = 'b'").agg(F.sum("n_tokens")).head()[0]
    assert 250 < got <= 300


def test_mix_edges(spark):
    _, df = _mix_rows(spark)
    blend, shares = mixing.mixed(df, [("absent", 0.5, 2), ("mid", 0.5, 1)])
    assert {r["source"] for r in blend.collect()} == {"mid"} and {r["source"]: r["actual_share"] for r in mixing.share_report(blend, shares).collect()} == {"absent": 0.0, "mid": 1.0}
    assert mixing.mixed(df.limit(0), [("mid", 1.0, 1)])[0].count() == 0
    huge = spark.createDataFrame([(1, "a", 1000), (2, "a", 3), (3, "b", 10)], "id int, source string, n bigint").withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 4))
    few = mixing.mixed(huge, [("a", 0.5, 1), ("b", 0.5, 1)])[0].collect()  # the long record does not fit, the short one does
    assert {r["id"] for r in few} == {2, 3}
    texts = spark.createDataFrame([(1, "a", None), (2, "a", ""), (None, "a", "xin chào"), (3, None, "x")], "id int, source string, t string")
    assert mixing.measured(texts, "id", "source", "t", ["a"]).count() == 1


#: Sentences written for this test by hand, none of them after a text of the test tables.
PLAIN = [
    ("Đội tuyển bóng đá thắng trận chung kết.", "sport"), ("The striker scored two goals in the final match.", "sport"), ("Bệnh nhân được phẫu thuật tim tại bệnh viện.", "health"), ("The nurse gave the patient antibiotics before surgery.", "health"),
    ("The bank raised its interest rate on mortgages.", "banking"), ("Khách gửi tiết kiệm được hưởng lãi suất cao hơn.", "banking"), ("Lập trình viên sửa lỗi phần mềm trên máy chủ.", "software"), ("The developers fixed a bug in the source code.", "software"),
    ("The courier lost two parcels at the warehouse.", "delivery"), ("Bưu tá giao bưu kiện chậm hai ngày.", "delivery"), ("Kẻ gian giả danh công an để lừa đảo.", "fraud"), ("Phishing scams cost victims their savings account.", "fraud"),
    ("House prices and rents rose in the city.", "real_estate"), ("Căn hộ chung cư tăng giá vì thiếu đất nền.", "real_estate"), ("A new SIM card with roaming and a larger data plan.", "telecom"), ("Nhà mạng mở rộng vùng phủ sóng di động.", "telecom"),
    ("Thương hiệu thuê biển quảng cáo cho chiến dịch quảng cáo.", "advertising"), ("The billboard was part of a marketing campaign.", "advertising"), ("Công dân nộp giấy khai sinh tại ủy ban nhân dân.", "public_admin"), ("The city council issues building permits.", "public_admin"),
    ("Shoppers filled the shopping cart and used vouchers at the online store.", "ecommerce"), ("Người mua đặt hàng trên sàn thương mại điện tử.", "ecommerce"), ("The insurer raised the premium after the insurance claim.", "insurance"), ("Người thụ hưởng nhận tiền bồi thường của hợp đồng bảo hiểm.", "insurance"),
]
NONE = ["Trời hôm nay đẹp quá.", "Đường vào làng đang sửa.", "It rained last Thursday, so volunteers came late.", "We met by the river in the evening.", "Quantum physics studies particles.", ""]


def test_sentences_of_other_hands():
    m = subjects.Matcher(subjects.load_model())
    assert sum(s in m.subjects(x) for x, s in PLAIN) >= 0.9 * len(PLAIN) and not any(m.subjects(x) for x in NONE)
    both = "Bệnh viện và ngân hàng hợp tác."
    assert m.subjects(both) == ["banking", "health"]


def test_subjects_of_documents(spark):
    health, software = "Khoa cấp cứu khám sàng lọc tim mạch. ", "Nhiều tài xế phàn nàn bản vá chậm hơn 3 ngày. "
    doc = health * 3 + software + "Câu chuyện kết thúc lúc 15h50 mà không ai trả lời thêm."
    df = spark.createDataFrame([(1, doc, "s"), (2, None, "s"), (3, "", "s"), (4, doc + health, "s"), (1, doc, "s")], "id int, text string, subject string")
    got = sorted((r["id"], r["subjects"]) for r in subjects.with_subjects(df, "text").collect())
    assert got == [(1, ["health", "software"]), (1, ["health", "software"]), (2, []), (3, []), (4, ["health"])]
    assert subjects.with_subjects(df.limit(0), "text").count() == 0
    long = spark.createDataFrame([(1, health * 20_000)], "id int, text string")
    assert subjects.with_subjects(long, "text").head()["subjects"] == ["health"]


def test_rarity_is_counted_over_the_table():
    model = {"subjects": ["a", "b"], "thresholds": [0.1, 0.1], "terms": [["x", 0, 1.0, 0.001], ["y", 1, 1.0, 0.001]]}
    m = subjects.Matcher(model)
    m.weigh(1_000_000, {0: 900_000, 1: 10})
    assert m.weights[0] < 0.05 < 0.9 < m.weights[1] and m.subjects("x y") == ["b"]
    m.weigh(0, {})
    assert m.subjects("x y") == ["a", "b"]


def test_labelled_examples(spark, sf_dir):
    m = subjects.Matcher(subjects.load_model())
    rows = spark.read.parquet(f"{sf_dir}/subject_examples.parquet").collect()
    lead = [collections.Counter(x for s in subjects.sentences(r["text"]) for x in m.subjects(s)).most_common(1) for r in rows]
    assert sum(bool(k) and k[0][0] == r["subject"] for k, r in zip(lead, rows)) >= 0.98 * len(rows)


def test_queries(spark, sf_dir):
    for name in ("p8_pack", "p8_fill", "p9_mix", "p9_shares", "p10_found", "p10_composition"):
        assert queries.QUERIES[name](spark, sf_dir).count() > 0
    fill = {r["container_kind"]: r for r in queries.p8_fill(spark, sf_dir).collect()}
    assert all(r["filled"] > 0.8 for r in fill.values())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("phone_identities", "phone_observations", "raw_documents", "claim_source_trust"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())
