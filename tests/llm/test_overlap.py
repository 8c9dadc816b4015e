import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brassvane.llm import overlap
from brassvane.llm.overlap import Index, Names

NAMES = {"苒关重工": "680963", "彧汐药业": "607237"}
G = "苒关重工大宗交易成交18378.01万元，折价36.60%"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc\U000f0001", min_size=1, max_size=9), min_size=1, max_size=12), st.lists(st.text("abc\U000f0001d", min_size=1, max_size=4), min_size=1, max_size=6))
def test_backward_search_against_find(strings, patterns):
    ix = Index(strings)
    for p, lo, hi in zip(patterns, *ix.search(patterns)):
        assert hi - lo == sum(s.startswith(p, i) for s in strings for i in range(len(s)))
        assert ix.owners(lo, hi).tolist() == [i for i, s in enumerate(strings) if p in s]


def cover(a, b):
    """Share of the shorter string's letters in the longest matches that end at each place, straight from the definition."""
    inside = [False] * len(a)
    for end in range(1, len(a) + 1):
        k = 0
        while k < end and a[end - k - 1 : end] in b:
            k += 1
        if k >= overlap.LEAST:
            inside[end - k : end] = [True] * k
    letters = [overlap.is_letter(overlap.symbols(x)).tolist() for x in (a, b)]
    shorter = min(map(sum, letters))
    return min(1.0, sum(map(lambda x, y: x and y, inside, letters[0])) / shorter) if shorter else float(sum(letters[0]) == sum(letters[1]))


def holds(x, y):
    least = overlap.COVER if x["figures"] and y["figures"] else overlap.COVER_NO_FIGURE
    return overlap.same_fact(x, y) and cover(y["body"], x["body"]) >= least


def same(a, b, names=NAMES):
    n = Names(names)
    return holds(overlap.canonical(a, n), overlap.canonical(b, n))


def test_packed_index_is_the_same():
    ix = Index(["abab", "b", "ba\U000f0001"])
    back = Index.unpack(ix.pack())
    assert [a.tolist() for a in back.search(["ab", "b", "x"])] == [a.tolist() for a in ix.search(["ab", "b", "x"])] and back.n == ix.n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=6), st.lists(st.text("abcd", min_size=1, max_size=12), min_size=1, max_size=4))
def test_maximal_matches_against_find(strings, titles):
    ix, rows = Index(strings), [(i, j) for i in range(len(titles)) for j in range(len(strings))]
    batch = overlap.Batch(ix, titles)
    got, _, _ = overlap.merged(ix, batch, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([len(s) for s in strings]))
    assert np.allclose(got, [cover(titles[i], strings[j]) for i, j in rows])


@pytest.mark.parametrize("b", [
    G, "【快讯】苒关重工大宗交易成交18,378.01万元,折价36.6%", "蘇 苒关重工大宗交易成交１８３７８．０１萬元，折價３６．６０％", "大宗交易成交18378.01万元，折价36.60%——苒关重工", "<em>苒关重工</em>大宗交意成交 18378.01 万元，折价36.60% (updated)",
    "苒关重工大宗交易成交18378.01万元…", "苒关重工(680963)大宗交易成交18378.01万元&nbsp;折价36.60%", "RT 苒关重工大宗交易交易成交18378.01万元，折价36.60%", "苒关重工大宗交易成交18378.01万元，折阶36.60%",
])
def test_same_headline(b):
    assert same(G, b) and same(b, G)


@pytest.mark.parametrize("a, b", [
    (G, "彧汐药业大宗交易成交18378.01万元，折价36.60%"), (G, "苒关重工大宗交易成交18378.02万元，折价36.60%"), (G, "苒关重工大宗交易成交18378.01万元，溢价36.60%"), (G, "苒关重工大宗交易成交18378.01万元"),
    ("苒关重工2024年全年净利润5.1万元 较上年同期多出2.2%", "苒关重工2025年全年净利润5.1万元 较上年同期多出2.2%"), ("苒关重工2024年全年净利润5.1万元 较上年同期多出2.2%", "苒关重工2024年上半年净利润5.1万元 较上年同期多出2.2%"),
    ("龙虎榜：苒关重工获机构净买入99.31万元", "龙虎榜：苒关重工遭机构净卖出99.31万元"), ("苒关重工拟9.5万元收购阀门资产", "苒关重工拟9.5万元出售阀门资产"), ("苒关重工拟9.5万元收够阀门资产", "苒关重工拟9.5万元出售阀门资产"), ("苒关重工股东质押9.5万股", "苒关重工股东解除质押9.5万股"),
    ("苒关重工阀门产线投产，年产值预计9.5万元", "苒关重工阀门产线停产，年产值预计减少9.5万元"), ("苒关重工收到监管罚单9.55万元", "苒关重工拟以9.55万元回购公司股份用于员工持股"), ("X Revenue Hits CNY 5.5mn, Up 4.3%", "X Revenue Hits CNY 5.5mn, Down 4.3%"),
])
def test_other_headline(a, b):
    assert not same(a, b) and not same(b, a)


def brute(golden, news, names):
    n = Names(names)
    out = set()
    for g, a in golden:
        for k, b in news:
            if a is None or b is None:
                continue
            x, y = overlap.canonical(a, n), overlap.canonical(b, n)
            if x["body"] and y["body"] and holds(x, y):
                out.add((g, k))
    return out


def titles(n, seed, first):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        c, f = rng.choice(["苒关重工", "彧汐药业", "未知公司"]), rng.choice(["18378.01", "5.5", "77,001.2", "2024", "31"])
        t = rng.choice([f"{c}大宗交易成交{f}万元，折价{rng.choice(['36.60', '4.1'])}%", f"{c}收到监管罚单，合计罚没{f}万元", f"{c}中标{f}万元机床主轴项目，工期约{rng.choice(['9', '31'])}个月"])
        t = rng.choice([t, t, "RT " + t, t + "｜解读", t.replace("，", ","), t.split("，")[0] + "…"])
        out.append((first + i, t))
    return out + [(first + n, None), (first + n + 1, ""), (first + n + 2, "…")]


@pytest.mark.parametrize("shard, cell", [(2_000_000, 50_000), (200, 30)])
def test_pairs_against_brute_force(spark, monkeypatch, shard, cell):
    monkeypatch.setattr(overlap, "SHARD", shard)
    monkeypatch.setattr(overlap, "CELL", cell)
    golden, news = titles(60, 1, 0), titles(150, 2, 1000)
    news += [(5000 + i, news[0][1]) for i in range(70)]  # a third are copies
    g = spark.createDataFrame([(*r, "x") for r in golden], "golden_id bigint, title string, hash string")
    t = spark.createDataFrame([(*r, "y") for r in news], "news_id bigint, title string, hash string")
    rows = overlap.overlapping_rows(g, t, "golden_id", "news_id", "title", "title", NAMES).collect()
    got = [(r["golden_id"], r["news_id"]) for r in rows]
    assert len(got) == len(set(got)) and set(got) == brute(golden, news, NAMES) and got


def test_titles_without_figures_and_empty(spark):
    g = spark.createDataFrame([(1, "董事会审议通过关于修订公司章程的议案"), (2, "关于召开股东大会的通知")], "golden_id bigint, title string")
    t = spark.createDataFrame([(11, "【公告】董事会审议通过关于修订公司章程的议案"), (12, "关于召开业绩说明会的公告")], "news_id bigint, title string")
    rows = overlap.overlapping_rows(g, t, "golden_id", "news_id", "title", "title").collect()
    assert [(r["golden_id"], r["news_id"]) for r in rows] == [(1, 11)]
    assert overlap.overlapping_rows(g.limit(0), t, "golden_id", "news_id", "title", "title").count() == 0
    assert overlap.overlapping_rows(g, t.limit(0), "golden_id", "news_id", "title", "title").count() == 0


def test_recall_of_titles_without_figures(spark):
    rng = random.Random(5)
    words = ["董事会", "审议", "通过", "修订", "章程", "议案", "召开", "股东大会", "通知", "控股", "子公司", "签署", "战略", "合作", "协议", "完成", "工商", "变更", "登记", "聘任", "高管", "公告", "补充", "说明"]
    base = [(c, "".join(rng.sample(words, 8))) for c in ("苒关重工", "彧汐药业", "未知公司") for _ in range(60)]
    golden = [(i, c + t) for i, (c, t) in enumerate(base)]

    def rewritten(c, t):
        k = rng.randrange(4)
        at = rng.randrange(2, len(t) - 2)
        return c + t if k == 0 else "【快讯】" + c + t if k == 1 else c + t[:at] + "错" + t[at + 1 :] if k == 2 else t[at:] + c + t[:at]

    news = [(1000 + i, rewritten(*rng.choice(base))) for i in range(400)]
    g, t = spark.createDataFrame(golden, "golden_id bigint, title string"), spark.createDataFrame(news, "news_id bigint, title string")
    got = {(r["golden_id"], r["news_id"]) for r in overlap.overlapping_rows(g, t, "golden_id", "news_id", "title", "title", NAMES).collect()}
    want = brute(golden, news, NAMES)
    assert got <= want and len(got & want) >= 0.9 * len(want) and len(want) > 300
