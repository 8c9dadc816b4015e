import random

import numpy as np

from brassvane.llm import content, script

CALM = ["今天大盘走势平稳", "公司公告很清楚", "求推荐一只股票", "the market closed higher today", "管理员把骂人的帖子删一删", "我真是个笨蛋又卖飞了", "等公告再说吧"]
BAD = ["你这个废物滚出去", "全家不得好死", "那群人都是寄生虫", "you are a filthy moron", "加我看裸聊直播"]


def mask(rng, t):
    k = rng.randrange(5)
    return t if k == 0 else "*".join(t) if k == 1 else "​".join(t) if k == 2 else t.upper() if k == 3 else " ".join(t)


def texts(n, seed, share=0.2):
    rng = random.Random(seed)
    out, y = [], []
    for _ in range(n):
        parts = [rng.choice(CALM) for _ in range(rng.randrange(1, 6))]
        bad = rng.random() < share
        if bad:
            parts.insert(rng.randrange(len(parts) + 1), mask(rng, rng.choice(BAD)))
        out.append("，".join(parts))
        y.append(float(bad))
    return out, np.array(y)


def test_folding():
    assert script.unmask("ＬＯＬ") == "lol" and script.unmask("寄​生蟲") == "寄生虫" and script.unmask("n4ked m0ron") == "naked moron"
    assert content.stream("你*这*个") == "你这个" and content.stream(None) == content.stream(" *​") == "" and content.stream("a12") == "a00" and content.stream("哈哈哈哈哈哈") == "哈哈哈"


def test_terms_stay_inside_texts():
    both, one = content.Terms(["你们这", "", "abc我", "ab"]), content.Terms(["你们这"])
    assert both.starts.tolist() == [0, 3, 3, 7, 9] and (both.codes[:, :3] == one.codes).all()
    assert both.codes[0, 3] != content.SIZE and (both.codes[0, [5, 7, 8]] == content.SIZE).all()  # fewer than three letters left


def plain_score(m, terms, a, b):
    c, x = terms.codes[:, a:b], terms.value[a:b]
    f = (m.v[c].astype(float) * x[None, :, None]).reshape(-1, content.FACTORS)
    return m.bias + content.SCALE * (m.w[c] * x).sum() + 0.5 * content.PAIR_SCALE * ((f.sum(axis=0) ** 2).sum() - (f * f).sum())


def test_windows_equal_a_plain_loop(monkeypatch):
    rng = np.random.default_rng(1)
    w, v = rng.normal(size=content.SIZE + 1), rng.normal(size=(content.SIZE + 1, content.FACTORS))
    w[-1], v[-1] = 0, 0
    m = content.Machine(-0.5, w, v)
    ts = ["短", "", "这是一个比较长的文本用来检查滑动窗口的得分是否正确abcdef" * 3, "an english sentence of some length is told by its letters " * 4, "十二个字" * 6]
    terms = content.Terms(ts)
    for chars in (10, 200_000):
        monkeypatch.setattr(content, "BLOCK_CHARS", chars)
        got, start, end = m.windows(terms)
        owner, a, b = terms.spots()
        for i in range(len(ts)):
            spots = [(x, y) for o, x, y in zip(owner, a, b) if o == i]
            assert all(terms.width[y] - terms.width[x] <= 4 * content.WINDOW for x, y in spots)
            assert not ts[i] or (spots[0][0] == terms.starts[i] and spots[-1][1] == terms.starts[i + 1])
            best = max((plain_score(m, terms, x, y) for x, y in spots if y > x), default=-np.inf)
            assert got[i] == best or abs(got[i] - best) < 1e-2


def test_pairs_tell_what_weights_cannot():
    rng = random.Random(3)
    first, second = ["去死", "猛涨"], ["白痴", "板块"]  # an insult to a person, or news of a sector, by the two together only
    t, y = [], []
    for _ in range(600):
        a, b = rng.randrange(2), rng.randrange(2)
        t.append(f"今天{first[a]}真让人说不出话来{second[b]}啊")
        y.append(float(a == b))
    y, terms, found = np.array(y), content.Terms(t), {}
    for pairs in (True, False):
        s = content.fit(terms, y, np.ones(len(y)), epochs=60, pairs=pairs).windows(terms)[0]
        found[pairs] = ((s > content.best_threshold(s, y, np.ones(len(y)))) == (y > 0)).mean()
    assert found[True] > 0.98 and found[False] < 0.8


def test_held_out_accuracy_under_label_noise():
    t, y = texts(1500, 1)
    noisy = np.where(np.random.default_rng(0).random(len(y)) < 0.05, 1 - y, y)
    m, cut = content.learn(t, noisy, np.full(len(y), 0.7))
    held, want = texts(800, 2)
    flag = m.windows(content.Terms(held))[0] > cut
    assert (flag & (want > 0)).sum() / want.sum() > 0.95 and (flag & (want > 0)).sum() / flag.sum() > 0.95


def test_frame(spark):
    t, y = texts(400, 3)
    docs = spark.createDataFrame([(i, "s", x, 1.0) for i, x in enumerate(t)] + [(1000, None, None, 1.0), (1001, "s", "", 1.0), (1002, "s", t[0], 1.0)], "doc_id bigint, source string, text string, score double")
    labels = spark.createDataFrame([(i, "r1", "abusive" if b else "none") for i, b in enumerate(y)] + [(0, "r2", "none"), (0, "r3", "none"), (None, "r1", "none"), (5000, "r1", "none")], "doc_id bigint, rater string, category string")
    model = content.train(docs, labels)
    out = {r["doc_id"]: r for r in content.score(docs, model).collect()}
    assert len(out) == 403 and out[1000]["score"] == out[1001]["score"] == 0.0 and not out[1000]["flagged"] and out[1002]["score"] == out[0]["score"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert content.train(docs, labels.where("category = 'none'")) is None and content.score(docs, None).where("flagged").count() == 0
    assert len(content.labelled(docs, labels, 50)) <= 50 and content.labelled(docs, labels, 400, 500)["text"].str.len().sum() <= 500 and content.score(docs.limit(0), model).count() == 0


def test_rules_of_the_fit_do_not_depend_on_its_size():
    rare = "鼠"
    code = content.Terms([rare]).codes[0, 0]
    for n in (900, 1100):
        t, y = texts(n, 4)
        t, y = [*t, *(f"{x}，{rare}" for x in t[:3])], np.append(y, [1.0] * 3)
        m = content.fit(content.Terms(t), y, np.ones(len(y)), epochs=1)
        assert m.w[code] > 0 and m.v[code].any()
