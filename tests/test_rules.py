"""Rule sets against plain loops, and labels written by hand."""

import random
import re
import time

import pytest

from sparkact.functions.rules import NameRules, RuleSet, needle, split
from sparkact.operators import classification as cls


def looped(rules, texts, per_needle=False):
    """Points by trying every needle of every rule."""
    held = {}
    for i, (_, _, field, needles, *none_of) in enumerate(rules):
        t, n = texts[field], 0
        for mode, text, unless in map(needle, split(needles)):
            if mode == "start":
                hit = t.startswith(text)
            elif mode == "word":
                hit = re.search(rf"(?<![a-z0-9]){re.escape(text)}(?![a-z0-9])", t) is not None
            else:
                hit = text in t
            n += hit and not (unless and unless in t)
        if n and not any(x in t for x in (split(none_of[0]) if none_of else ())):
            held[i] = n
    out = {}
    for i, n in held.items():
        out[rules[i][0]] = out.get(rules[i][0], 0) + rules[i][1] * (n if per_needle else 1)
    return (rules[min(held)][0] if held else None), out


@pytest.mark.parametrize("rules", [cls.BASE, cls.SEMANTIC, cls.INTENT], ids=["base", "semantic", "intent"])
def test_equals_loop(rules):
    r = random.Random(6)
    pieces = [p for row in rules.rows() for p in (row[5], row[6]) if p] + [x for _, _, x in rules.forbidden()] + ["x", " ", "9", "-", "é", "微信", "qq"]
    matcher = rules.compiled()
    for _ in range(2000):
        texts = {f: "".join(r.choice(pieces) for _ in range(r.randint(0, 5))) for f in rules.fields}
        first, scores = looped(rules.rules, texts, rules.per_needle)
        assert matcher.first(texts) == first
        assert dict(zip(*matcher.scores(texts), strict=True)) == scores


def test_name_rules_equal_loop():
    r = random.Random(7)
    for _ in range(300):
        rules = [("".join(r.choice("ab漢 ") for _ in range(r.randint(1, 5))), str(i)) for i in range(r.randint(0, 8))]
        find = NameRules(rules).matcher()
        for _ in range(20):
            name = "".join(r.choice("ab漢 ") for _ in range(r.randint(0, 6)))
            want = next((label for rule, label in rules if name == rule or (len(rule.encode()) >= 3 and rule in name) or (len(name.encode()) >= 3 and name in rule)), None)
            assert find(name) == want


def test_cost_does_not_grow_with_the_rules():
    text = {"t": "some title about nothing in particular, " * 50}
    took = []
    for n in (100, 20_000):
        m = RuleSet([(str(i), 1, "t", f"needle{i}x, other{i}y") for i in range(n)]).compiled()
        best = 9.0
        for _ in range(5):
            began = time.perf_counter()
            for _ in range(50):
                assert m.first(text) is None
            best = min(best, time.perf_counter() - began)
        took.append(best)
    assert took[1] < 5 * took[0]


KNOWN = [
    ("Slack", "产品方案讨论", None, "communication", "即时聊天"), ("Zoom", "项目例会", None, "communication", "会议沟通"),
    ("Google Chrome", "Tauri Guide", "https://tauri.app/zh-cn/develop/calling-rust/", "browser", "资料阅读"),
    ("Google Chrome", "tauri onmoved event - Google 搜索", "https://www.google.com/search?q=tauri+onmoved+event", "browser", "资料调研"),
    ("Google Chrome", "Fix updater retry · Pull Request #12 · a/b", "https://github.com/a/b/pull/12", "browser", "编码开发"),
    ("Google Chrome", "Sprint 15 Board - Linear", "https://linear.app/work-review/board", "browser", "任务规划"),
    ("Google Chrome", "ChatGPT - 帮我整理日报", "https://chatgpt.com/c/abc", "browser", "AI 协作"),
    ("Google Chrome", "项目周报 - 飞书云文档", "https://docs.feishu.cn/docx/abc", "browser", "内容撰写"),
    ("Google Chrome", "Rust 异步编程教程 - 哔哩哔哩", "https://www.bilibili.com/video/BV1xx411c7mD", "browser", "视频内容"),
    ("Google Chrome", "发现新鲜事", "https://weibo.com/home", "browser", "休息娱乐"), ("UnknownApp", "首页", None, "other", "未知活动"),
    ("OBS", "", None, "design", "未知活动"), ("Obsidian", "", None, "office", "内容撰写"), ("community", None, None, "other", "未知活动"), ("Jupyter Lab", None, None, "development", "未知活动"),
    ("微信读书", None, None, "entertainment", "未知活动"), ("微信", None, None, "communication", "即时聊天"), ("qqbrowser", None, None, "browser", "未知活动"), ("java.exe", "demo – IntelliJ IDEA", None, "development", "未知活动"),
    (None, None, None, "other", "未知活动"), ("search", None, None, "other", "未知活动"), ("Arc", "", "", "browser", "未知活动"),
]


def test_known_labels(spark):
    d = spark.createDataFrame([(i, *k[:3]) for i, k in enumerate(KNOWN)], "id long, app string, title string, url string")
    got = {r.id: (r.base_category, r.meaning) for r in cls.with_meaning(d).collect()}
    for i, (app, title, url, base, meaning) in enumerate(KNOWN):
        assert got[i] == (base, meaning), (app, title, url)
    assert cls.with_meaning(d.limit(0)).count() == 0


def test_resolution_order(spark):
    settings = cls.Settings(
        app_rules=[("zoom", "meetings"), ("sla", "office")], categories=("development", "browser", "office", "mine", "other"), meanings=("编码开发", "资料阅读"),
        domains={"github.com": ("development", "编码开发"), "gist.github.com": ("browser", "资料阅读")}, website_rules=[("Linear.app", "任务规划"), ("linear.app", "休息娱乐")],
    )
    learned = spark.createDataFrame([("app:tool", "mine", "编码开发"), ("app:slack", "mine", "编码开发"), ("domain:a.b", "development", "编码开发"), ("domain:github.com", "mine", "编码开发"), ("app:gone", "deleted", "编码开发")], "key string, category string, meaning string")
    rows = {
        ("Zoom", "", None): ("other", "未知活动"),  # the rule's category doesn't exist
        ("slack", "", None): ("office", "未知活动"),  # by a rule that is part of the name; meaning deleted
        ("Tool", "", None): ("mine", "编码开发"),  # learned
        ("gone", "", None): ("other", "未知活动"),  # learned, but its category was deleted
        ("Firefox", "", "https://github.com/x"): ("development", "编码开发"),  # known website refines
        ("Firefox", "", "https://gist.github.com/x"): ("browser", "资料阅读"),  # longest suffix
        ("Firefox", "", "https://a.b/x"): ("development", "编码开发"),  # learned website
        ("Firefox", "", "https://linear.app/x"): ("browser", "任务规划"),  # the first website rule has the last word
        ("Figma", "", None): ("other", "未知活动"),  # built-in category deleted
    }
    d = spark.createDataFrame([(i, *k) for i, k in enumerate(rows)], "id long, app string, title string, url string")
    got = {r.id: (r.base_category, r.meaning) for r in cls.resolved(d, settings, learned).collect()}
    assert got == dict(enumerate(rows.values()))
    assert {r.confidence for r in cls.resolved(d, settings, learned).where("url like '%linear%'").collect()} == {100}
