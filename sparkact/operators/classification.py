"""What a record of activity is about: base category, meaning, resolution by a user's rules, and
the intent of a session.

Labels depend on (app, title, url) only, so that they are computed once for each distinct triple
and joined back; AQE splits a triple that very many records share.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkact.functions import apps
from sparkact.functions import text as tx
from sparkact.functions.names import fresh
from sparkact.functions.rules import NameRules, RuleSet, added, lookup, ranked

UNKNOWN = "未知活动"

# Base categories by the first rule that holds, (category, points, field, needles).
BASE_RULES = [
    ("development", 0, "app", "code, visual studio, cursor, idea, pycharm, webstorm, goland, clion, rustrover, rider, phpstorm, datagrip, fleet, xcode, android studio, hbuilder, sublime, atom, vim, neovim, emacs, nova, bbedit, coteditor, textmate, terminal, iterm, warp, alacritty, kitty, wezterm, hyper, windowsterminal, cmd, powershell, git, sourcetree, gitkraken, docker, postman, insomnia, dbeaver, navicat, tableplus, sequel, charles, fiddler"),
    ("browser", 0, "app", "chrome, firefox, safari, msedge, microsoft edge, opera, brave, ^arc, vivaldi, chromium, orion, ^zen, sidekick, wavebox, maxthon, waterfox, librewolf, tor browser, duckduckgo, yandex, ^whale, naver, uc browser, qq browser, 360 browser, sogou browser, qqbrowser, 360se, 360chrome, sogouexplorer, 2345explorer, liebao, theworld, centbrowser, iexplore, qq浏览器, 360浏览器, 搜狗浏览器, tabbit"),
    ("communication", 0, "app", "slack, teams, zoom, discord, wechat, 微信 !微信读书, wecom, 企业微信, qq !qqbrowser, telegram, skype, dingtalk, 钉钉, 飞书, lark"),
    ("office", 0, "app", "word, excel, powerpoint, pages, numbers, keynote, notion, obsidian, logseq, evernote, onenote, wps, typora, bear, ulysses, xmind, mindnode"),
    ("design", 0, "app", "figma, sketch, photoshop, illustrator, xd, canva, pixelmator, affinity, lightroom, indesign"),
    ("entertainment", 0, "app", "spotify, music, youtube, netflix, bilibili, game, steam, 网易云, qqmusic, 爱奇艺"),
    # known programs, as whole words
    ("development", 0, "app", "=jupyter, =rstudio, =matlab, =unity, =unreal, =godot, =termius, =xshell, =finalshell, =tabby, =apifox, =apipost, =wireshark, =virtualbox, =vmware, =parallels, =utm, =mongodb compass, =redisinsight, =another redis"),
    ("office", 0, "app", "=语雀, =yuque, =zotero, =anki, =calibre, =goodnotes, =notability, =marginnote, =有道, =eudic, =欧路词典, =百度网盘, =baidunetdisk, =夸克, =飞书文档, =腾讯文档, =mweb, =思源笔记, =siyuan, =flomo"),
    ("communication", 0, "app", "=腾讯会议, =wemeet, =voov, =webex, =mattermost, =rocket.chat"),
    ("design", 0, "app", "=blender, =cinema 4d, =davinci, =premiere, =final cut, =after effects, =audacity, =剪映, =capcut, =obs, =obs studio, =procreate, =即时设计, =mastergo"),
    ("entertainment", 0, "app", "=腾讯视频, =优酷, =芒果tv, =抖音, =快手, =iina, =vlc, =potplayer, =mpv, =微信读书, =weread, =kindle, =crossover"),
    # the title, where the name says nothing
    ("development", 0, "title", "intellij, pycharm, webstorm, goland, clion, datagrip, rustrover, visual studio, vs code, cursor"),
]

# Meanings, (label, points, field, needles of which one is enough[, needles of which none may be there]).
SEMANTIC_RULES = [
    ("编码开发", 48, "app", "cursor, code, visual studio, idea, pycharm, webstorm, goland, terminal, powershell, warp, wezterm, docker, postman, insomnia, dbeaver"),
    ("编码开发", 24, "title", ".rs, .ts, .tsx, .js, .jsx, .vue, .py, .go, .java, .kt, .sql, cargo, npm, git, commit, pull request, branch"),
    ("编码开发", 22, "title", "pull request, code review, review comments, changed files, diff"),
    ("内容撰写", 36, "app", "word, typora, obsidian, notion, 飞书文档, wps, onenote"),
    ("内容撰写", 28, "title", "日报, 周报, 方案, 需求, prd, 复盘, 邮件, memo, 草稿"),
    ("资料阅读", 24, "app", "preview, reader, pdf, kindle, zotero, notion, obsidian"),
    ("资料阅读", 32, "title", "文档, readme, docs, guide, manual, wiki, 帮助, 教程"),
    ("资料阅读", 42, "url", "docs., /docs, readme, wiki, developer., tauri.app, doc.rust-lang.org"),
    ("AI 协作", 58, "url", "chatgpt.com, chat.openai.com, openai.com/chatgpt, claude.ai, chat.deepseek.com, kimi.moonshot.cn, gemini.google.com, yuanbao.tencent.com, tongyi.aliyun.com, doubao.com"),
    ("AI 协作", 24, "title", "chatgpt, claude, deepseek, kimi, gemini, 提示词, prompt, 大模型"),
    ("资料调研", 52, "url", "google.com/search, bing.com/search, baidu.com/s, sogou.com/web, so.com/s"),
    ("资料调研", 26, "title", "搜索, search, 对比, 最佳实践, 怎么实现, 如何, 方案选择"),
    ("资料调研", 12, "url", "stackoverflow.com, github.com, zhihu.com, juejin.cn, segmentfault.com"),
    ("会议沟通", 64, "app", "zoom, teams, meeting, meet, 腾讯会议, 飞书会议"),
    ("会议沟通", 30, "title", "会议, 例会, meeting, call, huddle, 共享屏幕, 语音通话, 视频会议"),
    ("即时聊天", 36, "app", "slack, discord, wechat, 微信, wecom, 企业微信, telegram, qq, 飞书, lark, dingtalk, 钉钉"),
    ("即时聊天", 18, "title", "群聊, 频道, 聊天, 消息, 联系人, 讨论, 讨论组"),
    ("任务规划", 50, "app", "jira, linear, trello, asana, clickup, todoist"),
    ("任务规划", 26, "title", "待办, 迭代, 任务, 排期, 看板, 里程碑, backlog, sprint"),
    ("任务规划", 46, "url", "linear.app, jira, atlassian.net, trello.com, clickup.com, asana.com, github.com/issues, github.com/projects"),
    ("内容撰写", 56, "url", "docs.google.com/document, docs.google.com/spreadsheets, docs.feishu.cn, shimo.im/docs, yuque.com, notion.so, notion.site, kdocs.cn"),
    ("内容撰写", 18, "title", "云文档, 在线文档, doc, document"),
    ("设计创作", 56, "app", "figma, sketch, photoshop, illustrator, canva, affinity"),
    ("设计创作", 20, "title", "画板, 组件, 原型, 设计稿, frame"),
    ("音乐音频", 54, "app", "spotify, music, 网易云, qqmusic, apple music, podcast"),
    ("音乐音频", 20, "title", "歌单, 专辑, 歌词, 播客, playlist, album"),
    ("视频内容", 52, "app", "youtube, bilibili, 爱奇艺, 腾讯视频, netflix, vlc, iina"),
    ("视频内容", 24, "title", "回放, 课程, 教程, lesson, 直播, 视频, episode, movie, 播放"),
    ("视频内容", 42, "url", "youtube.com/watch, youtube.com/playlist, bilibili.com/video, bilibili.com/list, v.qq.com, iqiyi.com, youku.com, netflix.com/watch"),
    ("休息娱乐", 46, "app", "steam, weibo, 微博, douyin, 抖音, 小红书, rednote, reddit"),
    ("休息娱乐", 18, "app", "steam"),
    ("休息娱乐", 20, "title", "游戏, 动态, 社区, 直播, 刷视频, 推荐"),
    ("休息娱乐", 64, "url", "weibo.com, x.com, twitter.com, xiaohongshu.com, douyin.com, reddit.com, tieba.baidu.com, hupu.com"),
    ("编码开发", 12, "url", "github.com/"),
    ("资料调研", 8, "url", "github.com/"),
    ("编码开发", 28, "url", "github.com/, /pull/, /compare/, /commit/, /blob/, /tree/, /files", "/wiki, /releases, /discussions"),
]

# What a base category adds to a meaning, the least points of a meaning, the meanings that must lead clearly,
# and the base category of a meaning that a website rule gives.
BASE_POINTS = {"development": ("编码开发", 28), "communication": ("即时聊天", 16), "office": ("内容撰写", 12), "design": ("设计创作", 24), "browser": ("资料阅读", 16), "entertainment": ("休息娱乐", 8)}
OWN_CATEGORY_POINTS = 12
THRESHOLDS = {"会议沟通": 60, "休息娱乐": 60, "即时聊天": 50, "视频内容": 50, "编码开发": 40, "内容撰写": 40, "资料阅读": 40, "资料调研": 40, "任务规划": 42, "设计创作": 42, "音乐音频": 42, "AI 协作": 42}
OTHER_THRESHOLD, LEAD, GUARDED = 45, 10, ("会议沟通", "休息娱乐")
MEANING_BASE = {"休息娱乐": "entertainment", "视频内容": "entertainment", "音乐音频": "entertainment", "即时聊天": "communication", "会议沟通": "communication", "设计创作": "design", "编码开发": "development", "内容撰写": "office", "资料阅读": "browser", "资料调研": "browser", "任务规划": "browser", "AI 协作": "browser", UNKNOWN: "browser"}

# Intents of sessions, (label, points of each needle, field, needles); then what other columns add.
INTENT_RULES = [
    ("编码开发", 12, "corpus", "cursor, vscode, visual studio code, code, pycharm, intellij, xcode, webstorm, terminal, iterm, warp, git, commit, branch, merge, cargo, npm, pnpm, debug, feature, 代码, 开发"),
    ("代码评审", 14, "corpus", "pull request, merge request, code review, review, diff, approval, comment, 'pr ', ' mr ', 评审, 审查"),
    ("需求文档", 10, "corpus", "prd, spec, doc, docs, document, notion, 语雀, 飞书文档, confluence, 需求, 文档, 方案, 设计稿"),
    ("会议沟通", 12, "corpus", "zoom, meeting, meet, teams, slack, discord, 飞书, 企业微信, 会议, 沟通, 同步, 站会, 腾讯会议"),
    ("问题排查", 12, "corpus", "bug, issue, error, exception, traceback, stack trace, failed, failure, 日志, 报错, 修复, 排查, 异常"),
    ("测试验证", 10, "corpus", "test, pytest, vitest, playwright, cypress, junit, assert, 验证, 回归, 测试, 单测"),
    ("学习调研", 8, "corpus", "google, stackoverflow, docs, documentation, guide, tutorial, research, readme, 调研, 教程, 文档, 资料"),
    ("AI 协作", 9, "corpus", "chatgpt, openai, claude, deepseek, kimi, gemini, copilot, cursor, llm, prompt, 大模型"),
    ("项目管理", 10, "corpus", "jira, linear, asana, trello, roadmap, milestone, todoist, sprint, 任务, 排期, 看板, 项目"),
]
INTENT_BONUSES = [
    ("编码开发", 10, "category", "^development"),
    ("学习调研", 4, "app", "browser, chrome, safari"),
    ("代码评审", 8, "title", "pr, review"),
    ("编码开发", 6, "domains", "github.com"),
    ("代码评审", 4, "domains", "github.com"),
    ("AI 协作", 10, "domains", "openai.com, claude.ai, chat.deepseek.com"),
    ("问题排查", 8, "keywords", "bug, 报错"),
]
NO_INTENT = "通用工作"

BASE, SEMANTIC = RuleSet(BASE_RULES), RuleSet(SEMANTIC_RULES)
INTENT, INTENT_BONUS = RuleSet(INTENT_RULES, per_needle=True), RuleSet(INTENT_BONUSES)


def base_category(app: Column, title: Column) -> Column:
    return F.coalesce(BASE.first(app=app, title=title), F.lit("other"))


def meaning(app: Column, title: Column, url: Column, base: Column) -> Column:
    """struct<label, confidence>: the meaning with most points if they reach its threshold and, for guarded
    ones, lead by LEAD. A base category of the user's own is a meaning with few points."""
    own = ~base.isin("other", *BASE_POINTS)
    label = F.coalesce(lookup({k: v[0] for k, v in BASE_POINTS.items()}, base), F.when(own, base))
    points = F.coalesce(lookup({k: v[1] for k, v in BASE_POINTS.items()}, base), F.when(own, F.lit(OWN_CATEGORY_POINTS)))
    trimmed = [F.trim(F.coalesce(c, F.lit(""))) for c in (app, title, url)]
    scores = added(SEMANTIC.scores(app=trimmed[0], title=trimmed[1], url=trimmed[2]), label, points)
    best, second = F.get(ranked(scores), F.lit(0)), F.coalesce(F.get(ranked(scores), F.lit(1))["points"], F.lit(0))
    lead = best["points"] - second
    least = F.coalesce(lookup(THRESHOLDS, best["label"]), F.lit(OTHER_THRESHOLD))
    fails = (best["points"] < least) | (best["label"].isin(*GUARDED) & (lead < LEAD))
    confidence = F.when(best.isNull(), 20).when(fails, 45).otherwise(F.least(F.greatest(best["points"] + lead, F.lit(55)), F.lit(98)))
    return F.struct(F.when(best.isNull() | fails, UNKNOWN).otherwise(best["label"]).alias("label"), confidence.cast("int").alias("confidence"))


@dataclass
class Settings:
    """A user's rules, in their order, and the labels that exist; ``domains`` (suffix: (category, meaning)) is what is known of websites."""

    app_rules: list[tuple[str, str]] = field(default_factory=list)
    categories: tuple[str, ...] = ("development", "browser", "communication", "office", "design", "entertainment", "other")
    meanings: tuple[str, ...] = tuple(MEANING_BASE)
    domains: dict[str, tuple[str, str]] = field(default_factory=dict)
    website_rules: list[tuple[str, str]] = field(default_factory=list)


def distinct_labels(records: DataFrame, columns: list[str], labelled) -> DataFrame:
    """``records`` with what ``labelled(distinct rows of columns)`` adds."""
    keys = [fresh(f"_key{i}", records) for i in range(len(columns))]
    marked = records.withColumns({k: F.coalesce(F.col(c), F.lit("")) for k, c in zip(keys, columns, strict=True)})
    distinct = marked.select(*[F.col(k).alias(c) for k, c in zip(keys, columns, strict=True)]).distinct()
    labels = labelled(distinct)
    return marked.join(labels.withColumnsRenamed(dict(zip(columns, keys, strict=True))), keys).drop(*keys)


def with_meaning(records: DataFrame) -> DataFrame:
    """``records`` (app, title, url) with base_category, meaning and confidence by the built-in rules."""

    def labelled(d: DataFrame) -> DataFrame:
        d = d.withColumn("base_category", base_category(F.trim("app"), F.trim("title")))
        d = d.withColumn("_m", meaning(F.col("app"), F.col("title"), F.col("url"), F.col("base_category")))
        return d.select("app", "title", "url", "base_category", F.col("_m.label").alias("meaning"), F.col("_m.confidence").alias("confidence"))

    return distinct_labels(records, ["app", "title", "url"], labelled)


def resolved(records: DataFrame, settings: Settings, learned: DataFrame | None = None) -> DataFrame:
    """``records`` (app, title, url) with base_category, meaning and confidence, resolved in this order: the user's rule for
    the program, else the built-in one; a deleted category is ``other``; a known website refines ``browser``;
    what was ``learned`` (key ``app:..`` or ``domain:..``, category, meaning) refines what is still
    ``other`` or an unknown website; then the meaning's points; a deleted meaning is unknown; known or learned
    meanings replace unsure ones; a website rule has the last word."""

    def labelled(d: DataFrame) -> DataFrame:
        own = {c for c in settings.categories}
        valid = lambda c: c.isin(*own)
        rules = NameRules([(name, label.strip().lower() if label.strip().lower() in own | {"other"} else "other") for name, label in settings.app_rules])
        d = d.withColumn("base_category", F.coalesce(rules.label(apps.display_name(F.col("app"))), base_category(F.col("app"), F.col("title"))))
        d = d.withColumn("base_category", F.when(valid(F.col("base_category")), F.col("base_category")).otherwise("other"))
        d = d.withColumn("_host", tx.host(F.col("url")))
        known = F.lit(None).cast("string")
        if settings.domains:  # the longest suffix; a lookup for each, as hosts have few parts
            suffixes = F.filter(tx.suffixes(F.col("_host")), lambda s: F.map_contains_key(table_of({k: k for k in settings.domains}), s))
            known = F.get(suffixes, F.lit(0))
        d = d.withColumn("_known", known)
        kb_base = lookup({k: v[0] for k, v in settings.domains.items()}, F.col("_known")).cast("string")
        kb_meaning = lookup({k: v[1] for k, v in settings.domains.items()}, F.col("_known")).cast("string")
        refined = (F.col("base_category") == "browser") & (kb_base != "browser") & valid(kb_base)
        d = d.withColumn("base_category", F.when(refined, kb_base).otherwise(F.col("base_category")))
        app_key = F.concat(F.lit("app:"), F.lower(F.trim("app")))
        site_key = F.when(F.col("_known").isNull() & (F.col("_host") != ""), F.concat(F.lit("domain:"), F.col("_host")))
        d = d.withColumn("_ask", F.when(F.col("base_category") == "other", app_key).when(F.col("base_category") == "browser", site_key))
        hint = F.lit(None).cast("string")
        if learned is not None:
            table = learned.where(valid(F.col("category"))).groupBy(F.col("key").alias("_ask")).agg(F.min(F.struct("category", "meaning")).alias("_learned"))
            d = d.join(table, "_ask", "left")
            d = d.withColumn("base_category", F.coalesce("_learned.category", "base_category"))
            hint = F.col("_learned.meaning")
        d = d.withColumn("_hint", F.coalesce(hint, kb_meaning))
        d = d.withColumn("_m", meaning(F.col("app"), F.col("title"), F.col("url"), F.col("base_category")))
        exists = lambda c: c.isin(*settings.meanings)
        label = F.when(exists(F.col("_m.label")), F.col("_m.label")).otherwise(UNKNOWN)
        unsure = (F.col("_m.confidence") < 70) & F.coalesce(exists(F.col("_hint")), F.lit(False))
        d = d.withColumns({"meaning": F.when(unsure, F.col("_hint")).otherwise(label), "confidence": F.when(unsure, 70).otherwise(F.col("_m.confidence"))})
        sites: dict[str, str] = {}
        for name, to in settings.website_rules:
            sites.setdefault(name.strip().lower(), to.strip())
        ruled = lookup(sites, F.col("_host")).cast("string")
        base = F.coalesce(lookup(MEANING_BASE, ruled), F.col("base_category"))
        d = d.select("app", "title", "url", F.when(ruled.isNotNull(), base).otherwise(F.col("base_category")).alias("base_category"), F.coalesce(ruled, "meaning").alias("meaning"), F.when(ruled.isNotNull(), 100).otherwise(F.col("confidence")).alias("confidence"))
        return d

    return distinct_labels(records, ["app", "title", "url"], labelled)


def table_of(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def session_intents(sessions: DataFrame) -> DataFrame:
    """``sessions`` (category, app, title, domains, keywords, corpus: strings) with intent and score: 40 and the points of the
    intent with most, each distinct needle of the corpus counting."""
    bonus = INTENT_BONUS.scores(**{c: F.col(c) for c in INTENT_BONUS.fields})
    both = F.map_zip_with(INTENT.scores(corpus=F.col("corpus")), bonus, lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    best = F.get(ranked(both), F.lit(0))
    score = F.lit(40) + F.coalesce(best["points"], F.lit(0))
    return sessions.withColumns({"intent": F.coalesce(best["label"], F.lit(NO_INTENT)), "score": score})
