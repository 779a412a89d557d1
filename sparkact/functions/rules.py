"""Rule sets over names, titles and addresses, matched by one automaton a field.

All needles of a field go into one Aho-Corasick automaton, which reads a text once, whatever the
number of rules; rules are looked up from the needles that were found. Rule sets are plain data:
(label, points, field, needles), needles separated by commas. ``^x`` must begin the text, ``=x`` must
stand between characters that are no ASCII letters or digits, ``x !y`` counts only where y is not in
the text. A last element of a rule, if given, holds needles of which none may be in the text.

Texts are compared in lower case. A null text counts as an empty one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PART, START, WORD = "part", "start", "word"


def needle(text: str) -> tuple[str, str, str | None]:
    """(mode, needle, unless)."""
    text, _, unless = text.partition(" !")
    mode = START if text.startswith("^") else WORD if text.startswith("=") else PART
    return mode, text if mode == PART else text[1:], unless or None


def split(needles: str) -> list[str]:
    """Needles between commas; blanks inside count, a quoted needle keeps those around it."""
    return [x.strip().strip("'") for x in needles.split(",")]


def alnum(ch: str) -> bool:
    return ch.isascii() and ch.isalnum()


class RuleSet:
    """``per_needle``: each needle found counts, else a rule counts once."""

    def __init__(self, rules: list[tuple], per_needle: bool = False):
        self.rules, self.per_needle = rules, per_needle
        self.fields = list(dict.fromkeys(r[2] for r in rules))

    def rows(self) -> Iterator[tuple[int, str, int, str, str, str, str | None]]:
        """(rule, label, points, field, mode, needle, unless) of every needle."""
        for i, (label, points, field, needles, *_) in enumerate(self.rules):
            for mode, text, unless in map(needle, split(needles)):
                yield i, label, points, field, mode, text, unless

    def forbidden(self) -> Iterator[tuple[int, str, str]]:
        """(rule, field, needle) of the needles that a rule must not meet."""
        for i, (_, _, field, _, *none_of) in enumerate(self.rules):
            for text in split(none_of[0]) if none_of else ():
                yield i, field, text

    def compiled(self) -> Matcher:
        return Matcher(self)

    def first(self, **columns: Column) -> Column:
        """The label of the first rule that holds, or null."""
        matcher, fields = Once(self.compiled), self.fields

        @F.pandas_udf("string")
        def task(*texts: pd.Series) -> pd.Series:
            of = matcher.get()
            return pd.Series([of.first(dict(zip(fields, row, strict=True))) for row in zip(*texts, strict=True)], dtype=object)

        return task(*self.asked(columns))

    def scores(self, **columns: Column) -> Column:
        """map<label, points> over the rules that hold."""
        matcher, fields = Once(self.compiled), self.fields

        @F.pandas_udf("labels array<string>, points array<int>")
        def task(*texts: pd.Series) -> pd.DataFrame:
            of = matcher.get()
            return pd.DataFrame([of.scores(dict(zip(fields, row, strict=True))) for row in zip(*texts, strict=True)], columns=["labels", "points"])

        found = task(*self.asked(columns))
        return F.map_from_arrays(found["labels"], found["points"])

    def asked(self, columns: dict[str, Column]) -> list[Column]:
        return [F.lower(F.coalesce(columns[f], F.lit(""))) for f in self.fields]


class Once:
    """What is made at the first call in a Python worker; only how to make it is sent there."""

    def __init__(self, make):
        self.make, self.made = make, None

    def get(self):
        if self.made is None:
            self.made = self.make()
        return self.made


class Matcher:
    """The automata of a rule set, made once in each Python worker and task."""

    def __init__(self, rules: RuleSet):
        import ahocorasick

        self.set = rules
        entries: dict[str, dict[str, list]] = {f: defaultdict(list) for f in rules.fields}
        for i, _, _, field, mode, text, unless in rules.rows():
            entries[field][text].append((mode, i, unless))
            if unless:
                entries[field][unless]  # noqa: B018  is to be noticed
        self.none_of: dict[int, list[tuple[str, str]]] = defaultdict(list)
        for i, field, text in rules.forbidden():
            entries[field][text]  # noqa: B018
            self.none_of[i].append((field, text))
        self.automata, self.entries = {}, entries
        for field, words in entries.items():
            automaton = ahocorasick.Automaton()
            for w in words:
                automaton.add_word(w, w)
            automaton.make_automaton()
            self.automata[field] = automaton

    def held(self, texts: dict[str, str]) -> dict[int, int]:
        """How many needles of each rule that holds were found."""
        found: dict[int, int] = defaultdict(int)
        seen = set()
        for field, automaton in self.automata.items():
            text = texts[field]
            places: dict[str, set[str]] = {}
            for end, w in automaton.iter(text):
                start = end - len(w) + 1
                modes = places.setdefault(w, {PART})
                if start == 0:
                    modes.add(START)
                if (start == 0 or not alnum(text[start - 1])) and (end + 1 == len(text) or not alnum(text[end + 1])):
                    modes.add(WORD)
            seen.update((field, w) for w in places)
            for w, modes in places.items():
                for mode, rule, unless in self.entries[field][w]:
                    if mode in modes and (unless is None or unless not in places):
                        found[rule] += 1
        return {r: n for r, n in found.items() if not any(x in seen for x in self.none_of.get(r, ()))}

    def first(self, texts: dict[str, str]) -> str | None:
        held = self.held(texts)
        return self.set.rules[min(held)][0] if held else None

    def scores(self, texts: dict[str, str]) -> tuple[list[str], list[int]]:
        out: dict[str, int] = defaultdict(int)
        for rule, n in self.held(texts).items():
            label, points = self.set.rules[rule][:2]
            out[label] += points * (n if self.set.per_needle else 1)
        return list(out), list(out.values())


class NameRules:
    """A user's ordered rules (name, label): the first whose name equals a given one, is a part of it, or
    has it as a part, where parts are of three bytes at least."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = [(name.lower(), label) for name, label in rules]

    def matcher(self):
        import ahocorasick

        first: dict[str, int] = {}
        for i, (name, _) in enumerate(self.rules):
            first.setdefault(name, i)
        automaton = ahocorasick.Automaton()
        for name, i in first.items():
            if len(name.encode()) >= 3:
                automaton.add_word(name, i)
        automaton.make_automaton()
        joined = "\0".join(name for name, _ in self.rules)
        begins, at = [], 0
        for name, _ in self.rules:
            begins.append(at)
            at += len(name) + 1

        def find(name: str) -> str | None:
            hits = [first[name]] if name in first else []
            if len(automaton):
                hits += [i for _, i in automaton.iter(name)]
            if len(name.encode()) >= 3 and (where := joined.find(name)) >= 0:
                hits.append(bisect_right(begins, where) - 1)
            return self.rules[min(hits)][1] if hits else None

        return find

    def label(self, name: Column) -> Column:
        """The label of the first rule that fits a name, or null."""
        matcher = Once(self.matcher)

        @F.pandas_udf("string")
        def task(names: pd.Series) -> pd.Series:
            return pd.Series([matcher.get()(n) for n in names], dtype=object)

        return task(F.lower(F.coalesce(name, F.lit(""))))


def added(scores: Column, label: Column, points: Column) -> Column:
    """``scores`` with points for one label more; nothing is added for null points."""
    one = F.when(points.isNotNull() & label.isNotNull(), F.create_map(label, points)).otherwise(F.create_map().cast("map<string,int>"))
    return F.map_zip_with(scores, one.cast("map<string,int>"), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def ranked(scores: Column) -> Column:
    """array<struct<points, label>>, most points first, smaller labels first among equals."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("label")))
    return F.transform(F.array_sort(entries), lambda e: F.struct((-e["minus"]).alias("points"), e["label"].alias("label")))


def lookup(table: dict[str, object], key: Column) -> Column:
    """The value of a small fixed table; null without one."""
    if not table:
        return F.lit(None)
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
