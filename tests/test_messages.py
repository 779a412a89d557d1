"""Chunks of conversations, against a plain loop, and without holding a conversation whole."""

import random

from sparkact.operators import messages as msg


def test_chunks_stream(spark):
    r = random.Random(6)
    rows, expected = [], []
    for c in [None, *range(6)]:
        t, made = 0, []
        for i in range(2000 if c == 3 else r.randint(1, 150)):
            t += r.choice([0, 1000, 1000, 1000, 2_000_000])
            made.append((c, i, t, r.choice([None, "", "é", "x" * r.randint(1, 90), "y" * 700])))
        rows += made
        held, fresh, out = [], 0, []
        text = lambda ms: "\n".join(m[3] or "" for m in ms)
        for m in made:
            if held and m[2] - held[-1][2] > 1_800_000:
                out += [held] if fresh else []
                held, fresh = [], 0
            if held and (len(held) >= 40 or len(text([*held, m]).encode()) > 512):
                out += [held] if fresh else []
                held, fresh = held[-2:], 0
                while held and len(text([*held, m]).encode()) > 512:
                    held = held[1:]
            held, fresh = [*held, m], fresh + 1
        out += [held] if fresh else []
        expected += [(c, k, h[0][1], h[-1][1], len(h), len(text(h).encode()), h[0][2], h[-1][2], text(h)) for k, h in enumerate(out)]
    r.shuffle(rows)
    found = msg.chunks(spark.createDataFrame(rows, "conversation long, ordinal long, created_at_ms long, content string").repartition(5))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
