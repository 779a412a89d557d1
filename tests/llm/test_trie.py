"""The conversation trie against plain loops."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256
from re import findall

import pytest
from pyspark.sql import functions as F

from sparkact.llm import prefix_trie


def plain(rows):
    """Every node by loops over lists of turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    nodes = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for seq in nodes:
        if seq:
            kids[seq[:-1]] += 1
    for seq, who in nodes.items():
        words = len(findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += not kids[seq]
            saved[seq[:d]] += (len(who) - 1) * words
    out = set()
    for seq, who in nodes.items():
        ends = ",".join(str(c) for c in sorted(who) if len(whole[c]) == len(seq))
        parent = min(nodes[seq[:-1]]) if seq else None
        out.add((min(who), len(seq), parent, len(who), kids[seq], leaves[seq], saved[seq], sha256(ends.encode()).hexdigest()))
    return out


def made(spark, rows):
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return d.withColumns({c: F.lit(c) for c in ("hi", "lo", "key", "pos", "depth", "total", "a", "b", "h", "k", "words", "a.b")})


def found(spark, rows):
    out = prefix_trie.trie(made(spark, rows)).collect()
    assert len(out) == len({tuple(r) for r in out})
    return {tuple(r) for r in out}


def test_random_conversations(spark):
    r = random.Random(5)
    rows = []
    for c in r.sample(range(90), 60):
        for t in range(r.randint(1, 6)):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]), r.choice(["a b", "a  b\tc", "", None, "é 漢字"])))
    assert found(spark, rows) == plain(rows)


def test_long_and_equal_conversations(spark):
    """One conversation holds a third of all rows, and hundreds are alike or end before any turn."""
    rows = [(7, t, "user", f"turn {t % 5}") for t in range(700)] + [(40, t, "user", f"turn {t % 5}") for t in range(300)]
    rows += [(c, t, "user", f"turn {t % 5}") for c in range(100, 450) for t in range(2)]
    assert found(spark, rows) == plain(rows)


def test_edges(spark):
    rows = [(None, 1, "user", "x"), (20, None, None, None), (20, None, None, None), (21, 1, "user", "word " * 5000), (-3, 1, "user", "below"), (5, 1, "", ""), (5, 1, "", "")]
    assert found(spark, [r for r in rows if (r[0] or 0) >= 0]) == plain([r for r in rows if (r[0] or 0) >= 0])
    assert found(spark, rows)
    assert found(spark, []) == set()


def test_shared_digest_is_noticed(spark):
    row = "conv_id long, total long, depth long, hi long, lo long, phi long, plo long, key string, words long"
    rows = spark.createDataFrame([(1, 1, 1, 5, 6, 0, 0, "one", 1), (2, 1, 1, 5, 6, 0, 0, "two", 1)], row)
    with pytest.raises(RuntimeError):
        prefix_trie.nodes_of(rows)
