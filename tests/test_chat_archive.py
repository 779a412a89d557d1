"""The archive source: what it reads, what it rejects, and in how much memory."""

import io
import json
import os
import subprocess
import sys

import pytest
from pyspark.errors import PySparkException

from sparkact.sources import chat_archive as arc

HEAD = {"schemaVersion": arc.VERSION, "exportId": "e", "account": {"stableId": "a"}}


def message(i, **more):
    return {"id": f"m{i}", "type": "text", "sender": "s", "createdAt": f"2024-01-01T00:00:0{i % 10}+01:00", "text": f"text {i}"} | more


def archive(root, messages=None, manifest=None, meta=None, envelope=None, raw=None, names=("c1", "c2")):
    """Two conversations of three messages; the arguments change the second one."""
    root.mkdir(parents=True, exist_ok=True)
    declared = [{"stableId": n, "metaPath": f"conv/{n}/meta.json", "messagesPath": f"conv/{n}/messages.json"} for n in names]
    for n in names:
        (root / "conv" / n).mkdir(parents=True)
        last = n == names[-1]
        rows = messages if last and messages is not None else [message(i) for i in range(3)]
        m = {"schemaVersion": arc.VERSION, "username": n, "displayName": "x", "avatarPath": None, "isGroup": False, "exportedAt": "", "messageCount": len(rows)}
        (root / "conv" / n / "meta.json").write_text(json.dumps(m | (meta or {} if last else {})))
        text = json.dumps(HEAD | {"conversation": {"stableId": n}, "messages": rows} | (envelope or {} if last else {}))
        (root / "conv" / n / "messages.json").write_text(raw(text) if raw and last else text)
    m = HEAD | {"exportedAt": "2024-01-01T00:00:00Z", "source": {"kind": "user_selected"}, "format": {}, "scope": {"kind": "full", "conversations": declared}, "filters": {}, "options": {"includeMedia": False}, "stats": {"conversationCount": len(names)}}
    (root / "manifest.json").write_text(json.dumps(m | (manifest or {})))
    return str(root)


def test_rows(spark, tmp_path):
    extra = [message(0, reference={"messageId": "m9"}, extra={"k": 1}, mediaRefs=[{"kind": "image"}]), message(1, text=None, type="image"), message(2, text="é\n\"漢\" 🙂 " * 2000)]
    got = arc.read_archive(spark, archive(tmp_path / "a", extra)).orderBy("conversation", "source_ordinal").collect()
    assert [(r.conversation, r.source_ordinal) for r in got] == [(c, i) for c in ("c1", "c2") for i in range(3)]
    assert got[3].refers_to == "m9" and got[4].content is None and got[5].content == extra[2]["text"].encode("utf-16", "surrogatepass").decode("utf-16")
    assert got[0].created_at_ms == 1704063600000 and arc.read_archive(spark, str(tmp_path / "a")).rdd.getNumPartitions() == 2


FAULTS = {
    "unknown field": {"messages": [message(0, more=1)]},
    "repeated field": {"raw": lambda t: t.replace('"id": "m0"', '"id": "m0", "id": "m0"')},
    "missing field": {"messages": [{"type": "text", "sender": "s"}]},
    "kind": {"messages": [message(0, type="poll")]},
    "sender": {"messages": [message(0, sender=" ")]},
    "long sender": {"messages": [message(0, sender="é" * 300)]},
    "long string": {"messages": [message(0, text="é" * 32_769)]},
    "long key": {"messages": [message(0, extra={"k" * 65_537: 1})]},
    "endless string": {"raw": lambda t: t[: t.index('"text 1')] + '"' + "x" * 6_000_000},
    "time": {"messages": [message(0, createdAt="2024-01-01T00:00:00")]},
    "no time": {"messages": [message(0, createdAt="yesterday")]},
    "cut off": {"raw": lambda t: t[:-40]},
    "more behind": {"raw": lambda t: t + "{}"},
    "other export": {"envelope": {"exportId": "f"}},
    "other conversation": {"envelope": {"conversation": {"stableId": "c1"}}},
    "other version": {"envelope": {"schemaVersion": "wechat_archive_v2"}},
    "envelope": {"envelope": {"note": 1}},
    "count": {"meta": {"messageCount": 4}},
    "meta": {"meta": {"username": "c1"}},
    "no object": {"messages": [1]},
    "reference": {"messages": [message(0, reference={"id": 1})]},
    "media": {"messages": [message(0, mediaRefs=[{"label": "x"}])]},
}


def test_a_faulty_conversation(spark, tmp_path):
    """It fails the read; or it has no row at all, others have theirs, and what is wrong is told."""
    for i, change in enumerate(FAULTS.values()):
        archive(tmp_path / f"all/{i:02d}", **change)
    members = {(r.conversation, r.fault is None) for r in arc.read_archive(spark, str(tmp_path / "all"), "members").collect()}
    assert members == {("c1", True), ("c2", False)}
    kept = arc.read_archive(spark, str(tmp_path / "all"), mode="permissive").groupBy("conversation").count().collect()
    assert [tuple(r) for r in kept] == [("c1", 3 * len(FAULTS))]
    with pytest.raises(PySparkException):
        arc.read_archive(spark, str(tmp_path / "all/00")).collect()


@pytest.mark.parametrize(
    "change",
    [
        {"schemaVersion": "2"}, {"surplus": 1}, {"scope": {"kind": "some", "conversations": []}}, {"options": {"includeMedia": True}}, {"stats": {"conversationCount": 3}}, {"source": {"kind": "x"}},
        *({"scope": {"kind": "full", "conversations": [{"stableId": "c", "metaPath": p, "messagesPath": "conv/c1/messages.json"}]}, "stats": {"conversationCount": 1}} for p in ("/etc/x", "../x", "a/../x", "a\\x", "", "a//x", "c:x", "./x")),
    ],
)
def test_a_faulty_manifest(tmp_path, change):
    with pytest.raises(arc.Unsupported):
        arc.manifest_of(arc.Folder(archive(tmp_path / "a", manifest=change)))


def test_links_are_not_followed(tmp_path):
    root = archive(tmp_path / "a")
    os.rename(f"{root}/conv", f"{tmp_path}/elsewhere")
    os.symlink(f"{tmp_path}/elsewhere", f"{root}/conv")
    member = arc.Reader({"path": root}).partitions()[0]
    assert "link" in member.checked()[1]


@pytest.mark.parametrize("piece", [1, 2, 7, 64])
def test_values_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(arc, "PIECE", piece)
    text = json.dumps(HEAD | {"conversation": {"stableId": "é漢"}, "messages": [message(i, extra={"n": 12.5, "deep": [[], {}, None, True]}) for i in range(5)]}, ensure_ascii=False)
    got = list(arc.envelope(io.BytesIO(text.encode())))
    assert [m for k, m in got if k == "message"] == json.loads(text)["messages"] and got[-1][1]["conversation"] == {"stableId": "é漢"}


MILLION = """
import resource, io, json
from sparkact.sources import chat_archive as arc

class Endless(io.RawIOBase):
    def __init__(self, n):
        self.n, self.i, self.rest = n, -1, b""
    def read(self, size):
        out = [self.rest]
        have = len(self.rest)
        while have < size and self.i <= self.n:
            if self.i < 0:
                x = b'{"schemaVersion": "v", "exportId": "e", "account": {}, "conversation": {}, "messages": ['
            elif self.i == self.n:
                x = b']}'
            else:
                x = (b"," if self.i else b"") + b'{"id": "m%d", "type": "text", "sender": "s", "createdAt": "2024-01-01T00:00:00Z", "text": "some words of a message, number %d"}' % (self.i, self.i)
            out.append(x); have += len(x); self.i += 1
        data = b"".join(out)
        self.rest = data[size:]
        return data[:size]

n = 0
for batch in arc.batches(((("e", "a", "c", i, *arc.message_row(m)) for i, (k, m) in enumerate(arc.envelope(Endless(1_000_000))) if k == "message")), arc.ROWS_SCHEMA):
    assert batch.num_rows <= arc.BATCH
    n += batch.num_rows
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_million_messages_in_little_memory():
    out = subprocess.run([sys.executable, "-c", MILLION], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=300)
    n, mb = map(int, out.stdout.split())
    assert n == 1_000_000 and mb < 300


def test_partitions_do_not_grow_with_conversations(spark, tmp_path, monkeypatch):
    """Large archives and sub-folders are read by slices of their manifests, each conversation once."""
    rows = [(c, i, "user", f"text {c} {i}") for c in range(400) for i in range(c % 3 + 1)]
    d = spark.createDataFrame(rows, "conversation long, ordinal long, role string, content string").selectExpr("*", "ordinal * 1000 AS created_at_ms")
    arc.write_archive(d, str(tmp_path / "many"), "e", "a")
    one = archive(tmp_path / "one", names=[f"c{i}" for i in range(300)])
    for path, want in ((str(tmp_path / "many"), sorted((str(c), i, t) for c, i, _, t in rows)), (one, sorted((f"c{c}", i, f"text {i}") for c in range(300) for i in range(3)))):
        got = arc.read_archive(spark, path)
        assert sorted((r.conversation, r.source_ordinal, r.content) for r in got.collect()) == want and got.rdd.getNumPartitions() <= 4
        monkeypatch.setattr(arc, "SLICE", 2048)  # of this process: planning and reading without Spark
        reader = arc.Reader({"path": path})
        parts = reader.partitions()
        assert 10 <= len(parts) < 100 and sorted((r["conversation"], r["source_ordinal"], r["content"]) for p in parts for b in reader.read(p) for r in b.to_pylist()) == want
        monkeypatch.undo()
