"""Chat archives as a data source: folders of a manifest, and for each conversation it declares two
JSON files, ``meta`` and ``messages``.

``spark.read.format("chat_archive").load(path)`` reads the archive in ``path`` itself or, without a manifest there, those
in its sub-folders. A small archive's partitions are its declared conversations; of a large one, or of sub-folders, they
are slices of the manifest (a slice for each SLICE bytes of it, MOST_SLICES at most), which their tasks read, so that neither
tasks nor what the driver holds grow with the conversations. A task reads each file
piece by piece and hands on messages in batches of BATCH rows, so that a conversation of any length
needs the memory of one message and one batch. Everything is checked as the manifest says and
fails closed: unknown, repeated or missing fields, kinds and versions, paths that leave the
folder or are links, headers and counts that differ from the manifest's, strings over MAX_STRING bytes.

Option ``what``: ``messages`` (the rows), or ``members`` (a row for each conversation: how many
messages it has and what is wrong with it, if anything). Option ``mode``: ``failfast`` (the read
fails) or ``permissive`` (a conversation with any fault has no row; it is read twice, first to check).
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The version and kinds that are read, the fields of each object, the size of a string and of a batch.
VERSION = "wechat_archive_v1"
SCOPES = ("selected", "full")
KINDS = ("text", "image", "video", "voice", "file", "location", "link", "emoji", "quote", "reply", "system", "recall", "unknown")
MOST_OF_A_SENDER = 512
MANIFEST = {"schemaVersion", "exportedAt", "exportId", "account", "source", "format", "scope", "filters", "options", "stats", "accountsAvailable", "integrityFiles"}
OPTIONAL = {"accountsAvailable", "integrityFiles"}
DECLARED = {"stableId", "metaPath", "messagesPath"}
META = {"schemaVersion", "username", "displayName", "avatarPath", "isGroup", "exportedAt", "messageCount"}
ENVELOPE = {"schemaVersion", "exportId", "account", "conversation", "messages"}
MESSAGE = {"id", "type", "sender", "createdAt", "text", "media", "renderType", "reference", "extra", "mediaRefs"}
NEEDED = {"type", "sender", "createdAt"}
MAX_STRING, BATCH = 64 * 1024, 256
MAX_ELEMENT = 4 * 1024 * 1024  # of one message in all, which bounds what is held of a damaged file
PIECE = 256 * 1024
SLICE, MOST_SLICES = 64 * 1024, 64  # bytes of a manifest a partition, partitions an archive

ROWS = "export_id string, account string, conversation string, source_ordinal long, message_id string, kind string, sender string, created_at_ms long, content string, refers_to string"
ROWS_SCHEMA = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in ROWS.split(", "))])
MEMBERS = "export_id string, account string, conversation string, messages long, fault string"
MEMBERS_SCHEMA = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in MEMBERS.split(", "))])


class Unsupported(ValueError):
    """What an archive says that isn't read."""


def demand(holds: bool, what: str) -> None:
    if not holds:
        raise Unsupported(what)


def no_repeats(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    demand(len(out) == len(pairs), "repeated field")
    return out


DECODER = json.JSONDecoder(object_pairs_hook=no_repeats)


def only_fields(x: object, known: set[str], needed: set[str], what: str) -> dict:
    demand(isinstance(x, dict), f"{what} is no object")
    demand(set(x) <= known, f"unknown field of {what}")
    demand(needed <= set(x), f"missing field of {what}")
    return x


def small_strings(x: object) -> None:
    """Every string, keys too, is of MAX_STRING bytes at most."""
    if isinstance(x, str):
        demand(len(x) <= MAX_STRING and (len(x) * 4 <= MAX_STRING or len(x.encode("utf-8", "surrogatepass")) <= MAX_STRING), "string over the size limit")
    elif isinstance(x, dict):
        for k, v in x.items():
            small_strings(k)
            small_strings(v)
    elif isinstance(x, list):
        for v in x:
            small_strings(v)


class Tokens:
    """JSON values one after the other from a file that is read in pieces."""

    def __init__(self, file, most: int = MAX_ELEMENT):
        self.file, self.most = file, most
        self.decoder = codecs.getincrementaldecoder("utf-8")()
        self.text, self.at, self.ended = "", 0, False

    def more(self, size: int = PIECE) -> bool:
        if self.ended:
            return False
        raw = self.file.read(size)
        self.ended = not raw
        self.text = self.text[self.at :] + self.decoder.decode(raw, final=self.ended)
        self.at = 0
        return True

    def peek(self) -> str:
        """The next character that is no white space; empty at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def take(self, mark: str) -> None:
        demand(self.peek() == mark, "damaged JSON")
        self.at += 1

    def value(self) -> object:
        self.peek()
        size = PIECE
        while True:
            try:
                out, end = DECODER.raw_decode(self.text, self.at)
                if end < len(self.text) or self.ended:  # a number may go on
                    self.at = end
                    return out
            except json.JSONDecodeError:
                demand(not self.ended, "damaged JSON")
            demand(len(self.text) - self.at <= self.most, "message over the size limit")
            self.more(size)
            size *= 2  # so that a long value isn't read again for each piece

    def items(self, begin: str, end: str) -> Iterator[None]:
        """Stops before each item of an object or array."""
        self.take(begin)
        if self.peek() != end:
            yield
            while self.peek() == ",":
                self.at += 1
                yield
        self.take(end)


def envelope(file) -> Iterator[tuple[str, object]]:
    """("message", m) for each message as it is read, then ("header", the other fields)."""
    tokens, header = Tokens(file), {}
    for _ in tokens.items("{", "}"):
        key = tokens.value()
        demand(isinstance(key, str) and key in ENVELOPE and key not in header, "unknown or repeated field of the messages")
        tokens.take(":")
        if key == "messages":
            header[key] = True
            for _ in tokens.items("[", "]"):
                yield "message", tokens.value()
        else:
            header[key] = tokens.value()
    demand(tokens.peek() == "", "damaged JSON")
    demand(set(header) == ENVELOPE, "missing field of the messages")
    yield "header", header


def millis(text: str) -> int:
    at = datetime.fromisoformat(text)
    demand(at.tzinfo is not None, "time without an offset")
    return round(at.timestamp() * 1000)


def message_row(m: object) -> tuple:
    """(message_id, kind, sender, created_at_ms, content, refers_to)."""
    m = only_fields(m, MESSAGE, NEEDED, "a message")
    small_strings(m)
    demand(m["type"] in KINDS, "unknown kind of message")
    for name in ("id", "text", "media", "renderType"):
        demand(m.get(name) is None or isinstance(m[name], str), f"{name} is no string")
    demand(isinstance(m["sender"], str) and isinstance(m["createdAt"], str), "sender or time is no string")
    demand(0 < len(m["sender"].strip().encode("utf-8", "surrogatepass")) <= MOST_OF_A_SENDER, "sender of no or too great length")
    demand(m.get("renderType") is None or m["renderType"] in KINDS, "unknown kind of display")
    demand(m.get("extra") is None or isinstance(m["extra"], dict), "extra is no object")
    demand(isinstance(m.get("mediaRefs", []), list), "mediaRefs is no list")
    for ref in m.get("mediaRefs", []):
        only_fields(ref, {"kind", "relativePath", "label", "extra"}, {"kind"}, "a media reference")
    reference = m.get("reference")
    if reference is not None:
        reference = only_fields(reference, {"messageId", "sender", "createdAt"}, set(), "a reference").get("messageId")
    return m.get("id"), m["type"], m["sender"], millis(m["createdAt"]), m.get("text"), reference


def safe_path(path: object) -> str:
    demand(isinstance(path, str) and path != "" and "\\" not in path and ":" not in path and "//" not in path and not path.startswith("/"), "unsafe path")
    demand(all(p not in ("", ".", "..") for p in path.split("/")), "unsafe path")
    return path


@dataclass
class Folder:
    """An archive's folder in any file system that Arrow opens."""

    uri: str

    def resolved(self, name: str = ""):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else f"file://{self.uri}")
        return system, str(PurePosixPath(root) / name) if name else root

    def open(self, name: str):
        """A member of the folder that is a file and behind no link."""
        import os

        system, path = self.resolved(safe_path(name))
        if system.type_name == "local":
            here = PurePosixPath(self.resolved()[1])
            for part in PurePosixPath(name).parts:
                here = here / part
                demand(not os.path.islink(here), "a link in the path")
        return system.open_input_stream(path, buffer_size=PIECE)

    def json(self, name: str) -> object:
        """A whole small file."""
        with self.open(name) as f:
            tokens = Tokens(f, 1 << 30 if name == "manifest.json" else MAX_ELEMENT)
            out = tokens.value()
            demand(tokens.peek() == "", "damaged JSON")
            return out


def manifest_of(folder: Folder) -> dict:
    m = only_fields(folder.json("manifest.json"), MANIFEST, MANIFEST - OPTIONAL, "the manifest")
    demand(m["schemaVersion"] == VERSION, f"unsupported version {m['schemaVersion']}")
    scope = only_fields(m["scope"], {"kind", "conversations"}, {"kind", "conversations"}, "the scope")
    demand(m["source"].get("kind") == "user_selected" and scope["kind"] in SCOPES and m["options"].get("includeMedia") is False, "unsupported kind of export")
    for c in scope["conversations"]:
        only_fields(c, DECLARED, DECLARED, "a conversation")
        safe_path(c["metaPath"])
        safe_path(c["messagesPath"])
    demand(m["stats"].get("conversationCount") == len(scope["conversations"]), "number of conversations differs")
    return m


@dataclass
class Member(InputPartition):
    """One declared conversation."""

    uri: str
    export_id: str
    account: str
    conversation: str
    meta: str
    messages: str

    def rows(self) -> Iterator[tuple]:
        """Its messages; what differs from the manifest raises, the latest at the end."""
        folder = Folder(self.uri)
        meta = only_fields(folder.json(self.meta), META, META - {"avatarPath"}, "a conversation's meta file")
        demand(meta["schemaVersion"] == VERSION and meta["username"] == self.conversation, "meta file of another conversation")
        n, head = 0, None
        with folder.open(self.messages) as f:
            for kind, x in envelope(f):
                if kind == "message":
                    yield self.export_id, self.account, self.conversation, n, *message_row(x)
                    n += 1
                else:
                    head = x
        own = (head["schemaVersion"], head["exportId"], (head["account"] or {}).get("stableId"), (head["conversation"] or {}).get("stableId"))
        demand(own == (VERSION, self.export_id, self.account, self.conversation), "messages of another export or conversation")
        demand(n == meta["messageCount"], "number of messages differs")

    def checked(self) -> tuple[int, str | None]:
        """(messages, what is wrong)."""
        n = 0
        try:
            for _ in self.rows():
                n += 1
        except (ValueError, KeyError, TypeError, AttributeError, OSError) as e:
            return n, str(e) or type(e).__name__
        return n, None


@dataclass
class Slice(InputPartition):
    """Every ``of``-th declared conversation of an archive, from the ``number``-th on."""

    uri: str
    number: int
    of: int

    def members(self) -> list[Member]:
        return members_of(self.uri)[self.number :: self.of]


def members_of(uri: str) -> list[Member]:
    m = manifest_of(Folder(uri))
    return [Member(uri, m["exportId"], m["account"]["stableId"], c["stableId"], c["metaPath"], c["messagesPath"]) for c in m["scope"]["conversations"]]


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.what, self.mode = options.get("path"), options.get("what", "messages"), options.get("mode", "failfast")
        demand(bool(self.path), "a path is needed")
        demand(self.what in ("messages", "members") and self.mode in ("failfast", "permissive"), "unknown option")

    def partitions(self) -> list[Member | Slice | None]:
        from pyarrow import fs

        system, root = Folder(self.path).resolved()
        below = system.get_file_info(fs.FileSelector(root))
        size = next((f.size for f in below if f.base_name == "manifest.json"), None)
        if size is not None:
            return (members_of(self.path) or [None]) if size <= SLICE // 4 else self.slices(self.path, size)
        folders = [f for f in sorted(below, key=lambda f: f.base_name) if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", "."))]
        found = system.get_file_info([f"{f.path}/manifest.json" for f in folders])
        return [s for f, m in zip(folders, found, strict=True) for s in self.slices(f"{self.path.rstrip('/')}/{f.base_name}", m.size or 0)] or [None]

    def slices(self, uri: str, size: int) -> list[Slice]:
        n = min(max(-(-size // SLICE), 1), MOST_SLICES)
        return [Slice(uri, i, n) for i in range(n)]

    def read(self, part: Member | Slice | None) -> Iterator[pa.RecordBatch]:
        members = [] if part is None else part.members() if isinstance(part, Slice) else [part]
        if self.what == "members":
            yield from batches(((m.export_id, m.account, m.conversation, *m.checked()) for m in members), MEMBERS_SCHEMA)
        else:
            yield from batches((r for m in members if self.mode == "failfast" or m.checked()[1] is None for r in m.rows()), ROWS_SCHEMA)


class ChatArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chat_archive"

    def schema(self) -> str:
        return MEMBERS if self.options.get("what") == "members" else ROWS

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_archive(spark: SparkSession, path: str, what: str = "messages", mode: str = "failfast") -> DataFrame:
    spark.dataSource.register(ChatArchive)
    return spark.read.format("chat_archive").option("what", what).option("mode", mode).load(path)


def write_archive(messages: DataFrame, path: str, export_id: str, account: str, exported_at: str = "1970-01-01T00:00:00Z") -> None:
    """Write messages (conversation, ordinal, role, content, created_at_ms) as archives under ``path``, one folder a task,
    which streams its conversations in order; a repeated task replaces its folder's files."""
    n = max(2, int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = messages.where("conversation is not null").select(F.col("conversation").cast("string").alias("c"), F.col("ordinal").cast("long").alias("o"), "role", "content", F.col("created_at_ms").cast("long").alias("t"))

    def task(found):
        from pyspark import TaskContext

        folder = Folder(f"{path.rstrip('/')}/part-{TaskContext.get().partitionId():05d}")
        system, root = folder.resolved()
        head = json.dumps({"schemaVersion": VERSION, "exportId": export_id, "account": {"stableId": account}})[:-1]
        declared, out, total, n = [], None, 0, 0

        def put(name: str, x: object) -> None:
            with system.open_output_stream(f"{root}/{name}") as f:
                f.write(json.dumps(x).encode())

        def close() -> None:
            if out:
                out.write(b"]}")
                out.close()
                put(declared[-1]["metaPath"], {"schemaVersion": VERSION, "username": declared[-1]["stableId"], "displayName": "", "avatarPath": None, "isGroup": False, "exportedAt": exported_at, "messageCount": n})

        for batch in found:
            for c, _, role, content, t in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if not declared or declared[-1]["stableId"] != c:
                    close()
                    system.create_dir(f"{root}/conversations", recursive=True)
                    at = f"conversations/{len(declared):08d}"
                    declared.append({"stableId": c, "metaPath": f"{at}-meta.json", "messagesPath": f"{at}-messages.json"})
                    out, n = system.open_output_stream(f"{root}/{at}-messages.json"), 0
                    out.write(f'{head}, "conversation": {json.dumps({"stableId": c})}, "messages": ['.encode())
                m = {"type": "text", "sender": role or "unknown", "createdAt": datetime.fromtimestamp((t or 0) / 1000, UTC).isoformat(timespec="milliseconds"), "text": content}
                out.write((("," if n else "") + json.dumps(m, ensure_ascii=False)).encode("utf-8", "surrogatepass"))
                n, total = n + 1, total + 1
        close()
        if declared:
            put("manifest.json", {"schemaVersion": VERSION, "exportedAt": exported_at, "exportId": export_id, "account": {"stableId": account}, "source": {"kind": "user_selected"}, "format": {"manifestContentHash": None}, "scope": {"kind": "selected", "conversations": declared}, "filters": {}, "options": {"includeMedia": False}, "stats": {"conversationCount": len(declared), "messageCount": total, "missingCount": 0}})
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    rows.repartition(n, "c").sortWithinPartitions("c", "o", "role", "content").mapInArrow(task, "n long").agg(F.sum("n")).collect()
