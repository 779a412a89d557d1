"""Operators that SQL can't express, against plain versions."""

import random
import re
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from sparkact.llm import bpe_packing, fingerprints, html_blocks, line_join, media, ngram_join, sentencepiece_viterbi, suffix_dedup, toxicity, url_cascade

JSON, RANKS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def corpus(n=60, seed=3):
    """Short texts of few words, with copies, near copies and shared passages."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(60)]
    made = [" ".join(r.choices(words, k=r.randint(0, 160))) for _ in range(n)]
    for i in range(n // 2, n):
        kind, old = r.randrange(4), made[r.randrange(n // 2)]
        if kind == 0:
            made[i] = old
        elif kind == 1:
            cut = old.split(" ")
            for _ in range(r.randint(1, 3)):
                cut[r.randrange(len(cut))] = r.choice(words)
            made[i] = " ".join(cut)
        elif kind == 2:
            made[i] = made[i][:100] + old[20:150] + made[i][100:]
    return [(i, t) for i, t in enumerate(made)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("seed", [3, 4])
def test_passages(spark, seed):
    rows = corpus(seed=seed)
    first = {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    expected = {}
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        expected[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_report(frame(spark, rows)).collect()} == expected


@pytest.mark.parametrize("words,percent,most", [(3, 90, 1500), (5, 80, 4)])
def test_ngram_components(spark, words, percent, most):
    rows = corpus(80, 5)
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(frame(spark, rows), words, percent, most).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert any(find(i) != i for i in sets)


@pytest.mark.parametrize("percent", [80, 90])
def test_ngram_isolated_pairs(spark, percent):
    """Each document has one partner, which lacks or adds some words at its end."""
    r, rows, linked = random.Random(percent), [], 0
    for seed in range(800):
        n = r.randint(8, 200)
        more = r.randint(1, max(1, n * (100 - percent) // percent))
        text = [f"w{seed}x{k}" for k in range(n + more)]
        rows += [(2 * seed, " ".join(text[:n])), (2 * seed + 1, " ".join(text))]
    expected = {}
    for (i, a), (j, b) in zip(rows[::2], rows[1::2]):
        a, b = set(a.split()), set(b.split())
        near = 100 * len(a & b) >= percent * len(a | b)
        expected |= {i: i, j: i if near else j}
        linked += near
    assert linked > 400
    got = {x.doc_id: x.component_id for x in ngram_join.components(frame(spark, rows), 1, percent).collect()}
    assert got == expected


def test_ngram_crowded_prefixes(spark, monkeypatch):
    """Short lists as blocks, split into parts, so that links come from the search in them."""
    monkeypatch.setattr(ngram_join, "FEW", 2)
    r, rows = random.Random(6), []
    rare = [f"rare{i}" for i in range(4)]
    for i in range(60):
        base = random.Random(i // 3).choices("abcdefghijklmnopqrstuvwxyz", k=14)
        rows.append((i, " ".join([*base, r.choice(rare), *(r.choices("xyz", k=2) if i % 3 else [])])))
    sets = {i: set(t.split()) for i, t in rows}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    got = {x.doc_id: x.component_id for x in ngram_join.components(frame(spark, rows), 1, 80, most=6).collect()}
    assert got == root and len(set(root.values())) < 60


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines(spark, edits):
    r = random.Random(edits)
    base = ["".join(r.choices("ab ", k=r.randint(8, 16))) for _ in range(12)]
    lines = []
    for _ in range(90):
        x = list(r.choice(base))
        for _ in range(r.randint(0, edits + 1)):
            at, kind = r.randrange(len(x)), r.randrange(3)
            x[at : at + (kind != 0)] = r.choice("abc") if kind < 2 else ""
        lines.append("".join(x))
    rows = [(i, "\n".join(lines[9 * i : 9 * i + 9])) for i in range(10)]
    seen, expected = [], {}
    for i, t in rows:
        kept = []
        for x in t.split("\n"):
            if len(x) < 8 or not any(abs(len(x) - len(y)) <= edits and edit_distance(x, y) <= edits for y in seen):
                kept.append(x)
            if len(x) >= 8:
                seen.append(x)
        expected[i] = "\n".join(kept)
    got = {r.doc_id: r.text for r in line_join.deduplicated(frame(spark, rows), edits, least=8).collect()}
    assert got == expected


def test_lines_of_one_template(spark):
    """More lines under one key than are compared with each other, near and not near."""
    r = random.Random(8)
    form, lines = "an order of number {} was sent to the customer", []
    for _ in range(150):
        lines.append(form.format("".join(r.choices("123", k=r.choice((5, 6))))))
    lines += [form.format(x) for x in "abcdefghijklmnopqrstuvwxyz"] + [form.format(x + "y") for x in "abcdefghijklmnopqrstuvwxyz"]
    r.shuffle(lines)
    rows = [(i, "\n".join(lines[10 * i : 10 * i + 10])) for i in range(21)]
    seen, expected = [], {}
    for i, t in rows:
        kept = []
        for x in t.split("\n") if t else []:
            if not any(abs(len(x) - len(y)) <= 1 and edit_distance(x, y) <= 1 for y in seen):
                kept.append(x)
            seen.append(x)
        expected[i] = "\n".join(kept)
    got = {x.doc_id: x.text for x in line_join.deduplicated(frame(spark, rows)).collect()}
    assert got == expected and len(set(lines)) > 150


def test_fingerprints(spark):
    rows = [*corpus(30, 7), (100, "Some  TEXT ﬁne"), (101, "some text fine"), (102, "some text\nFINE ")]
    got = {r.doc_id: r for r in fingerprints.fingerprinted(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        ed = fingerprints.edited(t, following)
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == sha256(ed.encode()).hexdigest()
        assert got[i].near_next == float(fingerprints.canonical(t) == fingerprints.canonical(following))
    assert got[100].fingerprint == got[101].fingerprint == got[102].fingerprint != got[0].fingerprint


def test_fingerprint_collisions_are_told_apart(spark):
    d = frame(spark, [(1, "a"), (2, "b"), (3, "A"), (4, "c"), (5, "B")])
    same = d.selectExpr("doc_id", "'h' AS fingerprint")
    got = {r.doc_id: r["class"] for r in fingerprints.told_apart(same, d).collect()}
    assert set(got) == {2, 4, 5} and got[2] == got[5] != got[4]


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [*corpus(40, 9), (50, "word " * 3000 + "end. Next!"), (51, "a <|endoftext|> b"), (52, "two  spaces\n\n here")]
    library = Tokenizer.from_file(JSON)
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    pieces = bpe_packing.packed(frame(spark, rows), JSON, RANKS, chunk_ids=3000).collect()
    import zlib

    parts, windows = {}, {}
    for p in pieces:
        parts.setdefault(p.doc_id, []).append(p)
        windows.setdefault(p.sequence_id, []).append(p)
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    for i, own in ids.items():
        at = 0
        for p in sorted(parts[i], key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(own)
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024


def test_cuts_are_of_least_cost():
    r = np.random.default_rng(1)
    for _ in range(30):
        positions = np.cumsum([0, *r.integers(1, 7, 14)])
        costs = r.integers(0, 4, 15)
        window = 16
        best = [0] + [10**9] * 14
        for j in range(1, 15):
            for i in range(j):
                n = int(positions[j] - positions[i])
                if n <= window:
                    best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else window - n) + int(costs[j]))
        out = bpe_packing.cuts(positions, costs, window)
        total = 0
        for a, b in zip([0, *out[:-1]], out):
            n = int(positions[b] - positions[a])
            total += (0 if n & (n - 1) == 0 else window - n) + int(costs[b])
        assert out[-1] == 14 and total == best[-1]


def test_viterbi_equals_library():
    """The library's unigram encoder over the same pieces: the model file with its type changed."""
    import sentencepiece

    raw = open(PIECES, "rb").read()
    at = raw.rindex(b"\x18\x02")  # model_type of the trainer's settings: 2, byte pairs
    library = None
    for place in (m.start() for m in re.finditer(b"\x18\x02", raw)):
        if place > len(raw) - 2000:
            try:
                library = sentencepiece.SentencePieceProcessor(model_proto=raw[:place] + b"\x18\x01" + raw[place + 2 :])
                break
            except RuntimeError:
                continue
    assert library is not None and at
    pieces = sentencepiece_viterbi.Pieces(PIECES)
    for text in ["Hello world, this is a test.", "éàü 漢字 🙂 x", "", "  two  spaces ", "thorouen nderly", "a" * 60, *[t for _, t in corpus(20, 11)]]:
        mine = np.frombuffer(pieces.encode(text), "<u4").tolist()
        score = lambda ids: sum(pieces.scores.get(library.id_to_piece(i), pieces.unknown_score) for i in ids)
        theirs = library.encode(text)
        assert mine == theirs or score(mine) == pytest.approx(score(theirs)), text
        assert pieces.decode(pieces.encode(text)) == library.decode(theirs)
        runs = [i for run in pieces.search(pieces.normal(text)) for i in run]
        assert score(runs) == pytest.approx(score(mine))
    natural = sentencepiece_viterbi.Pieces(PIECES)
    for _, text in corpus(20, 12):
        list(natural.search(natural.normal(text)))
    assert 0 < natural.window <= 3 * natural.longest


def test_sentencepiece_round_trip(spark):
    rows = corpus(20, 13)
    d = frame(spark, rows)
    back = {r.doc_id: r.text for r in sentencepiece_viterbi.decoded(sentencepiece_viterbi.encoded(d, PIECES), PIECES).collect()}
    assert back == dict(rows)


def test_media_round_trip_and_resync():
    for n in (64, 128, 64 * 15, 64 * 40):
        payload = bytes(random.Random(n).randrange(256) for _ in range(n))
        stored = media.wrap(payload)
        parsed = media.parse(stored)
        assert media.unwrap(stored, parsed) == payload and not parsed["checksums_wrong"] and not parsed["skipped"]
        assert parsed["vbr"]["frames"] == len(parsed["offsets"]) - 1 and parsed["seconds"] == media.Fraction(1152 * (len(parsed["offsets"]) - 1), 48000)
    broken = stored[: parsed["offsets"][1]] + b"\xff\xfbgarbage" + stored[parsed["offsets"][1] :]
    again = media.parse(broken)
    assert again["skipped"] == 9 and len(again["offsets"]) == len(parsed["offsets"])
    at = parsed["offsets"][1] + 8
    assert media.parse(stored[:at] + b"\x77" + stored[at + 1 :])["checksums_wrong"] == 1
    assert media.parse(b"")["offsets"] == [] and media.parse(None)["seconds"] == 0


def plain_crc(bits):
    c = 0xFFFF
    for b in bits:
        top = c >> 15 ^ b
        c = c << 1 & 0xFFFF
        if top:
            c ^= 0x8005
    return c


def bits_of(data):
    return [x >> k & 1 for x in data for k in range(7, -1, -1)]


def test_media_layers_and_tables():
    """Streams of other layers and versions, put together from the format's description."""
    # Layer I, 32 kHz, 32 kbit/s, mono, protected: 48 bytes, 384 samples, 128 bits of allocation
    body = bytes([0x12] * 16) + bytes(26)
    head = bytes([0xFF, 0xFE, 0x18, 0xC0])
    one = head + plain_crc(bits_of(head[2:] + body[:16])).to_bytes(2, "big") + body
    assert len(one) == 48
    got = media.parse(one * 3)
    assert got["offsets"] == [0, 48, 96] and got["seconds"] == media.Fraction(3 * 384, 32000) and (got["checksums"], got["checksums_wrong"]) == (3, 0)
    bad = one + one[:10] + bytes([one[10] ^ 1]) + one[11:] + one
    assert media.parse(bad)["checksums_wrong"] == 1
    # Layer II, 48 kHz, 32 kbit/s, mono: 8 subbands, of which the first two are in use
    head = bytes([0xFF, 0xFC, 0x14, 0xC0])
    body = bytes([0b0001_0010, 0, 0, 0b00_01_10_00]) + bytes(86)  # 2 x 4 bits, 6 x 3 bits, then 2 x 2 bits
    covered = bits_of(body)[: 8 + 18 + 4]
    two = head + plain_crc(bits_of(head[2:]) + covered).to_bytes(2, "big") + body
    assert len(two) == 96
    got = media.parse(two * 2)
    assert got["offsets"] == [0, 96] and got["seconds"] == media.Fraction(2 * 1152, 48000) and (got["checksums"], got["checksums_wrong"]) == (2, 0)
    # MPEG-2 Layer III, 22.05 kHz, 8 kbit/s, unprotected; a VBRI table in a frame before
    frame = bytes([0xFF, 0xF3, 0x10, 0xC0]) + bytes(22)
    first = bytes([0xFF, 0xF3, 0x40, 0xC0]) + bytes(32)
    first += b"VBRI" + bytes([0, 1, 0, 0, 0, 75]) + (500).to_bytes(4, "big") + (4).to_bytes(4, "big") + bytes([0, 2, 0, 3, 0, 1, 0, 2]) + bytes([7, 9])
    first = first.ljust(104, b"\0")
    got = media.parse(first + frame * 4)
    assert got["vbr"] == {"kind": "VBRI", "bytes": 500, "frames": 4, "quality": 75, "toc": [21, 27], "frames_per_entry": 2}
    assert got["offsets"] == [0, 104, 130, 156, 182] and got["seconds"] == media.Fraction(4 * 576, 22050) and got["checksums"] == 0


def test_media_keeps_all_seek_offsets():
    stored = media.wrap(b"y" * 64 * 400)
    parsed = media.parse(stored)
    assert len(parsed["offsets"]) > 25 and media.feature(parsed).endswith("seek=" + ",".join(map(str, parsed["offsets"])))


def test_toxicity_ignores_neutral_mentions():
    r = random.Random(2)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(50)]
    texts, labels = [], []
    for i in range(400):
        w = r.choices(words, k=20)
        toxic = i % 3 == 0
        if toxic:
            w.append(r.choice(["idiot", "moron"]))
        if r.random() < (0.6 if toxic else 0.1):  # a group is named in toxic texts more often
            w.append("muslim")
        texts.append(" ".join(w))
        labels.append(int(toxic))
    fair, plain = toxicity.fit(texts, labels), toxicity.fit(texts, labels, swap_penalty=0.0)
    neutral = " ".join(words[:10])
    gap = lambda m: abs(m.score(neutral + " muslim") - m.score(neutral + " christian"))
    assert gap(fair) < gap(plain) and gap(fair) < 0.05
    assert fair.score(neutral + " idiot") > 0.5 > fair.score(neutral)


def test_html_labels_held_out_pages():
    net = html_blocks.trained(pages=500, epochs=4)
    made, right, total = html_blocks.Pages(77), 0, 0
    for _ in range(60):
        x, y = html_blocks.labelled(made.page())
        prob = net.forward(*html_blocks.padded([x]))[0][0]
        right += int(((prob >= 0.5) == (y >= 0.5)).sum())
        total += len(y)
    assert right / total > 0.97


def test_cascade_is_exact(spark):
    keys = [f"host{i}.com/{i % 7}" for i in range(3000)]
    listed = spark.createDataFrame([(k,) for k in keys[::9]], "key string")
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = url_cascade.build(listed, universe, bits_per_key=4, hashes=2)
    assert len(cascade.levels) > 1
    from pyspark.sql import functions as F

    got = {r.key for r in universe.where(cascade.member(F.col("key"))).collect()}
    assert got == set(keys[::9])
    few = url_cascade.build(listed, universe, many=3000)
    assert {r.key for r in universe.where(few.member(F.col("key"))).collect()} == set(keys[::9]) and few.levels[0].bits > 8 * len(keys[::9]) / 2


def test_urls_against_plain_rules(spark):
    r = random.Random(4)
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "b.net/")]
    rows = []
    for i in range(400):
        host = r.choice(["example.com", "www.example.com", "a.www.Example.COM", "b.net", "a.b.net", "ab.net", "notexample.com", "com", "", "x..com"])
        rows.append((i, r.choice(["http://", "https://", "", "://"]) + host + r.choice(["", "/", "/en/", "/en/a?b", "/es/x#y", "/EN/", "?q=/en/", "//en/"])))
    rows.append((400, None))
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_cascade.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    for i, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(x), v, x) for v, x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        best = max(fit, default=(0, "allow", None))
        assert got[i] == (host, path, best[2], best[1]), url


def plain_blocks(html):
    """What stands between block tags, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.now, self.hidden = [], [], 0

        def cut(self):
            if text := " ".join("".join(self.now).split()):
                self.out.append(text)
            self.now = []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")
            self.now.append(" " if tag == "br" else "")
            if tag in html_blocks.BLOCK:
                self.cut()

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style")
            if tag in html_blocks.BLOCK:
                self.cut()

        def handle_data(self, data):
            if not self.hidden:
                self.now.append(data)

    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.cut()
    return reader.out


HAND_MADE = [
    """<html><body><header><h1>The Daily</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>
    <article><h1>Rain over the hills</h1><p>It has rained &amp; rained for   days, and the river rose to its banks. Nobody had seen that before, people said.</p>
    <script>var a = "<p>no</p>";</script><p>The dam will hold, says the mayor, who has <b>seen</b> it.</p></article>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>I was there!</p></div><div class="comment"><p>So was I.</p></div></section>
    <footer><p>&copy; The Daily</p></footer></body></html>""",
    """<body><div class="cookie-banner"><p>We use cookies.</p><button>Accept</button></div><div class="ad sponsored">Buy now</div>
    <main><h1>How bread is made</h1><p>Flour and water are mixed, then left alone for a night, so that the dough can rise.</p><ul><li>flour</li><li>water</li></ul>
    <p>Bake it hot.</p></main><aside class="sidebar"><h3>Related</h3><ul><li><a href=#>More bread</a></li></ul></aside>
    <form class="newsletter"><label>Your address</label><input><button>Subscribe</button></form></body>""",
]
MAIN_TEXTS = [
    "Rain over the hills\nIt has rained & rained for days, and the river rose to its banks. Nobody had seen that before, people said.\nThe dam will hold, says the mayor, who has seen it.",
    "How bread is made\nFlour and water are mixed, then left alone for a night, so that the dough can rise.\nflour\nwater\nBake it hot.",
]


def test_html_blocks_against_a_parser():
    made = html_blocks.Pages(5)
    for page in [*HAND_MADE, *(made.page() for _ in range(40))]:
        assert [b[0] for b in html_blocks.blocks(page)] == plain_blocks(page)
    odd = "<p>one</p><svg width=1/><p>two</p><iframe src=x><p>three</p><noscript>a<p>b</noscript>c"
    assert [b[0] for b in html_blocks.blocks(odd)] == ["one", "two", "three", "c"]


def test_html_hand_made_pages():
    net = html_blocks.trained()
    parsed = [html_blocks.blocks(h) for h in HAND_MADE]
    assert [html_blocks.main_text(b, p) for b, p in zip(parsed, net.labels(parsed))] == MAIN_TEXTS


def test_html_labels_depend_on_all_words():
    start = "word " * 100
    a, b = (html_blocks.vectors([(start + end, (), 0.0)]) for end in ("alpha beta", "gamma delt"))
    assert (a != b).any()


def test_packing_ids_equal_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(JSON), bpe_packing.Ids(JSON, RANKS)
    r = random.Random(12)
    odd = ["\u00a0", "\u2003", "\u3000", "\u0085", "\x1c", "\u200b", "\ufeff", "\r\n", "\t", " ", "a", "é", "漢", "١", "Ⅷ", "²", "_", "'s", "'", "'ll", ".", "🙂", "\u0301", "\x00"]
    for _ in range(3000):
        text = "".join(r.choices(odd, k=r.randint(0, 12)))
        assert own.of(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_boundaries_are_all_sentence_ends():
    ends = np.array([False, True, False])
    positions, costs = bpe_packing.boundaries(np.array([0, 1, 1, 0, 2, 1, 0]), ends, np.array([4, 7]), 16, 2, 64)
    assert positions.tolist() == [0, 2, 3, 4, 6, 7] and costs.tolist() == [2, 2, 2, 0, 2, 0]
    positions, costs = bpe_packing.boundaries(np.zeros(10, int), ends, np.array([10]), 4, 2, 64)
    assert positions.tolist() == list(range(11)) and costs.tolist() == [2] + [64] * 9 + [0]


def test_sentencepiece_short_words_are_searched_alike():
    """The search without a window gives what the streaming one gives; a text is normalised once for its round trip."""
    pieces = sentencepiece_viterbi.Pieces(PIECES)
    r = random.Random(11)
    letters = "▁eaitñ漢🙂 xqz'.1é\x00"
    for w in ["", *("".join(r.choice(letters) for _ in range(r.randint(1, 63))) for _ in range(2000)), *list(pieces.ids)[::97]]:
        assert pieces.short(w) == [i for run in pieces.search(w) for i in run]
