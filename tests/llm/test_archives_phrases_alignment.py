"""Archives by round trip and at every cut, phrases against a count by hand, alignment against the libraries."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tochi.llm import alignment, phrases, warc

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _record(k: int, payload: bytes, level: int = 6) -> bytes:
    row = {"warc_type": "response", "record_id": f"urn:page:{k}", "target_uri": f"https://a.example/{k}", "warc_date": "2020-01-01T00:00:00Z", "refers_to": None, "payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(warc.record_bytes(row)) + packer.flush()


def _scan(data: bytes, cuts: list[int], **options) -> list[dict]:
    edges = [0, *cuts, len(data)]
    return [r for a, b in zip(edges, edges[1:]) for r in warc.scan(io.BytesIO(data), len(data), a, b, **options)]


def test_every_cut_gives_each_record_once():
    rng = random.Random(3)
    payloads = [b"", b"x", rng.randbytes(700), b"\x1f\x8b\x08\x00" * 90, zlib.compress(b"inner"), "é東".encode() * 50]
    data = b"".join(_record(k, p, level) for level in (0, 6) for k, p in enumerate(payloads))
    for cut in range(len(data) + 1):
        found = _scan(data, [cut])
        assert [r["payload"] for r in found] == payloads * 2, cut
    step = 97  # many small ranges, most of which own nothing
    assert [r["record_id"] for r in _scan(data, list(range(step, len(data), step)))] == [f"<urn:page:{k}>" for k in range(len(payloads))] * 2


def test_padding_damage_and_nested_archives():
    good = [_record(k, b"p" * 50 + bytes([k])) for k in range(4)]
    padded = good[0] + b"\0" * 40 + good[1]
    assert [r["record_id"] for r in _scan(padded, [len(good[0]) + 5])] == ["<urn:page:0>", "<urn:page:1>"]
    broken = bytearray(good[1])
    broken[-6] ^= 255  # its checksum
    data = good[0] + bytes(broken) + good[2]
    with pytest.raises(warc.Damaged):
        _scan(data, [])
    rows = _scan(data, [], permissive=True)
    assert [r.get("record_id") for r in rows] == ["<urn:page:0>", None, "<urn:page:2>"] and rows[1]["error"]
    with pytest.raises(warc.Damaged):
        _scan(data[:-9], [])
    nested = good[0] + _record(9, good[1] + good[2] + b"tail" * 9, level=0) + good[3]
    assert [r["record_id"] for r in _scan(nested, [])] == ["<urn:page:0>", "<urn:page:9>", "<urn:page:3>"]


def test_nested_members_are_told_by_their_borders(spark):
    rows = [("f", 0, 10), ("f", 10, 50), ("f", 20, 30), ("f", 50, 60)]
    assert [tuple(r) for r in warc.unchained(spark.createDataFrame(rows, "path string, start long, stop long")).collect()] == [("f", 20)]


def test_headers_of_other_writers():
    block = b"HTTP/1.1 200 OK\r\nX-Long: a\r\n b\r\n\r\nbody"
    head = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http\r\ncontent-length: %d\r\n\r\n" % len(block)
    two = list(warc.records_in((head + block + b"\r\n\r\n") * 2))
    assert [r["payload"] for r in two] == [b"body", b"body"] and two[0]["http_headers"] == {"x-long": "a b"}
    with pytest.raises(warc.Damaged):
        list(warc.records_in(head + block[:-3]))


PAGES = "page_id long, url string, html string, headers string, warc_type string"


def _by_hand(rows):
    keeper: dict[bytes, int] = {}
    for page, _, html, *_ in rows:
        payload = (html or "").encode()
        if len(payload) >= 1000 and page is not None:
            keeper[payload] = max(keeper.get(payload, page), page)
    out = []
    for page, _, html, *_ in rows:
        payload = (html or "").encode()
        response = payload not in keeper or page == keeper[payload]
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response" if response else "revisit", None if response else keeper[payload]))
    return out


def test_pages_through_archives(spark, tmp_path):
    long, exact, short = "<p>é</p>" * 300, "x" * 1000, "y" * 999
    rows = [(k, f"https://h.example/{k}", long, "a", "b") for k in range(30)]
    rows += [(100, None, None, None, None), (101, "", "", "", ""), (102, "https://x.example/a b\r\nWARC-Type: evil", exact, "", ""), (103, "u", exact, "", ""), (104, "u", short, "", ""), (105, "u", short, "", "")]
    rows += [(103, "u", exact, "", ""), (None, "u", exact, "", ""), (None, "u", "z" * 2000, "", ""), (106, "u", "w" * 3_000_000, "", ""), (-5, "u", "v" * 1500, "", ""), (-7, "u", "v" * 1500, "", "")]
    pages = spark.createDataFrame(rows, PAGES)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in warc.query(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == sorted(_by_hand(rows), key=str)
    path = f"{tmp_path}/archives"
    warc.write(warc.records_of(pages.repartition(3)), path)
    records = warc.read(spark, path, splitBytes=500)
    assert warc.unchained(records).isEmpty() and records.filter("error is not null").isEmpty()
    kept = records.filter("warc_type = 'response'").select("record_id", "payload").collect()
    by_id = {f"<urn:page:{r[0]}>": (r[2] or "") for r in rows if r[0] is not None}
    assert all(bytes(r.payload).decode() == by_id[r.record_id] for r in kept if r.record_id != "<urn:page:null>")
    assert records.filter("target_uri like '%evil'").count() == 1 and records.filter("warc_type = 'evil'").isEmpty()
    assert records.filter("warc_type = 'revisit'").count() == sum(1 for r in _by_hand(rows) if r[3] == "revisit")


def test_an_empty_table_and_appended_archives(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    warc.write(warc.records_of(none), f"{tmp_path}/none")
    assert warc.read(spark, f"{tmp_path}/none").filter("warc_type <> 'warcinfo'").isEmpty()
    one = warc.records_of(spark.createDataFrame([(1, "u", "a", "", "")], PAGES))
    warc.write(one, f"{tmp_path}/two")
    warc.write(one, f"{tmp_path}/two")
    assert warc.read(spark, f"{tmp_path}/two", ["warc_type"]).filter("warc_type = 'response'").count() == 2


DOCS = "doc_id long, text string, lang string, chunk string, freq long"


def _collocations(rows, top=phrases.TOP):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts: dict[str, Counter] = {}
    totals: Counter = Counter()
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(table)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for m in range(1, 5):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= phrases.LEAST}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, totals[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def _odd_texts():
    rng = random.Random(8)
    words = ["The", "cat", "sat", "on", "é", "École", "東京", "x y", "a b", "İ", "ß", "q" * 300]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "!", "\x0b", "\x0c"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None])) for _ in range(250)]
    rows += [("go " * 5000, "en"), ("", "en"), (None, "fr"), (None, None), (" \t\n", "de"), ("only. one! word?", "one"), ("New York City Hall. " * 40, "en"), ("New York. " * 8, "en")]
    return rows + rows[:40]


@pytest.mark.parametrize("spacing,longest", [(16, 128), (2, 5), (10**9, 3)])
def test_collocations_are_those_of_a_count_by_hand(spark, monkeypatch, spacing, longest):
    """Wherever the borders of chunks stand, nothing is lost and nothing is counted twice."""
    monkeypatch.setattr(phrases, "SPACING", spacing)
    monkeypatch.setattr(phrases, "LONGEST_CHUNK", longest)
    rows = _odd_texts()
    docs = spark.createDataFrame([(k, t, g, "c", 3) for k, (t, g) in enumerate(rows)], DOCS).repartition(3)
    got = [tuple(r) for r in phrases.collocations(docs).collect()]
    assert sorted(got) == _collocations(rows)


@pytest.mark.parametrize(("top", "rare", "most"), [(5, 64 * 30, 10**6), (2, 40, 7), (3, 10**9, 2), (1, 0, 10**6), (2000, 64 * 30, 5)])
def test_floors_and_shuffled_parts_lose_no_phrase(spark, monkeypatch, top, rare, most):
    monkeypatch.setattr(phrases, "RARE", rare)
    monkeypatch.setattr(phrases, "FEW_LANGS", 1 if rare == 40 else 50)
    rows = _odd_texts()
    docs = spark.createDataFrame([(k, t, g, "c", 3) for k, (t, g) in enumerate(rows)], DOCS)
    assert sorted(tuple(r) for r in phrases.collocations(docs, top=top, most=most).collect()) == _collocations(rows, top)


def test_chunks_own_every_word_once():
    words = phrases.Words([t.encode() for t, _ in _odd_texts() if t])
    first, own, size = phrases.chunks_of(words)
    assert own.sum() == len(words) and (first == np.cumsum(own) - own).all()
    same = words.piece[first] == words.piece[first + size - 1]
    assert same.all() and (size >= own).all() and (size <= own + phrases.OVERLAP).all()


def test_bitmaps_let_every_key_pass(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 5000)
    bits = phrases.Bitmap(phrases.marked(spark.createDataFrame([(int(k),) for k in keys], "key long")))
    assert bits.has(keys.view(np.uint64)).all()
    assert bits.has(np.random.default_rng(2).integers(0, 1 << 63, 100_000).astype(np.uint64)).mean() < 0.01


def test_no_documents_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).isEmpty()
    assert phrases.collocations(spark.createDataFrame([(1, "a b", "en", "", 0)], DOCS), top=5).isEmpty()


class Plain:
    """Groups by the libraries on whole texts and decoded bytes alone."""

    def __init__(self) -> None:
        self.a, self.b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        self.a.encode_special_tokens = True
        self.names = {i: t for t, i in self.a.get_vocab().items()}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}

    def groups(self, text):
        if not text:
            return 0, 0, [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        parts = [bytes(self.byte[c] for c in self.names[i]) for i in a], [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if any(b"".join(p) != (" " + text).encode() for p in parts):
            return 0, 0, [], []
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        both = set(ends[0]) & set(ends[1])
        cut = []
        for ids, stops in zip((a, b), ends):
            own = [[]]
            for i, e in zip(ids, stops):
                own[-1].append(i)
                if e in both:
                    own.append([])
            cut.append(own[:-1])
        return len(a), len(b), list(zip(*cut)), sorted(both)


def _mixed_texts():
    rng = random.Random(4)
    bits = [" ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "a", "the", "'s", "don't", "é", "東京", "😀", "👩‍👧", "▁", "<|endoftext|>", "<s>", "<0x0A>", "123", "...", "\x00", "\xa0", "\x1c", "\x85", "é", "x" * 300, "ไทย"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(700)]
    return [*texts, *texts[:50], None, "", " ", "\n", "the cat", "the " * 30_000, "東京" * 20_000]


@pytest.mark.parametrize("held", [20, alignment.HELD_CHUNKS])
def test_documents_are_aligned_as_by_the_libraries(spark, monkeypatch, held):
    monkeypatch.setattr(alignment, "HELD_CHUNKS", held)
    plain, texts = Plain(), _mixed_texts()
    want = [plain.groups(t) for t in texts]
    count = Counter((a[-1], b[-1]) for w in want for a, b in w[2])
    top: Counter = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, pairs string, row long")
    got = {r.doc_id: tuple(r) for r in alignment.alignment(docs, A_PATH, B_PATH).collect()}
    assert len(got) == len(texts)
    for k, (n_a, n_b, groups, _) in enumerate(want):
        ids = [(a[-1], b[-1]) for a, b in groups]
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if written else ""
        assert got[k] == (k, n_a, n_b, len(groups), len(groups), sum(count[i] == top[i[1]] for i in ids), sum(count[i] for i in ids), digest), texts[k]


def test_spans_of_groups(spark):
    plain, texts = Plain(), [t for t in _mixed_texts() if t and len(t) < 500][:200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in alignment.group_spans(docs, A_PATH, B_PATH).collect():
        _, _, groups, ends = plain.groups(texts[r.doc_id])
        assert [(g.stop, g.a, g.b) for g in r.groups] == [(e, a, b) for e, (a, b) in zip(ends, groups)]


def test_pairs_beyond_a_broadcast_are_joined_alike(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(_mixed_texts()[:300])), "doc_id long, text string")
    want = sorted(tuple(r) for r in alignment.alignment(docs, A_PATH, B_PATH).collect())
    few = alignment.with_facts
    monkeypatch.setattr(alignment, "with_facts", lambda *a: few(*a, most=10))
    assert sorted(tuple(r) for r in alignment.alignment(docs, A_PATH, B_PATH).collect()) == want


def test_no_documents_are_no_rows(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).isEmpty()
