"""The text operators against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tochi.llm import chat, embeddings, graph, langid, licenses, lines, minhash, packing, pieces, quality, webpages

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, c string, key string, pos string, d string, h string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] + str(rng.integers(100)) for k in rng.integers(0, len(WORDS), n))


BASE = sentence(1, 60)
NEAR = " ".join(w if k != 30 else "changed" for k, w in enumerate(BASE.split()))
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, NEAR), (4, sentence(2, 60)), (5, None), (6, ""), (7, "   \n\t"), (8, "one"), (9, "one two"), (9, "one two"),
    (None, sentence(3, 40)), (10, sentence(4, 5000)), (11, "tab\tand  double  spaces \n\n end ▁mark <|endoftext|>  x"), (12, "café naïve 日本語 \U0001f600 it's 12,5."),
    (13, "first line of five words\nFirst  line of FIVE words\nfirst line with five words\nshort one\nshort one"), (14, "first line of five good words\nanother line that stays here"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 3 else None, "s", len(t or ""), "r", "c", "k", "p", "d", "h") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def words(text):
    return (text or "").encode().split()


# ------------------------------------------------------------ op2


def brute_counts(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(8)}
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


@pytest.mark.parametrize("text", [t for _, t in TEXTS] + [(sentence(5, 9) + " ") * 3, "a b " * 30, "x\nx\n \nx|#"])
def test_base_counts(text):
    assert quality.base_counts(text or "") == brute_counts(text)


def brute_kneser_ney(texts):
    """p(symbol | four before) by definition, on plain dictionaries."""
    grams = Counter()
    for t in texts:
        t = "\x01" * 4 + t.lower()
        grams.update(t[k : k + 5] for k in range(len(t) - 4))
    counts = {5: grams}
    for n in (4, 3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    model = {}
    for n in (1, 2, 3, 4, 5):
        of = Counter(counts[n].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else None
        d = [min(max(k - (k + 1) * y * of[k + 1] / of[k] if y is not None and of[k] else 0.5 * k, 0.05 * k), 0.95 * k) for k in (1, 2, 3)]
        total, held = Counter(), Counter()
        for g, c in counts[n].items():
            total[g[:-1]] += c
            held[g[:-1]] += d[min(c, 3) - 1]
        for g, c in counts[n].items():
            low = model[g[1:]] if n > 1 else 1 / 4096
            model[g] = max(c - d[min(c, 3) - 1], 0) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * low
    return model


def test_perplexity_is_kneser_ney(spark):
    texts = [sentence(k, 30) for k in range(5)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.perplexity for r in quality.quality_rules(df).collect()}
    model = brute_kneser_ney(texts)
    for k, t in enumerate(texts):
        s = "\x01" * 4 + t.lower()
        want = math.exp(-np.mean([math.log(model[s[j : j + 5]]) for j in range(len(t))]))
        assert got[k] == pytest.approx(want, rel=2e-3)  # grams that share a hash slot


def test_quality_on_odd_rows(docs, none):
    rows = quality.quality_rules(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    assert quality.quality_rules(none).count() == 0


def test_band_rejects_labelled_junk_and_keeps_clean_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.quality_rules(df).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("not base_failed").collect()
    junk, clean = ([r for r in rows if r.quality == q] for q in (0, 1))
    assert sum(not r.kept for r in junk) >= len(junk) / 4  # none before
    assert sum(not r.kept for r in clean) <= len(clean) / 20
    assert np.mean([r.perplexity_unseen > r.perplexity for r in rows]) > 0.95  # a text adds to its own grams


@pytest.mark.parametrize("held", [1, 2000, 10**9])
def test_shards_of_a_model_score_alike(spark, held):
    texts = [sentence(k, 30) for k in range(8)] + ["".join(chr(0x4E00 + (k * 37 + j * j) % 9000) for j in range(9000)) for k in range(2)] + [None, "", "\U0001f600 \u1234\u1234"]
    texts += ["".join("e" if j % 2 else chr(0x3400 + (k * 91 + j * j) % 6000) for j in range(20_000)) for k in range(2)]  # one character in half of the places
    df = spark.createDataFrame([(k, t, "en" if k % 2 else None, k) for k, t in enumerate(texts)], "doc_id long, text string, lang string, q_n_words long")
    one, many = (quality.fit(df, whole=True, shard_grams=n) for n in (10**9, 4000))
    many.held_chars = held
    filed = many.source()
    assert one.shards == 1 and many.shards > 20
    largest = max(sum(len(keys) for keys, _ in filed._parts(quality.WHOLE, k)) for k in range(many.shards))
    assert largest < 1.2 * 4000  # no shard is larger, however many grams share a character
    a, b = ({r.doc_id: r for r in quality.score(df, m).collect()} for m in (one, many))
    assert len(a) == len(b) == len(texts)
    for k in a:
        for c in ("log_perplexity", "unseen_perplexity"):
            assert a[k][c] == b[k][c] is None or a[k][c] == pytest.approx(b[k][c], rel=1e-9)


def test_quality_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(k, sentence(k, 40), "en", k) for k in range(40)], "doc_id long, text string, lang string, q_n_words long")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() > 20 and all(r.q_n_words == r.doc_id for r in kept.collect())


def test_band_rejects_on_both_sides(spark):
    rng = np.random.default_rng(11)
    plain = [sentence(k, 60) for k in range(240)]
    notice = sentence(999, 80)
    low = [f"{notice} {k}" for k in range(24)]
    high = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 8)) for _ in range(60)) for _ in range(6)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(plain + low + high)], "doc_id long, text string, lang string").repartition(4)
    rows = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert all(rows[k].kept for k in range(240))
    assert all(rows[k].perplexity_unseen < rows[k].perplexity_low for k in range(240, 264))
    assert all(rows[k].perplexity_unseen > rows[k].perplexity_high for k in range(264, 270))
    # the limits by definition, from the perplexities themselves
    logs = np.sort([round(math.log(r.perplexity_unseen) * 1000) for r in rows.values()])
    q1, mid, q3 = np.percentile(logs, [25, 50, 75]) / 1000
    for r in rows.values():
        half = 2.0 * max(q3 - q1, 0.02) * math.sqrt(1 + 1000 / r.word_chars)
        assert math.log(r.perplexity_low) == pytest.approx(mid - half, abs=2e-3) and math.log(r.perplexity_high) == pytest.approx(mid + half, abs=2e-3)


# ------------------------------------------------------------ op4


def test_languages_are_told_on_held_out_rows(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_on_odd_rows(docs, none):
    rows = langid.identify(docs).collect()
    assert len(rows) == len(TEXTS)
    assert Counter(r.lang_pred for r in rows if r.doc_id in (5, 6, 7)) == {"und": 3}
    assert langid.keep_identified(docs).columns == docs.columns
    assert langid.identify(none).count() == 0


def test_languages_equal_brute_force_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, "".join(rng.choice(list("abcdefgh" if k % 3 else "efghxyz"), 30)) + " " + str(k % 7), f"l{k % 7}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df).collect()}
    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", 3)
    blocks = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df).collect()}
    counts, documents = defaultdict(Counter), Counter()

    def grams(t):
        found = Counter()
        for _, bucket, count in langid._buckets([t]):
            found.update(dict(zip(bucket.tolist(), count.tolist())))
        return found

    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(grams(t))
            documents[lang] += 1
    for i, t, _ in rows:
        joint = {}
        for lang, own in counts.items():
            rest = sum(own.values()) + langid.SMOOTHING * langid.BUCKETS
            joint[lang] = math.log(documents[lang] / sum(documents.values())) + sum(n * math.log((own[b] + langid.SMOOTHING) / rest) for b, n in grams(t).items())
        best = max(sorted(joint), key=joint.get)
        score = 1 / sum(math.exp(v - joint[best]) for v in joint.values())
        for got in (whole, blocks):
            assert got[i][0] == best and got[i][1] == pytest.approx(score, abs=1e-3)


def test_language_stage_rejects_texts_that_fit_no_language(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").drop("quality")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    total = {r.quality: r["count"] for r in df.join(labels, "doc_id").groupBy("quality").count().collect()}
    kept = {r.quality: r["count"] for r in langid.keep_identified(df).join(labels, "doc_id").groupBy("quality").count().collect()}
    assert kept[0] <= 0.75 * total[0]  # all were kept before
    assert kept[1] >= 0.95 * total[1]


# ------------------------------------------------------------ op3, op1, op9


def same_rows(df, con, sql):
    cols = sorted(df.columns)
    rel = con.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == cols
    assert Counter(tuple(map(str, (r[c] for c in cols))) for r in df.collect()) == Counter(tuple(str(r[names.index(c)]) for c in cols) for r in rel.fetchall())


def test_lines_licenses_and_chat_equal_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    same_rows(lines.query(spark, SF), con, lines.ORACLE_SQL)
    same_rows(licenses.query(spark, SF), con, licenses.ORACLE_SQL)
    same_rows(chat.query(spark, SF), con, chat.ORACLE_SQL)


def test_lines_on_odd_rows(docs, none):
    rows = {r.doc_id: r.text for r in lines.without_repeats(docs).collect()}
    assert rows[13] == "first line of five words\nshort one"  # a line of any length goes when it repeats
    assert rows[14] == "another line that stays here"
    assert rows[1] == BASE and rows[2] == "" and rows[3] == "" and rows[5] is None and rows[8] == "one" and rows[9] == "one two"
    assert lines.without_repeats(docs).count() == len(TEXTS) and lines.without_repeats(none).count() == 0


def test_license_texts(spark, docs):
    mit = licenses.KNOWN[0][1].upper().replace(",", " ;")
    df = spark.createDataFrame([(1, "Copyright (c) 2020 Someone\n" + mit), (2, "Text.\nreleased under the MIT licence!"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.line_licenses) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", ""), 2: (None, "MIT"), 3: (None, "")}
    assert licenses.scan(docs).count() == len(TEXTS)


@pytest.mark.parametrize("holder", ["", "Copyright (c) 2020 Someone\n", "Copyright Jane Doe 2020\nAll rights reserved.\n", "  © 1999-2020, A. Body\n\n", "(c) 2001 X. All rights reserved\n"])
def test_license_copies(spark, holder):
    import os
    import textwrap

    texts = [(name, text) for name, text in licenses.KNOWN if len(text) > 200]
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("MPL-2.0", "MPL-2.0"), ("LGPL-2.1", "LGPL-2.1")):
        if os.path.exists(f"/usr/share/common-licenses/{file}"):
            with open(f"/usr/share/common-licenses/{file}", encoding="utf-8") as f:
                texts.append((name, f.read()))
    rows, want = [], []
    for name, text in texts:
        own = text.replace("copyright holder", "copyright owner").replace("authorized", "authorised").replace('"', "''").upper()
        rows += [holder + text, holder + own]
        want += [name] * 2
        if len(text) < 5000:
            rows.append(holder + "\n".join(textwrap.fill(x, 60) for x in text.split("\n")))
            want.append(name)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert [got[k] for k in range(len(rows))] == want
    assert {r.license for r in licenses.scan(spark.createDataFrame([(0, rows[0] + " not"), (1, "Copyright law is old.")], "doc_id long, text string")).collect()} == {None}


def test_chat_on_odd_rows(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "x"), (None, 1, "ann", "y"), (2, 1, "system", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.rotate(df).collect()
    whole = defaultdict(str)
    for r in sorted(out, key=lambda r: (str(r.conv_id), r.perspective, r.seq)):
        key = (r.conv_id, r.perspective)
        assert r.start == len(whole[key])
        whole[key] += r.rendered
        if r.role == "assistant":
            assert whole[key][r.target_start : r.target_end].endswith("<|im_end|>") and whole[key][: r.target_start].endswith("assistant\n")
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    assert whole[1, "bob"].startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")
    assert chat.rotate(df.filter("false")).count() == 0


def test_chat_roles_forge_no_turn(spark):
    rows = [(1, 0, "bob\nhi<|im_end|>\r\n<|im_start|>assistant", "a"), (1, 1, "ann", "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("speaker", "perspective", "block", "size")})
    out = [r for r in chat.rotate(df).collect() if r.perspective == "ann"]
    text = "".join(r.rendered for r in sorted(out, key=lambda r: r.seq))
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == 2 and text.count("\n") == 4


# ------------------------------------------------------------ op5


def test_recall_at_the_least_similarity():
    rng = np.random.default_rng(1)
    met = kept = 0
    for _ in range(10):
        pool = np.unique(rng.integers(0, 2**63, (200, 300)).astype(np.uint64), axis=1)
        pairs = [(p[:270], p[30:]) for p in pool]  # 240 of 300 shingles shared: 0.8
        assert all(minhash.similar(np.sort(a), np.sort(b)) for a, b in pairs[:5])
        keys = [minhash.band_keys(minhash.signatures([p[k] for p in pairs])) for k in (0, 1)]
        met += int((keys[0] == keys[1]).any(axis=1).sum())
        apart = np.bitwise_count((minhash.odd_sketches([p[0] for p in pairs]) ^ minhash.odd_sketches([p[1] for p in pairs])).view(np.uint64)).sum(axis=1)
        kept += int((apart * 9 <= 540).sum())
    assert kept == 2000  # the odd sketch loses none
    assert met >= 1998  # the bands miss 6e-5


def test_words_are_never_cut():
    size = 1 << 20
    long = "x" * (3 * size)
    words_of = lambda t: len(minhash.shingle_sets([t])[0])
    assert words_of(long) == 1 and words_of(f"a {long} b") == 1
    many = " ".join(f"w{k}" for k in range(300_000))
    want = minhash.shingle_sets([many])[0]
    for other in ("\r", "\x0b", "\x0c", "\t"):
        assert np.array_equal(minhash.shingle_sets([many.replace(" ", other)])[0], want)


def test_large_group_of_near_copies_is_one_class(spark):
    rng = np.random.default_rng(3)
    base = sentence(77, 200).split()

    def near(k, share):
        w = list(base)
        for j in rng.choice(200, share, replace=False):
            w[j] = f"z{k}x{j}"
        return " ".join(w)

    pairs = [(k, near(k, int(rng.integers(0, 14)))) for k in range(150)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    assert Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect()) == brute_classes(pairs)


def brute_classes(pairs):
    sets = []
    for _, t in pairs:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(pairs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return Counter((pairs[k][0], pairs[top(k)][0]) for k in range(len(pairs)))


def test_near_duplicates_equal_brute_force(spark, docs, none):
    pairs = sorted(TEXTS, key=lambda x: (x[0] is None, x[0] or 0))
    rows = minhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.class_id) for r in rows) == brute_classes(pairs)
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    assert Counter(r.doc_id for r in kept.collect())[9] == 1
    less = [r.doc_id for r in minhash.keep_first(docs, blank_alone=False).collect()]
    assert len(less) == kept.count() - 2 and 5 in less and not {6, 7} & set(less)  # null, empty and blank are one
    assert minhash.near_duplicates(none).count() == 0
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert Counter((r.doc_id, r.class_id) for r in minhash.query(spark, SF).collect()) == brute_classes(real)


def test_weighted_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    e = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    x, y = rng.integers(1, 6, len(e)), rng.integers(1, 6, len(e))
    s = minhash.signatures([e, e], [x, y])
    assert abs((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.12


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 8), (6, 6), (None, 1)], "a long, b long")
    got = dict(graph.components(links).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}


# ------------------------------------------------------------ op6


def test_wrapper_induction(spark):
    def page(k):
        return f"<html><body><div><p>Same on all pages</p></div><div><h1>Title {k} &amp; more</h1><p>Body <b>text</b> {k}<br>goes on<p>Second {k}</div><div class='comments'><p>reader {k}</p></div><nav>menu</nav></body></html>"

    rows = [(k, f"http://Host.example/{k}", page(k)) for k in range(12)] + [(90, None, None), (91, "x", ""), (92, "http://a/", "<article><p>a<p>a</article>tail"), (92, "http://a/", "<article><p>a<p>a</article>tail"), (93, "http://b/", "1 < 2 <!-- x --> <script>no</script>&lt;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = defaultdict(list)
    for r in webpages.main_text(df).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    assert all(got[k] == [f"Title {k} & more\nBody text {k} goes on\nSecond {k}"] for k in range(12))
    assert got[90] == [""] and got[91] == [""] and got[92] == ["a\na"] * 2 and got[93] == ["1 < 2 <"]
    assert webpages.main_text(df.filter("false")).count() == 0


def test_copies_are_no_template_and_rare_texts_stay(spark):
    def page(k):
        body = "".join(f"<p>copied {j}</p>" for j in range(4)) if k < 85 else "".join(f"<p>own {k} {j}</p>" for j in range(4))
        return f"<div><p>Notice</p></div><div>{body}</div>"

    def marked(k):
        return f"<div>x {k}</div><article><p>Read more every day</p><p>story {k}</p></article>"

    rows = [(k, "http://a.example/x", page(k)) for k in range(100)] + [(200 + k, "http://b.example/x", marked(k)) for k in range(12)]
    got = {r.page_id: r.text for r in webpages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "\n".join(f"copied {j}" for j in range(4)) for k in range(85))
    assert all(got[k] == "\n".join(f"own {k} {j}" for j in range(4)) for k in range(85, 100))
    assert all(got[200 + k] == f"story {k}" for k in range(12))


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<p>text</p><nav>menu</nav>" + "</div>" * 3000
    a = webpages.Aligner(deep)
    runs = list(webpages._runs(a.align(deep)))
    assert [(r.text[0], r.chrome) for r in runs] == [("text", False), ("menu", True)] and all(r.slot >= 0 for r in runs)
    other = list(webpages._runs(a.align("<div>" * 2999 + "<p>else</p>")))
    assert [r.text[0] for r in other] == ["else"]
    long = list(webpages._runs(webpages.parse("<p>a b</i></p>" * 50_000)))
    assert len(long) == 50_000


def test_alignment_equals_brute_force():
    from functools import lru_cache

    rng = np.random.default_rng(4)

    def html(depth):
        if depth == 0 or rng.random() < 0.3:
            return "t"
        return "".join(f"<{t}>{html(depth - 1)}</{t}>" for t in rng.choice(["div", "ul", "section"], rng.integers(1, 4)))

    def best(a, b):  # by definition: every order-keeping pairing of the children
        if a.tag != b.tag:
            return 0
        x, y = a.children, b.children

        @lru_cache(None)
        def pairing(i, j):
            if i == len(x) or j == len(y):
                return 0
            return max(pairing(i + 1, j), pairing(i, j + 1), best(x[i], y[j]) + pairing(i + 1, j + 1) if x[i].tag == y[j].tag else 0)

        return 1 + pairing(0, 0)

    for _ in range(150):
        a = webpages.Aligner(html(4))
        tree = a.tree(html(4))
        assert a._size(tree, a.pivot) == best(tree, a.pivot)
        a._match(tree, a.pivot)
        slots = [r.slot for r in webpages._runs(tree) if r.slot >= 0]
        assert slots == sorted(set(slots))


def test_tree_matching_size():
    a = webpages.Aligner("<div><p>x</p><ul><li>1</li><li>2</li></ul></div>")
    tree = a.tree("<div><h2>t</h2><p>y</p><ul><li>1</li></ul></div>")
    assert a._size(tree, a.pivot) == 7  # root, div, p, its text, ul, li, its text


# ------------------------------------------------------------ op7, op8


def test_pieces_equal_the_library(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for i, t in TEXTS:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, pieces.digests(docs, path).collect())) == want
    assert pieces.digests(none, path).count() == 0


def test_packing_is_exact_and_gapless(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    want = Counter()
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for _, parts in by_seq.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(by_seq) == list(range(len(by_seq)))
    ids_of = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in TEXTS}
    for i, _ in TEXTS:
        want[i] += len(ids_of[i])
    got = Counter()
    for r in rows:
        own = ids_of[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids_of[r.doc_id])
        got[r.doc_id] += r.length
    assert got == want
    assert packing.pack(none, path).count() == 0


def test_hilbert_neighbours_touch():
    n = 1 << 12
    grid = np.stack(np.meshgrid(*[np.arange(4)] * packing.DIMENSIONS, indexing="ij"), -1).reshape(-1, packing.DIMENSIONS)
    keys = packing.hilbert(grid)
    order = grid[np.argsort(keys)]
    assert len(set(keys.tolist())) == len(grid) and keys.max() == len(grid) - 1 < n
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# ------------------------------------------------------------ op10


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    near = base[:30] + 0.02 * rng.standard_normal((30, 16))
    vectors = [list(map(float, v)) for v in np.vstack([base, near, near[:5]])]
    rows = [(k, v, k % 30 % 2) for k, v in enumerate(vectors)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [None] + [1.0] * 15, 1), (203, [float("nan")] * 16, 1), (204, [float("inf")] * 16, 0), (205, vectors[0], None), (206, [1.0, 2.0], 0), (207, [], 0), (None, vectors[0], 0), (0, vectors[0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit("clash"))
    usable = [(i, np.array(v), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    parent = list(range(len(usable)))
    links = Counter()

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(usable)):
        for b in range(a):
            (_, u, s), (_, v, t) = usable[a], usable[b]
            if s == t and len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.98:
                links[a] += 1
                links[b] += 1
                parent[max(top(a), top(b))] = min(top(a), top(b))
    got = Counter((r.vec_id, r.n_links) for r in embeddings.near_embeddings(df).collect())
    want = Counter((usable[k][0], links[k]) for k in range(len(usable)))
    want += Counter((i, 0) for i, v, lab in rows if not any(x[0] == i and x[0] is not None for x in usable) and i is not None)
    assert got == want
    comps = {r.vec_id: r.component_id for r in embeddings.near_embeddings(df).collect() if r.vec_id is not None}
    least = defaultdict(lambda: 10**9)
    for k, (i, _, _) in enumerate(usable):
        if i is not None:
            least[top(k)] = min(least[top(k)], i)
    assert all(comps[i] == least[top(k)] for k, (i, _, _) in enumerate(usable) if i is not None)
    assert embeddings.near_embeddings(df.filter("false")).count() == 0


def test_dense_cells_are_dealt_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    close = centre + 0.003 * rng.standard_normal((300, 16))
    far = rng.standard_normal((40, 16))
    df = spark.createDataFrame([(k, list(map(float, v)), 1) for k, v in enumerate(np.vstack([close, far]))], "vec_id long, embedding array<double>, label int")
    whole = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_embeddings(df).collect()}
    monkeypatch.setattr(embeddings, "BLOCK_CLASSES", 20)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_embeddings(df).collect()} == whole
    assert all(whole[k] == (299, 0, k == 0) for k in range(300)) and all(whole[k] == (0, k, True) for k in range(300, 340))


def test_recall_at_the_least_cosine():
    rng = np.random.default_rng(6)
    for cosine, least in ((0.98, 0.995), (0.985, 0.999)):
        x = rng.standard_normal((3000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal((3000, 64))
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        a, b = embeddings.cells(x), embeddings.cells(y)
        met = ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any(axis=(1, 2))
        assert met.mean() >= least


def test_huge_and_tiny_vectors_link(spark):
    v = np.random.default_rng(8).standard_normal(16)
    rows = [(k, [float(x) for x in v * s], 1) for k, s in enumerate((1.0, 1e300, 1e-300, -1.0))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3)}


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, (200, 8))
    point = embeddings.nearest_e8(x)
    steps = embeddings.minimal_vectors()
    assert len(steps) == 240
    own = ((x - point) ** 2).sum(axis=1)
    assert (own[:, None] <= ((x[:, None] - point[:, None] - steps[None]) ** 2).sum(axis=2) + 1e-9).all()


# ------------------------------------------------------------ pipeline


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] == counts[3] > counts[4] > 0
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == counts[4]
