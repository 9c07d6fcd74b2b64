"""Wrappers of hosts with several layouts, of small hosts, and the whole template rule by brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tochi.llm import webpages

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: (r.text, r.wrapped) for r in webpages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_each_layout_has_its_wrapper(spark):
    def plain(k):
        return f"<body><div><p>Site notice everywhere</p></div><div><h1>Story {k}</h1><p>text {k} goes on</p></div></body>"

    def framed(k):
        return f"<body><section><div><h2>Report {k}</h2><p>words of {k}</p></div><div><p>Site notice everywhere</p></div></section></body>"

    rows = [(k, "http://a.example/", plain(k)) for k in range(30)] + [(100 + k, "http://a.example/", framed(k)) for k in range(20)]
    got = texts(spark, rows)
    assert all(got[k] == (f"Story {k}\ntext {k} goes on", True) for k in range(30))
    assert all(got[100 + k] == (f"Report {k}\nwords of {k}", True) for k in range(20))


def test_small_hosts_have_a_wrapper_from_three_pages(spark):
    def page(k):
        return f"<div><p>Read this first</p></div><div><p>own {k}</p></div>"

    rows = [(k, f"http://h{n}.example/", page(k)) for n, k in enumerate((0, 1, 1, 2, 2, 2, 3, 3, 3, 3)) for k in [10 * n + j for j in range((n % 4) + 1)]]
    sizes = Counter(u for _, u, _ in rows)
    for r, (text, wrapped) in zip(rows, (texts(spark, rows)[r[0]] for r in rows)):
        assert wrapped == (sizes[r[1]] >= 3)
        assert text == (f"own {r[0]}" if wrapped else f"Read this first\nown {r[0]}")


def test_a_notice_that_the_pivot_lacks_goes(spark):
    def page(k):
        notice = "" if k == 0 else "<table><tr><td>Only for readers</td></tr></table>"
        return f"<div><p>own {k}</p>{notice}</div>" + " " * (3900 - 10 * k)  # page 0 is nearest to the pivot's length

    got = texts(spark, [(k, "http://a.example/", page(k)) for k in range(20)])
    assert all(got[k] == (f"own {k}", True) for k in range(20))


def _paths(root):
    """(run, path of tags) in page order."""
    if root.tag == "#":
        yield root, ()
    for child in root.children:
        for run, path in _paths(child):
            yield run, (child.tag, *path)


def brute(rows):
    """The texts by the definition, from trees that are aligned one by one."""
    hosts = defaultdict(list)
    for page_id, url, html in rows:
        hosts[url].append((page_id, html))
    out = {}
    for pages in hosts.values():
        sizes = Counter(webpages.layout_of(h) for _, h in pages)
        top = max(sizes, key=lambda x: (sizes[x], x))
        groups = defaultdict(list)
        for page_id, html in pages:
            mine = webpages.layout_of(html)
            groups[mine if mine != top and sizes[mine] >= 10 else 0].append((page_id, html, mine))
        for group, members in groups.items():
            _, pivot = min((abs(len(h) - 4000), h) for _, h, mine in members if group or mine == top)
            aligner = webpages.Aligner(pivot)
            blocks = {}
            for page_id, html, _ in members:
                runs = [(r.slot if r.slot >= 0 else path, r.inside, r.text[0]) for r, path in _paths(aligner.align(html)) if not r.chrome]
                inside = any(r[1] for r in runs)
                blocks[page_id] = [r for r in runs if r[1] or not inside]
            different = {tuple(t for *_, t in own): own for own in blocks.values() if own}
            n, filled = Counter(), Counter()
            for own in different.values():
                n.update(set(own))
                filled.update((s, i) for s, i, _ in set(own))
            template = set()
            for (slot, inside, text), k in n.items():
                of = filled[slot, inside] if isinstance(slot, int) else len(different)
                if inside and k >= 10 and k >= 0.9 * of or not inside and (k >= 5 and k >= 0.5 * of or k == len(different) >= 3):
                    template.add((slot, text))
            for page_id, own in blocks.items():
                out[page_id] = "\n".join(t for s, _, t in own if (s, t) not in template)
    return out


def test_the_template_rule_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(260):
        host, layout = f"http://h{rng.choice([0, 0, 0, 1, 1, 2])}.example/", rng.choice([0, 0, 0, 1, 1, 2])
        body = "".join(f"<p>{rng.choice(['often', 'seen', f'own {k} {j}'])}</p>" for j in range(rng.randint(1, 6)))
        extra = rng.choice(["", "<ul><li>widget</li><li>link</li></ul>", "<h3>widget</h3>"])
        core = [f"<div><p>hello</p>{body}{extra}</div>", f"<section>{extra}<div>{body}</div><div><p>bye</p></div></section>", f"<div>x {k}</div><article><h1>title {rng.randint(0, 3)}</h1><p>read more</p>{body}</article>"][layout]
        rows.append((k, host, f"<body>{core}</body><!--{'-' * (k * 3)}x-->"))
    lengths = Counter((u, webpages.layout_of(h), len(h)) for _, u, h in rows)
    rows = [r for r in rows if lengths[r[1], webpages.layout_of(r[2]), len(r[2])] == 1]
    assert len(rows) > 200
    want, got = brute(rows), texts(spark, rows)
    assert {k: t for k, (t, _) in got.items()} == want
    plain = {r[0]: "\n".join(x.text[0] for x in webpages._runs(_finished(r[2]))) for r in rows}
    assert sum(plain[k] != want[k] for k in want) > 150  # the wrapper decides


def _finished(page):
    root = webpages.parse(page)
    webpages._finish(root, {})
    return root


def test_layouts_of_odd_pages(spark):
    assert webpages.layout_of("") == webpages.layout_of("</div></div>text") != 0
    assert webpages.layout_of("<div><div>" * 50_000) > 0
    rows = [(k, None, x) for k, x in enumerate([None, "", "</article>", "<div", "<div><section></div>t"])] * 3
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"host": F.lit(1), "layout": F.lit(2), "pages": F.lit(3)})
    got = webpages.main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars", "wrapped"] and got.count() == 15
    assert webpages.main_text(df.filter("false")).count() == 0
