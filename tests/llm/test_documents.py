import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_text, media, quality, shards, simhash
from tidemark.llm.store import P

WORDS = r"[^\x20\x09-\x0D]+"


def repeated(words):
    wins, hit = {}, set()
    for i in range(len(words) - 7):
        wins.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in wins.values():
        if len(at) > 1:
            hit.update(i + k for i in at for k in range(8))
    return len(hit)


def test_quality_counts_against_brute_force(spark):
    rnd = random.Random(1)
    values = [None, "", " \n\t", "a b c d e f g h " * 3, "x " * 200, "l\nl\n\n \nl m\n", "#*$%&|<> a", "é\xa0b\x0bc\x0cd", "w " * 5000]
    values += ["".join(rnd.choices(["a ", "b ", "c\n", "d\t", "#", " the", "\r"], k=rnd.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, rnd.choice(["en", None]), rnd.choice(["s", None]), 3) for i, t in enumerate(values)], "doc_id long, text string, lang string, source string, n_words int")
    got = {r["doc_id"]: r for r in quality.assess(df).collect()}
    for i, t in enumerate(values):
        t = t or ""
        w = re.findall(WORDS, t)
        lines = [x for x in t.split("\n") if re.search(WORDS, x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated(w))
        r = got[i]
        assert tuple(r[c] for c in quality.COUNTS) == want, (i, t)
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.assess(df.limit(0)).count() == 0
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_thresholds_follow_their_group(spark):
    rnd = random.Random(2)
    words = lambda: " ".join("w" + str(rnd.randint(0, 10**6)) for _ in range(60))
    noisy = lambda: " ".join(f"w{rnd.randint(0, 10**6)}{'#' * rnd.choice([1, 2, 2])}" for _ in range(60))
    rows = [(i, words(), "en", "clean") for i in range(150)] + [(200 + i, noisy(), "en", "code") for i in range(150)] + [(500, "### " * 40 + noisy(), "en", "clean")]
    got = {r["doc_id"]: r["kept"] for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(150)) and all(got[200 + i] for i in range(150)) and not got[500]


def test_sketches_merge_to_the_whole(spark):
    df = spark.createDataFrame([(i, " ".join(["ab"] * (i % 37 + 1)), "en", f"s{i % 3}") for i in range(300)], "doc_id long, text string, lang string, source string")
    counted = quality.with_counts(df)
    merged = quality.merge(quality.sketch(counted, ["lang", "source"]), ["lang"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, quality.sketch(counted, ["lang"]).collect()))


def brute_capacity(sizes, k):
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(k):
        new = list(best)
        for j in range(1, len(sizes) + 1):
            for i in range(j):
                if best[i] < float("inf"):
                    new[j] = min(new[j], max(best[i], sum(sizes[i:j])))
        best = new
    return best[-1]


def test_smallest_capacity():
    rnd = random.Random(3)
    for _ in range(60):
        sizes, k = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 14))], rnd.randint(1, 6)
        assert shards.smallest_capacity(sizes, k) == brute_capacity(sizes, k)


def test_hierarchy_finds_the_flat_cuts(spark, monkeypatch):
    monkeypatch.setattr(shards, "FIRST_BITS", 3)
    monkeypatch.setattr(shards, "MORE_BITS", 4)
    rnd = random.Random(4)
    groups = sorted((rnd.randint(-(1 << 63), (1 << 63) - 1), rnd.randint(1, 90)) for _ in range(700))
    cuts = shards.cut_keys(spark.createDataFrame(groups, "key long, size long"), 7)
    sizes = [s for _, s in groups]
    loads = [sum(s for k, s in groups if sum(c <= k for c in cuts) == n) for n in range(7)]
    assert max(loads) == shards.smallest_capacity(sizes, 7) and sum(loads) == sum(sizes)


@pytest.mark.parametrize("cell", [3, 4096])
def test_shards(spark, monkeypatch, cell):
    monkeypatch.setattr(shards, "CELL", cell)
    values = [None, "", "é", "hot" * 50, *["hot" * 50] * 40, *(f"text {i} " * (i % 7 + 1) for i in range(120))]
    df = spark.createDataFrame([(None if i == 2 else i // 2 if i < 8 else i, t, 1) for i, t in enumerate(values)], "doc_id long, text string, shard int")
    out = shards.assign(df, 5).collect()
    assert len(out) == len(values)
    slots, crcs, loads = {}, {}, {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        crcs.setdefault(r["text_crc32"], set()).add(r["shard"])
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in crcs.values())
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in values)
    rest = sorted(loads.values())[:-1]
    assert max(rest) < 1.4 * min(rest)  # the hot text has a shard of its own
    assert shards.assign(df.limit(0)).count() == 0


def test_png_and_archive(spark, tmp_path):
    values = [None, "", "a", "é" * 100, "twin", "twin", "z" * 100_000]
    df = spark.createDataFrame([(None if i == 2 else min(i, 5), t, b"x") for i, t in enumerate(values)], "doc_id long, text string, media binary")
    path = str(tmp_path / "m")
    media.write_media(df.repartition(3), path)
    got = media.read_media(spark, path).collect()
    want = sorted(((t or "").encode() for t in values))
    assert sorted(bytes(r["payload"])[: r["n_bytes"]] for r in got) == want
    assert all(len(r["payload"]) % 192 == 0 and len(r["payload"]) >= max(192, r["n_bytes"]) and set(bytes(r["payload"])[r["n_bytes"] :]) <= {32} for r in got)
    twins = [r for r in got if r["n_bytes"] == 4]
    assert twins[0]["media"] == twins[1]["media"] and twins[0]["feature"] == twins[1]["feature"]
    assert sum(r["doc_id"] is None for r in got) == 1
    small = spark.read.format(media.FORMAT).option("range_bytes", 200).load(path)
    assert small.count() == len(values) and small.rdd.getNumPartitions() > 3
    media.write_media(df.limit(0), str(tmp_path / "e"))
    assert media.read_media(spark, str(tmp_path / "e")).count() == 0


def test_members_are_read_again_alone(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    media.write_media(spark.createDataFrame([(i, f"t{i}") for i in range(5)], "doc_id long, text string").coalesce(1), path)
    real, calls = media.read_member, []

    def flaky(source, m):
        calls.append(m.header_offset)
        if m.filename.startswith("2/") and calls.count(m.header_offset) < 3:
            raise OSError("lost")
        return real(source, m)

    monkeypatch.setattr(media, "read_member", flaky)
    reader = media.ArchiveReader({"path": path})
    out = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert len(out) == 5 and sorted(calls.count(c) for c in set(calls)) == [1, 1, 1, 1, 3]
    with pytest.raises(ValueError, match="damaged"):
        media.decode_png(out[0]["media"][:40] + b"!" + out[0]["media"][41:])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="home">
<header><div>Site name</div></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies. Accept them, please.</div>
{open}<h1>Title &amp; more</h1><p>First para with <b>bold</b>ness, commas.<p>Second&nbsp;para; it is long enough to count, surely.<br>After break.
<ul><li>item one<li>item two</ul><div class="ad">Buy now, really, it is good.</div><!-- gone --><form><label>Mail</label><input></form><table><tr><td>c1<td>c2</table><p>Tiny.</p>{close}
<aside>Side, with, punctuation.</aside><div id="comments"><p>A reader says: good, very good text, thank you for writing it, truly.</p></div><footer>&copy; foot</footer></body></html>"""
TEXT = "Title & more First para with boldness, commas. Second para; it is long enough to count, surely. After break. item one item two c1 c2 Tiny."


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='x7'>", "</div>"), ("<section><div id=story>", "</div></section>"), ("<article><div class=body>", "</div><div class=comments><p>Me too, I liked it, thanks.</p></div></article>")])
def test_main_text(tags):
    assert html_text.main_text(PAGE.format(open=tags[0], close=tags[1])) == TEXT


def test_names_about_the_page():
    page = "<body class='has-ads'><div class='layout with-sidebar'><article class='post no-comments'><p>Main text, long enough.</p></article></div><div class=sidebar>Other, text.</div></body>"
    assert html_text.main_text(page) == "Main text, long enough."
    assert html_text.main_text("<div class='widget'><p>All there is, really.</p></div>") == "All there is, really."
    assert html_text.main_text("<article><p>Short.</p></article><article class=comment><p>A much longer reader comment, with commas, and more.</p></article>") == "Short."
    assert html_text.main_text("<div class=site-header>Site</div><div class=c><div class=post-header><h1>Head</h1></div><p>Body text, long enough to count.</p></div>") == "Head Body text, long enough to count."
    assert html_text.main_text("<article><p>a<button>press<p>b</p></article>") == "a press b"


def test_names_drop_no_whole_article():
    body = "<h1>The title</h1><p>The article's own text, long enough to count, with commas.</p><p>And a second one, as long as the first, or nearly.</p>"
    want = "The title The article's own text, long enough to count, with commas. And a second one, as long as the first, or nearly."
    side = "<div class=sidebar><p>Other, text.</p></div>"
    for page in (
        f"<div class='content-sidebar-wrap'><main>{body}</main>{side}</div>",
        f"<div class='content-sidebar-wrap'><article>{body}</article>{side}</div>",
        f"<div class='content-sidebar-wrap'><div class=post>{body}</div>{side}</div><div>&copy; 2020</div>",
        f"<div id=header-layout><div class=menu-grid>{body}</div></div>{side}",
        f"<article class='post comments-open'>{body}</article>",
        f"<article class='post tag-related'>{body}</article><div>&copy; 2020</div>",
        f"<main><div class='widget-area'><article>{body}</article></div></main><div class=related><article><p>Another one, to read.</p></article></div>",
        f"<article>{body}<div class=comments><p>{'A reader comment, longer than the text. ' * 20}</p></div></article>",
        f"<article><div class='nav-content'>{body}</div></article>",
    ):
        assert html_text.main_text(page).removesuffix(" © 2020") == want, page
    assert html_text.main_text("<article><p>A <span class='ad-hoc promo'>marked</span> word, <em class=notice>kept</em>.</p></article>") == "A marked word, kept."


def test_picked_text_outside_the_region_is_kept():
    lead, long = "A lead paragraph, with what matters most, of some length.", "<p>" + "A sentence of the body, one of many. " * 12 + "</p>"
    body = " ".join(("A sentence of the body, one of many. " * 12).split())
    for page, want in (
        (f"<div id=post><div class=intro><p>{lead}</p></div><h2>Part</h2><div class=body>{long}</div></div>", f"{lead} Part {body}"),
        (f"<div class=a><p>{lead}</p><div class=b><p>{lead}</p><div class=c>{long}</div></div></div>", f"{lead} {lead} {body}"),
        (f"<nav>Menu</nav><main><h1>Title</h1><p>{lead}</p><article>{long}</article></main><footer>Foot</footer>", f"Title {lead} {body}"),
        (f"<main><h1>Title</h1><div>By A</div><article>{long}</article><ul><li><a href=x>Next one</a></ul></main>", f"Title By A {body}"),
        (f"<article>{long}</article><article><p>{lead}</p></article>", f"{body} {lead}"),
        (f"<div class=top>Site, with a motto.</div><div class=x><h1>Title</h1><div>By A, May 3</div><div class=y>{long}{long}</div></div>", f"Title By A, May 3 {body} {body}"),
        (f"<div><a href=1>Home</a> | <a href=2>News</a></div><div>{lead}<br>{lead}</div>", f"{lead} {lead}"),
        (f"<h1>Title</h1><div><div>{long}{long}</div></div>", f"Title {body} {body}"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn><annotation>x=1</annotation></math>, and <object data=f><param name=a>file</object> or <canvas>drawing</canvas>.</p></article>", "Let x=1, and file or drawing."),
    ):
        assert html_text.main_text(page) == want, page


def test_odd_pages(spark):
    for source, want in [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>open <i>tags", "open tags"), ("<article>short</article><footer>much longer footer, here it is.</footer>", "short"), ("<article><p>a &lt;b&gt; &#233; &unknown; c</article", "a <b> é &unknown; c"), ("<script>x", ""), ("<article><p>cut off <a href='x", "cut off"), ("<p title='a>b'>x < y<br/>z", "x < y z")]:
        assert html_text.main_text(source) == want, source
    assert html_text.main_text("<article><p>" + "long word " * 200_000 + "</p></article>") == ("long word " * 200_000).strip()
    df = spark.createDataFrame([(1, "u", None, 5), (1, "u", "<p>x</p>", 6), (1, "u", "<p>x</p>", 6)], "page_id long, url string, html string, text int")
    assert sorted(r["text"] for r in html_text.extract(df).collect()) == ["", "x", "x"]
    assert html_text.extract(df.limit(0)).count() == 0


def test_given_pages(spark):
    rows = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()
    import html

    for _, h in rows:
        inner = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        inner = re.sub(r"<[^>]+>", "", re.sub(r"<(/?)(p|h1|br)[^>]*>", " ", inner))
        assert html_text.main_text(h) == " ".join(html.unescape(inner).split())


@pytest.mark.parametrize("part", ["<div>word, one. ", "<p>word, one. ", "<b>x ", "<ul><li>word ", "<article>word, one. ", "<a>w</p>", "<svg>", '<div class="sidebar">word, one. '])
def test_long_pages_take_time_in_proportion(part):
    """A page of elements that nothing closes, and one ten times as long."""
    import time

    took = []
    for n in (2_000, 20_000):
        start = time.process_time()
        html_text.main_text(part * n)
        took.append(time.process_time() - start)
    assert took[1] < 40 * max(took[0], 0.02)


def test_deep_pages():
    assert html_text.main_text("<div>" * 20_000 + "text here." + "</div>" * 20_000) == "text here."


def nameless(page):
    """The page without any element or class that tells of its part."""
    return re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", re.sub(r' class="[^"]*"', "", page))


def test_ratios_choose_where_no_name_tells(monkeypatch):
    """Given pages with all telling names taken out: the ratios find the article; without them nothing does."""
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id LIMIT 100").fetchall()
    right = lambda: sum(html_text.main_text(nameless(h)) == html_text.main_text(h) for (h,) in rows)
    assert right() >= 90
    every = type("Every", (set,), {"__contains__": lambda self, x: True})
    for paths in (set(), every()):
        monkeypatch.setattr(html_text.Page, "content_paths", lambda self, without=(), paths=paths: paths)
        assert right() == 0


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(ids, fps, threshold=4):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= threshold or (ids[i] is not None and ids[i] == ids[j]):
                a, b = find(i), find(j)
                parent[a] = b
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    best = {r: min((ids[i] for i in m if ids[i] is not None), default=None) for r, m in groups.items()}
    return [best[find(i)] for i in range(len(ids))]


def test_fingerprints_and_components(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rnd.choices(vocab, k=rnd.choice([1, 3, 4, 60, 300])) for _ in range(40)]
    values = [None, "", "  ", "UPPER Äß İ Case here now"]
    for b in base:
        values.append(" ".join(b))
        for _ in range(rnd.choice([0, 1, 4])):
            c = list(b)
            c[rnd.randrange(len(c))] = rnd.choice(vocab)
            values.append("\n".join(c).upper() if rnd.random() < 0.2 else " ".join(c))
    ids = [None if i in (3, 9) else 7 if i in (20, 21) else 1000 - i for i in range(len(values))]
    df = spark.createDataFrame([(d, t, "x") for d, t in zip(ids, values)], "doc_id long, text string, fp string")
    out = simhash.near_duplicates(df).collect()
    fps = [slow_fingerprint(t) for t in values]
    want = sorted(map(str, zip(ids, fps, brute_components(ids, fps))))
    assert sorted(str((r["doc_id"], r["fp"] % (1 << 64), r["component_id"])) for r in out) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [4, 4096])
def test_links_of_random_fingerprints(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rnd = random.Random(8)
    fps = set()
    for _ in range(60):
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 3, 40])):
            fps.add(x)
            for b in rnd.sample(range(64), rnd.choice([1, 2, 4, 5])):
                x ^= 1 << b
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "node long, fp long")
    roots = {r["u"]: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute_components(list(range(len(fps))), fps)


def test_ball_holds_all_anchors():
    fps = np.random.default_rng(3).integers(0, 1 << 64, 40, np.uint64)
    for bits in (2, 5):
        words = simhash.code(bits).astype(np.uint64)
        anchors = (words[:, None] | words[None, :] << np.uint64(32)).ravel()
        d = np.bitwise_count(fps[:, None] ^ anchors)
        for i, low, high in simhash._halves(fps.view(np.int64), bits):
            row, anchor = simhash._ball(low, high, 4)
            assert sorted(zip(row + i, anchor)) == [(r, a) for r, a in zip(*np.nonzero(d <= d.min(axis=1, keepdims=True) + 4)) if i <= r < i + len(low)]
            assert (d[np.arange(i, i + len(low)), simhash._homes(low, high)] == d[i : i + len(low)].min(axis=1)).all()


def test_rows_without_doc_id_do_not_stand_in_for_each_other(spark):
    texts = [f"{k} quite another text about {k} things, {k} times over, as {k} goes" for k in ("red", "green", "blue", "seven")]
    df = spark.createDataFrame([(None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, `x.y` int")
    out = simhash.near_duplicates(df).collect()
    fps = [slow_fingerprint(t) for t in texts]
    assert all(r["component_id"] is None for r in out)
    kept = simhash.keep_one(df).collect()
    assert len(kept) == len(set(brute_components(list(range(4)), fps)))


def test_components_of_a_chain(spark):
    edges = [(i + 1, i) for i in range(60)] + [(200, 100), (200, 150)]
    roots = {r["u"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert roots == {i: 0 for i in range(1, 61)} | {200: 100, 150: 100}


def test_keep_one_takes_one_of_repeated_rows(spark):
    text = "some words that repeat in every row of this small table"
    df = spark.createDataFrame([(3, text), (3, text), (5, text + " "), (None, text), (None, "alone among others, quite another text altogether"), (9, "")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(df).collect()) == ["3", "9", "None"]


def test_prefix_is_reserved():
    assert P.startswith("__") and F is not None
