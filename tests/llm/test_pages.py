"""Operators over pages, benchmark items and vectors."""

import gzip
import hashlib
import io
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import connect, rows
from pyarrow import fs

from sievemill.llm import decontaminate, hamming_search, html_wrapper, queries, warc
from sievemill.llm.common import new_path

PAGES = "page_id long, url string, html string"
BIG = "<p>" + "x" * 1500 + "</p>"


@pytest.fixture(scope="module")
def odd_pages(spark):
    made = [(1, "http://h.example/a b\n", BIG), (2, None, BIG), (2, None, BIG), (3, "http://h.example/", None), (4, "nohost", ""), (5, "http://h.example/", "<p>small</p>"), (6, "http://h.example/", "<p>small</p>"), (None, "http://h.example/", BIG), (7, "http://h.example/", "é" * 600)]
    return spark.createDataFrame(made, PAGES).selectExpr("*", "'x' AS payload", "'y' AS owner", "1 AS wrapper")


# --- WARC


def brute_records(made):
    size = lambda h: len((h or "").encode())
    owner = {}
    for p, _, h in made:
        if size(h) >= 1000 and p is not None:
            owner[h] = max(owner.get(h, p), p)
    copies = Counter(h for _, _, h in made)
    out = Counter()
    for p, _, h in made:
        response = size(h) < 1000 or copies[h] == 1 or owner[h] == p
        out[(p, size(h), hashlib.sha1((h or "").encode()).hexdigest(), "response" if response else "revisit", None if response else owner[h])] += 1
    return out


def test_archives(spark, odd_pages):
    got = warc.archive_pages(odd_pages, roll_bytes=3000).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r) for r in got.collect()) == brute_records([tuple(r)[:3] for r in odd_pages.collect()])
    assert warc.archive_pages(odd_pages.limit(0)).collect() == []


def test_archives_of_named_pages_and_long_payloads(spark):
    long = "<p>" + "y" * 9_000_000 + "</p>"
    made = [("a b/%", "http://h/", BIG), ("é", None, BIG), (None, None, "s"), ("long", "http://h/", long), ("None", "http://h/", "t")]
    got = warc.archive_pages(spark.createDataFrame(made, "page_id string, url string, html string")).collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got} == {("a b/%", "revisit", "é", 1507), ("é", "response", None, 1507), (None, "response", None, 1), ("long", "response", None, len(long)), ("None", "response", None, 1)}
    assert {bytes(r["payload"]).decode() for r in got if r["page_id"] == "long"} == {long}


def test_normalised_members_and_index(spark, odd_pages):
    folder = new_path(spark, "warc-test")
    raw = warc.write_archives(warc.label_records(odd_pages).coalesce(1), folder)
    store, base = fs.FileSystem.from_uri(folder)
    before = gzip.decompress(store.open_input_file(f"{base}/{raw.first()['name']}").read())
    done = warc.normalise(raw, folder).first()
    data = store.open_input_file(f"{base}/{done['name']}").read()
    index = [eval(x) for x in store.open_input_file(f"{base}/{done['name']}.idx").read().decode().splitlines()]
    members = [gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]) for x in index]
    assert b"".join(members) == before and len(members) == done["records"] == odd_pages.count()
    assert sum(x["length"] for x in index) == len(data) and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)


def test_inflate_reads_one_member_or_many_in_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    rec = [warc.build_record(i, "http://x/", bytes([65 + i]) * (50 * i), hashlib.sha1(b"").hexdigest(), None) for i in range(5)]
    for raw in (gzip.compress(b"".join(rec)), b"".join(map(gzip.compress, rec))):
        assert list(warc.split_records(warc.inflate(io.BytesIO(raw)))) == rec
    with pytest.raises(ValueError):
        list(warc.split_records(iter([rec[0][:-9]])))


# --- main text


def plain(html):
    """The generated pages' article, by pattern."""
    import html as h

    found = re.search(r"<article>(.*?)</article>", html, re.S)
    blocks = re.split(r"</?(?:h1|p)>", found[1])
    return "\n".join(x for x in (" ".join(h.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks) if x)


def test_main_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for limit in (0, 32 << 20):
        got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_wrapper.extract_pages(pages, limit).collect()}
        assert got == {r["page_id"]: (r["url"], t := plain(r["html"]), len(t)) for r in pages.collect()}


def test_main_text_odd(odd_pages):
    got = Counter((r["page_id"], r["text"]) for r in html_wrapper.extract_pages(odd_pages).collect())
    x = "x" * 1500
    assert got == Counter({(1, x): 1, (2, x): 2, (3, ""): 1, (4, ""): 1, (5, "small"): 1, (6, "small"): 1, (None, x): 1, (7, "é" * 600): 1})
    assert html_wrapper.extract_pages(odd_pages.limit(0)).collect() == []


@pytest.mark.parametrize(
    "html, text",
    [
        ("plain <b>x</b> text", "plain x text"),
        ("<div class='with-sidebar'><article><h1>T</h1><p>a&nbsp;b&amp;c<p>d</article></div>", "T\na b&c\nd"),
        ("<body><ul><li>one<li>two</ul><p>x<table><tr><td>1<td>2</table></body>", "one\ntwo\nx\n1\n2"),
        ("<header>h</header><main><section><p>Hi <a href=x>you</a>!</p></section><aside>s</aside><div id='comments'><article class='comment'>c</article></div></main>", "Hi you!"),
        ("<p>open <i>a</p></div>b<script>var x='</p>';</script><!-- c -->d<form>f</form>", "open a\nb\nd"),
        ("<article>text<br>more<pre>a\n b</pre>tail</article>", "text more\na b\ntail"),
        ("<nav>n</nav><div class='cookie-notice'>c</div><div>body</div><footer>f</footer>", "body"),
    ],
)
def test_main_text_of_snippets(html, text):
    assert html_wrapper.Extractor(None).text(html) == text


def test_deep_and_unclosed_pages(spark):
    deep = "<div>" * 3000 + "<p>far down</p><script>no</script>" + "</div>" * 3000 + "<p>end"
    made = [(i, "http://d.example/", h) for i, h in enumerate([deep, "<div>" * 5000 + "x", "<p>" * 3000 + "y", "<ul><li>" * 2000 + "z", "<!-- open", "<" * 3000, "<script>never closed"])]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract_pages(spark.createDataFrame(made, PAGES)).collect()}
    assert [got[i] for i in range(4)] == ["far down\nend", "x", "y", "z"] and got[6] == ""


def test_constant_nodes_become_template(spark):
    """Without telling tags, only the host's other pages show what is template."""
    made = [(i, f"http://same.example/{i}", f"<div><div>Best site ever</div><section><p>story {i} goes on</p><p>and {i * 7} ends</p></section><div>All about us</div></div>") for i in range(30)]
    made += [(100 + i, f"http://few.example/{i}", f"<div><div>Best site ever</div><section><p>own {i}</p></section></div>") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract_pages(spark.createDataFrame(made, PAGES).repartition(5)).collect()}
    assert all(got[i] == f"story {i} goes on\nand {i * 7} ends" for i in range(30))
    assert got[100] == "Best site ever\nown 0"


@pytest.mark.parametrize(
    "html, text",
    [
        ("<html><head><title>T</title><body><article><p>a</p></article></body></html>", "a"),
        ("<head><meta charset=utf-8><script>x</script><style>y</style><div>a</div><p>b", "a\nb"),
        ("<html><head><title>T</title>bare text<p>b</p>", "bare text\nb"),
        ("<head><template><p>no</p></template><title>T</title></head><body><p>b</p>", "b"),
        ("<body><form id='aspnetForm'><nav>n</nav><article><p>a</p><form>f</form></article></form></body>", "a"),
        ("<form class='search-page'><div><main><p>a</p></main></div></form>", "a"),
        ("<body><form method=post><div>one</div><p>two<select><option>o</select></p></form><div>x</div></body>", "one\ntwo\nx"),
        ("<div>a page of some length</div><form>find</form>", "a page of some length"),
    ],
)
def test_unclosed_heads_and_forms_around_pages(html, text):
    assert html_wrapper.Extractor(None).text(html) == text


def made_pages(spark, htmls, host="same.example"):
    return spark.createDataFrame([(i, f"http://{host}/{i}", h) for i, h in enumerate(htmls)], PAGES).repartition(5)


def texts_of(pages):
    return {r["page_id"]: r["text"] for r in html_wrapper.extract_pages(pages).collect()}


def test_template_by_share_of_pages_and_among_siblings(spark):
    menu = lambda i: "menu edited" if i == 3 else "menu"
    got = texts_of(made_pages(spark, [f"<div>{menu(i)}</div><div>story {i}</div><div>about us</div>" for i in range(40)]))
    assert all(got[i] == (f"menu edited\nstory {i}" if i == 3 else f"story {i}") for i in range(40))
    got = texts_of(made_pages(spark, [f"<article><h2>Why</h2><p>one {i}</p><p>two {i}</p><p>Write to us</p></article>" for i in range(20)]))
    assert all(got[i] == f"Why\none {i}\ntwo {i}" for i in range(20))


def test_template_of_one_layout_among_three_and_copies(spark):
    got = texts_of(made_pages(spark, [f"<div class='layout{'xyz'[i % 3]}'><div>Best site {i % 3}</div><div>story {i}</div></div>" for i in range(60)]))
    assert all(got[i] == f"story {i}" for i in range(60))
    got = texts_of(made_pages(spark, ["<article><p>one and the same</p><p>article</p></article>"] * 60))
    assert set(got.values()) == {"one and the same\narticle"}


def test_simple_tree_matching():
    tree = lambda html: html_wrapper.shape_of(html_wrapper.parse(html))
    a, b = tree("<div><h1>a</h1><p>b</p><ul><li>c</li></ul></div>"), tree("<div><p>x</p><section>y</section><ul><li>z</li><li>w</li></ul></div>")
    assert html_wrapper.match(a, b, {}) == 5  # html, div, p, ul, li
    both = html_wrapper.merged(a, b)
    assert [k.label for k in both.kids[0].kids] == ["h1", "p", "section", "ul"] and both.pages == 2


def test_wide_pages_keep_their_slots(spark):
    shape = lambda label, kids=(): html_wrapper.Shape(label, list(kids), 1, 0)
    a = [shape("x"), *(shape(f"l{i}") for i in range(3000)), shape("y")]
    b = [shape("z"), *(shape(f"l{i}") for i in (1, 700, 2500, 2999)), shape("w")]
    assert html_wrapper.pairing(a, b, {}) == [(2, 1), (701, 2), (2501, 3), (3000, 4)]
    wide = lambda i: "".join(f"<div class='k{chr(97 + (i * j) % 26)}{chr(97 + j % 26)}'><p>own {i} {j}</p></div><section><p>edge</p></section>" for j in range(150 + i))
    got = texts_of(made_pages(spark, [wide(i) for i in range(12)]))
    assert all(got[i].split("\n") == [f"own {i} {j}" for j in range(150 + i)] for i in range(12))


def test_alignment_is_exact_on_long_lists():
    """Against the plain table of simple tree matching, with and without equal ends."""

    def brute(a, b):
        if a.label.rstrip("+") != b.label.rstrip("+"):
            return 0
        table = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids):
            for j, y in enumerate(b.kids):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + brute(x, y))
        return 1 + table[-1][-1]

    rng = random.Random(4)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.randrange(7))] if depth else []
        return html_wrapper.Shape(rng.choice("abc") + rng.choice(["", "+"]), kids, 1)

    for _ in range(150):
        a, b = html_wrapper.Shape("r", [tree(2) for _ in range(rng.randrange(12))], 1), html_wrapper.Shape("r", [tree(2) for _ in range(rng.randrange(12))], 1)
        assert html_wrapper.match(a, b, {}) == brute(a, b)
        assert len(html_wrapper.preorder(html_wrapper.merged(a, b))) == len(html_wrapper.preorder(a)) + len(html_wrapper.preorder(b)) - brute(a, b)


def test_deep_and_wide_pages_are_aligned(spark):
    """No bound on depth or width: an article under 3000 divs is found, and 10,000 children are aligned."""
    story = lambda i: f"<article><p>story {i}</p><p>Write to us</p></article><div>outside</div>"
    got = texts_of(made_pages(spark, ["<div>" * 3000 + story(i) + "</div>" * 3000 for i in range(12)]))
    assert got == {i: f"story {i}" for i in range(12)}
    wide = lambda i: "<article>" + "".join(f"<h2>h {i} {j}</h2><p>t {i} {j}</p>" for j in range(5000)) + ("<figure>f</figure>" if i % 2 else "") + "<p>edge</p>" * 2 + "</article>"
    got = texts_of(made_pages(spark, [wide(i) for i in range(9)]))
    assert all(got[i].split("\n") == [x for j in range(5000) for x in (f"h {i} {j}", f"t {i} {j}")] + ["f"] * (i % 2) for i in range(9))


def test_optional_blocks_are_told_by_their_place(spark):
    """A block with one text that only some pages have is template by its place in the wrapper, not by its labels."""
    page = lambda i: f"<div><p>story {i} is told</p></div><section><p>more on {i}</p></section>" + ("<div><p>Join our club</p></div>" if i % 4 == 0 else "")
    got = texts_of(made_pages(spark, [page(i) for i in range(60)]))
    assert all(got[i] == f"story {i} is told\nmore on {i}" for i in range(60))


def test_all_shapes_of_a_host_make_its_wrapper(spark):
    """40 frequent shapes and 40 rarer ones, which alone have a block with one text: it has its own place in the wrapper
    and is template, though an other block of its labels, with a text of its own on each page, comes before it."""
    tags = lambda k: "".join(f"<{t}><p>{t} {k}</p></{t}>" for j, t in enumerate(("figure", "blockquote", "details", "address", "center", "pre")) if k >> j & 1)
    club = lambda i: "<div><p>Join our club</p></div>" if i % 2 else ""
    often = [f"<div><p>story {i} is told</p></div>{tags(i % 40)}<section><p>and there is more to say on {i}</p></section>" for i in range(400)]
    rare = [f"<div><p>story {i} is told</p></div>{tags(i % 40)}<ul><li>u {i}</li></ul><div><p>note {i}</p></div><ol><li>o {i}</li></ol>{club(i)}<section><p>and there is more to say on {i}</p></section>" for i in range(400, 560)]
    pages = made_pages(spark, often + rare)
    tree = html_wrapper.load(bytes(html_wrapper.induce_trees(html_wrapper.parse_pages(pages)).first()["tree"]))
    assert tree.pages == 560 and [(k.label, k.pages) for k in tree.kids if k.label in ("section", "ol")] == [("ol", 160), ("section", 560)]
    got = texts_of(pages)
    assert all("Join our club" not in t and f"story {i} is told" in t and (i < 400 or f"note {i}\n" in t) for i, t in got.items())


def test_rare_paths_leave_the_wrapper_small(spark):
    """Each page has a block of its own label: the merged tree holds none of them, and no page's text changes."""
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    pages = made_pages(spark, [f'<div><p>story {i} is told</p></div><section class="z{name(i)}"><p>part {i}</p></section><div><p>Join our club</p></div><table><tr><td>and this here is the end of {i}</td></tr></table>' for i in range(300)])
    tree = html_wrapper.load(bytes(html_wrapper.induce_trees(html_wrapper.parse_pages(pages)).first()["tree"]))
    assert tree.pages == 300 and [k.label for k in tree.kids] == ["div", "div", "table"] and all(s.pages == 300 for s in html_wrapper.preorder(tree))
    assert texts_of(pages) == {i: f"story {i} is told\npart {i}\nand this here is the end of {i}" for i in range(300)}


def test_region_without_telling_tags(spark, sf_dir):
    """Without article, main, class, id and role the wrapper finds the text of nearly all generated pages."""
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet").collect()
    bare = lambda html: re.sub(r"</?(article|main)\b[^>]*>|\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]*)", "", html or "")
    made = spark.createDataFrame([(r["page_id"], r["url"], bare(r["html"])) for r in pages], PAGES)
    got, alone = texts_of(made), {r["page_id"]: html_wrapper.Extractor(None).text(bare(r["html"])) for r in pages}
    right = [got[r["page_id"]] == plain(r["html"]) for r in pages]
    assert np.mean(right) >= 0.95
    assert sum(got[i] != alone[i] for i in got) > 0.9 * len(got)  # the wrapper changed them


# --- decontamination


def test_leaks_of_planted_passages(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(30)] + [(30, "too short item"), (31, None), (32, "")]
    docs, want = [], set()
    for i in range(200):
        text = [word() for _ in range(150)]
        kind, (item, passage) = i % 5, items[rng.randrange(30)]
        w = passage.split()
        if kind == 0:
            text[70:70] = [x.upper() + "," for x in w]
        if kind == 1:  # halves swapped, apart
            text[20:20], text[120:120] = w[20:], w[:20]
        if kind == 2:  # a quarter only
            text[30:30] = w[:10]
        if kind == 3:  # every fourth word replaced: no run of five is left
            text[30:30] = [word() if k % 4 == 0 else x for k, x in enumerate(w)]
        want |= {(i, item)} if kind in (0, 1) else set()
        docs.append((i, " ".join(text)))
    docs += [(900, None), (901, ""), (902, " ".join(items[3][1].split() * 50)), (903, items[4][1] + " " + items[5][1]), (904, "too short item")]
    want |= {(902, 3), (903, 4), (903, 5)}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (7, 20_000):
        got = decontaminate.find_leaks(d, b, block_items=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
        left = {r["doc_id"] for r in decontaminate.drop_leaks(d, b, block_items=block).collect()}
        assert left == {x for x, _ in docs} - {x for x, _ in want}
    assert decontaminate.find_leaks(d, b.limit(0)).collect() == [] and decontaminate.find_leaks(d.limit(0), b).collect() == []


def test_leaks_of_items_with_many_texts_and_without_blanks(spark):
    rng = random.Random(9)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20))
    texts = [[sentence() for _ in range(4)] for _ in range(6)]
    han = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(30))
    items = [(i, t) for i, own in enumerate(texts) for t in own] + [(50, han)]
    docs = [(i, " ".join(["before", *own, "after"])) for i, own in enumerate(texts)] + [(50, "前" + han + "。后"), (51, None), (52, sentence())]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (3, 20_000):
        got = decontaminate.find_leaks(d, b, block_items=block).collect()
        assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in got) == [(i, i, 1.0) for i in (*range(6), 50)]
        left = decontaminate.drop_leaks(d, b, block_items=block)
        assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {51, 52}


def brute_tiles(item, doc, k):
    """Greedy string tiling by the book: the longest unmarked match, first in item then in document, over and over."""
    a, b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i, j in itertools.product(range(len(item)), range(len(doc))):
            n = 0
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                n += 1
            best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < k:
            return sorted(out)
        a[i : i + n], b[j : j + n] = [True] * n, [True] * n
        out.append(n)


def test_tiles_are_greedy():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item, doc = rng.integers(1, 4, 14).astype(np.uint64), rng.integers(1, 4, 25).astype(np.uint64)
        h, g = decontaminate.rolling(item, 3), decontaminate.rolling(doc, 3)
        i, j = np.nonzero(h[:, None] == g[None, :])
        assert sorted(decontaminate.tile(item, doc, i, j, 3)) == brute_tiles(item.tolist(), doc.tolist(), 3)


def test_leaks_against_brute_force(spark):
    """Every document against every item by the book; repeated rows, shared ids, long texts, clashing columns."""
    rng = random.Random(12)
    item_words = lambda n: [rng.choice("abcdefghijkl") * rng.randrange(1, 3) for _ in range(n)]
    items = [(i // 2, " ".join(item_words(rng.randrange(1, 30)))) for i in range(24)] + [(40, "a b"), (None, " ".join(item_words(12)))]
    docs = []
    for i in range(60):
        words = item_words(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1].split()
            cut = rng.randrange(len(own) + 1)
            words[rng.randrange(len(words) + 1) :] = own[cut:] + item_words(2) + own[:cut]
        docs.append((i, " ".join(words)))
    docs += [docs[0], (None, items[3][1]), (70, " ".join(["ab"] * 3000 + items[5][1].split() * 400))]
    for short in (False, True):
        want = {}
        for doc, text in docs:
            for item, passage in items:
                a, b = passage.split(), text.split()
                tiles = [x for x in brute_tiles(a, b, min(5, len(a)) if short else 5)] if len(b) < 500 else None
                if tiles is None:
                    continue
                if len(a) < 5:
                    tiles = tiles[:1]
                if tiles and sum(tiles) >= 0.5 * len(a):
                    want[doc, item] = max(want.get((doc, item), 0), sum(tiles) / len(a))
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS hit", "1 AS coverage", "'y' AS _digest")
        b = spark.createDataFrame(items, "item_id long, text string")
        for block in (5, 20_000):
            got = [r for r in decontaminate.find_leaks(df, b, block_items=block, short_items=short).collect() if r["doc_id"] != 70]
            assert {(r["doc_id"], r["item_id"]): round(r["coverage"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
            assert Counter((r["doc_id"], r["item_id"]) for r in got) == Counter({k: 1 + (k[0] == 0) for k in want})
            left = decontaminate.drop_leaks(df, b, block_items=block, short_items=short)
            assert left.columns == df.columns and all(r["_digest"] == "y" for r in left.collect())
            assert Counter(r["doc_id"] for r in left.collect()) == Counter(d for d, _ in docs if d not in {d for d, _ in want} and d != 70)


def test_repeated_words_cost_linear_memory():
    import tracemalloc

    block = decontaminate.Benchmark([(1, "same " * 2000), (2, "one two three four five six seven")], 5)
    tracemalloc.start()
    got = block.holds("same " * 20_000, 0.5)
    assert got == [(1, 2000, 2000, 1, 2000)] and tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()


# --- top-k search


@pytest.mark.parametrize("shard_rows, block_queries", [(200_000, 50_000), (90, 7)])
def test_search_is_exact(spark, shard_rows, block_queries):
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2, (6, 64))
    bits = centre[rng.integers(0, 6, 400)] ^ (rng.random((400, 64)) < 0.12)
    bits[100:180] = bits[100]  # one very common code
    made = [(int(i), [float(x) - 0.5 for x in b]) for i, b in enumerate(bits)]
    df = spark.createDataFrame([*made, (900, None), (901, []), (5, made[5][1])], "vec_id long, embedding array<double>")
    codes = hamming_search.binary_codes(df).cache()
    got = hamming_search.top_k(codes, codes.filter("vec_id % 20 = 0"), 10, shard_rows, block_queries).collect()
    found = {(r["query_id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in got}
    want = {}
    for q in range(0, 400, 20):
        order = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(400) if i != q)[:10]
        want |= {(q, k + 1): (i, d) for k, (d, i) in enumerate(order)}
    assert found == want  # recall 1.0
    assert hamming_search.top_k(codes.limit(0), codes.limit(0)).collect() == []


# --- queries with SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_and_sql(spark, sf_dir, name):
    want = connect(sf_dir).execute(queries.ORACLES[name]).df()
    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(want)


@pytest.mark.parametrize(
    "html, text",
    [
        ('<article><h2 id="search-trees">Search trees</h2><p>Balanced.</p></article>', "Search trees\nBalanced."),
        ('<main><p class="lead social-history">Once.</p><div class="related">more</div></main>', "Once."),
        ('<article><p>A <a class="related">linked word</a> and <span id="ad">one more</span>.</p></article>', "A linked word and one more."),
        ('<article><p>whole</p><p title="x>abc</p></article>', "whole"),
        ('<article><p>a < b</p></article><p class="share">s</p><a href="x', "a < b"),
    ],
)
def test_text_of_articles_stays_whatever_its_names(html, text):
    assert html_wrapper.Extractor(None).text(html) == text
