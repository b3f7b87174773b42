"""GIF columns, page text and neighbour search."""
import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from framelark.llm import gif, html, neighbours


def lzw(samples, least):
    """A plain greedy encoder that fills the table and clears it now and then."""
    rng, clear = random.Random(1), 1 << least
    out, bits, held = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, held
        bits |= code << held
        held += width
        while held >= 8:
            out.append(bits & 255)
            bits >>= 8
            held -= 8

    def fresh():
        return {bytes([i]): i for i in range(clear)}, clear + 2, least + 1

    table, after, width = fresh()
    put(clear, width)
    run = b""
    for s in samples:
        longer = run + bytes([s])
        if longer in table:
            run = longer
            continue
        put(table[run], width)
        if after < 4096:
            table[longer] = after
            after += 1
            if after > 1 << width and width < 12:
                width += 1
        elif rng.random() < 0.001:
            put(clear, width)
            table, after, width = fresh()
        run = bytes([s])
    put(table[run], width)
    put(clear + 1, width)
    return bytes(out) + (bytes([bits & 255]) if held else b"")


@pytest.mark.parametrize("least", [2, 4, 8])
@pytest.mark.parametrize("n", [1, 5, 300, 60000])
def test_lzw_streams_of_other_writers(least, n):
    rng = random.Random(n)
    for samples in ([rng.randrange(1 << least) for _ in range(n)], [i // 7 % (1 << least) for i in range(n)], [0] * n):
        assert gif.read_lzw(lzw(samples, least), least, n).tolist() == samples


def image(frames, size=(4, 4)):
    """frames: (left, top, width, height, samples, disposal, transparent, interlaced)."""
    out = b"GIF89a" + size[0].to_bytes(2, "little") + size[1].to_bytes(2, "little") + b"\x81\x00\x00" + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    for left, top, w, h, samples, disposal, clear, woven in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + (7).to_bytes(2, "little") + bytes([clear or 0, 0])
        out += b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (left, top, w, h)) + bytes([64 * woven, 2]) + gif.blocks(lzw(samples, 2))
    return out + b"\x3b"


def test_disposal_transparency_and_interlace():
    full = (0, 0, 4, 4, [1] * 16)
    size, frames = gif.decode(image([(*full, 1, None, 0), (1, 1, 2, 2, [2, 0, 0, 2], 2, 0, 0), (0, 0, 1, 1, [3], 3, None, 0), (3, 3, 1, 1, [3], 0, None, 0)]))
    a, b, c, d = (s.copy() for s in gif.compose(size, frames))
    assert frames[0].delay == 7 and a[0, 0].tolist() == [255, 0, 0, 255]
    assert b[1, 1].tolist() == [0, 255, 0, 255] and b[1, 2].tolist() == [255, 0, 0, 255]
    assert c[1, 1].tolist() == [0, 0, 0, 0] and c[0, 0].tolist() == [0, 0, 255, 255]
    assert d[0, 0].tolist() == [255, 0, 0, 255] and d[3, 3].tolist() == [0, 0, 255, 255]
    rows = [r for r in (0, 2, 1, 3) for _ in range(4)]
    woven = gif.decode(image([(0, 0, 4, 4, rows, 0, None, 1)]))[1][0].samples
    assert woven[:, 0].tolist() == [0, 1, 2, 3]


def test_payloads_come_back():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 64 * 254, 64 * 1024, 64 * 1024 + 1, 200_000):
        payload = gif.payload_of(rng.integers(0, 256, n, np.uint8).tobytes())
        stored = gif.encode(payload)
        assert len(payload) % 64 == 0 and payload and b"".join(f.samples.tobytes() for f in gif.decode(stored)[1]) == payload
    for bad in (b"", b"PNG", gif.encode(bytes(64))[:-200]):
        with pytest.raises(ValueError):
            gif.decode(bad)


def test_gif_query(spark, messy, documents, folder):
    texts = {r[0]: (r[1] or "").encode() for r in messy}
    got = gif.op7_gif_columns(spark, folder).collect()
    assert len(got) == len(messy)
    for r in got:
        payload = gif.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert sum(int(x.split(":")[1]) for x in r.feature.split(",")) >= len(payload)
    media = {r.doc_id: r.media for r in gif.store(documents).collect()}
    assert all(hashlib.sha256(media[r.doc_id]).hexdigest() == r.media_sha256 and len(media[r.doc_id]) == r.media_bytes for r in got)
    frames = gif.frame_columns(gif.store(documents)).where("doc_id = 14").collect()
    assert len(frames) > 1 and all(f.delay_cs == gif.DELAY for f in frames)


PAGE = "<html><body><header>Top</header><nav><a href=x>Menu</a></nav><div class='cookie-notice'>We use</div><main><article class='post'><h1>T &amp; t</h1><p><b>Lead\n one<br><p>long text one two three four</p><script>var x='</p>';</script><div class=ad>Buy</div><ul><li>x<li>y</ul></article><aside>side</aside></main><section id=comments><p>a very long comment of a reader that has many more words than all the article has</p></section><footer>&copy; f</footer></body></html>"


def test_page_text():
    assert html.extract(PAGE) == "T & t\nLead one\nlong text one two three four\nx\ny"
    assert html.extract("") == html.extract("<p></p>") == html.extract("<nav>a</nav>") == ""
    assert html.extract("plain & 1 < 2") == "plain & 1 < 2"
    assert html.extract("<p>cut &amp; off <b") == "cut & off"
    assert html.extract("<div>" * 3000 + "deep") == "deep"


LONG = "<h1>Title</h1>" + "<p>The article has a sentence of some length here, and one more.</p>" * 5


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "with-sidebar", "no-comments", "content social-share", "post comments-open", "page widget"])
def test_wrapper_names_keep_the_article(wrapper):
    want = html.extract(f"<body>{LONG}</body>")
    assert want.startswith("Title") and want.count("sentence") == 5
    for inner in (LONG, f"<article>{LONG}</article>"):
        page = f"<body><nav>Menu</nav><div class='{wrapper}'>{inner}<div class='sidebar'>Side text</div><div class='share'>Share</div></div><div id='comments'><p>{'a reader says so. ' * 40}</p></div></body>"
        assert html.extract(page) == want
    assert html.extract(f"<main><h1>A</h1><div class='social'>{LONG}</div></main>").count("sentence") == 5


@pytest.mark.parametrize("quote", ["'", '"'])
def test_long_attributes_are_no_text(quote):
    value = quote + "a > b " * 2000 + quote
    assert html.extract(f"<p title={value}>text</p>") == "text"
    for tag in ("script", "style", "svg", "iframe"):
        assert html.extract(f"<p>text</p><{tag} data-x={value}>var code = 1;</{tag}>") == "text"
        assert html.extract(f"<p>text</p><{tag} data-x={quote}cut>var code = 1;</{tag}>") == "text"


def test_density_decides():
    """Nothing in the names tells the boxes apart: the text is where characters for each tag are dense."""
    box = "<div>" + "".join(f"<p><a href='{k}'>go to page {k}</a></p>" for k in range(30)) + "</div>"
    body = "<div>" + "<p>A long sentence of the article that has many words and not a single link in it, on and on.</p>" * 8 + "</div>"
    got = html.extract(f"<body>{box}{body}{box}</body>")
    assert got.count("sentence") == 8 and "go to page" not in got


def test_long_pages_take_linear_time():
    """Open and unmatched elements, links within links: 40 times what took seconds when each was looked for."""
    began = time.process_time()
    n = 40_000
    assert html.extract("<div>" * n + "<p>x" * n).count("x") == n
    assert html.extract("<div>" * n + "</span></section>" * n + "y") == "y"
    assert html.extract("<i>" * n + "<a>t</a> " * n).count("t") == n
    assert time.process_time() - began < 60


def test_forms_around_the_article():
    """A form that holds the page or its article stays; others go."""
    story = "<p>" + "Some words of the story, told at length. " * 8 + "</p><p>" + "And how it went on. " * 9 + "</p>"
    want = html.extract(f"<body><article>{story}</article></body>")
    assert want.startswith("Some words") and want.endswith("went on.")
    for page in (f"<body><form id=aspnetForm><div>{story}</div></form></body>", f"<article><form>{story}</form></article>", f"<form method=post><nav>Home</nav><article>{story}</article><footer>f</footer></form>", f"<body><form><select><option>a</select><button>Search</button></form><article>{story}<form>Mail: <input><label>your name</label></form></article></body>"):
        assert html.extract(page) == want


def test_page_query(spark, tmp_path):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.text == html.extract(PAGE), r.n_chars) for r in html.op9_html_text(spark, str(tmp_path)).collect())
    n = len(html.extract(PAGE))
    assert got == [(1, True, n), (1, True, n), (2, False, 0), (3, False, 0)]
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert html.op9_html_text(spark, f"{tmp_path}/none").count() == 0


def nearest(rows, k=20):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    return {q: [i for _, i in sorted((-float((ok[q] * v).sum()), i) for i, v in ok.items() if i != q)[:k]] for q in ok if q % 20 == 0}


def search(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {}
    v = neighbours.usable(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    for r in sorted(neighbours.search(v, v.where("vec_id % 20 = 0"), share=1.0).collect()):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_neighbours_with_copies_ties_and_bad_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(i, rows[40][1]) for i in range(1000, 1200)]  # a very common vector
    rows += [(2000, None), (2001, [0.0] * 8), (2020, [float("nan")] * 8), (2040, [1.0, None] * 4), (2060, [float("inf")] * 8)]
    got, want = search(spark, tmp_path, rows), nearest(rows)
    assert got.keys() == want.keys()
    assert all([v for _, v, _ in got[q]] == want[q] and [r for r, _, _ in got[q]] == list(range(1, 21)) for q in want)


def test_few_and_no_vectors(spark, tmp_path):
    assert [v for _, v, _ in search(spark, tmp_path / "a", [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [2.0, 1.0])])[0]] == [2, 1]
    assert search(spark, tmp_path / "b", []) == {}


@pytest.mark.parametrize("clusters", [0, 50])
def test_recall_of_the_index(spark, tmp_path, clusters):
    """With the defaults, on vectors as long as those of the tables."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9000, 64))
    if clusters:
        x = 0.3 * x + rng.normal(size=(clusters, 64))[rng.integers(0, clusters, 9000)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in neighbours.op10_multi_index(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {q: set(np.argsort(-(x @ x[q]), kind="stable")[:21].tolist()) - {q} for q in range(0, 9000, 20)}
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(got[q] & w) / 20 for q, w in want.items()]) >= 0.9
    index = neighbours.MultiIndex(neighbours.fit_half(x[:, :32], 23), neighbours.fit_half(x[:, 32:], 23))
    assert neighbours.share_for(index, x, 20) < (0.2 if clusters else 0.8)


def test_walk_goes_by_falling_sum():
    rng = np.random.default_rng(3)
    index = neighbours.MultiIndex(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    index.plan(np.ones(35, np.int64), 10)
    q = rng.normal(size=6)
    near = ((index.first @ q[:3])[:, None] + (index.second @ q[3:])[None]).ravel()
    assert index.walk(q, 35) == np.argsort(-near, kind="stable").tolist()


def test_a_block_answers_while_queries_stream():
    """Memory of a block does not depend on its queries: answers come before later queries are read."""
    rng, dim, k = np.random.default_rng(4), 6, 5
    index = neighbours.MultiIndex(rng.normal(size=(3, 3)), rng.normal(size=(3, 3)))
    x = rng.normal(size=(400, dim))
    q = rng.normal(size=(5000, dim))
    names = [f.name for f in neighbours.pa.schema([(c.split()[0], neighbours.pa.null()) for c in neighbours.GRID.split(", ")])]
    kinds = neighbours.pa.schema(list(zip(names, (neighbours.pa.int64(), neighbours.pa.bool_(), neighbours.pa.binary(), neighbours.pa.int32(), neighbours.ENTRY, neighbours.pa.int64(), neighbours.pa.float64()), strict=True)))
    batch = lambda *c: neighbours.pa.RecordBatch.from_arrays([neighbours.pa.array(v, t) for v, t in zip(c, kinds.types, strict=True)], schema=kinds)
    read = []

    def batches():
        for block in (0, 1):
            mine = range(200 * block, 200 * block + 200)
            yield batch([block] * 200, [False] * 200, [x[i].tobytes() for i in mine], index.cells(x[list(mine)]), [[i] for i in mine], [None] * 200, [None] * 200)
            for at in range(0, len(q), 100):
                read.append(at)
                yield batch([block] * 100, [True] * 100, [v.tobytes() for v in q[at : at + 100]], [None] * 100, [None] * 100, range(at, at + 100), [-1e9] * 100)

    got = {}
    for n, b in enumerate(neighbours.reranked(batches(), index, dim, k)):
        assert len(read) == n + 1
        for name, far, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got.setdefault(name, []).append((far, i))
    for name in range(0, len(q), 97):
        assert [i for _, i in sorted(got[name])[: k + 1]] == np.argsort(-(x @ q[name]), kind="stable")[: k + 1].tolist()


def test_share_among_all_vectors(spark, monkeypatch, tmp_path):
    """Beyond the sample the share is measured on all vectors, and holds as many neighbours there."""
    monkeypatch.setattr(neighbours, "SAMPLE", 1000)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 16))
    rows = neighbours.usable(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"))
    got = {}
    for r in neighbours.search(rows, rows.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {i: set(np.argsort(-(x @ x[i]), kind="stable")[:21].tolist()) - {i} for i in range(0, 6000, 20)}
    assert got.keys() == want.keys() and np.mean([len(got[i] & {*sorted(w)}) / 20 for i, w in want.items()]) >= 0.9


def test_the_writer_is_greedy_lzw():
    """The codes of a plain greedy encoder, which fills the table, and repeats that shrink."""
    rng = random.Random(3)
    for samples in ([7], [0] * 640, [rng.randrange(256) for _ in range(300)], [i // 7 % 256 for i in range(3000)], list(b"to be or not to be, " * 90)):
        assert gif.write_lzw(np.array(samples, np.uint8)) == lzw(samples, 8)
    assert len(gif.encode(gif.payload_of(b"to be or not to be, " * 2000))) < 4000
    for n in (254, 255, 256, 257, 766, 767, 768, 1790, 1791, 1792, 3837, 3838, 3839, 3840, 9000):  # where widths grow, tables fill
        for alphabet in (256, 2):
            samples = np.array([rng.randrange(alphabet) for _ in range(n)], np.uint8)
            assert gif.read_lzw(gif.write_lzw(samples), 8, n).tolist() == samples.tolist()
            try:
                from PIL import Image
            except ImportError:
                continue
            import io

            payload = gif.payload_of(samples.tobytes())
            assert Image.open(io.BytesIO(gif.encode(payload))).tobytes() == payload
