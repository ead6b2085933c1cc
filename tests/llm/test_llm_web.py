from __future__ import annotations

import html
import re
import struct

import numpy as np
import zstandard
from helpers import empty_documents, odd_documents, prose

from callscope.llm import ann, langid, warc, wrapper
from callscope.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, error string, payload string"


def test_archives_round_trip(spark, tmp_path):
    long = "<p>" + "é word " * 30_000
    rows = [
        (3, "http://a.b/x", "x" * 100), (1, "http://a.b/y", "x" * 100), (7, None, "x" * 100), (1, "http://a.b/y", "x" * 100), (4, "u", "y" * 99), (5, "u\r\nX: 1 2", "y" * 99),
        (6, "u", None), (8, "u", ""), (None, "u", "é\r\n\r\nz" * 20), (9, "u", long), (10, "u", long), (2, "u", "WARC/1.1\r\n\r\n" * 20),
    ]
    frame = spark.createDataFrame([(*r, "e", "p") for r in rows], PAGES).repartition(3)
    warc.write_archives(frame, str(tmp_path / "w"))
    records = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True)
    got = warc.resolve(records).collect()
    assert len(got) == len(rows) and all(r["error"] is None for r in got)
    of = lambda r: r and int(r.removeprefix(warc.RECORD_ID) or -1)
    kinds = sorted((of(r["record_id"]), r["record_type"], of(r["refers_to"]) or 0, r["payload_bytes"]) for r in got)
    n = len(long.encode())
    assert kinds == sorted([
        (1, "response", 0, 100), (1, "response", 0, 100), (3, "revisit", 1, 100), (7, "revisit", 1, 100), (4, "response", 0, 99), (5, "response", 0, 99), (6, "response", 0, 0),
        (8, "response", 0, 0), (-1, "response", 0, 140), (9, "response", 0, n), (10, "revisit", 9, n), (2, "response", 0, 240),
    ])
    payloads = {of(r["record_id"]): r["payload"].decode() for r in records.where("record_type = 'response'").collect()}
    assert payloads[9] == long and payloads[-1] == "é\r\n\r\nz" * 20
    warc.write_archives(frame.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_damaged_archives_say_what_is_wrong():
    good = warc.record("response", "1", "u", b"payload", "d", None)
    sample = [good + bytes([i]) * 50 + prose(i, 60).encode() for i in range(200)]
    stored = zstandard.train_dictionary(2048, sample).as_bytes()
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(stored), write_checksum=True)
    lead = struct.pack("<II", warc.DICTIONARY_MAGIC, len(stored)) + stored
    packed = zstandard.ZstdCompressor().compress(stored)
    frame = pack.compress(good)
    read = lambda data: [(r.error, r.payload) for r in warc.read_records(data)]
    assert read(lead + frame + frame) == [(None, b"payload")] * 2
    assert read(struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + frame) == [(None, b"payload")]
    assert read(frame)[0][0] and read(lead + frame[:-3])[0][0] and read(lead[:50])[0][0] == "a skippable frame is cut off"
    for change, error in (
        ((b"Content-Length: 7\r", b"Content-Length: 8\r"), "wrong block digest"), ((b"WARC/1.1", b"WORC/1.1"), "no WARC head"), ((b"WARC-Date", b"WARC-Dote"), "no warc-date"),
        ((b"\r\n\r\npayload", b"\r\n\r\npayloa"), "wrong length"),
    ):
        assert read(lead + pack.compress(good.replace(*change)) + frame) == [(error, b""), (None, b"payload")]
    assert read(lead + frame + b"junkjunk")[-1][0] == "not a frame" and read(b"") == []


def test_frames_without_size_and_beside_broken_ones_are_read():
    good = warc.record("response", "1", "u", b"payload", "d", None)
    stream = zstandard.ZstdCompressor().compressobj()
    unsized = stream.compress(good) + stream.flush()
    whole = zstandard.ZstdCompressor(write_checksum=True).compress(good)
    broken = whole[:-1] + bytes([whole[-1] ^ 1])
    got = [(bool(r.error), r.payload) for r in warc.read_records(unsized + broken + whole)]
    assert got == [(False, b"payload"), (True, b""), (False, b"payload")]


def test_articles_of_the_pages(spark, sf):
    """Every page shows a document: its title and lines are the article."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op4_wrapper_extraction"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("<h1>|</h1>|<p>|</p>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_constant_nodes_are_template_and_copies_are_not(spark):
    def page(i, body, extra=""):
        return (i, f"http://site.test/{i}", f"<body><div><div>Our motto, always the same</div><div class=x>{extra}<p>{body}</p></div></div>")

    rows = [page(i, f"story &amp; {i} {prose(i, 20)}") for i in range(8)] + [page(20 + i, "the one copied story", f"<h2>part {i}</h2>") for i in range(30)]
    rows += [(90, "http://lone.test/", "<p>alone<footer>f</footer>"), (91, None, "<p>no host"), (92, "nonsense", None), (93, "http://site.test/", ""), (None, "http://site.test/z", "<p>null id")]
    frame = spark.createDataFrame([(*r, "e", "p") for r in rows], PAGES)
    got = {r["page_id"]: r["text"] for r in wrapper.extract(frame).collect()}
    assert len(got) == len(rows)
    assert got[3] == f"story & 3 {prose(3, 20)}"
    assert "the one copied story" in got[25]
    assert (got[90], got[91], got[92], got[93], got[None]) == ("alone", "no host", "", "", "null id")
    assert wrapper.extract(frame.limit(0)).count() == 0


def test_markup_that_is_no_article():
    page = """<html><head><title>t</title><script>if (a < b) "</p>"</script></head><body><header><h1>Site</h1></header><nav>menu</nav>
    <div class="cookie-notice">cookies</div><main><h1>Title</h1><p>one &eacute;&nbsp;<b>bold</b> <span class="ad">buy</span>two<ul><li>a<li>b</ul>
    <table><tr><td>c<td>d</table><form>f<button>go</button></form><aside>side</aside><div id=comments><p>first!</div></main>
    <div class="adventure">outside</div><footer>foot</footer>"""
    assert wrapper.extract_text(page, None, None) == "Title\none é bold two\na\nb\nc\nd"
    deep = "<div>" * 5000 + "<p>in</p>" + "</div>" * 5000 + "<p>after"
    assert wrapper.extract_text(deep, None, None) == "in\nafter"
    assert wrapper.extract_text("<" * 3000 + "<a href='" * 2000 + "&#x110000;<p", None, None) is not None
    assert wrapper.extract_text("<script>never closed <p>x", None, None) == ""


def test_tree_matching():
    a = ["r", "", [["p", "1", []], ["q", "2", [["x", "3", []]]], ["p", "4", []]]]
    b = ["r", "", [["q", "2", [["x", "5", []]]], ["p", "4", []], ["z", "", []]]]
    total, pairs = wrapper.match(a, b)
    assert total == 4 and sorted(pairs) == [(0, 0), (2, 1), (3, 2), (4, 3)]
    assert wrapper.match(a, ["s", "", []])[0] == 0


def test_language_of_held_out_documents(spark, sf):
    """The declared language is hidden from half of the documents; text, suffix and host must tell it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    rows = langid.with_likelihoods(docs.where("doc_id % 2 = 1"), model, "text", ["doc_id", "lang", "source"])
    rows = rows.selectExpr("doc_id", "lang", "cast(null as string) _declared", "cast(null as string) _suffix", "source _host", "_likelihoods", "_vote", "_words")
    got = langid.fuse(rows, rows).collect()
    right = [r["language"] == r["lang"] for r in got]
    assert sum(right) / len(right) >= 0.98
    assert sum(r["kept"] for r in got) >= 0.995 * len(got)


def test_language_query_keeps_documents(spark, sf):
    rows = QUERIES["op2_language_fusion"](spark, sf).collect()
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert sum(r["language"] == docs[r["doc_id"]] for r in rows) >= 0.98 * len(rows)
    assert all(r["kept"] for r in rows) and any(r["suffix"] == r["declared"] for r in rows)


def test_weak_text_is_decided_by_the_other_evidence(spark):
    texts = [(f"the and of with {prose(i, 5)} shall", "en", "en", "w.en.test") for i in range(40)] + [(f"der und das mit {prose(i, 5)} nicht", "de", "de", "w.de.test") for i in range(40)]
    docs = spark.createDataFrame(texts + [("0 1", "de", "de", "x.de.test"), ("0 1", None, None, "y.de.test"), (None, None, None, None), ("漢字" * 50, "zz", "zz", "h")], "text string, lang string, suffix string, host string")
    model = langid.train(docs)
    rows = langid.with_likelihoods(docs, model, "text", ["lang", "suffix", "host"]).selectExpr("*", "lang _declared", "suffix _suffix", "host _host").drop("lang", "suffix", "host")
    got = langid.fuse(rows, rows).collect()
    assert [r["language"] for r in got[:80]] == ["en"] * 40 + ["de"] * 40
    assert got[80]["language"] == "de" and got[80]["kept"]
    assert not got[82]["kept"] and not got[83]["kept"]
    assert langid.fuse(rows.limit(0), rows.limit(0)).count() == 0
    assert langid.train(empty_documents(spark)).shape == (4, 1 << langid.BUCKET_BITS)
    assert langid.with_likelihoods(odd_documents(spark), model, "text", ["doc_id", "score"]).count() == odd_documents(spark).count()


def brute_nearest(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-float(np.sum(vectors[q].astype(float) * v.astype(float))), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_neighbours_reach_their_recall(spark):
    sf = "/root/testdata/sf0.01"
    vectors = {r["vec_id"]: np.array(r["embedding"], np.float32) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {}
    for r in QUERIES["op3_multiprobe_ann"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(vectors, [q for q in vectors if q % 20 == 0], 20)
    assert got.keys() == want.keys()
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in dict(found)
        assert all(abs(s - float(np.sum(vectors[q].astype(float) * vectors[i].astype(float)))) < 1e-12 for i, s in found)


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 5)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(50)]
    bad = [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] * 6), (280, [float("inf")] * 6), (None, [1.0] * 6), (300, [1.0, 2.0]), (320, [])]
    rows += bad + [(100, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ann.nearest(frame, frame["vec_id"] % 20 == 0, probes=81).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    vectors = {i: np.array(v, np.float32) for i, v in rows if i is not None and (i < 200)}
    want = brute_nearest(vectors, [q for q in vectors if q % 20 == 0], 20)
    assert got.keys() == want.keys()
    for q in want:
        hit = {i for i, _ in got[q]} & {i for i, _ in want[q]}
        assert len(hit) >= 0.8 * len(want[q]) and len(got[q]) == 20
    tied = [i for i, s in got[100] if s == 1.0]
    assert tied == list(range(101, 101 + len(tied))) and len(tied) > 3
    assert ann.nearest(frame.limit(0), frame["vec_id"] % 20 == 0).count() == 0


def test_probes_come_in_order_of_cost():
    inside = np.array([0.1, 0.6, 0.45])
    order = ann.probe_order(inside, 27)
    cost = [sum(inside[i] ** 2 if s < 0 else (1 - inside[i]) ** 2 for i, s in steps) for steps in order]
    assert len(order) == len({tuple(sorted(o)) for o in order}) == 27 and np.all(np.diff(cost) >= -1e-12)


def found_and_wanted(spark, vectors):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(frame, frame["vec_id"] % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got, brute_nearest(vectors, [q for q in vectors if q % 20 == 0], 20)


def test_neighbours_among_uneven_norms(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    even = {r["vec_id"]: np.array(r["embedding"], np.float32) for r in given}
    rng = np.random.default_rng(3)
    for vectors in (
        {i: v * np.float32(10 if i == 7 else 1) for i, v in even.items()},
        {i: v * np.float32(rng.lognormal(0, 0.5)) for i, v in even.items()},
        even,
    ):
        got, want = found_and_wanted(spark, vectors)
        assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in want)
        assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.93 * sum(map(len, want.values()))


def test_neighbours_of_few_or_far_vectors_are_complete(spark):
    """What the probes miss is completed: every query has min(20, n - 1) neighbours, and the right ones."""
    rng = np.random.default_rng(4)
    vectors = {i: (rng.normal(size=64) * 10.0 ** (i % 13 - 6)).astype(np.float32) for i in range(21)}
    vectors |= {100 + i: rng.normal(size=5).astype(np.float32) for i in range(4)}
    got, want = found_and_wanted(spark, vectors)
    assert [len(got[q]) for q in (0, 20, 100)] == [20, 20, 3]
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_names_of_layouts_do_not_remove_the_article():
    body = "<p>" + prose(1, 40) + "</p>"
    text = prose(1, 40)
    for names in ("layout has-sidebar", "no-sidebar", "site-content sidebar-right", "content comments-open", "legal-notices", "widget"):
        for inner in (f"<article>{body}</article>", body):
            page = f'<body><div class="{names}">{inner}<div class="sidebar">{prose(2, 20)}</div></div><div id="comments">{prose(3, 15)}</div></body>'
            assert wrapper.extract_text(page, None, None) == text, (names, inner)
    many = f'<article><p>{prose(1, 10)}</p></article><div id="comments"><article class="comment">{prose(2, 90)}</article></div>'
    assert wrapper.extract_text(many, None, None) == prose(1, 10)
    assert wrapper.extract_text(f'<p>on <span class="ad">buy</span> it<p><span class="text-widget">{prose(4, 30)}</span>', None, None) == f"on buy it\n{prose(4, 30)}"


def test_article_elements_count_by_their_share(spark):
    teasers = "".join(f"<article>teaser {i}</article>" for i in range(3))
    page = f"<body><div class=top>{teasers}</div><div class=text><p>{prose(1, 60)}</p></div>"
    assert prose(1, 60) in wrapper.extract_text(page, None, None)
    rows = [(i, f"http://m.test/{i}", f"<body><main>Our motto</main><div><p>{prose(i, 30)}</p></div>", "e", "p") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: prose(i, 30) for i in range(8)}
