import time
from hashlib import sha256

import duckdb
import pytest

from marketloom.llm import chat, decontamination, fingerprints, html_text, near_join, url_filter
from marketloom.llm.near_join import WordHashes, shingle_set

WORDS = [f"w{i}x" for i in range(400)]


def text_of(start, count, changed=()):
    return " ".join("zz" + str(i) if i in changed else WORDS[(start + i) % 400] for i in range(count))


def brute_classes(rows):
    hashes = WordHashes()
    sets = [set(shingle_set(t, hashes).tolist()) for _, t in rows]
    linked = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    n = len(rows)
    links = [[j for j in range(n) if j != i and linked(sets[i], sets[j])] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in links[i]:
                label[i] = label[j] = min(label[i], label[j])
    ids = {}
    for i in range(n):
        if rows[i][0] is not None:
            ids[label[i]] = min(ids.get(label[i], rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), str(ids.get(label[i])), len(links[i])) for i in range(n))


def near_rows():
    rows = [(i, text_of(0, 120, {i % 7 * 9})) for i in range(30)] + [(100 + i, text_of(200, 60)) for i in range(5)]
    rows += [(200 + i, text_of(17 * i, 40)) for i in range(20)] + [(300, None), (301, ""), (302, "one two"), (303, "One, two!")]
    return rows + [(None, text_of(200, 60)), (None, "alone in the whole wide world"), (304, "one two"), (304, "one two"), (305, text_of(3, 20_000))]


@pytest.mark.parametrize("blocks", [(256, 1024), (4, 3)])
def test_near_classes_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_join, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(near_join, "GROUP_ROWS", blocks[1])
    rows = near_rows()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, digest int, uid int").repartition(3)
    got = near_join.near_classes(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in got) == brute_classes(rows)
    kept = near_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    classes = {(r["class_id"], r["keeper"]) for r in got}
    assert kept.count() == len(classes) and {r["doc_id"] for r in kept.collect()} >= {0, 100, 300, 302, None}


def exact_pairs(sizes):
    """Texts of 5k shingles, each beside a beginning of 4k (a similarity of exactly 0.8) and one of 4k - 1 shingles of words of its own."""
    for k in sizes:
        for kind, shorter in (("at", 4 * k), ("below", 4 * k - 1)):
            words = [f"{kind}{k}n{i}" for i in range(5 * k + 4)]
            yield kind, k, " ".join(words), " ".join(words[: shorter + 4])


@pytest.mark.parametrize("k", [1, 3, 7, 40, 79, 1000, 4001])
def test_pairs_exactly_at_the_threshold_are_linked(k):
    hashes = WordHashes()
    for kind, _, whole, part in exact_pairs([k]):
        sets = [shingle_set(t, hashes) for t in (whole, part)]
        assert [len(s) for s in sets] == [5 * k, 4 * k - (kind == "below")]
        frame = near_join.pd.DataFrame({"uid": [0, 1], "shingles": [s.tobytes() for s in sets], "copies": [1, 1], "block": 0, "low": 0, "high": 0})
        assert near_join.verified(frame, 0.8)["links"].tolist() == ([1, 1] if kind == "at" else [0, 0])


def test_near_classes_at_the_threshold_against_brute_force(spark):
    rows = []
    for _, _, whole, part in exact_pairs([3, 5, 8, 12, 20, 33, 60]):
        rows += [(len(rows), whole), (len(rows) + 1, part)]
    got = near_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in got) == brute_classes(rows)
    assert sum(r["n_links"] for r in got) == len(rows) // 2


def test_near_classes_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_join.near_classes(empty).collect() == [] and near_join.keep_one_of_each(empty).collect() == []


def test_band_choice():
    for recall in (0.9, 0.999, 0.9999):
        bands, rows = near_join.choose_bands(0.8, recall)
        assert bands * rows <= near_join.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= recall


def test_leaks_against_brute_force(spark):
    items = [(1, text_of(0, 30)), (2, text_of(50, 9)), (3, "too short"), (4, None), (None, text_of(90, 12)), (5, text_of(200, 100, {50}))]
    docs = [(10, "Before " + text_of(0, 30).upper().replace(" ", ", ") + " after"), (11, text_of(0, 24)), (12, text_of(0, 31, {29})),
            (13, None), (14, ""), (15, text_of(190, 5000)), (None, text_of(88, 20)), (10, text_of(50, 9)), (10, text_of(50, 9)), (16, text_of(50, 8))]
    doc_frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, doc_key int")
    item_frame = spark.createDataFrame(items, "item_id long, text string")

    def shingles(text):
        words = (text or "").lower().replace(",", " ").split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    wanted = set()
    for d, text in docs:
        for i, item in items:
            if (s := shingles(item)) and len(s & shingles(text)) >= 0.8 * len(s):
                wanted.add((d, i, len(s), len(s & shingles(text))))
    got = decontamination.find_leaks(doc_frame, item_frame).collect()
    assert {(r["doc_id"], r["item_id"], r["item_shingles"], r["shared"]) for r in got} == wanted and len(got) == len(wanted)
    clean = decontamination.remove_leaks(doc_frame, item_frame)
    leaky = {d for d, *_ in wanted}
    assert clean.columns == doc_frame.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _ in docs if d not in leaky)
    assert decontamination.remove_leaks(doc_frame, item_frame.limit(0)).count() == len(docs)
    assert decontamination.find_leaks(doc_frame.limit(0), item_frame).collect() == []


def test_fingerprints_against_brute_force(spark):
    rows = [(i * 37 % 101, text_of(i * 3, 5 + i * 4) + " é\U0001f600") for i in range(60)] + [(500, None), (-5, ""), (None, "null id"), (501, text_of(0, 60_000))]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, guest int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(frame).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        row = got[doc_id]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == fingerprints.fingerprint(text) and row["edited_fingerprint"] == fingerprints.fingerprint(edited)
        one = fingerprints.decoded(row["fingerprint"])
        assert row["near_next"] == fingerprints.containment(one, fingerprints.decoded(fingerprints.fingerprint(following)))
        assert row["near_edited"] == fingerprints.containment(one, fingerprints.decoded(row["edited_fingerprint"]))
    assert fingerprints.compare_with_next(frame.limit(0)).collect() == []
    same = fingerprints.compare_with_next(spark.createDataFrame([(1, "abc"), (1, "abc")], "doc_id long, text string")).collect()
    assert len(same) == 2
    assert fingerprints.with_fingerprints(frame).columns[-1] == "fingerprint"


@pytest.mark.parametrize("spread", ["whole", "far", "clustered", "null"])
def test_fingerprint_ranges_follow_any_spread_of_ids(spark, spread):
    ids = {
        "whole": [-(2**63), 2**63 - 1] + [(i * 0x9E3779B97F4A7C15) % 2**64 - 2**63 for i in range(598)],
        "far": [2**62, *range(599)],
        "clustered": [10**9 * (i % 3) + i for i in range(600)],
        "null": [None if i % 3 == 0 else i for i in range(600)],
    }[spread]
    rows = [(doc_id, f"{i * 7919 % 600} " + text_of(i, 20)) for i, doc_id in enumerate(ids)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = fingerprints._in_order(frame, 4).where("guest = 0").rdd.glom().map(len).collect()
    assert sum(sizes) == 600 and max(sizes) < 300
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    wanted = []
    for i, (doc_id, text) in enumerate(order):
        edited = fingerprints.edit(text, order[(i + 1) % 600][1])
        wanted.append((doc_id, sha256(edited.encode()).hexdigest()))
    got = [(r["doc_id"], r["edited_sha256"]) for r in fingerprints.compare_with_next(frame).collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))


def test_chunks_resist_shifts():
    text = text_of(0, 3000)
    shifted = fingerprints.fingerprint("some words put before " + text)
    assert fingerprints.containment(fingerprints.decoded(fingerprints.fingerprint(text)), fingerprints.decoded(shifted)) > 0.95


def test_main_text():
    page = """<html><body><header><h1>Site</h1><nav><a href=/>x</a></nav></header><div id="cookie-notice">We use cookies, please, accept.</div>
    <div class="content"><h2>Title &amp; more</h2><p>First  para, with commas,\n and text &eacute; that is long enough.</p><div class="ad">BUY</div>
    <ul><li>one<li>two</ul><p>Second<br>para <a href=x>link</a>. 1 < 2</div><aside>side, bar</aside><form><p>name, please</p></form>
    <div class="comments"><p>nice, post, really, great</p></div><footer>foot</footer><script>var a="</p>";</script></body>"""
    assert html_text.main_text(page) == "Title & more\nFirst para, with commas, and text é that is long enough.\none\ntwo\nSecond para link. 1 < 2"
    for empty in (None, "", "<html><body></body></html>", "<script>x", "<!-- only"):
        assert html_text.main_text(empty) == ""


@pytest.mark.parametrize("outer", ["article", "main"])
@pytest.mark.parametrize("paragraphs", [1, 4, 5, 20])
def test_long_bodies_keep_titles_and_short_sections(outer, paragraphs):
    body = [f"Paragraph {i}, with commas, " + "and words " * 27 for i in range(paragraphs)]
    page = f"""<body><header><a href=/>Site</a></header><{outer}><h1><a href=/t>Title</a></h1><p>Short lead.</p>By someone
    <div class=content>{"".join(f"<p>{p}</p>" for p in body)}</div><section><h2>Note</h2><p>Few words.</p></section>
    <div class=share><a href=/s>Share</a></div></{outer}><footer>foot</footer></body>"""
    wanted = ["Title", "Short lead.", "By someone", *(p.strip() for p in body), "Note", "Few words."]
    assert html_text.main_text(page).split("\n") == wanted
    links = "<ul>" + "<li><a href=/x>Another story, with commas</a>" * 4 + "</ul>"
    if paragraphs == 20:
        assert html_text.main_text(page.replace("<section>", links + "<section>")).split("\n") == wanted


def test_html_edges(spark):
    rows = [(1, "u", None), (None, None, "<p>a</p>"), (2, "u", "<div>" * 3000 + "deep"), (2, "u", "<p>" + "word, " * 100_000)]
    frame = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract_text(frame).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"][:4] for r in got} == {"", "a", "deep", "word"}
    assert html_text.extract_text(frame.limit(0)).collect() == []


def test_url_filter(spark):
    link = '<head><link rel="canonical" href="{}"></head>'
    rows = [
        (1, "http://A.Example.NET/en/x?q#f", None), (2, "http://net/", ""), (3, "http://net", ""), (4, "https://x.example.com/de/1", ""),
        (5, "http://b.org/fr/1", link.format("http://bad.net/page")), (6, "http://b.org/xx", link.format("//bad.net/page#z")),
        (7, "http://c.org/yy", '<meta http-equiv="refresh" content="0; url=http://b.org/xx">'), (8, None, "x"), (9, "no host", "x"),
        (10, "http://d.org/a/b?x=1", '<link href="../q" rel=canonical><!-- <link rel=canonical href="http://bad.net/page"> -->'),
        (11, "http://fakenet/", ""), (11, "http://fakenet/", ""),
    ]
    frame = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string")
    judged = url_filter.judge(frame).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["by_alias"]) for r in judged}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow", False), 2: ("net", "/", "net/", "block", False), 3: ("net", "", None, "allow", False),
        4: ("x.example.com", "/de/1", "example.com/de/", "block", False), 5: ("b.org", "/fr/1", "org/fr/", "allow", False),
        6: ("b.org", "/xx", None, "block", True), 7: ("c.org", "/yy", None, "block", True), 8: ("", "", None, "allow", False),
        9: ("", "", None, "allow", False), 10: ("d.org", "/a/b", None, "allow", False), 11: ("fakenet", "/", None, "allow", False),
    }
    assert url_twin(frame) == sorted(str(tuple(r)) for r in judged)
    assert len(judged) == len(rows) and url_filter.judge(frame.limit(0)).collect() == []


def url_twin(frame):
    connection = duckdb.connect()
    connection.register("pages", frame.select("page_id", "url", "html").toPandas())
    return sorted(map(str, connection.execute(url_filter.ORACLE_SQL).fetchall()))


def test_one_page_under_several_names(spark):
    """Targets beside the name that their page goes by: ports, dot segments, empty paths, relative links."""
    names = {
        "http://bad.net": "bad.net/", "http://bad.net:80": "bad.net/", "https://BAD.net:443?q": "bad.net/?q", "https://bad.net:80/": "bad.net:80/",
        "http://bad.net:/x": "bad.net/x", "//bad.net:80/a": "bad.net/a", "../q": "{}.org/q", "./q": "{}.org/x/q", "/a/./b/../../..//c/.": "{}.org//c/",
        "..": "{}.org/", ".": "{}.org/x/", "?z=1": "{}.org/x/y?z=1", "q/..": "{}.org/x/", "...": "{}.org/x/...", "/a/.b/..c": "{}.org/a/.b/..c",
        "http://bad.net/a>b": "bad.net/a>b", "&#x20;": "{}.org/x/&", "mailto:a@bad.net": None, "#top": None, "": None,
    }
    rows = [(i, f"http://p{i}.org/x/y", f'<link title="a > b" rel="canonical" href="{target}">') for i, target in enumerate(names)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    edges = {r["a"]: r["b"] for r in url_filter.alias_edges(frame).collect()}
    assert edges == {f"p{i}.org/x/y": name.format(f"p{i}") for i, name in enumerate(names.values()) if name}
    blocked = [(100 + i, f"http://c{i}.org/x/y", f"<link rel=canonical href={t}>") for i, t in enumerate(("http://bad.net", "../../q"))]
    pages = [*rows, *blocked, (200, "http://c1.org/q", "<link rel=canonical href=//bad.net>"), (201, "http://c1.org:80/a/../q", ""), (202, "https://c1.org:80/q", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    judged = url_filter.judge(frame).collect()
    assert {r["page_id"] for r in judged if r["page_id"] >= 100 and r["by_alias"]} == {100, 101, 200, 201}
    assert url_twin(frame) == sorted(str(tuple(r)) for r in judged)


def test_markup_that_never_closes(spark):
    """Half a megabyte each: no part is scanned again and again, and what stands in an open comment, script or tag is no link."""
    link = "<link rel=canonical href=http://bad.net/>"
    hostile = ["<link '" * 70_000, "<link a='" * 60_000, "<!--" * 120_000, "<script " * 60_000, "<link " + "a" * 500_000, "<meta " + "a='b' " * 80_000 + ">",
               "<link " + "a=" * 250_000, "<link href=" + "/.." * 160_000 + "/q rel=canonical>", "<link" + " " * 500_000]
    rows = [(i, f"http://p{i}.org/x", link + text + link) for i, text in enumerate(hostile)]
    rows += [(20, "http://p20.org/x", "<script>a='<!--'</script>" + link), (21, "http://p21.org/x", "<!-- <script> -->" + link),
             (22, "http://p22.org/x", "<!-- " + link), (23, "http://p23.org/x", "<script>" + link), (24, "http://p24.org/x", '<link title="' + link)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    start = time.monotonic()
    found = {(r["a"], r["b"]) for r in url_filter.alias_edges(frame).collect()}
    assert time.monotonic() - start < 30
    assert found == {(f"p{i}.org/x", "bad.net/") for i in [*range(len(hostile)), 20, 21]} | {("p7.org/x", "p7.org/q")}


def test_alias_links_in_any_quoting(spark):
    bad = "http://bad.net/page"
    marks = [
        f'<link rel=canonical href="{bad}">', f'<link href="{bad}" rel=canonical>', f"<link rel=canonical href={bad}>", f"<link href={bad} rel=canonical>",
        f'<link rel="canonical nofollow" href={bad}>', f"<LINK HREF='{bad}' REL='nofollow  Canonical'/>", f'<link rel="canonical"href="{bad}">',
        f'<meta http-equiv=refresh content="0; url={bad}">', f'<meta content="0;url={bad}" http-equiv=refresh>', f"<meta http-equiv=refresh content=0;url={bad}>",
        f"<meta content=0;URL={bad} http-equiv=Refresh>", f"<meta http-equiv='refresh' content='3, {bad}'>",
    ]
    others = [
        f"<link rel=canonicals href={bad}>", f'<link rel=stylesheet title="x rel=canonical" href={bad}>', f"<link data-rel=canonical href={bad}>",
        f"<meta name=refresh content=0;url={bad}>", "<link rel=canonical href=>", "<link rel=canonical>",
    ]
    rows = [(i, f"http://p{i}.org/x", "<head>" + mark) for i, mark in enumerate([*marks, *others])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = sorted((r["a"], r["b"]) for r in url_filter.alias_edges(frame).collect())
    assert edges == sorted((f"p{i}.org/x", "bad.net/page") for i in range(len(marks)))
    assert {r["page_id"] for r in url_filter.judge(frame).collect() if r["verdict"] == "block"} == set(range(len(marks)))


def test_chat_threads(spark):
    rows = [
        (1, 0, "user", "First question here.\n\nA second\nparagraph."), (1, 1, "assistant", "> first  question here\n\nAn answer."),
        (1, 2, "user", "> A second paragraph.\nMore on this."), (1, 3, "user", "On Monday X wrote:\n>> First question here.\n> An answer.\n\nThanks."),
        (1, 4, "assistant", "> nobody said that\nHm."), (2, 0, "user", "> First question here.\nother conversation"),
        (None, None, None, None), (3, 1, "user", ""), (3, 1, "user", ""), (4, 0, "user", "a\n" * 5000),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = chat.linked_messages(frame).collect()
    one = {r["turn"]: (r["reply_to"], r["thread"], r["depth"], r["quotes"], r["linked"], r["text"]) for r in got if r["conv_id"] == 1}
    assert one[0] == (None, 0, 0, 0, 0, "First question here.\n\nA second\nparagraph.")
    assert one[1] == (0, 0, 1, 1, 1, "An answer.")
    assert one[2] == (0, 0, 1, 1, 1, "More on this.")
    assert one[3] == (1, 0, 2, 2, 2, "Thanks.")
    assert one[4] == (None, 4, 0, 1, 0, "Hm.")
    assert [r["turn"] for r in got if r["conv_id"] == 1] == [0, 1, 2, 3, 4] and len(got) == len(rows)
    assert [r["reply_to"] for r in got if r["conv_id"] == 2] == [None]
    assert chat.linked_messages(frame.limit(0)).collect() == []
