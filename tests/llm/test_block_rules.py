import random
import time

from cairn.llm import block_rules as br
from cairn.llm import queries

LONG = "The quick fox of the land is in a big house and it was there for the whole day of work with them on and on again"


def test_structure_and_references():
    page = f"""<!DOCTYPE html><html><head><title>No</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
    <header>Site name</header><div class="ad">Buy the best of the things in the world and be happy with it for all of the time that is left to you, now</div>
    <article><header><h1>Title &amp;  more</h1></header><p><b>{LONG}&nbsp;&copy;<br>x</b><p>Short.</p><!-- <p>gone</p> --><style>p{{}}</style><form>Your name</form></article>
    <section class="comments"><p>{LONG}</p></section><aside>{LONG}</aside><footer>&copy; us</footer></body></html>"""
    assert br.extract(page) == f"Title & more\n{LONG} © x\nShort."


def test_pages_without_an_article_use_density_and_neighbours():
    page = f"<div id=main><p>{LONG}</p><p>Short one.</p></div><div class='sidebar'><p>x</p></div><div><a href=a>one</a> <a href=b>two</a></div><div class=notice>{LONG}</div>"
    assert br.extract(page) == f"{LONG}\nShort one."


def test_only_short_blocks_of_an_article_are_kept_whole():
    assert br.extract("<nav>menu</nav><article><h1>A</h1><p>B</p></article><footer>c</footer>") == "A\nB"


def test_article_text_next_to_boilerplate_is_kept():
    names = "Anna Bell, Carl Dorn, Emil Falk, Gerd Horn, Ines Jung, Karl Lang, Mona Nord 1912 1934"
    for other in ("<aside>ad</aside>", "<nav>Contents</nav>", "<form>Your name</form>", "<p class=ad>x</p>"):
        assert br.extract(f"<article><h1>Title</h1>{other}<p>{LONG}</p>{other}<p>{names}</p>{other}<p>End.</p></article>") == f"Title\n{LONG}\n{names}\nEnd."
    assert br.extract(f"<article><p>{LONG}</p><ul><li><a href=a>one more page</a></ul><p>{names}</p></article>") == f"{LONG}\n{names}"
    assert br.extract(f"<div><h2>Title</h2><nav>x</nav><p>{LONG}</p></div>") == f"Title\n{LONG}"
    assert br.extract(f"<header>Site</header><div>Skip it</div><div><p>{LONG}</p></div>") == LONG


def test_attributes_are_read_by_whole_names():
    for attributes in ('class="post" style="overflow:hidden"', 'title="the hidden coast"', 'data-id="share-12"', "data-x='class=ad'", 'data-hidden aria-hidden="false"', "alt=hidden", 'title = "id=nav"', "data-role=banner"):
        assert br.extract(f"<article {attributes}><p>{LONG}</p></article>") == LONG, attributes
    for attributes in ("hidden", "HIDDEN=''", 'style="a" hidden', "title='x'class='ad'", "ID = sidebar", 'role="navigation"', "data-a/class=ad"):
        assert br.extract(f"<article><p>{LONG}</p><div {attributes}><p>{LONG} x</p></div></article>") == LONG, attributes


def test_languages_without_stop_words():
    for text in ("Talo seisoo joen rannalla " * 8, "Дом стоит на берегу реки " * 8, "房子在河邊" * 15):
        assert br.extract(f"<nav>menu</nav><div><p>{text}</p><p>{LONG}</p></div>" if text[0] != "T" else f"<nav>menu</nav><div><p>{text}</p></div>").startswith(text.strip())
    assert br.extract(f"<div><p>{LONG}</p></div><div><p>{'cheap shoes sale ' * 10}</p></div>") == LONG
    assert br.extract(f"<div>{'12 345 ' * 20}</div>") == ""


def test_defined_cases():
    assert br.extract(None) == br.extract("") == br.extract("   ") == br.extract("<nav>a</nav>") == ""
    assert br.extract("<article><p>cut &amp here &am</p><p>more</p><foot") == "cut & here &am\nmore"
    many = "<article>" + "".join(f"<p>{LONG} {k}</p>" for k in range(3000)) + "</article>"
    assert br.extract(many).count("\n") == 2999
    assert br.extract("<div>" * 20000 + "x") == ""
    assert br.extract("<article><p>1 < 2 and a<b</p></article>") in ("1 < 2 and a", "1 < 2 and a<b")


def test_operator_rows(table):
    page = f"<article><p>{LONG}</p></article>"
    rows = [(1, "u", page, "t", 5), (1, "u", page, "t", 5), (None, None, None, None, None), (2, "v", "", "t", 1)]
    pages = table(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, br.extract_pages(pages).collect()), key=str)
    assert got == sorted([(1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert br.extract_pages(pages.limit(0)).count() == 0


def test_query_gives_each_article(spark, tiny):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    got = queries.queries()["op6_block_rules"](spark, tiny).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.sub(r"<[^>]*$", "", pages[r.page_id].partition("<article>")[2].partition("</article>")[0])
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)[^>]*>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def two_passes(first, blocks):
    """The second pass by its definition: every decided block is looked at for every undecided one."""
    out = []
    for k, (_, _, _, container, inside) in enumerate(blocks):
        decided = [d for d in range(len(first)) if first[d] is not None and (not inside or blocks[d][4] == inside)]
        clean = [d for d in decided if not blocks[d][2]]
        near = [d for d in clean if blocks[d][3] == container] or (clean if inside else decided)
        if first[k] is not None:
            out.append(first[k])
        elif inside and not any(first[d] for d in decided):
            out.append(True)
        elif not near:
            out.append(False)
        else:
            labels = {first[d] for d in near if abs(d - k) == min(abs(e - k) for e in near)}
            out.append(labels.pop() if len(labels) == 1 else inside > 0)
    return out


def test_second_pass_matches_its_definition():
    rng = random.Random(6)
    for _ in range(400):
        article, blocks, first = 0, [], []
        for k in range(rng.randrange(25)):
            if rng.random() < 0.2:
                article = rng.choice([0, k + 1])
            container = rng.randrange(3) + 10 * article
            bad = rng.random() < 0.2
            blocks.append((f"b{k}", 0, bad, container, article))
            first.append(False if bad else rng.choice([True, False, None, None]))
        assert br._second_pass(first, blocks) == two_passes(first, blocks)


def test_pages_match_both_passes_by_definition(monkeypatch):
    """Random pages of articles, sections and furniture: the text is that of the two passes as they are defined."""
    rng, real = random.Random(7), br._second_pass
    pieces = ["<p>" + LONG + "</p>", "<p>Short {0}.</p>", "<p>Anna Bell, Carl Dorn, Emil Falk, Gerd Horn, Ines Jung, Karl Lang {0}</p>", "<nav>menu {0}</nav>", "<p><a href=x>link {0}</a></p>", "<div>", "</div>", "<section>", "</section>", "<article>", "</article>", "<aside>x {0}</aside>", "</ul>"]
    for _ in range(200):
        page = "".join(rng.choice(pieces).format(k) for k in range(rng.randrange(30)))
        got = br.extract(page)
        monkeypatch.setattr(br, "_second_pass", two_passes)
        assert got == br.extract(page)
        monkeypatch.setattr(br, "_second_pass", real)


def test_pages_of_ten_megabytes_take_seconds():
    unclosed = "<article>" + "<div>" * 50_000 + f"<p>{LONG}</p></ul></p></section>" * 60_000
    for page in (f"<div><p>Short.</p><p>{LONG}</p></div>" * 70_000, "<article>" + "<p>Short one.</p>" * 600_000, "<div>" * 100_000 + "<p>x</p></div>" * 600_000, unclosed, "<p>x" * 2_000_000, "<a " * 3_000_000, "<!--" * 2_000_000):
        begun = time.perf_counter()
        br.extract(page)
        assert time.perf_counter() - begun < 30


def test_marks_are_whole_names():
    for name in ("search-results-explained", "share-of-profits", "related-rights", "notice-and-takedown", "ad-hoc"):
        assert br.extract(f"<article><div class='{name}'><p>{LONG}</p></div></article>") == LONG, name
    for name in ("search-box", "shareButtons", "ad-slot-2", "site-footer", "post-comments", "cookie_banner", "sidebar", "comment-list", "widget widget-area"):
        assert br.extract(f"<article><p>{LONG}</p><div class='{name}'><p>{LONG} x</p></div></article>") == LONG, name
