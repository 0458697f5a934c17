"""XML sections with inherited headings and main blocks of pages against plain parsers."""

import random
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pytest

from rankwell.sources.page_blocks import BLOCKS, DROPPED, KEPT, main_block, main_blocks
from rankwell.sources.xml_context import sections


def document(rng, parts):
    """A title with chapters, subchapters, parts and sections, some levels left out, some sections nested or empty."""
    out, n = ["<?xml version='1.0'?>\n<ROOT><DIV1 N='8'><HEAD>Title 8</HEAD>"], 0
    for c in range(3):
        out.append(f'<DIV3 N="{c}" TYPE="CHAPTER">\n<HEAD>CHAPTER {c}—<I>About</I> it</HEAD>')
        for s in range(rng.randrange(3)):
            sub = rng.random() < 0.7
            out.append(f'<DIV4 N="{s}"><HEAD>SUBCHAPTER {s}</HEAD>' if sub else "")
            for _ in range(rng.randrange(parts)):
                n += 1
                part = rng.random() < 0.8
                out.append(f'<DIV5 N="{n}"><HEAD>Part {n}b – name</HEAD>' if part else "")
                for k in range(rng.randrange(4)):
                    nested = f'<DIV9 N="A"><HEAD>Appendix</HEAD><P>nested {n}.{k}</P></DIV9>' if rng.random() < 0.3 else ""
                    body = "" if rng.random() < 0.1 else f"<P>Text {n}.{k} &amp; <E>more</E></P>\n<P/><P>“quoted” §&#160;2</P>"
                    out.append(f'<DIV8 N="§ {n}.{k}" TYPE="SECTION"><HEAD>{f"§ {n}.{k} Heading {k}." if rng.random() < 0.9 else ""}</HEAD>{body}{nested}</DIV8>\n')
                out.append("</DIV5>" if part else "")
            out.append("</DIV4>" if sub else "")
        out.append("</DIV3>")
    return "".join(out) + "</DIV1></ROOT>"


def by_hand(text):
    """The sections by a recursive walk."""
    clean = lambda e: " ".join("".join(e.itertext()).replace(" ", " ").replace("“", '"').replace("”", '"').replace("–", "-").replace("—", "--").split())
    out = []

    def walk(e, chapter, sub, part):
        head = e.find("HEAD")
        name = clean(head) if head is not None else ""
        if e.tag == "DIV3":
            chapter, sub, part = name, None, None
        elif e.tag == "DIV4":
            sub, part = name, None
        elif e.tag == "DIV5":
            part = name.split()[1].upper()
        elif e.tag == "DIV8":
            paragraphs = [p for p in map(clean, e.iter("P")) if p]
            title = name.split(" ", 2)[2] if name.startswith("§") else name
            if title or paragraphs:
                out.append((chapter, sub, part, e.get("N")[2:], title, "\n\n".join(paragraphs)))
            return
        for child in e:
            walk(child, chapter, sub, part)

    walk(ET.fromstring(text), None, None, None)
    return out


def read(spark, path):
    return sorted((tuple(r[c] for c in ("chapter", "subchapter", "part", "section", "title", "text")) for r in sections(spark, path).collect()), key=repr)


@pytest.mark.parametrize("most", ["128m", "700", "97"])
def test_sections_do_not_depend_on_splits(spark, tmp_path, most):
    rng, want = random.Random(4), []
    for i in range(3):
        text = document(rng, 5)
        (tmp_path / f"t{i}.xml").write_text(text)
        want += by_hand(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        assert read(spark, str(tmp_path)) == sorted(want, key=repr)
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{key}")


def test_files_without_sections(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<ROOT>nothing</ROOT>")
    (tmp_path / "b.xml").write_text("")
    assert read(spark, str(tmp_path)) == []


# --- pages


class Plain(HTMLParser):
    """Well-formed markup as nested lists [tag, attributes, children]."""

    def __init__(self, text):
        super().__init__()
        self.root = ["root", {}, []]
        self.open = [self.root]
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.open[-1][2].append([tag, dict(attrs), []])
        self.open.append(self.open[-1][2][-1])

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][2].append(data)


def block_by_hand(text, least):
    """Recursive scores of all blocks in document order; inline elements belong to the block around them."""
    noise = lambda e: any(w.startswith(("nav", "menu", "promo")) or w == "ad" for w in (e[1].get("class") or "").replace("-", " ").split())
    found = []

    def walk(e, quiet=False):
        own, linked, kids, words = 0, 0, [], []
        entry = [e[0], 0.0, 0, 0, "", noise(e) or quiet]
        found.append(entry)

        def inside(parts, link):
            nonlocal own, linked
            for p in parts:
                if isinstance(p, str):
                    own += len(p.strip())
                    linked += len(p.strip()) if link else 0
                    words.append(p)
                elif p[0] in DROPPED:
                    continue
                elif p[0] in BLOCKS:
                    kid = walk(p)
                    words.append(" ")
                    if not noise(p):
                        kids.append(kid)
                        words.append(kid[4])
                    words.append(" ")
                else:
                    inside(p[2], link or p[0] == "a")

        inside(e[2], False)
        entry[2] = own + sum(k[2] for k in kids)
        entry[3] = linked + sum(k[3] for k in kids)
        entry[1] = 0.0 if noise(e) else max(0, own - 2 * linked) + KEPT * sum(k[1] for k in kids)
        entry[4] = " ".join("".join(words).split())
        return entry

    walk(Plain(text).root)
    good = [f for f in found if not f[5] and f[2] >= least and f[0] != "root"]
    best = max(good, key=lambda f: f[1], default=found[0])
    return best[0], best[4], (best[2] - best[3]) / best[2] if best[2] else 0.0


def page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["text", "text", "p", "div", "section", "ul", "a", "b", "nav", "script", "noise"])
        inner = "" if depth > 3 else page(rng, depth + 1)
        words = " ".join(rng.choices(["alpha", "beta", "gamma &amp;", "delta"], k=rng.randrange(1, 9)))
        if kind in ("text", "script"):
            out.append(words if kind == "text" else f"<script>{words.replace('&amp;', '')}</script>")
        elif kind in ("a", "b", "p"):
            out.append(f"<{kind}>{words}</{kind}>")
        elif kind == "ul":
            out.append("<ul>" + "".join(f"<li>{w}</li>" for w in words.split()) + "</ul>")
        elif kind == "noise":
            out.append(f'<div class="main-{rng.choice(["nav", "menu", "ad"])}">{inner}</div>')
        else:
            out.append(f"<{kind}>{inner}</{kind}>")
    return " ".join(out)


def test_main_blocks_by_hand():
    rng = random.Random(12)
    for _ in range(1500):
        text = f"<html><body>{page(rng)}</body></html>"
        least = rng.choice([1, 40, 200])
        assert main_block(text, least) == block_by_hand(text, least), text


def test_main_block_of_a_page():
    story = "A long story about one thing and another. " * 9
    html = f"<!doctype html><html><head><title>t</title></head><body><nav>Home About</nav><div id=sidebar>{'<a href=x>link text here</a> ' * 40}</div><div class=wrap><article><h1>Head</h1><p>{story}<p>{story}<br>end</article></div><footer>{story}</footer></body></html>"
    tag, text, density = main_block(html)
    assert tag == "article" and text == f"Head {story * 2}end" and density == 1.0
    assert main_block(None) == ("root", "", 0.0) and main_block("") == ("root", "", 0.0)
    assert main_block("<p>a<div>b</p></b>c") == ("root", "a b c", 1.0)
    assert main_block("<div>" * 5000 + story + "</div>" * 5000)[1] == story.strip()


def test_main_blocks_of_a_table(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "<p>hi</p>", "y")], "page_id int, html string, tag string")
    assert {(r.page_id, r.main) for r in main_blocks(rows, "html", ["page_id"]).collect()} == {(1, ""), (2, "hi")}


# --- records of unlike shapes


def hierarchy(spark, json, shape):
    from rankwell.operators.shapes import hierarchies

    r = hierarchies(spark.createDataFrame([(1, json)], "i int, json string"), "json", shape).first().asDict(recursive=True)
    return r | {"children": [tuple(c.values()) for c in r["children"]]}


def test_shapes_of_odd_records(spark):
    from rankwell.operators.shapes import SHAPES, Shape

    law, rules, acts = SHAPES["annotated_law"], SHAPES["regulations"], SHAPES["statutes"]
    for odd in (None, "", "no json", "[]", "3", "{}", '{"clauses": "x", "title": null, "text": ""}', '{"clauses": []}'):
        assert hierarchy(spark, odd, law) == {"i": 1, "article": None, "section": None, "title": "", "children": []}
    assert hierarchy(spark, '{"clauses": ["bare", {"number": 7}, null, {"text": "t", "title": "T", "x": 1}], "article": 5}', law)["children"] == [(None, "", "bare"), ("7", "", ""), (None, "", ""), (None, "T", "t")]
    got = hierarchy(spark, '{"sections": [], "clauses": [{"number": 9}, {"number": 4, "text": "t"}], "article": "Title 8", "section": "§ 103.2(a)"}', rules)
    assert got["children"] == [("2", "", "t")] and got["title"] == "Title 8 Section 103.2" and got["section_number"] == "103.2"
    assert hierarchy(spark, '{"title": "§ 1.2 Scope."}', rules)["children"] == [("1", "Scope", "")]
    only = hierarchy(spark, '{"section": [{"number": 12, "text": "t"}], "title": " Act "}', acts)
    assert only["children"] == [("1", "Act", "t")] and only["section"] == "12"
    assert hierarchy(spark, '{"section": [{"title": "First"}, {"text": "t"}]}', acts)["title"] == "First"
    flat = hierarchy(spark, '{"clauses": [{"text": " a"}, {"title": "x"}, {"text": "b"}], "text": "c "}', Shape(flat=True, wrap=""))
    assert flat["text"] == "a b c"


def test_variants_are_parsed_once(spark):
    from rankwell.operators.shapes import SHAPES, hierarchies, stored_variants

    rows = spark.createDataFrame([(1, '{"title": "A", "text": "b", "article": "c"}'), (2, None)], "i int, json string")
    kept = stored_variants(rows, "json")
    for shape in SHAPES.values():
        assert hierarchies(kept, "json", shape).collect() == hierarchies(rows, "json", shape).collect()
